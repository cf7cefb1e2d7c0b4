"""Operators on texts: pages, languages, benchmark passages, token ids."""

import hashlib
import random

import public_tokenizers
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from midmile.llm import byte_bpe, decontaminate, html_text, language_id

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


# --- pages

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var x = "</p><p>no";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies for everything you can think of, please agree to all of them now.</p></div>
<main><article><header><h1>Title &amp; more</h1></header><p>First   paragraph with
several words &lt;here&gt; and <b>bold</b><br>text, long enough to count as the body of an article.</p>
<div class="ad">Buy now, cheap, cheap, cheap, with a long text that tries to look like an article's own.</div>
<h2>Part</h2><p>Second paragraph, also of some length, so that its density stands out well.<ul><li>One item<li>Other item</ul>
<form><p>Your name please</p><input name=a></form></article></main>
<aside class="sidebar"><p>Other stories that are not part of this one and should not be in the text at all.</p></aside>
<section class="comments"><article class="comment"><p>Reader: I do not agree with any of this, and here is why at length.</p></article></section>
<footer>&copy; nobody</footer></body></html>"""


def test_article_without_what_surrounds_it():
    assert html_text.main_text(PAGE).split("\n\n") == [
        "Title & more",
        "First paragraph with several words <here> and bold text, long enough to count as the body of an article.",
        "Part",
        "Second paragraph, also of some length, so that its density stands out well.",
        "One item",
        "Other item",
    ]


def test_pages_without_article_tags_use_density():
    words = "plain words in a row that make up the story and say a lot about it. " * 4
    menu = "".join(f'<li><a href="/{k}">Link {k}</a></li>' for k in range(30))
    page = f"<body><div><ul>{menu}</ul></div><div><div><p>{words}</p><p>{words}</p><p>{words}</p></div></div></body>"
    assert html_text.main_text(page) == "\n\n".join([words.strip()] * 3)


@pytest.mark.parametrize("start, end", [
    ('<div class="layout has-sidebar"><div class="post">', "</div></div>"), ('<div id="no-comments">', "</div>"), ('<div class="skip-target"><div class="form-page">', "</div></div>"),
    ('<article title="The hidden valley">', "</article>"), ('<div class="overflow hidden lg">', "</div>"), ("<div data-x=' class=\"menu\"'>", "</div>"), ('<div class="header-fixed">', "</div>"),
])
def test_text_in_wrappers_with_names_of_noise(start, end):
    words = "Many words in a row make a paragraph that is dense enough to be the text. "
    side = '<div class="sidebar"><p>Short words at the side.</p></div><div hidden><p>Not shown.</p></div><p aria-hidden="true">Nor this.</p>'
    want = "\n\n".join([words.strip()] * 3)
    assert html_text.main_text(f"<body>{start}{f'<p>{words}</p>' * 3}{side}{end}</body>") == want


def test_named_parts_of_little_text_or_many_links_go():
    words = "Many words in a row make a paragraph that is dense enough to be the text. "
    page = f'<body><div>{f"<p>{words}</p>" * 3}</div><div class="menu">{"<p><a href=x>A link of many words to another page</a></p>" * 20}</div><div class="comments"><p>{words}</p></div></body>'
    assert html_text.main_text(page) == "\n\n".join([words.strip()] * 3)


@pytest.mark.parametrize("page", ["", " ", "<", "<p", "</p>", "<p><b>", "<!--", "<script>x", "<a href='>", "&#xZZ; &", "\0", "<div>" * 3000])
def test_broken_pages_give_some_text(page):
    html_text.main_text(page)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div>", "</div>", "<li>", "<td>", "<a href='x'>", "</a>", "<!-- c", "-->", "word ", "&amp;", "<br/>", "<script>", "</script>"]), max_size=40))
def test_any_tags_keep_blocks_clean(parts):
    for block in html_text.main_text("".join(parts)).split("\n\n"):
        assert block == block.strip() and "  " not in block


def test_extract_rows(spark):
    rows = [(1, None, 5), (2, "", 6), (3, "<p>Some text</p>", 7), (3, "<p>Some text</p>", 7), (4, "<p>" + "long " * 300_000 + "</p>", 8)]
    pages = spark.createDataFrame(rows, "page_id long, html string, text int")
    got = sorted((r.page_id, r.text) for r in html_text.extract(pages).collect())
    assert got[:4] == [(1, ""), (2, ""), (3, "Some text"), (3, "Some text")]
    assert len(got[4][1]) == len("long " * 300_000) - 1
    assert html_text.extract(pages.limit(0)).count() == 0


# --- languages


def slow_distance(text, profile, most):
    words = regex.findall(r"\p{L}[\p{L}\p{M}]*", text.lower())
    counts = {}
    for w in words:
        padded = f" {w} "
        for n in (1, 2, 3):
            for k in range(len(padded) - n + 1):
                g = padded[k : k + n]
                if g != " ":
                    counts[g] = counts.get(g, 0) + 1
    # n-grams are ordered by count, then as the operator codes them
    code = lambda g: sum(ord(c) << (21 * (len(g) - 1 - k)) for k, c in enumerate(g))
    # two neighbouring words share one blank: its bigrams and trigrams never reach across
    mine = sorted(counts, key=lambda g: (-counts[g], code(g)))[:most]
    place = {g: k for k, g in enumerate(profile)}
    return sum(abs(place[code(g)] - k) if code(g) in place else most for k, g in enumerate(mine)) / (most * len(mine))


def test_languages(spark):
    random.seed(3)
    make = lambda words, n: " ".join(random.choice(words) for _ in range(n))
    a, b = "the and thing other with that".split(), "über straße nicht schön daß für".split()
    rows = [(k, make(a if k % 2 else b, 40), "xx" if k % 2 else "yy", 0.5) for k in range(40)]
    rows += [(100, None, "xx", 0.0), (101, "", None, 0.0), (102, "12 34 !?", "yy", 0.0), (103, "the " * 100_000, None, 0.0), (103, "the " * 100_000, None, 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    profiles = language_id.learn(docs)
    got = {r.doc_id: r for r in language_id.predict(docs, profiles).collect()}
    assert all(got[k].lang_pred == ("xx" if k % 2 else "yy") for k in range(40))
    assert [got[k].lang_pred for k in (100, 101, 102, 103)] == ["und", "und", "und", "xx"]
    assert got[100].score == 0 and 0 < got[1].score <= 1
    by = {}
    for r in profiles.orderBy("lang", "rank").collect():
        by.setdefault(r.lang, []).append(r.gram)
    for k in (0, 1, 7):
        near = {name: 1 - slow_distance(rows[k][1], p, language_id.PROFILE) for name, p in by.items()}
        assert got[k].score == pytest.approx(max(near.values()), abs=1e-12)
    assert language_id.predict(docs, profiles).count() == len(rows)
    empty = docs.limit(0)
    assert language_id.learn(empty).count() == 0
    assert {r.lang_pred for r in language_id.predict(docs, language_id.learn(empty)).collect()} == {"und"}
    assert language_id.predict(empty, profiles).count() == 0


# --- benchmark passages


def slow_judge(text, tests, window=13):
    words = decontaminate.words_of(text and text.encode())
    hit, items = set(), set()
    for key, test in tests:
        t = decontaminate.words_of(test and test.encode())
        for k in range(max(1, len(t) - window + 1)) if t else ():
            w = t[k : k + window]
            for p in range(len(words) - len(w) + 1):
                if words[p : p + len(w)] == w:
                    hit.update(range(p, p + len(w)))
                    items.add(str(key))
    return len(words), len(hit), sorted(items), bool(hit) and 20 * len(hit) >= len(words)


@pytest.fixture(scope="module")
def passages():
    random.seed(5)
    vocabulary = [f"w{k}" for k in range(12)]
    text = lambda n: " ".join(random.choice(vocabulary) for _ in range(n))
    tests = [(k, text(random.choice([13, 14, 30, 40]))) for k in range(12)] + [(20, "Rare, short"), (21, None), (22, " !"), (20, "w1 w2 w3")]
    docs = [(k, text(random.choice([0, 5, 60, 300])), "x") for k in range(30)]
    docs += [(40 + k, f"{text(20)} {tests[k][1].upper()}, {text(10 * k)}", "x") for k in range(12)]
    docs += [(60, None, "x"), (61, "", "x"), (62, "RARE-short rare short", "x"), (62, "RARE-short rare short", "x"), (None, tests[0][1], "x")]
    docs += [(70, text(60_000) + " " + tests[3][1], "x")]
    return docs, tests


@pytest.mark.parametrize("block", [decontaminate.BLOCK_BYTES, 100])
def test_judge_like_brute_force(spark, passages, block, monkeypatch):
    docs, tests = passages
    monkeypatch.setattr(decontaminate.blocks, "__defaults__", (block,))
    frame = spark.createDataFrame(docs, "doc_id long, text string, n_hit string").repartition(3)
    index = decontaminate.build_index(frame, segment_bytes=3000).cache()
    found = decontaminate.judge(index, spark.createDataFrame(tests, "item_id long, text string"))
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, r["items"], r.contaminated) for r in found.collect())
    assert got == sorted((str(i), *slow_judge(t, tests)) for i, t, _ in docs)
    index.unpersist()


def test_phrase_and_proximity_places(spark):
    docs = spark.createDataFrame([(1, "a b x c a b c"), (2, "c b a"), (3, "a b")], "doc_id long, text string").coalesce(1)
    tests = spark.createDataFrame([("q", "a b c")], "item_id string, text string")
    index = decontaminate.build_index(docs)
    assert [(r.doc_id, r.place, r.length) for r in decontaminate.search(index, tests).collect()] == [(1, 4, 3)]
    near = {(r.doc_id, r.place) for r in decontaminate.search(index, tests, near=2).collect()}
    assert {d for d, _ in near} == {1, 2}  # the third text lacks a word, and no match reaches into the next text


def test_empty_tables(spark, passages):
    docs = spark.createDataFrame(passages[0], "doc_id long, text string, x string")
    none = spark.createDataFrame([], "item_id long, text string")
    index = decontaminate.build_index(docs)
    rows = decontaminate.judge(index, none).collect()
    assert len(rows) == len(passages[0]) and not any(r.n_hit or r.contaminated for r in rows)
    assert decontaminate.search(index, none).count() == 0
    assert decontaminate.judge(decontaminate.build_index(docs.limit(0)), none).count() == 0


# --- token ids


CODE, ONE = byte_bpe.encoding(RANKS, PATTERN), byte_bpe.encoding(RANKS, r"(?s).+")


def plain_ids(text):
    return [t for piece in regex.findall(PATTERN, text) for t in ONE.encode_ordinary(piece)]


TEXTS = ["", " ", "Hello, world's  end\n\n\n", "<|endoftext|>", "ünï¢ødé 漢字 🎉", "a" * 5000, " " * 5000 + "x", "x \t\n" * 2000, "don't 'tis 123abc456", "    z"]


@pytest.mark.parametrize("chunk", [10, 1000, byte_bpe.CHUNK])
def test_ids_of_cut_texts(chunk):
    coder = byte_bpe.Coder(RANKS, PATTERN, chunk)
    for text in TEXTS + ["".join(TEXTS) * 3]:
        ids = coder.ids(text).tolist()
        assert ids == plain_ids(text)
        assert CODE.decode_bytes(ids) == text.encode()


CODER = byte_bpe.Coder(RANKS, PATTERN, 7)


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ab1 \n\t'.,sé ", max_size=60))
def test_cuts_do_not_change_ids(text):
    assert CODER.ids(text + " " * 1200 + text * 30).tolist() == plain_ids(text + " " * 1200 + text * 30)


def test_encode_rows(spark):
    rows = [(1, None, 0), (2, "", 0), (3, "some words", 0), (3, "some words", 0), (4, "very long text " * 100_000, 0), (5, " " * 2_000_000 + "x", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    coded = byte_bpe.decode(byte_bpe.encode(docs, RANKS, PATTERN), RANKS, PATTERN)
    got = coded.collect()
    assert len(got) == 6 and all(bytes(r.decoded).decode() == (r.text or "") for r in got)
    assert got[0]["ids"] == [] and got[2]["ids"] == plain_ids("some words")
    assert hashlib.sha256(" ".join(map(str, got[4]["ids"])).encode()).hexdigest() == hashlib.sha256(" ".join(map(str, plain_ids(rows[4][1]))).encode()).hexdigest()
    assert byte_bpe.encode(docs.limit(0), RANKS, PATTERN).count() == 0
    raw = spark.createDataFrame([(b"\xff\xfe ok",)], "text binary")
    assert bytes(byte_bpe.decode(byte_bpe.encode(raw, RANKS, PATTERN), RANKS, PATTERN).first().decoded).decode() == "�� ok"
