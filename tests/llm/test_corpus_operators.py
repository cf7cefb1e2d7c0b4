"""Near duplicates, language-model scores and the pipeline."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from midmile.llm import byte_bpe, context_mix, decontaminate, near_dup
from midmile.llm.common import fold

# --- near duplicates


def slow_groups(rows, k, percent):
    """{id: (set size, least id reachable)}"""
    sets = []
    for id, text in rows:
        w = (text or "").encode().lower().split()
        sets.append((id, frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset()))
    root = {id: id for id, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if None not in (i, j) and x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return sorted(((id, len(s), find(id)) for id, s in sets), key=str)


@pytest.fixture(scope="module")
def copies():
    random.seed(9)
    words = [f"w{k}" for k in range(400)]
    make = lambda n: [random.choice(words) for _ in range(n)]
    rows = []
    for family in range(6):
        base = make(80)
        for _ in range(40):  # overlaps from nearly none to nearly all, near the threshold too
            other = list(base)
            for at in random.sample(range(80), random.randrange(0, 9)):
                other[at] = random.choice(words)
            rows.append((len(rows), " ".join(other)))
    line = make(60)
    rows += [(1000 + k, " ".join(line + make(30))) for k in range(80)]  # a common passage, not enough to link
    rows += [(2000 + k, rows[0][1].upper()) for k in range(50)]
    rows += [(3000, None), (3001, ""), (3002, " \t"), (3003, "one"), (3004, "ONE"), (3005, "two words"), (3006, "two  words\n"), (3006, "two  words\n")]
    rows += [(None, rows[0][1]), (3010, "long " * 200_000), (3011, "long " * 150_000)]
    return rows


@pytest.mark.parametrize(("k", "percent", "block"), [(3, 85, 512), (5, 80, 16)])
def test_groups_like_brute_force(spark, copies, k, percent, block):
    docs = spark.createDataFrame([(*r, 1) for r in copies], "doc_id long, text string, kept int").repartition(5)
    rule = near_dup.Rule(shingle=k, percent=percent)
    got = near_dup.near_duplicates(docs, rule, block=block).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == slow_groups(copies, k, percent)
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)


def test_no_documents(spark):
    assert near_dup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_pruning_follows_the_posterior():
    rule = near_dup.Rule(percent=85, bands=30, miss=1e-6)
    p0 = 0.85 + 0.15 / 256
    for n, least in rule.least_matches():
        # the posterior by numerical integration of the likelihood under a uniform prior
        p = np.linspace(0, 1, 400_001)
        tail = lambda m: (p**m * (1 - p) ** (n - m))[p >= p0].sum() / (p**m * (1 - p) ** (n - m)).sum()  # noqa: B023, E731
        assert tail(least) >= rule.miss * 0.9 and (least == 0 or tail(least - 1) < rule.miss * 1.1)
    assert (1 - 0.85**rule.rows) ** rule.bands < 1e-6  # two texts at the threshold that share no band


# --- language-model scores


def slow_model(texts):
    """Counts of all contexts by plain dictionaries, without hashing."""
    counts = defaultdict(lambda: [0, 0])
    for t in texts:
        raw = context_mix.PAD + t + context_mix.END
        for k in range(5, len(raw)):
            for o in range(context_mix.ORDERS):
                for bit in range(8):
                    counts[o, raw[k - o : k], 1 << bit | raw[k] >> (8 - bit)][raw[k] >> (7 - bit) & 1] += 1
    return counts


TEXTS = [b"the cat sat on the mat", b"the dog sat on the cat", b"", b"a mat and a cat", "é ü".encode()]


def test_counts_like_dictionaries(spark):
    want = slow_model(TEXTS)
    seen = context_mix.gather(spark.createDataFrame([(t,) for t in TEXTS], "text binary").repartition(2)).where("kind = 0").select("key", "n").cache()
    counts = context_mix._tables(seen)
    assert counts.sum() == sum(map(sum, want.values()))
    for (order, context, node), (n0, n1) in random.Random(1).sample(sorted(want.items()), 400):
        bit = node.bit_length() - 1
        byte = (node << (8 - bit)) & 255
        x = np.array([int.from_bytes((b"\0" * 5 + context)[-5:] + bytes([byte]), "big")])
        found = counts[context_mix.slots(context_mix.contexts(x)[order], context_mix.first_bits(x, bit), order)[0]]
        assert (found >= [n0, n1]).all()  # a slot may be shared
        logits, _ = context_mix.inputs(x, context_mix.contexts(x), bit, counts)  # the window's own occurrence is left out
        own = [max(int(found[0]) - 1, 0), int(found[1])]
        if not context_mix.bit_of(x, bit)[0]:
            assert logits[0, order] == pytest.approx(math.log((own[1] + 0.4) / (own[0] + 0.4)), rel=1e-5)


def test_probabilities_of_a_byte_add_up_to_one():
    dice = np.random.default_rng(1)
    counts = dice.integers(0, 50, (int(context_mix.BASE[-1]), 2)).astype(np.uint16)
    model = context_mix.Model(counts, context_mix.Mixer().weights, context_mix.plain_map())
    before = int.from_bytes(b"abcde", "big") << 8
    assert np.exp2(model.log2_byte(np.arange(before, before + 256))).sum() == pytest.approx(1, abs=1e-9)


def test_pieces_do_not_change_windows():
    text = "wörds in a row ".encode() * 9
    whole = context_mix.windows(context_mix.pieces(text, 10**6))
    assert (context_mix.windows(context_mix.pieces(text, 7)) == whole).all() and len(whole) == len(text) + 1


@pytest.fixture(scope="module")
def scored(spark):
    random.seed(4)
    syllables = "the and ing ion ent ver sch ung eau oux".split()
    word = lambda: "".join(random.choice(syllables) for _ in range(random.choice([2, 3, 4, 5])))  # noqa: E731  an open vocabulary
    rows = [(k, " ".join(word() for _ in range(random.randrange(5, 120))) + random.choice([".", "\n", ""])) for k in range(300)]
    rows += [(400, None), (401, ""), (402, " \t\n"), (403, "The THE the" * 40_000), (404, "solo"), (404, "solo"), (None, "no id")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, score int").repartition(4)
    return rows, context_mix.score(docs, fold("doc_id", 5) == 1).collect()


def test_base_scores_like_brute_force(scored):
    rows, got = scored
    tokens = lambda t: (t or "").encode().lower().split() + [None]
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    counts = Counter(w for i, t in rows if not out(i) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = []
    for i, t in rows:
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t))
        want.append((str(i), out(i), len(tokens(t)), sum(w in counts for w in tokens(t)), n, round(base, 4)))
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == sorted(want)


def test_model_beats_pairs_of_bytes_on_held_out_texts(scored):
    rows, got = scored
    held = {r.doc_id: r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 300}
    learned = {r.doc_id for r in got if not r.held_out}
    pairs, firsts = Counter(), Counter()
    for i, t in rows:
        if i in learned:
            raw = b"\xfe" + (t or "").encode() + b"\xff"
            pairs.update(zip(raw, raw[1:], strict=False))
            firsts.update(raw[:-1])
    by_pair = 0.0
    for i, t in rows:
        if i in held:
            raw = b"\xfe" + t.encode() + b"\xff"
            by_pair += sum(math.log10((pairs[a, b] + 0.01) / (firsts[a] + 2.56)) for a, b in zip(raw, raw[1:], strict=False))
    assert len(held) > 30 and sum(r.score for r in held.values()) > 0.8 * by_pair
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    sizes = {i: len((t or "").encode()) for i, t in rows}
    assert all(r.bits_per_byte * (sizes[r.doc_id] + 1) * math.log10(2) == pytest.approx(-r.score) for r in got)


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "ab"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in context_mix.score(docs, F.lit(True)).collect()}
    assert got[1].score == pytest.approx(24 * math.log10(0.5)) and got[2].score == pytest.approx(8 * math.log10(0.5))
    assert got[1].train_tokens == 0 and got[1].n_known == 0
    assert context_mix.score(docs.limit(0), F.lit(False)).count() == 0


def test_many_distinct_windows_like_text_by_text(spark, monkeypatch):
    monkeypatch.setattr(context_mix, "SHARD", 50_000)
    dice = np.random.default_rng(5)
    texts = [bytes(dice.integers(97, 123, 30_000).astype(np.uint8)).decode() for _ in range(4)]
    docs = spark.createDataFrame([(k, texts[k % 4]) for k in range(8)], "doc_id long, text string").coalesce(1)
    models, dealt, made = [], [], context_mix._mapped
    monkeypatch.setattr(context_mix, "_mapped", lambda *a: dealt.append(a[0].toPandas()) or models.append((context_mix._unpacked(a[1]), a[2], made(*a))) or models[0][2])
    got = context_mix.score(docs, F.lit(False)).collect()
    short, weights, table = models[0]
    shards = {k: context_mix.Model(context_mix._shard_counts(rows, short)[2], weights, table) for k, rows in dealt[0].groupby("shard")}
    assert len(shards) == 3  # 120,000 windows
    for r in got:
        x = context_mix.windows(context_mix.pieces(texts[r.doc_id % 4].encode(), 10**6))
        of = context_mix._shard_of(x, 3)
        assert r.score == pytest.approx(sum(shards[k].log2_byte(x[of == k]).sum() for k in range(3)) * math.log10(2), rel=1e-6)


def test_requests_and_answers_travel_packed(spark, monkeypatch):
    dice = random.Random(8)
    docs = spark.createDataFrame([(k, " ".join(dice.choice(["ab", "cde", "fghi"]) + str(dice.randrange(400)) for _ in range(900))) for k in range(12)], "doc_id long, text string")
    made, sent = context_mix._answered, []
    monkeypatch.setattr(context_mix, "_answered", lambda parts, *a: sent.append((parts.where("n is null").toPandas(), made(parts, *a).toPandas())) or made(parts, *a))
    assert len(context_mix.score(docs, F.col("doc_id") % 4 == 1).collect()) == 12
    (asks, answers), = sent
    n = sum(len(b) for b in answers["bits"]) // 8
    assert n > 5_000 and all(len(b) == 8 * len(context_mix._unsqueezed(x)) for x, b in zip(answers["x"], answers["bits"], strict=True))
    assert sorted(asks["x"]) == sorted(answers["x"]) and sum(map(len, asks["x"])) < 6 * n  # 8 bytes a window before
    x = np.array([5, 9, 2**47, 2**48 - 1], np.int64)
    assert (context_mix._unsqueezed(context_mix._squeezed(x)) == x).all() and len(context_mix._unsqueezed(context_mix._squeezed(x[:0]))) == 0


def test_shards_follow_the_corpus(spark, monkeypatch):
    """A context that was never seen stays unseen however much text there is: tables are not fuller than the shard's windows make them."""
    monkeypatch.setattr(context_mix, "SHARD", 20_000)
    dealt, made = [], context_mix._learned
    monkeypatch.setattr(context_mix, "_learned", lambda *a: dealt.append(a[0].toPandas()) or made(*a))
    dice = np.random.default_rng(6)
    docs = spark.createDataFrame([(k, bytes(dice.integers(97, 123, 20_000).astype(np.uint8)).decode()) for k in range(20)], "doc_id long, text string")
    assert context_mix.score(docs, F.lit(False)).count() == 20
    short = np.zeros((int(context_mix.BASE[context_mix.SHORT]), 2), np.uint16)
    found = {k: context_mix._shard_counts(rows, short) for k, rows in dealt[0].groupby("shard")}
    assert len(found) == 20
    for x, n, counts in found.values():
        assert counts[int(context_mix.BASE[context_mix.SHORT]) :].sum() == 3 * 8 * n.sum()
        assert (counts[int(context_mix.BASE[-2]) :].any(axis=1)).mean() < 0.1


# --- the pipeline


def test_pipeline_like_brute_force(spark, tmp_path):
    random.seed(8)
    words = {"en": "the and with that from this have were".split(), "de": "und der nicht eine werden über schön".split()}
    make = lambda lang, n: " ".join(random.choice(words[lang]) + random.choice("abcdefgh") for _ in range(n))
    tests = [(k, make("en", 30)) for k in range(5)]
    rows = [(k, make("en" if k % 2 else "de", 60), "en" if k % 2 else "de", "s", 1) for k in range(60)]
    rows += [(100 + k, rows[k][1] + " more", "en", "s", 1) for k in range(10)]  # near copies
    rows += [(200 + k, make("en", 20) + " " + tests[k][1] + " " + make("en", 20), "en", "s", 1) for k in range(5)]
    rows += [(210, make("en", 2000) + " " + tests[0][1], "en", "s", 1)]  # too little of it to count
    rows += [(300, None, "en", "s", 1), (301, "", None, None, None), (302, "12 !", "de", "s", 1), (None, make("de", 40), "de", "s", 1), (None, tests[1][1], "en", "s", 1)]
    rows += [rows[3], rows[3]]
    spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, kept int").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(tests, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    left = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    least = {i: g for i, _, g in slow_groups([(r[0], r[1]) for r in left], 5, 80)}
    left = [r for r in dict.fromkeys(left) if r[0] is None or least[r[0]] == r[0]]
    test_words = {k: decontaminate.words_of(t.encode()) for k, t in tests}
    windows = {tuple(t[k : k + 13]) for t in test_words.values() for k in range(len(t) - 12)}

    def contaminated(text):
        w = decontaminate.words_of(text.encode())
        hit = {p for k in range(len(w) - 12) if tuple(w[k : k + 13]) in windows for p in range(k, k + 13)}
        return bool(hit) and 20 * len(hit) >= len(w)

    left = [r for r in left if not contaminated(r[1])]
    code = byte_bpe.encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    assert isinstance(code, tiktoken.Encoding)
    assert sorted((str(r.doc_id), r["ids"], r.n_tokens, r.round_trip) for r in got) == sorted(
        (str(r[0]), code.encode_ordinary(r[1]), len(code.encode_ordinary(r[1])), True) for r in left
    )


def test_pipeline_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_keep_the_columns_of_documents(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, step in corpus_pipeline.STAGES[:-1]:
        assert step(spark, docs.limit(20), folder).columns == docs.columns, name
