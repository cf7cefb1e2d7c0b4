"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from midmile.llm import spelling


def slow_vocabulary(rows):
    counts = Counter()
    for id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if id is None else id}:{low}".encode())
            if h % 97 == 0:
                low = low[: h % len(low)] + low[h % len(low) + 1 :]
            counts[low] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    return a[k + 1 :] == b[k + 1 :] or a[k:] == b[k + 1 :] or a[k + 1 :] == b[k:]


def slow_variants(words):
    out = {}
    for w, n in words.items():
        found = sorted((-m, v) for v, m in words.items() if near(w, v))
        fits = found and -found[0][0] >= 2 * n
        out[w] = (n, len(found), found[0][1] if fits else None, -found[0][0] if fits else None)
    for w in words:
        root = w
        while out[root][2]:
            root = out[root][2]
        out[w] += (root,)
    return out


def result(rows):
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in rows}


@pytest.fixture(scope="module")
def words():
    dice = random.Random(4)
    parts = ["the", "tion", "er", "an", "in", "sch", "é", "o", "a", "nd", "aa", "ll"]
    base = {"".join(dice.choice(parts) for _ in range(dice.randrange(2, 6))) for _ in range(700)}
    for w in list(base)[:350]:
        k = dice.randrange(len(w))
        base |= {w[:k] + w[k + 1 :], w[:k] + "x" + w[k:], w[:k] + "ÿ" + w[k + 1 :]}
    base |= {"a" * k for k in range(5, 40)} | {"ab" * k for k in range(3, 9)} | {"b" + "ab" * k for k in range(3, 9)}
    return {w: 3 + dice.randrange(60) for w in base if len(w) >= 5}


@pytest.mark.parametrize("grams", [spelling.Grams(), spelling.Grams(2, 6, 4), spelling.Grams(2, 9, 1), spelling.Grams(4, 8, 2, entries=5), spelling.Grams(3, 3)])
def test_like_brute_force(spark, words, grams):
    table = spark.createDataFrame(list(words.items()), "word string, n long").withColumn("token", F.lit(1)).repartition(3)
    assert result(spelling.variants(table, grams).collect()) == slow_variants(words)


def test_words_of_documents(spark):
    dice = random.Random(7)
    some = ["Thing", "THINGS", "Ététion", "ététion", "word×word", "straße", "don't", "x" * 9, "thinng", "abcd", "abcde"]
    rows = [(k, " ".join(dice.choice(some) for _ in range(300)) + dice.choice([".", "", "\n7"])) for k in range(40)]
    rows += [(None, "thing thing"), (3, None), (4, ""), (5, "1234 中文"), (6, "y" * 300_000 + " " + "thing " * 50_000), rows[0], rows[0]]
    docs = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, word string").repartition(4)
    got = {r.word: r.n for r in spelling.vocabulary(docs).collect()}
    assert got == slow_vocabulary(rows) and len(got) > 8


def test_no_words(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variants(spelling.vocabulary(empty)).count() == 0


def test_an_edit_affects_only_grams_that_cover_it(words):
    """Near words share at least as many grams as either's bound says."""
    some = sorted(words)[:600]
    grams = spelling.Grams(2, 6, 4)
    code, _, _, places = spelling._layout(some, grams.most)
    all_ = np.concatenate([h for size, h in spelling._hashes(code, places, grams.most) if grams.least <= size < grams.most])
    known, n = np.unique(all_, return_counts=True)
    owner, _, token, _, affected = spelling.decompose(some, (known[n > grams.places], n[n > grams.places]), grams)
    tokens = [Counter(token[owner == k].tolist()) for k in range(len(some))]
    checked = 0
    for i, a in enumerate(some):
        for j in range(i):
            if near(a, some[j]):
                shared = (tokens[i] & tokens[j]).total()
                assert shared >= max(tokens[i].total() - affected[i], tokens[j].total() - affected[j])
                checked += 1
    assert checked > 50


def test_the_query(spark, tmp_path):
    from midmile.llm.queries import QUERIES

    dice = random.Random(3)
    make = lambda: "".join(dice.choice(["tion", "er", "the", "and"]) for _ in range(3))
    pool = [make() for _ in range(60)]
    rows = [(k, " ".join(dice.choice(pool) for _ in range(400)), "en") for k in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op11_spelling"](spark, str(tmp_path))
    assert set(got.columns) >= {"word", "form", "root", "n", "n_near", "form_n"}
    assert result(got.collect()) == slow_variants(slow_vocabulary([r[:2] for r in rows]))
