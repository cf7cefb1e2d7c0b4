"""Language of a text by rank-order profiles of its most frequent n-grams.

A profile lists the most frequent 1- to 3-grams of a language by rank. A text is compared with
each profile: the distance is the sum, over the text's own most frequent n-grams, of how many
places each stands away from its place in the profile, or the full length where it is missing.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from midmile.llm.common import bounded_batches, give_back, tidied

PROFILE = 400  # n-grams kept for a language and compared for a text
HELD_WORDS = 1_000_000  # distinct words that a learning task holds before it hands their n-grams on
_LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
_BITS = np.uint64(21)  # of a code point


def grams(text: str) -> np.ndarray:
    """Codes of the 1- to 3-grams of a lower-case text whose words stand between single blanks."""
    code = np.frombuffer(f" {text} ".encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    pairs = code[:-1] << _BITS | code[1:]
    triples = pairs[:-1] << _BITS | code[2:]
    inner = code[1:-1] != 32  # no n-gram reaches from one word into the next
    return np.concatenate([code[code != 32], pairs, triples[inner]])


def ranked(codes: np.ndarray, weights: np.ndarray | None = None, most: int = PROFILE) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` most frequent codes with their counts; ties by code."""
    if weights is None:
        found, n = np.unique(codes, return_counts=True)
    else:
        found, at = np.unique(codes, return_inverse=True)
        n = np.bincount(at, weights=weights, minlength=len(found)).astype(np.int64)
    first = np.lexsort((found, -n))[:most]
    return found[first], n[first]


def letters(text: str) -> str:
    """Lower-case runs of letters, one blank between them."""
    return " ".join(_LETTERS.findall(text.lower()))


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", most: int = PROFILE) -> DataFrame:
    """Rows (lang, rank, gram): the ``most`` most frequent n-grams of every language, from all rows.

    Rows without text or language teach nothing. Tasks add up words, then their n-grams,
    before the shuffle; the window sees one row per distinct n-gram and language, trimmed to
    ``most`` in each task first.
    """
    bounded_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = defaultdict(Counter)

        def out() -> Iterator[pa.RecordBatch]:
            for name, held in words.items():
                lists = list(held)
                for k in range(0, len(lists), 100_000):
                    part = [grams(w) for w in lists[k : k + 100_000]]
                    times = np.repeat([held[w] for w in lists[k : k + 100_000]], [len(g) for g in part])
                    codes, n = ranked(np.concatenate(part), times, most=2**62)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(codes)), pa.array(codes.astype(np.int64)), pa.array(n)], ["lang", "gram", "n"]
                    )
            words.clear()

        for batch in batches:
            for value, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words[name].update(letters(value.decode("utf-8", "replace")).split())
            if sum(map(len, words.values())) > HELD_WORDS:
                yield from out()
        yield from out()

    known = docs.select(F.col(text).cast("binary").alias("t"), F.col(lang).cast("string").alias("l")).na.drop()
    counts = known.mapInArrow(tidied(count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    return counts.withColumn("rank", place).where(F.col("rank") <= most).select("lang", "rank", "gram")


def predict(docs: DataFrame, profiles: DataFrame, text: str = "text", most: int = PROFILE, least_score: float = 0.0) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (0 to 1: one less the share of the largest distance).

    Null texts, texts without a letter, and texts that score below ``least_score`` get ``und``,
    as do all if nothing was learned; without letters the score is 0. Equal distances go to the
    first language by name. ``profiles`` has at most ``most`` rows per language and is sent to
    every task. Repeated rows and other columns stay; ``lang_pred`` and ``score`` are replaced.
    """
    bounded_batches(docs.sparkSession)
    by: dict[str, list[int]] = defaultdict(list)
    for row in profiles.orderBy("lang", "rank").collect():  # languages x most: a bounded table
        by[row["lang"]].append(row["gram"])
    names = sorted(by)
    tables = []
    for name in names:
        codes = np.array(by[name], dtype=np.uint64)
        order = np.argsort(codes)
        tables.append((codes[order], order))

    def score(value: bytes) -> tuple[str, float]:
        words = letters(value.decode("utf-8", "replace"))
        if not words or not names:
            return "und", 0.0
        mine, _ = ranked(grams(words), most=most)
        place, best = np.arange(len(mine)), ("und", -1.0)
        for name, (codes, ranks) in zip(names, tables, strict=True):
            at = np.minimum(np.searchsorted(codes, mine), len(codes) - 1)
            away = np.where(codes[at] == mine, np.abs(ranks[at] - place), most)
            near = 1.0 - float(away.sum()) / (most * len(mine))
            if near > best[1]:
                best = (name, near)
        return best if best[1] >= least_score else ("und", max(best[1], 0.0))

    @F.pandas_udf("lang string, score double")
    def to_language(column: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in column:
            yield pd.DataFrame([score(x) for x in batch], columns=["lang", "score"])
        give_back()

    found = to_language(F.coalesce(F.col(text).cast("binary"), F.lit(b"")))
    named = docs.drop("lang_pred", "score", "_language").withColumn("_language", found)
    return named.withColumns({"lang_pred": F.col("_language.lang"), "score": F.col("_language.score")}).drop("_language")
