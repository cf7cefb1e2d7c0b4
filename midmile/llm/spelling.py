"""Spelling variants: words one inserted, deleted or replaced letter apart, through an index of variable-length grams.

The gram dictionary starts with the short grams; a gram that stands in more than a threshold of places
gives way to its extensions. At every place a word has the shortest gram that the dictionary does not
extend, so a gram is told by its own letters alone and one edit affects only the grams that
cover it. If an edit affects at most ``a`` of a word's grams, one of the first ``a + 1`` in one order of
all grams, rarest first, also stands among those of any near word, at its place or the next.
Lists of these are merged and pairs verified. Words of which an edit can affect all grams
are also listed under themselves and every form with a letter less.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from midmile.operators.ranking import balanced_join
from midmile.runtime import stage

RUN = "[A-Za-zÀ-ÿ]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_OPEN, _CLOSE = "\x02", "\x03"
_EXACT_COUNTS = 1 << 16  # counts beyond are told apart by powers of two when the threshold is chosen


@dataclass(frozen=True)
class Grams:
    """Grams of ``least`` to ``most`` letters. One in more than ``places`` places is extended; if more
    than ``entries`` grams would be, the threshold rises, so the dictionary that travels is bounded."""

    least: int = 4
    most: int = 8
    places: int = 32
    entries: int = 1 << 18


def damaged(run: Column, key: Column) -> Column:
    """A run without one code point, where the crc32 of key, colon and run is a multiple of 97."""
    h = F.crc32(F.concat(key, F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % 97 == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def vocabulary(docs: DataFrame, id: str = "doc_id", text: str = "text", letters: int = 5, times: int = 3) -> DataFrame:
    """``word, n``: words of at least ``letters`` code points that occur ``times`` times or more.

    Words are runs of Latin letters with A-Z lowered, after `damaged`. A null text has none; a null id counts as the
    empty text; repeated rows count each time. Other columns are not read.
    """
    key = F.coalesce(F.col(id).cast("string"), F.lit(""))
    runs = docs.select(key.alias("key"), F.explode(F.regexp_extract_all(F.col(text), F.lit(RUN), F.lit(0))).alias("run"))
    run = F.col("run")
    low = F.when(run == F.lower(run), run).otherwise(F.translate(run, UPPER, UPPER.lower()))
    words = runs.select("key", low.alias("run")).select(damaged(F.col("run"), F.col("key")).alias("word"))
    counted = words.where(F.length("word") >= letters).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= times)


# --- grams


def _layout(words: list[str], most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all words between marks, where each word begins, its letters, and the places its grams start at."""
    sizes = np.array([len(w) for w in words], np.int64)
    code = np.frombuffer("".join(_OPEN + w + _CLOSE * (most - 1) for w in words).encode("utf-32-le", "surrogatepass"), np.uint32)
    begin = np.concatenate([[0], np.cumsum(sizes + most)[:-1]]) if len(words) else np.empty(0, np.int64)
    count = sizes + 1
    owner = np.repeat(np.arange(len(words)), count)
    places = begin[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    return code, begin, sizes, places


def _hashes(code: np.ndarray, places: np.ndarray, most: int) -> Iterator[tuple[int, np.ndarray]]:
    """(length, hash of the gram of that length at every place)."""
    h = np.full(len(places), 0x9E3779B97F4A7C15, np.uint64)
    for k in range(most):
        h = (h ^ code[places + k].astype(np.uint64)) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
        yield k + 1, h


def _counted(grams: Grams) -> Callable:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, _, _, places = _layout(batch.column(0).to_pylist(), grams.most)
            for size, h in _hashes(code, places, grams.most):
                if grams.least <= size < grams.most:
                    found, n = np.unique(h, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n, pa.int64())], ["gram", "n"])

    return count


def dictionary(words: DataFrame, grams: Grams = Grams()) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the grams that are extended, in order, and the number of places of each; at most ``grams.entries``."""
    counts = words.select("word").mapInArrow(_counted(grams), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    often = stage(counts.where(F.col("n") > grams.places), "grams")
    exact = F.col("n") < _EXACT_COUNTS
    level = F.when(exact, F.col("n")).otherwise(F.pow(F.lit(2.0), F.floor(F.log2(F.col("n").cast("double")))).cast("long"))
    held, least = 0, grams.places
    for size, n in often.groupBy(level.alias("level")).agg(F.count("*")).orderBy(F.desc("level")).collect():
        held += n
        if held > grams.entries:
            least = size if size < _EXACT_COUNTS else 2 * size - 1
            break
    kept = often.where(F.col("n") > least).toArrow()
    gram, n = kept.column("gram").to_numpy().view(np.uint64), kept.column("n").to_numpy()
    order = np.argsort(gram)
    return gram[order], n[order]


def decompose(words: list[str], extended: tuple[np.ndarray, np.ndarray], grams: Grams) -> tuple[np.ndarray, ...]:
    """(word, place, gram, weight) of every gram, a word's rarest first, and for every word the most grams that an edit affects.

    The weight is the number of places of the longest part that the dictionary extends.
    """
    code, begin, sizes, places = _layout(words, grams.most)
    owner = np.repeat(np.arange(len(words)), sizes + 1)
    known, n = extended
    length = np.full(len(places), grams.least, np.int64)
    weight = np.zeros(len(places), np.int64)
    gram, open_ = np.zeros(len(places), np.uint64), np.ones(len(places), bool)
    for size, h in _hashes(code, places, grams.most):
        if size < grams.least:
            continue
        gram[open_] = h[open_] + np.uint64(size)
        if size < grams.most:
            at = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
            open_ &= (known[at] == h) if len(known) else False
            length[open_] = size + 1
            if len(known):
                weight[open_] = n[at[open_]]
    cover = np.zeros(len(code) + 1, np.int64)
    np.add.at(cover, places, 1)
    np.add.at(cover, places + length, -1)
    cover = np.cumsum(cover)
    inside = np.stack([begin + 1, begin + sizes + 1], axis=1).ravel()
    affected = np.maximum.reduceat(cover, inside)[::2] if len(words) else np.empty(0, np.int64)
    place = places - begin[owner]
    order = np.lexsort((place, gram, weight, owner))
    return owner[order], place[order], gram[order], weight[order], affected


SAME, LONGER = 0, 1  # a listed word meets others as one of the same length or as the longer one
SHORTER = 2


def _mixed(gram: np.ndarray, size: np.ndarray, place: np.ndarray) -> np.ndarray:
    h = (gram ^ (size * 1024 + place).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    return (h ^ h >> np.uint64(29)).view(np.int64)


def _listed(extended: tuple[np.ndarray, np.ndarray], grams: Grams) -> Callable:
    """Rows (key, kind, word, n): lists hold the words of a length with a gram at a place.

    Of two near words of one length, a gram that the edit does not affect stands at the same place; in a word
    that is longer by a letter, at the same place or the next. The first of these grams in the order of all stands
    among the first ``affected + 1`` of both words, as those before it are affected.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).to_pylist()
            if not words:
                continue
            owner, place, gram, _, affected = decompose(words, extended, grams)
            count = np.bincount(owner, minlength=len(words))
            nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
            keep = nth <= affected[owner]
            owner, place, gram = owner[keep], place[keep], gram[keep]
            size = np.array([len(w) for w in words])[owner]
            own = _mixed(gram, size, place)
            keys = [own, own, _mixed(gram, size - 1, place), _mixed(gram, size - 1, place - 1)]
            kinds = np.repeat([SHORTER, SAME, LONGER, LONGER], len(owner))
            owners = np.tile(owner, 4)
            more: list[tuple[int, int, int]] = []
            for k in np.nonzero(count <= affected)[0].tolist():
                word = words[k]
                digest = lambda x, seed: xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass"), seed=seed) - 2**63
                more.append((digest(word, 5), SHORTER, k))
                for less in {word[:j] + word[j + 1 :] for j in range(len(word))}:
                    more += [(digest(less, 6), SHORTER, k), (digest(less, 6), SAME, k), (digest(less, 5), LONGER, k)]
            key = np.concatenate([*keys, np.array([m[0] for m in more], np.int64)])
            kind = np.concatenate([kinds, np.array([m[1] for m in more], np.int64)])
            at = pa.array(np.concatenate([owners, np.array([m[2] for m in more], np.int64)]))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(kind.astype(np.int8)), batch.column(0).take(at), batch.column(1).take(at)], ["key", "kind", "word", "n"])

    return rows


def near_pairs(words: DataFrame, grams: Grams = Grams()) -> DataFrame:
    """``a, a_n, b, b_n``: every two of the distinct ``words(word, n)`` that one edit sets apart, once.

    Long lists are split over tasks by `balanced_join`.
    """
    extended = dictionary(words, grams)
    listed = stage(words.select("word", "n").mapInArrow(_listed(extended, grams), "key long, kind byte, word string, n long"), "gram-lists")
    short = listed.where(F.col("kind") == SHORTER).select("key", F.col("word").alias("a"), F.col("n").alias("a_n"))
    other = listed.where(F.col("kind") != SHORTER).select("key", "kind", F.col("word").alias("b"), F.col("n").alias("b_n"))
    met = balanced_join(short, other, "key").where((F.col("kind") == LONGER) | (F.col("a") < F.col("b")))
    met = met.where(F.levenshtein("a", "b", 1) == 1)
    return met.select("a", "a_n", "b", "b_n").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for ``forms(word, form)``, whose chains end: the last word that forms lead to, found by doubling steps."""
    found = stage(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = found.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        found = stage(found.join(onward, "root", "left").select("word", F.coalesce("onward", "root").alias("root"), F.col("onward").isNotNull().alias("moved")), "roots")
        if found.where("moved").isEmpty():
            return found.select("word", "root")
        found = found.drop("moved")


def variants(words: DataFrame, grams: Grams = Grams(), times: int = 2) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` for distinct ``words(word, n)``.

    A word's form is its near word of largest n, of equal ones the first in code-point order, if that n is at least
    ``times`` times the word's; else null. As n grows along forms, they end at the root, which is the word
    itself without a form. An empty table gives an empty result.
    """
    words = stage(words.select("word", "n"), "words")
    pairs = stage(near_pairs(words, grams), "near-words")
    both = pairs.select(F.col("a").alias("word"), F.col("a_n").alias("n"), F.col("b").alias("near"), F.col("b_n").alias("near_n"))
    both = both.unionByName(pairs.select(F.col("b").alias("word"), F.col("b_n").alias("n"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    figures = both.groupBy("word", "n").agg(F.count("*").alias("n_near"), best)
    fits = -F.col("best.less") >= times * F.col("n")
    figures = figures.select("word", "n_near", F.when(fits, F.col("best.near")).alias("form"), F.when(fits, -F.col("best.less")).alias("form_n"))
    figures = stage(figures, "forms")
    ends = roots(figures.where("form is not null"))
    joined = words.join(figures, "word", "left").join(ends, "word", "left")
    return joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))
