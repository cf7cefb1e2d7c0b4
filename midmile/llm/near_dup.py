"""Near-duplicate texts: MinHash bands, sequential Bayesian pruning, exact verification.

Texts with equal shingle sets are one class. Classes that share a band meet in buckets, where their
signatures are compared a batch of hashes at a time: a pair goes as soon as the posterior
probability that its similarity reaches the threshold falls below the miss probability. What is
left joins classes into families. Inside a family, full shingle sets are compared and links are
confirmed, skipping pairs that confirmed links already connect. Large buckets and families
are cut into blocks and every two blocks meet in a task of bounded size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from midmile.llm.common import bounded_batches, components, tidied
from midmile.runtime import stage

BLOCK = 512  # rows of a block
BATCH = 25  # hashes compared before the next decision
_HELD_WORDS = 1_000_000
_PIECE = 4096


@dataclass(frozen=True)
class Rule:
    """Link texts whose sets of ``shingle``-word shingles have 100 x intersection >= ``percent`` x union.

    Two texts at the threshold share no band with probability (1 - s^rows)^bands; ``miss`` is
    the posterior probability below which a candidate is pruned.
    """

    shingle: int = 5
    percent: int = 80
    bands: int = 40
    rows: int = 5
    miss: float = 1e-6

    def least_matches(self) -> list[tuple[int, int]]:
        """(hashes seen, least matches to stay) after each batch.

        A signature byte matches with p = s + (1 - s) / 256. With a uniform prior on p, the posterior
        probability of p >= p0 after m of n matches is that of at most m successes in n + 1 draws.
        """
        p0 = self.percent / 100 + (1 - self.percent / 100) / 256
        steps = []
        for n in [*range(BATCH, self.bands * self.rows, BATCH), self.bands * self.rows]:
            total, m = 0.0, -1
            while total < self.miss:
                m += 1
                total += comb(n + 1, m) * p0**m * (1 - p0) ** (n + 1 - m)
            steps.append((n, m))
        return steps


class _Words(dict):
    """Hash of every word, kept while there are not too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _HELD_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def shingles(text: bytes | None, k: int, words: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of ``k`` words; a shorter text is one shingle, a wordless one none."""
    tokens = (text or b"").lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    if len(tokens) < k:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(tokens), seed=1)], np.uint64)
    h = np.fromiter(map(words.__getitem__, tokens), np.uint64, len(tokens))
    mixed = np.zeros(len(h) - k + 1, np.uint64)
    for j in range(k):
        mixed = (mixed ^ h[j : len(h) - k + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def minhash(sets: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    best = np.full(len(a), 2**32 - 1, np.uint64)
    for k in range(0, len(sets), _PIECE):
        x = a[:, None] * sets[None, k : k + _PIECE]
        x += b[:, None]
        np.minimum(best, x.min(axis=1) >> np.uint64(32), out=best)
    return best.astype(np.uint32)


SIGNED = "doc_id long, n long, s1 long, s2 long, bands array<long>, sig binary"


def _sign(rule: Rule) -> Callable:
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dice = np.random.default_rng(11)
        count = rule.bands * rule.rows
        a = dice.integers(1, 2**63, count, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
        b = dice.integers(0, 2**63, count, dtype=np.uint64)
        words = _Words()
        for batch in batches:
            n, s1, s2, bands, sigs = [], [], [], [], []
            for text in batch.column(1):
                x = shingles(text.as_py(), rule.shingle, words)
                whole = xxhash.xxh3_128_digest(x.tobytes())
                n.append(len(x))
                s1.append(int.from_bytes(whole[:8], "little", signed=True))
                s2.append(int.from_bytes(whole[8:], "little", signed=True))
                sig = minhash(x, a, b)
                rows = sig.reshape(rule.bands, rule.rows)
                bands.append(np.array([xxhash.xxh3_64_intdigest(r.tobytes(), seed=k) for k, r in enumerate(rows)], np.uint64).view(np.int64))
                sigs.append((sig & 255).astype(np.uint8).tobytes())
            values = pa.array(np.concatenate(bands) if bands else np.empty(0, np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * rule.bands), values)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), lists, pa.array(sigs, pa.binary())],
                ["doc_id", "n", "s1", "s2", "bands", "sig"],
            )

    return tidied(sign)


# --- blocks


def _paired(df: DataFrame, group: str, size: str, block: int) -> DataFrame:
    """``df`` with (i, j, side): copies of every row so that any two rows of a group meet in one pair of blocks."""
    blocks = F.greatest(F.lit(1), F.ceil(F.col(size) / block)).cast("int")
    own = F.pmod(F.xxhash64("class_id", F.lit(3)), blocks).cast("int")
    rows = df.withColumn("side", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.withColumns({"i": F.least("side", "other"), "j": F.greatest("side", "other")}).drop("other", size)
    return rows.repartition(group, "i", "j").sortWithinPartitions(group, "i", "j", "class_id")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole groups (equal in the first three columns) of sorted rows, many at a time, with their numbers."""
    held: list[pa.RecordBatch] = []

    def numbered(table: pa.Table) -> tuple[pa.Table, np.ndarray]:
        keys = [table.column(k).to_numpy() for k in range(3)]
        new = np.zeros(table.num_rows, bool)
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
        return table, np.cumsum(new)

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            table, number = numbered(pa.Table.from_batches(held))
            last = int(np.searchsorted(number, number[-1]))
            if last:
                yield table.slice(0, last), number[:last]
                held = table.slice(last).combine_chunks().to_batches()
    if held:
        yield numbered(pa.Table.from_batches(held))


def _near(sigs: np.ndarray, number: np.ndarray, side: np.ndarray, alone: np.ndarray, fits: np.ndarray | None, rule: Rule) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of a group that no batch of hashes rules out; of two blocks only pairs across."""
    steps = rule.least_matches()
    at, away = np.arange(len(number)), 1
    while len(at):
        at = at[at + away < len(number)]
        at = at[number[at] == number[at + away]]
        a, b = at, at + away
        keep = alone[a] | (side[a] != side[b])
        if fits is not None:
            small, large = np.minimum(fits[a], fits[b]), np.maximum(fits[a], fits[b])
            keep &= 100 * small >= rule.percent * large
        a, b = a[keep], b[keep]
        matched, seen = np.zeros(len(a), np.int64), 0
        for n, least in steps:
            matched = matched + (sigs[a, seen:n] == sigs[b, seen:n]).sum(axis=1)
            stay = matched >= least
            a, b, matched, seen = a[stay], b[stay], matched[stay], n
        if len(a):
            yield a, b
        away += 1


class _Union(dict):
    """Disjoint sets of ids."""

    def find(self, x: int) -> int:
        root = x
        while (up := self.get(root, root)) != root:
            root = up
        while (up := self.get(x, x)) != root:
            self[x] = root
            x = up
        return root

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self[max(a, b)] = min(a, b)
        return True


def _linker(rule: Rule, exact: bool) -> Callable:
    """Links of the pairs that stay, only as many as connect what they connect; with sets, only confirmed ones."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, number in _groups(batches):
            column = lambda name: table.column(name).to_numpy()  # noqa: B023, E731
            sigs = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(len(number), -1)
            ids, sets = column("class_id"), None
            if exact:
                sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
            fits = np.array([len(x) for x in sets]) if sets else None
            one, a_out, b_out = _Union(), [], []
            for a, b in _near(sigs, number, column("side"), column("i") == column("j"), fits, rule):
                for k, m in zip(a.tolist(), b.tolist(), strict=True):
                    x, y = int(ids[k]), int(ids[m])
                    if x != y and one.find(x) != one.find(y):
                        if sets:
                            common = len(np.intersect1d(sets[k], sets[m], assume_unique=True))
                            if 100 * common < rule.percent * (len(sets[k]) + len(sets[m]) - common):
                                continue
                        one.join(x, y)
                        a_out.append(x)
                        b_out.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], ["a", "b"])

    return tidied(link)


def _sets(rule: Rule) -> Callable:
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in batches:
            found = [shingles(x.as_py(), rule.shingle, words).tobytes() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["class_id", "shingles"])

    return tidied(sets)


def near_duplicates(docs: DataFrame, rule: Rule = Rule(), id: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """Rows (id, n_shingles, component_id, kept): for every document the least id that links reach.

    Words are lower-cased (A-Z) runs without ASCII white space. Texts without words, null texts and null
    ids link with nothing and are kept. Equal rows come out as often as they go in; rows that
    share an id share its links. Ties cannot occur, as a component is named by its least id. An
    empty table gives an empty result. Other columns are not read.
    """
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    signed = stage(texts.mapInArrow(_sign(rule), SIGNED), "signatures")
    usable = signed.where("n > 0 and doc_id is not null")
    classes = usable.groupBy("s1", "s2").agg(F.min("doc_id").alias("class_id"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    classes = stage(classes, "classes")
    banded = classes.select("class_id", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.count("*").alias("size")).where("size > 1")
    met = banded.join(shared, "band").join(classes.select("class_id", "sig"), "class_id")
    paired = _paired(met.select("band", "class_id", "sig", "size"), "band", "size", block).select("band", "i", "j", "side", "class_id", "sig")
    near = stage(paired.mapInArrow(_linker(rule, False), "a long, b long").distinct(), "near")
    families = components(near, "a", "b")
    sizes = families.groupBy("component").agg(F.count("*").alias("size"))
    families = families.join(sizes, "component").select(F.col("node").alias("class_id"), F.col("component").alias("family"), "size")
    families = stage(families, "families")
    own = texts.join(families.select(F.col("class_id").alias("doc_id")), "doc_id", "left_semi")
    sets = own.mapInArrow(_sets(rule), "class_id long, shingles binary")
    held = families.join(sets, "class_id").join(classes.select("class_id", "sig"), "class_id")
    paired = _paired(held.select("family", "class_id", "sig", "shingles", "size"), "family", "size", block)
    paired = paired.select("family", "i", "j", "side", "class_id", "sig", "shingles")
    links = stage(paired.mapInArrow(_linker(rule, True), "a long, b long").distinct(), "links")
    roots = components(links, "a", "b").withColumnRenamed("node", "class_id")
    found = classes.select("s1", "s2", "class_id").join(roots, "class_id", "left")
    found = found.select("s1", "s2", F.coalesce("component", "class_id").alias("component"), F.lit(True).alias("ok"))
    rows = signed.select("doc_id", "n", "s1", "s2", F.expr("n > 0 and doc_id is not null").alias("ok"))
    component = F.coalesce("component", "doc_id")
    return rows.join(found, ["s1", "s2", "ok"], "left").select(
        F.col("doc_id").alias(id),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"),
    )
