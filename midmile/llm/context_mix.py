"""Language-model scores by logistic mixing of hashed-context bit predictors.

A text is a sequence of bytes, and a byte one of eight bits, highest first. For each of the last
0 to 5 bytes as context, a hashed table counts the zeros and ones that followed it after the same
first bits. The logits of these predictors are added up with weights that a gate selects, learned
online with each occurrence left out of its own counts. An adaptive map then corrects the mixed
probability by what really followed at that confidence. The sum over all bits is the text's
log-probability. As a bit depends on the last six bytes only, every distinct run of six bytes is
looked up once for some megabytes of text.

Contexts of 0 to 2 bytes are as many as the alphabet has; their tables travel. Longer ones grow with
the corpus: runs of six bytes are dealt to shards by the three bytes before the last, with as many
shards as the runs counted in training need. All counts of a longer context are in one shard, so its
tables are made, learned from and asked there.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from midmile.llm.common import bounded_batches, give_back
from midmile.runtime import stage

ORDERS = 6  # contexts of 0 to 5 bytes
BITS = (16, 17, 20, 22, 22, 22)  # of the slot number of each order's table: the size of one shard's model
SHORT = 3  # orders whose tables all shards share
BASE = np.concatenate([[0], np.cumsum([1 << b for b in BITS])])  # first slot of each order in one common numbering
WINDOW = 6
PAD, END = b"\xfe" * (WINDOW - 1), b"\xff"  # no byte of UTF-8 is either
PRIOR = 0.4
MOST_COUNT = 65_535
GATES = ORDERS * 5 * 8
BUCKETS = 33
LEAST_P = 1 / 65_536
_SEEN_OFTEN = np.array([1, 2, 3, 6, 21])


def pieces(text: bytes, most: int) -> list[tuple[bytes, bytes]]:
    """A text with its end in pieces of at most ``most`` bytes, each after the five bytes before it."""
    whole = text + END
    return [(whole[k - WINDOW + 1 : k] if k else PAD, whole[k : k + most]) for k in range(0, len(whole), most)]


def windows(parts: list[tuple[bytes, bytes]]) -> np.ndarray:
    """The last six bytes at every byte of the pieces."""
    raw = np.frombuffer(b"".join([x for part in parts for x in part]), np.uint8)
    sizes = np.array([len(data) for _, data in parts], np.int64)
    own = np.ones(len(raw), bool)
    starts = np.cumsum(sizes + WINDOW - 1) - sizes - (WINDOW - 1)
    own[(starts[:, None] + np.arange(WINDOW - 1)).ravel()] = False
    at = np.flatnonzero(own)
    x = np.zeros(len(at), np.int64)
    for j in range(WINDOW):
        x = x << 8 | raw[at - (WINDOW - 1 - j)]
    return x


_MIX = np.uint64(0x9E3779B97F4A7C15)


def contexts(x: np.ndarray) -> list[np.ndarray]:
    """For every order, the part of the slots' hash that the bytes before the last one make."""
    before = x.astype(np.uint64) >> np.uint64(8)
    return [(before & np.uint64((1 << 8 * o) - 1)) * (_MIX << np.uint64(8)) for o in range(ORDERS)]


def slots(context: np.ndarray, seen: np.ndarray, order: int) -> np.ndarray:
    """Slots of an order's table after the bits ``seen`` of the last byte."""
    h = context + seen.astype(np.uint64) * _MIX
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h >>= np.uint64(64 - BITS[order])
    return h.view(np.int64) + BASE[order]


def bit_of(x: np.ndarray, bit: int) -> np.ndarray:
    return (x >> (7 - bit) & 1).astype(np.int64)


def inputs(x: np.ndarray, before: list[np.ndarray], bit: int, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logits of all orders (rows by ``x``) without the window's own occurrence, and the gate of each row."""
    seen = first_bits(x, bit)
    n = np.stack([counts[slots(before[o], seen, o)] for o in range(ORDERS)], axis=1).astype(np.float32)
    one, at = bit_of(x, bit), np.arange(len(x))
    for o in range(ORDERS):
        n[at, o, one] = np.maximum(n[at, o, one] - 1, 0)
    return logits_of(n), _gate(levels_of(n.sum(axis=2)), bit)


def logits_of(n: np.ndarray) -> np.ndarray:
    return np.log((n[..., 1] + np.float32(PRIOR)) / (n[..., 0] + np.float32(PRIOR)))


def levels_of(total: np.ndarray) -> np.ndarray:
    """0 for a context never seen, else 1 to 5 by how often it was."""
    return np.searchsorted(_SEEN_OFTEN, total, side="right")


def _gate(levels: np.ndarray, bit: int) -> np.ndarray:
    """The gate: the longest context that was seen, how often, and which bit."""
    longest = np.where(levels > 0, np.arange(ORDERS), 0).max(axis=1)
    level = np.maximum(levels[np.arange(len(levels)), longest], 1) - 1
    return (longest * 5 + level) * 8 + bit


def squash(t: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(t, -30, 30)))


class Mixer:
    """Gated weights, learned online from weighted examples, a batch at a time."""

    def __init__(self, weights: np.ndarray | None = None, rate: float = 0.05):
        self.weights = np.full((GATES, ORDERS), 0.3) if weights is None else weights.copy()
        self.rate, self.seen = rate, np.zeros(GATES)
        self.square = np.full((GATES, ORDERS), 1e-3)

    def mix(self, logits: np.ndarray, gate: np.ndarray) -> np.ndarray:
        return np.einsum("ij,ij->i", logits, self.weights[gate])

    def learn(self, logits: np.ndarray, gate: np.ndarray, one: np.ndarray, weight: np.ndarray) -> None:
        error = (one - squash(self.mix(logits, gate))) * weight
        total = np.bincount(gate, weight, GATES)
        step = np.stack([np.bincount(gate, error * logits[:, o], GATES) for o in range(ORDERS)], axis=1)
        step /= np.maximum(total, 1)[:, None]
        self.square += step**2
        self.weights += self.rate * step / np.sqrt(self.square)
        self.seen += total


def place(t: np.ndarray) -> np.ndarray:
    """Where a logit lies between the points of the adaptive map."""
    return (np.clip(t, -8, 8) + 8) * ((BUCKETS - 1) / 16)


def refine(t: np.ndarray, seen: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Probability of a one: the mixed one, averaged with the map's for the byte's first bits and this confidence."""
    at = place(t)
    low = np.minimum(at.astype(np.int64), BUCKETS - 2)
    part = at - low
    mapped = table[seen, low] * (1 - part) + table[seen, low + 1] * part
    return np.clip((squash(t) + mapped) / 2, LEAST_P, 1 - LEAST_P)


def plain_map() -> np.ndarray:
    """The map before it has learned: every point is the probability of its logit."""
    return np.tile(squash(np.linspace(-8, 8, BUCKETS)), (256, 1))


def first_bits(x: np.ndarray, bit: int) -> np.ndarray:
    return 1 << bit | (x & 255) >> (8 - bit)


class Model:
    """What scoring needs: a logit and a level for every slot, the weights, and the map."""

    def __init__(self, counts: np.ndarray, weights: np.ndarray, table: np.ndarray):
        self.logits, self.levels = np.empty(len(counts), np.float16), np.empty(len(counts), np.uint8)
        for k in range(0, len(counts), CHUNK):
            part = counts[k : k + CHUNK].astype(np.float32)
            self.logits[k : k + CHUNK], self.levels[k : k + CHUNK] = logits_of(part), levels_of(part.sum(axis=1))
        self.weights, self.table = weights.astype(np.float32), table

    def log2_byte(self, x: np.ndarray) -> np.ndarray:
        """log2 of the probability of the last byte of every window."""
        total, before = np.zeros(len(x)), contexts(x)
        for bit in range(8):
            seen, t = first_bits(x, bit), np.zeros(len(x), np.float32)
            at = [slots(before[o], seen, o) for o in range(ORDERS)]
            levels = [self.levels[k] for k in at]
            longest, level = np.zeros(len(x), np.int64), levels[0]
            for o in range(1, ORDERS):  # a longer context that was seen takes over the gate
                known = levels[o] > 0
                longest[known], level = o, np.where(known, levels[o], level)
            gate = (longest * 5 + np.maximum(level, 1) - 1) * 8 + bit
            for o in range(ORDERS):
                t += self.logits[at[o]] * self.weights[gate, o]
            p = refine(t, seen, self.table)
            total += np.log2(np.where(bit_of(x, bit) == 1, p, 1 - p))
        return total


# --- Spark

PIECE_BYTES = 2 << 20  # text looked up at once
HELD = 2_000_000  # distinct windows or words that a task adds up
SHARD = 150_000  # distinct windows of the training texts in one shard, on average
SHARD_BYTES = 64 << 20  # text that one shard is asked for, on average
BUNDLE_BYTES = 8 << 20  # text that asks the shards together
STEP = 1024  # windows in one online step
LOOKED_UP = 16_384  # windows looked up in one go: fits the cache
HEAD = 400_000  # frequent words that travel with every task; the others are joined
CHUNK = 1 << 16  # slots in one row of the packed table
_END_WORD = b"\n"  # the end token: no word has white space


class _Words(dict):
    """Hash of every word, kept while there are not too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= HELD:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def _hashes(text: bytes, words: _Words) -> np.ndarray:
    """64-bit hashes of the tokens of a text: its words in lower case, and its end."""
    tokens = text.lower().split() + [_END_WORD]
    return np.fromiter(map(words.__getitem__, tokens), np.uint64, len(tokens)).view(np.int64)


def _sums(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    found, at = np.unique(np.concatenate(keys), return_inverse=True)
    return found, np.bincount(at, np.concatenate(counts), len(found)).astype(np.int64)


def _batches(batches: Iterable[pa.RecordBatch], column: int, most: int = PIECE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of batches of about ``most`` bytes of text; a longer text is a slice by itself."""
    for batch in batches:
        texts = [x.as_py() or b"" for x in batch.column(column)]
        start, size = 0, 0
        for k, text in enumerate(texts):
            if size and size + len(text) > most:
                yield batch.slice(start, k - start), texts[start:k]
                start, size = k, 0
            size += len(text)
        if start < len(texts):
            yield batch.slice(start), texts[start:]


def gather(docs: DataFrame) -> DataFrame:
    """Rows (kind, key, n): how often each window (kind 0) and each token (kind 1, hashed) occurs in all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        held: dict[int, tuple[list, list]] = {0: ([], []), 1: ([], [])}

        def add(kind: int, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
            found, n = np.unique(keys, return_counts=True)
            held[kind][0].append(found)
            held[kind][1].append(n)
            if sum(map(len, held[kind][0])) > HELD:
                found, n = _sums(*held[kind])
                held[kind] = ([found], [n])
                if len(found) > HELD // 2:
                    yield from out(kind)

        def out(kind: int) -> Iterator[pa.RecordBatch]:
            if held[kind][0]:
                found, n = _sums(*held[kind])
                held[kind] = ([], [])
                for k in range(0, len(found), 100_000):
                    part = found[k : k + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), kind, np.int32)), pa.array(part), pa.array(n[k : k + 100_000])], ["kind", "key", "n"])

        for _, texts in _batches(batches, 0):
            for run in _runs(texts):
                yield from add(0, windows([p for _, p in run]))
            yield from add(1, np.concatenate([_hashes(t, words) for t in texts]))
        for kind in held:
            yield from out(kind)

    return docs.mapInArrow(count, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _tables(seen: DataFrame, orders: int = ORDERS) -> np.ndarray:
    """Zeros and ones of every slot of the first ``orders`` tables, from the windows; large counts are scaled down to 16 bits."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = [], []

        def out() -> Iterator[pa.RecordBatch]:
            x, n = np.concatenate(keys), np.concatenate(counts)
            before = contexts(x)
            keys.clear()
            counts.clear()
            for o in range(orders):
                size = 1 << BITS[o]
                sums = np.zeros(2 * size)
                for bit in range(8):
                    sums += np.bincount((slots(before[o], first_bits(x, bit), o) - BASE[o]) * 2 + bit_of(x, bit), n, 2 * size)
                sums = sums.reshape(size, 2)
                used = np.flatnonzero(sums.any(axis=1))
                for k in range(0, len(used), 100_000):
                    at = used[k : k + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(at + BASE[o]), pa.array(sums[at, 0].astype(np.int64)), pa.array(sums[at, 1].astype(np.int64))], ["slot", "n0", "n1"])

        for batch in batches:
            keys.append(batch.column(0).to_numpy())
            counts.append(batch.column(1).to_numpy())
            if sum(map(len, keys)) > HELD:
                yield from out()
        if keys:
            yield from out()

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        dense = np.zeros((CHUNK, 2))
        dense[rows["slot"].to_numpy() % CHUNK] = rows[["n0", "n1"]].to_numpy()
        dense /= np.maximum(1, dense.max(axis=1) / MOST_COUNT)[:, None]
        return pd.DataFrame({"chunk": [int(rows["slot"].iloc[0]) // CHUNK], "data": [dense.round().astype("<u2").tobytes()]})

    sums = seen.mapInArrow(count, "slot long, n0 long, n1 long").groupBy("slot").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    packed = sums.groupBy(F.floor(F.col("slot") / CHUNK)).applyInPandas(pack, "chunk long, data binary")
    counts = np.zeros((-(-int(BASE[orders]) // CHUNK), CHUNK, 2), np.uint16)
    for row in packed.toLocalIterator():  # a table of fixed size: 5 MB for the short contexts
        counts[row["chunk"]] = np.frombuffer(row["data"], "<u2").reshape(CHUNK, 2)
    return counts.reshape(-1, 2)[: int(BASE[orders])]


def _sent(spark: SparkSession, counts: np.ndarray) -> Broadcast:
    """The table, packed: it has a fixed size, and most of it is empty where the corpus is small."""
    return spark.sparkContext.broadcast(zstandard.compress(counts.tobytes(), 1))


def _unpacked(packed: Broadcast) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(packed.value), np.uint16).reshape(-1, 2)


def _shard_of(x: np.ndarray, shards: int) -> np.ndarray:
    """The shard of every window: windows with equal three bytes before the last one are in one."""
    h = (x.astype(np.uint64) >> np.uint64(8) & np.uint64(0xFFFFFF)) * _MIX
    return ((h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)).astype(np.int64) % shards


def _squeezed(x: np.ndarray) -> bytes:
    """Windows in order, packed: neighbours differ little."""
    return zstandard.compress(np.diff(x, prepend=0).tobytes(), 1)


def _unsqueezed(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zstandard.decompress(data), np.int64))


PART = "shard long, bundle long, x binary, n binary"


def _parts(x: np.ndarray, n: np.ndarray | None, bundle: int | None, shards: int) -> pa.RecordBatch:
    """Windows as one row for each shard: with counts, from the training texts; without, asked for by a bundle."""
    of = _shard_of(x, shards)
    order = np.argsort(of, kind="stable")
    found, starts = np.unique(of[order], return_index=True)
    cut = lambda v, kept=np.ndarray.tobytes: [kept(p) for p in np.split(v[order], starts[1:])]
    return pa.RecordBatch.from_arrays(
        [pa.array(found), pa.array([bundle] * len(found), pa.int64()), pa.array(cut(x) if n is not None else cut(x, _squeezed), pa.binary()), pa.array(cut(n) if n is not None else [None] * len(found), pa.binary())],
        [c.split()[0] for c in PART.split(", ")],
    )


def _dealt(seen: DataFrame, shards: int) -> DataFrame:
    """The windows of the training texts by shard."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list] = ([], [])
        for batch in batches:
            held[0].append(batch.column(0).to_numpy())
            held[1].append(batch.column(1).to_numpy())
            if sum(map(len, held[0])) > HELD:
                yield _parts(np.concatenate(held[0]), np.concatenate(held[1]), None, shards)
                held = ([], [])
        if held[0]:
            yield _parts(np.concatenate(held[0]), np.concatenate(held[1]), None, shards)

    return seen.mapInArrow(deal, PART)


def _joined(column: Iterable[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.int64)


def _shard_counts(rows: pd.DataFrame, short: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A shard's windows of the training texts in an order without meaning, their counts, and its tables."""
    rows = rows[rows["n"].notna()]
    x, n = _joined(rows["x"]), _joined(rows["n"])
    order = np.argsort(x.astype(np.uint64) * _MIX)
    x, n = x[order], n[order]
    counts = np.zeros((int(BASE[-1]), 2), np.uint16)
    counts[: len(short)] = short
    before = contexts(x)
    for o in range(SHORT, ORDERS):
        at = np.concatenate([slots(before[o], first_bits(x, bit), o) * 2 + bit_of(x, bit) for bit in range(8)])
        used, of = np.unique(at, return_inverse=True)
        sums = np.bincount(of, np.tile(n, 8), len(used))
        slot, of = np.unique(used >> 1, return_inverse=True)
        both = np.zeros((len(slot), 2))
        both[of, used & 1] = sums
        counts[slot] = (both / np.maximum(1, both.max(axis=1) / MOST_COUNT)[:, None]).round()
    return x, n, counts


def _learned(dealt: DataFrame, packed: Broadcast) -> np.ndarray:
    """Mixing weights: each shard learns online from its windows; gates are averaged by what they saw."""

    def learn(rows: pd.DataFrame) -> pd.DataFrame:
        mixer = Mixer()
        x, n, counts = _shard_counts(rows, _unpacked(packed))
        for k in range(0, len(x), STEP):
            part = x[k : k + STEP]
            before = contexts(part)
            for bit in range(8):
                mixer.learn(*inputs(part, before, bit, counts), bit_of(part, bit), n[k : k + STEP].astype(np.float64))
        return pd.DataFrame({
            "gate": np.repeat(np.arange(GATES), ORDERS), "input": np.tile(np.arange(ORDERS), GATES),
            "w": (mixer.weights * mixer.seen[:, None]).ravel(), "seen": np.repeat(mixer.seen, ORDERS),
        })

    found = dealt.groupBy("shard").applyInPandas(learn, "gate long, input long, w double, seen double")
    sums = found.groupBy("gate", "input").agg(F.sum("w").alias("w"), F.sum("seen").alias("seen"))
    weights = Mixer().weights
    for row in sums.collect():  # one for each gate and input
        if row["seen"] > 0:
            weights[row["gate"], row["input"]] = row["w"] / row["seen"]
    return weights


def _mapped(dealt: DataFrame, packed: Broadcast, weights: np.ndarray) -> np.ndarray:
    """The adaptive map: share of ones at every confidence, after every run of first bits."""

    def follow(rows: pd.DataFrame) -> pd.DataFrame:
        mixer, sums = Mixer(weights), np.zeros((2, 256 * BUCKETS))
        all_x, all_n, counts = _shard_counts(rows, _unpacked(packed))
        for k in range(0, len(all_x), LOOKED_UP):
            x, n = all_x[k : k + LOOKED_UP], all_n[k : k + LOOKED_UP].astype(np.float64)
            before = contexts(x)
            for bit in range(8):
                at = place(mixer.mix(*inputs(x, before, bit, counts)))
                low = np.minimum(at.astype(np.int64), BUCKETS - 2)
                one, cell = bit_of(x, bit), first_bits(x, bit) * BUCKETS + low
                for shift, part in ((0, n * (low + 1 - at)), (1, n * (at - low))):
                    sums[0] += np.bincount(cell + shift, part, 256 * BUCKETS)
                    sums[1] += np.bincount(cell + shift, part * one, 256 * BUCKETS)
        used = np.flatnonzero(sums[0])
        return pd.DataFrame({"cell": used, "n": sums[0, used], "ones": sums[1, used]})

    found = dealt.groupBy("shard").applyInPandas(follow, "cell long, n double, ones double")
    table = plain_map().ravel()
    for row in found.groupBy("cell").agg(F.sum("n").alias("n"), F.sum("ones").alias("ones")).collect():  # 256 x 33 cells
        table[row["cell"]] = (row["ones"] + 2 * table[row["cell"]]) / (row["n"] + 2)
    return table.reshape(256, BUCKETS)


TEXTS = "uid long, doc_id long, held_out boolean, text binary, bundle long"


def _bundled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the number of their bundle: the uid of its first row. A longer text is a bundle by itself."""
    bundle, size = None, 0
    for batch in batches:
        bundles = []
        for uid, length in zip(batch.column(0).to_pylist(), pc.binary_length(batch.column(3)).to_pylist(), strict=True):
            if bundle is None or size + length > BUNDLE_BYTES:
                bundle, size = uid, 0
            size += length
            bundles.append(bundle)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bundles, pa.int64())], [c.split()[0] for c in TEXTS.split(", ")])


def _asked(texts: DataFrame, shards: int) -> DataFrame:
    """The distinct windows of every bundle by shard."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []
        for batch in batches:
            at = batch.column(1).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)]
            for start, stop in zip(edges, edges[1:]):
                if start == stop:
                    continue
                if held and at[start] != last:
                    yield _parts(np.unique(np.concatenate(held)), None, last, shards)
                    held = []
                last = int(at[start])
                held += [np.unique(windows([p for _, p in run])) for run in _runs([t.as_py() for t in batch.column(0)[start:stop]])]
        if held:
            yield _parts(np.unique(np.concatenate(held)), None, last, shards)

    return texts.select("text", "bundle").mapInArrow(ask, PART)


def _answered(parts: DataFrame, packed: Broadcast, weights: np.ndarray, table: np.ndarray) -> DataFrame:
    """Rows (bundle, x, bits): log2 of the probability of every window that a bundle asked a shard for.

    A window that many bundles ask for is looked up once. Requests and answers stay packed but for the one at hand.
    """

    def answer(rows: pd.DataFrame) -> pd.DataFrame:
        asks = rows[rows["n"].isna()]
        if not len(asks):
            return pd.DataFrame({"bundle": [], "x": [], "bits": []}).astype({"bundle": "int64"})
        x = np.unique(np.concatenate([_unsqueezed(a) for a in asks["x"]]))
        bits = _looked_up(Model(_shard_counts(rows, _unpacked(packed))[2], weights, table), x)
        found = [bits[np.searchsorted(x, _unsqueezed(a))].tobytes() for a in asks["x"]]
        give_back()
        return pd.DataFrame({"bundle": asks["bundle"].astype("int64"), "x": asks["x"], "bits": found})

    return parts.groupBy("shard").applyInPandas(answer, "bundle long, x binary, bits binary")


SCORED = "uid long, doc_id long, held_out boolean, n_tokens long, bytes long, bits double, head_known long, head_score double, rare array<long>, often array<long>"


def score(docs: DataFrame, held_out: Column, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) for all documents.

    Counts, weights and the map are learned from all rows that are not ``held_out``. ``score`` is the
    log10 of the model's probability of the text's bytes and its end, ``bits_per_byte`` the same per
    byte (the end counted as one). ``base_score`` is that of single tokens: words in lower case
    (A-Z) between ASCII white space, and one end. Null texts are empty. Rows are scored one
    by one: repeated rows, null ids and ties come out as they go in, a null ``held_out`` is false.
    With nothing to learn from, every bit has probability 1/2. Other columns are not read.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("text"))
    numbered = rows.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "held_out", "text")
    texts = stage(numbered.mapInArrow(_bundled, TEXTS), "texts")
    gathered = stage(gather(texts.where(~F.col("held_out")).select("text")), "gathered")
    seen, words = gathered.where("kind = 0").select("key", "n"), gathered.where("kind = 1").select("key", "n")
    packed = _sent(spark, _tables(seen, SHORT))
    n_bytes = texts.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    shards = max(1, -(-seen.count() // SHARD), -(-n_bytes // SHARD_BYTES))
    dealt = stage(_dealt(seen, shards), "dealt")
    weights = _learned(dealt, packed)
    table = _mapped(dealt, packed, weights)
    answers = _answered(dealt.union(_asked(texts, shards)), packed, weights, table)

    n_all, n_distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    least = _head_least(words)
    head = words.where(F.col("n") >= least).orderBy("key").toPandas()  # at most HEAD words
    frequent = spark.sparkContext.broadcast((head["key"].to_numpy(np.int64), np.log10(head["n"].to_numpy(np.float64) + 0.5)))

    def judge(bundle: pa.Table, answered: pa.Table) -> pa.Table:
        hashes, (keys, logs) = _Words(), frequent.value
        known = np.concatenate([_unsqueezed(v.as_py()) for v in answered["x"]])
        bits_of = np.concatenate([np.frombuffer(v.as_py(), np.float64) for v in answered["bits"]])
        known, first = np.unique(known, return_index=True)  # a bundle that two tasks read has asked twice
        bits_of, out = bits_of[first], []
        for batch, texts in _batches(bundle.to_batches(), 3):
            bits = np.zeros(len(texts))
            for run in _runs(texts):
                x = windows([p for _, p in run])
                at = np.searchsorted(known, x)
                assert (known[at] == x).all()
                ends = np.cumsum([len(p[1]) for _, p in run])
                sums = np.add.reduceat(bits_of[at], np.concatenate([[0], ends[:-1]]))
                np.add.at(bits, [k for k, _ in run], sums)
            tokens = [_hashes(t, hashes) for t in texts]
            n_known, total, rare, often = [], [], [], []
            for t in tokens:
                at = np.minimum(np.searchsorted(keys, t), max(len(keys) - 1, 0))
                there = keys[at] == t if len(keys) else np.zeros(len(t), bool)
                n_known.append(int(there.sum()))
                total.append(float(logs[at[there]].sum()))
                found, n = np.unique(t[~there], return_counts=True)
                rare.append(found)
                often.append(n)
            out.append(pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), batch.column(2), pa.array([len(t) for t in tokens], pa.int64()),
                    pa.array([len(t) for t in texts], pa.int64()), pa.array(bits), pa.array(n_known, pa.int64()), pa.array(total, pa.float64()),
                    pa.array(rare, pa.list_(pa.int64())), pa.array(often, pa.list_(pa.int64())),
                ],
                [x.split()[0] for x in SCORED.split(", ")],
            ))
        give_back()
        return pa.Table.from_batches(out)

    scored = stage(texts.groupBy("bundle").cogroup(answers.groupBy("bundle")).applyInArrow(judge, SCORED), "scored")
    asked = scored.select("uid", F.explode(F.arrays_zip("rare", "often")).alias("w")).select("uid", F.col("w.rare").alias("key"), F.col("w.often").alias("often"))
    found = asked.join(words.where(F.col("n") < least), "key", "left").groupBy("uid").agg(
        F.sum(F.col("often") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("rare_score"), F.sum(F.when(F.col("n").isNotNull(), F.col("often"))).alias("rare_known")
    )
    per_token = math.log10(n_all + 0.5 * (n_distinct + 1))
    return scored.drop("rare", "often").join(found, "uid", "left").select(
        F.col("doc_id").alias(id),
        "held_out",
        "n_tokens",
        (F.col("head_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("head_score") + F.coalesce("rare_score", F.lit(0.0)) - F.col("n_tokens") * per_token).alias("base_score"),
        (F.col("bits") * math.log10(2)).alias("score"),
        (-F.col("bits") / (F.col("bytes") + 1)).alias("bits_per_byte"),
    )


def _head_least(words: DataFrame) -> int:
    """The least count such that no more than HEAD words have it or more."""
    level = F.floor(F.log2("n") * 8)
    rows = words.groupBy(level.alias("level")).agg(F.count("*").alias("words"), F.max("n").alias("most")).orderBy(F.desc("level")).collect()
    total, least = 0, 1
    for row in rows:  # at most 8 levels for each doubling
        total += row["words"]
        if total > HEAD:
            return row["most"] + 1
    return least


def _runs(texts: list[bytes]) -> Iterator[list[tuple[int, tuple[bytes, bytes]]]]:
    """Pieces of texts with the text's number, some megabytes of them at a time."""
    run, size = [], 0
    for k, text in enumerate(texts):
        for part in pieces(text, PIECE_BYTES):
            if run and size + len(part[1]) > PIECE_BYTES:
                yield run
                run, size = [], 0
            run.append((k, part))
            size += len(part[1])
    if run:
        yield run


def _looked_up(model: Model, x: np.ndarray) -> np.ndarray:
    found = np.concatenate([model.log2_byte(x[k : k + LOOKED_UP]) for k in range(0, len(x), LOOKED_UP)])
    assert len(found) == len(x)
    return found
