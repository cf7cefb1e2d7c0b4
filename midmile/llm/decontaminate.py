"""Benchmark passages in training texts, found in a positional inverted index.

The index lies in segments, one row for a few megabytes of documents: the words of the
segment in order, and for every word the sorted places where it stands. Test passages are
looked up in every segment: of each passage, the words with the fewest places come first,
their place lists are shifted by the word's offset and intersected, and what is left is
an exact occurrence. A segment never needs another one, so neither index nor lists are shuffled.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from midmile.llm.common import bounded_batches, tidied

WINDOW = 13
SEGMENT_BYTES = 4 << 20  # text in a segment; one longer document is a segment by itself
BLOCK_BYTES = 32 << 20  # test text sent to the tasks at once
SHARE = 20  # contaminated: at least one word in so many is hit

# A-Z become a-z; 0-9, a-z and all bytes from 0x80 on belong to words, others separate them.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

INDEX = "segment string, ids binary, starts binary, words binary, ends binary, places binary"


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FOLD).split()


def _segment(ids: list[int | None], texts: list[list[bytes]]) -> list[bytes]:
    """One index row: ids of the documents, where each starts, and the places of every word."""
    codes: dict[bytes, int] = {}
    flat = np.fromiter((codes.setdefault(w, len(codes)) for t in texts for w in t), dtype=np.int32, count=sum(map(len, texts)))
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    # one empty place after each document, so that no passage reaches into the next
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])
    at = np.arange(len(flat), dtype=np.int64) + np.repeat(np.arange(len(texts)), sizes)
    order = np.argsort(flat, kind="stable")
    ends = np.cumsum(np.bincount(flat, minlength=len(codes)))
    known = np.array([(0 if x is None else x, x is not None) for x in ids], dtype=np.int64).reshape(-1, 2)
    return [known.tobytes(), starts.astype(np.int64).tobytes(), b" ".join(codes), ends.astype(np.int64).tobytes(), at[order].astype(np.int32).tobytes()]


def build_index(docs: DataFrame, id: str = "doc_id", text: str = "text", segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Index rows over whole texts, made where the documents lie.

    Null and empty texts are documents without words. Every row of ``docs`` is a document of
    its own, whatever its id: repeated and null ids stay apart. An empty table has no rows.
    """
    bounded_batches(docs.sparkSession)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0

        def out() -> pa.RecordBatch:
            row = _segment(ids, texts)
            columns = [pa.array([uuid.uuid4().hex])] + [pa.array([x], pa.binary()) for x in row]
            return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in INDEX.split(", ")])

        for batch in batches:
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                value = value.as_py() or b""
                if ids and size + len(value) > segment_bytes:
                    yield out()
                    ids, texts, size = [], [], 0
                ids.append(key)
                texts.append(words_of(value))
                size += len(value)
        if ids:
            yield out()

    return docs.select(F.col(id).cast("long"), F.col(text).cast("binary")).mapInArrow(tidied(index), INDEX)


class Segment:
    """One index row, ready to be searched."""

    def __init__(self, segment: str, ids: bytes, starts: bytes, words: bytes, ends: bytes, places: bytes):
        self.name = segment
        self.known = np.frombuffer(ids, np.int64).reshape(-1, 2)
        self.starts = np.frombuffer(starts, np.int64)
        self.code = {w: k for k, w in enumerate(words.split(b" "))} if words else {}
        self.ends = np.frombuffer(ends, np.int64)
        self.all_places = np.frombuffer(places, np.int32)

    def places(self, word: bytes) -> np.ndarray:
        k = self.code[word]
        return self.all_places[(self.ends[k - 1] if k else 0) : self.ends[k]]

    def phrase(self, words: tuple[bytes, ...]) -> np.ndarray:
        """Starts of the exact phrase: shifted place lists, from the rarest word on."""
        if not all(w in self.code for w in words):
            return np.empty(0, np.int32)
        lists = sorted(((self.places(w), k) for k, w in enumerate(words)), key=lambda x: len(x[0]))
        found = lists[0][0] - lists[0][1]
        for places, offset in lists[1:]:
            if not len(found):
                break
            at = np.minimum(np.searchsorted(places, found + offset), len(places) - 1)
            found = found[places[at] == found + offset]
        return found

    def near(self, words: tuple[bytes, ...], slop: int) -> np.ndarray:
        """Places of the rarest word that have every other word at most ``slop`` places away, in the same document."""
        words = tuple(dict.fromkeys(words))
        if not words or not all(w in self.code for w in words):
            return np.empty(0, np.int32)
        lists = sorted((self.places(w) for w in words), key=len)
        found = lists[0]
        doc = np.searchsorted(self.starts, found, side="right") - 1
        low, high = np.maximum(found - slop, self.starts[doc]), np.minimum(found + slop, self.starts[doc + 1] - 1)
        keep = np.ones(len(found), bool)
        for places in lists[1:]:
            keep &= np.searchsorted(places, low) < np.searchsorted(places, high, side="right")
        return found[keep]


def blocks(tests: DataFrame, id: str, text: str, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The test passages with words, in blocks of at most ``block_bytes`` of text; at least one block, maybe empty.

    Longer passages make a block by themselves; the driver holds one block at a time.
    """
    held, size = [], 0
    for key, value in tests.select(F.col(id).cast("string"), F.col(text).cast("binary")).orderBy(id).toLocalIterator():
        words = words_of(value and bytes(value))
        if not words or key is None:
            continue
        if held and size + len(value) > block_bytes:
            yield held
            held, size = [], 0
        held.append((key, words))
        size += len(value)
    yield held


def _windows(items: list[tuple[str, list[bytes]]], window: int) -> dict[tuple[bytes, ...], list[str]]:
    """Items of every distinct window; an item of fewer words is one window."""
    found: dict[tuple[bytes, ...], dict[str, None]] = {}
    for key, words in items:
        for k in range(max(1, len(words) - window + 1)):
            found.setdefault(tuple(words[k : k + window]), {})[key] = None
    return {w: list(keys) for w, keys in found.items()}


def search(
    index: DataFrame, tests: DataFrame, id: str = "item_id", text: str = "text", window: int = WINDOW, near: int | None = None
) -> DataFrame:
    """Matches (segment, document, doc_id, place, length, items) of all windows of the tests.

    ``document`` counts the documents of a segment, ``place`` the words of the document, from 0;
    ``items`` are the ids, as strings, of the test rows with that window. With ``near``, a match is
    a place of the window's rarest word with all its other words at most ``near`` places away, in
    any order. Null ids and wordless tests match nothing.
    """
    return _by_block(index, tests, id, text, window, lambda found: _matcher(found, near), MATCHES)


def judge(index: DataFrame, tests: DataFrame, id: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """For every document of the index: doc_id, n_words, n_hit, items, contaminated.

    ``n_hit`` counts its words inside exact occurrences of windows, ``items`` are the ids, as
    sorted strings, of the test rows whose windows occur. A document is contaminated if it has a
    hit and at least one word in 20 is hit. Without tests or words nothing is hit.
    """
    n_blocks = [0]
    rows = _by_block(index, tests, id, text, window, _spans, SPANS, n_blocks)
    if n_blocks[0] > 1:  # each block has told its own spans of a document
        flat = lambda c: F.flatten(F.collect_list(c)).alias(c)
        keys = ["segment", "document", "doc_id", "n_words"]
        rows = rows.groupBy(*keys).agg(flat("spans"), flat("items"))
    start = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
    more = lambda a, x: F.greatest(F.lit(0).cast("long"), x["stop"] - F.greatest(a["end"], x["start"]))
    add = lambda a, x: F.struct(F.greatest(a["end"], x["stop"]).alias("end"), (a["n"] + more(a, x)).alias("n"))
    n_hit = F.aggregate(F.array_sort("spans"), start, add, lambda a: a["n"])
    hit = rows.select("doc_id", "n_words", n_hit.alias("n_hit"), F.array_sort(F.array_distinct("items")).alias("items"))
    return hit.withColumn("contaminated", (F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words")))


def _by_block(index, tests, id, text, window, task, schema, n_blocks=None) -> DataFrame:
    out = None
    for block in blocks(tests, id, text):
        found = index.mapInArrow(tidied(task(_windows(block, window))), schema)
        out = found if out is None else out.union(found)
        if n_blocks:
            n_blocks[0] += 1
    return out


MATCHES = "segment string, document long, doc_id long, place long, length long, items array<string>"
SPANS = "segment string, document long, doc_id long, n_words long, spans array<struct<start: long, stop: long>>, items array<string>"
_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[Segment]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield Segment(*(column[k].as_py() for column in batch.columns))


def _rare(windows: dict[tuple[bytes, ...], list[str]]) -> dict[bytes, list[tuple[bytes, ...]]]:
    """Windows by the one of their words that the fewest windows have: other segments need not try them."""
    often = Counter(w for words in windows for w in set(words))
    by_word: dict[bytes, list[tuple[bytes, ...]]] = {}
    for words in windows:
        by_word.setdefault(min(words, key=lambda w: (often[w], w)), []).append(words)
    return by_word


def _matcher(windows: dict[tuple[bytes, ...], list[str]], near: int | None):
    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_word = _rare(windows)
        for segment in _rows(batches):
            rows = []
            for word in by_word.keys() & segment.code.keys():
                for words in by_word[word]:
                    at = segment.phrase(words) if near is None else segment.near(words, near)
                    doc = np.searchsorted(segment.starts, at, side="right") - 1
                    for d, p in zip(doc.tolist(), at.tolist(), strict=True):
                        key = int(segment.known[d, 0]) if segment.known[d, 1] else None
                        rows.append((segment.name, d, key, p - int(segment.starts[d]), len(words) if near is None else 1, windows[words]))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.string(), *[pa.int64()] * 4, pa.list_(pa.string())]
            names = ["segment", "document", "doc_id", "place", "length", "items"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    return match


def _spans(windows: dict[tuple[bytes, ...], list[str]]):
    """A row for every document of a segment: its hit spans, disjoint and in order, and its items."""

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_word = _rare(windows)
        for segment in _rows(batches):
            n = len(segment.known)
            found: list[list[tuple[int, int]]] = [[] for _ in range(n)]
            items: list[set[str]] = [set() for _ in range(n)]
            for word in by_word.keys() & segment.code.keys():
                for words in by_word[word]:
                    at = segment.phrase(words)
                    for d, p in zip((np.searchsorted(segment.starts, at, side="right") - 1).tolist(), at.tolist(), strict=True):
                        found[d].append((p - int(segment.starts[d]), len(words)))
                        items[d].update(windows[words])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([segment.name] * n, pa.string()),
                    pa.array(np.arange(n)),
                    pa.array(segment.known[:, 0], mask=segment.known[:, 1] == 0),
                    pa.array(np.diff(segment.starts) - 1),
                    pa.array([_merged(x) for x in found], _SPAN),
                    pa.array([sorted(x) for x in items], pa.list_(pa.string())),
                ],
                ["segment", "document", "doc_id", "n_words", "spans", "items"],
            )

    return spans


def _merged(found: list[tuple[int, int]]) -> list[dict[str, int]]:
    out: list[dict[str, int]] = []
    for place, length in sorted(found):
        if out and place <= out[-1]["stop"]:
            out[-1]["stop"] = max(out[-1]["stop"], place + length)
        else:
            out.append({"start": place, "stop": place + length})
    return out
