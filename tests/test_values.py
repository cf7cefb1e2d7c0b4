"""Hashed vectors and seeded places by value, against plain implementations of their hashes."""

import math
import struct
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from midmile.functions import columns as C
from midmile.operators import retrieval as R


def murmur3(data, seed=42):
    """The 32-bit hash by its published definition."""
    h, mask = seed, 0xFFFFFFFF
    rotl = lambda x, r: ((x << r) | (x >> (32 - r))) & mask
    mix = lambda k: rotl(k * 0xCC9E2D51 & mask, 15) * 0x1B873593 & mask
    whole = len(data) // 4 * 4
    for k in range(0, whole, 4):
        h = (rotl(h ^ mix(struct.unpack_from("<I", data, k)[0]), 13) * 5 + 0xE6546B64) & mask
    if tail := data[whole:]:
        h ^= mix(int.from_bytes(tail, "little"))
    h ^= len(data)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = ((h ^ h >> shift) * factor) & mask
    h ^= h >> 16
    return h - 2**32 if h >= 2**31 else h


def vector(text, dim):
    counts = Counter(murmur3(w.encode()) % dim for w in text.lower().split())
    norm = math.sqrt(sum(n * n for n in counts.values()))
    return {k: n / norm for k, n in counts.items()}


def test_vectors_of_texts(spark):
    texts = ["Heavy snow on route 9", "snow snow SNOW", "é ü straße 中文 words of any kind", "a b c d e f g h i j k l m", "one\ttwo\nthree  four"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for dim in (768, 16):
        for r in R.embed_text(rows, "text", dim).collect():
            want = vector(texts[r.id], dim)
            assert len(r.embedding) == dim
            assert {k for k, x in enumerate(r.embedding) if x} == set(want)
            assert all(abs(r.embedding[k] - x) < 1e-6 for k, x in want.items())


def test_places_of_a_seeded_order(spark):
    ids = [0, 1, 42, -7, 2**62, 123456789]
    found = spark.createDataFrame([(k,) for k in ids], "id long").select("id", C.seeded_order(F.col("id")).alias("place"), C.seeded_order(F.col("id"), 7).alias("other"))

    def place(id, seed):
        h = xxhash.xxh64_intdigest(struct.pack("<i", seed), seed=xxhash.xxh64_intdigest(struct.pack("<q", id), seed=42))
        return h - 2**64 if h >= 2**63 else h

    assert {r.id: (r.place, r.other) for r in found.collect()} == {k: (place(k, 42), place(k, 7)) for k in ids}
