"""Byte-level BPE by a local rank file: texts to token ids and back."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from midmile.llm.common import bounded_batches, give_back

CHUNK = 200_000  # characters; longer texts are cut before they meet the pattern
_CUT = re.compile(r"(?<=[A-Za-z0-9])(?=[ \n])")
# The characters with the Unicode property White_Space.
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_LONG_SPACE = re.compile(f"[{_SPACE}]{{1000,}}")


def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    """The encoding of a rank file; every task loads it once."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


class Coder:
    """Encodes texts of any length by a rank file."""

    def __init__(self, path: str, pattern: str, chunk: int = CHUNK):
        self.by_pattern, self.as_one, self.chunk = encoding(path, pattern), encoding(path, r"(?s).+"), chunk

    def ids(self, text: str) -> np.ndarray:
        """Ids of one text; every match of the pattern is encoded by itself, special tokens never."""
        if len(text) <= 1000:
            return np.asarray(self.by_pattern.encode_ordinary(text), dtype=np.int32)
        parts = [(self.as_one if one else self.by_pattern).encode_to_numpy(x, disallowed_special=()) for x, one in pieces(text, self.chunk)]
        return np.concatenate(parts).astype(np.int32)


def pieces(text: str, chunk: int = CHUNK) -> Iterator[tuple[str, bool]]:
    """Cut a long text at places that no match of the pattern reaches across; flag pieces that are one match.

    No match runs from a letter or digit into white space. Of a run of white space before
    another character, all but its last character are one match, at the end of the text all of them:
    runs of over 1,000 are flagged, as the pattern steps back through them and gives up in the end.
    """
    at = 0
    for run in _LONG_SPACE.finditer(text):
        last = run.end() - (run.end() < len(text))
        yield from ((x, False) for x in _cut(text[at : run.start()], chunk))
        yield text[run.start() : last], True
        at = last
    yield from ((x, False) for x in _cut(text[at:], chunk))


def _cut(text: str, chunk: int) -> Iterator[str]:
    at = 0
    while len(text) - at > chunk:
        end = _CUT.search(text, at + chunk)
        if not end:
            break
        yield text[at : end.start()]
        at = end.start()
    if at < len(text):
        yield text[at:]


def encode(docs: DataFrame, ranks: str, pattern: str, text: str = "text", ids: str = "ids", chunk: int = CHUNK) -> DataFrame:
    """``docs`` with the column ``ids``: array of token ids of the whole ``text``.

    ``ranks`` is the path of a rank file that every executor has. Null and empty texts give
    an empty array; bytes that are no UTF-8 count as U+FFFD. Rows are treated one by one,
    so repeated rows, ties and other columns stay as they are; a column named ``ids`` is replaced.
    """
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("array<int>")
    def to_ids(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coder = Coder(ranks, pattern, chunk)
        for batch in texts:
            yield batch.map(lambda x: coder.ids(x.decode("utf-8", "replace")))
        del coder
        give_back()

    return docs.withColumn(ids, to_ids(F.coalesce(F.col(text).cast("binary"), F.lit(b""))))


def decode(df: DataFrame, ranks: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the column ``out``: the raw bytes of the token ids.

    The bytes need not be UTF-8 and are not made so. Null ids give empty bytes.
    """
    bounded_batches(df.sparkSession)

    @F.pandas_udf("binary")
    def to_bytes(column: Iterator[pd.Series]) -> Iterator[pd.Series]:
        code = encoding(ranks, pattern)
        for batch in column:
            yield batch.map(lambda x: code.decode_bytes(x.tolist()))
        del code
        give_back()

    return df.withColumn(out, to_bytes(F.coalesce(F.col(ids), F.array().cast("array<int>"))))
