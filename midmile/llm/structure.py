"""Repair of conversations whose rows are missing, blank, repeated, cut off or of the wrong role.

A conversation should read system (optional), then user and assistant in turn. The cheapest edits are a walk over
four states, so a row is a matrix of costs between states, each with the rope of its edits, and rows
follow each other by the min-plus product. Sequences of roles and faults are compressed by Re-Pair rules that all
conversations share: every rule's matrix is made once, of those of its two symbols. Long
conversations are cut into blocks, whose matrices are multiplied in order.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from midmile.llm.common import bounded_batches
from midmile.operators.ranking import row_index
from midmile.runtime import stage

BLOCK = 2048  # rows of a conversation in one sequence
RULES, ROUNDS, RULES_A_ROUND = 200, 8, 32
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 1, 2, 5, 5  # fixed values: what edits cost, and a row that stays cut off

SPACE = " \t\n\x0b\x0c\r"
ROLES = {"s": "system", "u": "user", "a": "assistant"}
# One letter a row: the first of its role (o for others), capital if it is cut off, a figure if it must go.
_SYMBOLS = {"plain": "suao", "cut": "SUAO", "gone": "1234"}
_ROLE_OF = {c: "suao"[k] for text in _SYMBOLS.values() for k, c in enumerate(text)}

START, SYSTEM, USER, ASSISTANT = range(4)
_KEPT = {("s", START): SYSTEM, ("u", START): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}
_NEXT = {START: "u", SYSTEM: "u", ASSISTANT: "u", USER: "a"}  # the role that an inserted or renamed row has
_AFTER = {"u": USER, "a": ASSISTANT}


class Rope:
    """Edits of a stretch, as those of its two parts; spelled out when they are asked for."""

    __slots__ = ("left", "right", "text")

    def __init__(self, left: Rope | None = None, right: Rope | None = None, text: str | None = None):
        self.left, self.right, self.text = left, right, text

    def __str__(self) -> str:
        if self.text is None:
            parts, todo = [], [self]
            while todo:
                rope = todo.pop()
                if rope.text is not None:
                    parts.append(rope.text)
                else:
                    todo += [rope.right, rope.left]
            self.text, self.left, self.right = "".join(parts), None, None
        return self.text


Matrix = list[list["tuple[int, Rope] | None"]]


def _better(a: tuple[int, Rope] | None, b: tuple[int, Rope] | None) -> tuple[int, Rope] | None:
    """The cheaper walk, of equal ones that whose edits are ASCII-least.

    Of two walks of equal cost over the same rows between the same states, neither's edits begin with the other's, so the
    choice holds for whatever comes before and after.
    """
    if a is None or b is None:
        return b if a is None else a
    if a[0] != b[0]:
        return a if a[0] < b[0] else b
    return a if str(a[1]) <= str(b[1]) else b


def product(a: Matrix, b: Matrix) -> Matrix:
    out: Matrix = []
    for row in a:
        line: list[tuple[int, Rope] | None] = [None] * 4
        for k, x in enumerate(row):
            if x is not None:
                for j, y in enumerate(b[k]):
                    if y is not None and (line[j] is None or x[0] + y[0] <= line[j][0]):
                        line[j] = _better(line[j], (x[0] + y[0], Rope(x[1], y[1])))
        out.append(line)
    return out


def inserts() -> Matrix:
    """Rows put in, as few as lead from state to state."""
    out: Matrix = []
    for state in range(4):
        line: list[tuple[int, Rope] | None] = [None] * 4
        n = 0
        while line[state] is None:
            line[state] = (INSERT * n, Rope(text="I" * n))
            state, n = _AFTER[_NEXT[state]], n + 1
        out.append(line)
    return out


def of_row(symbol: str) -> Matrix:
    """Edits of one row, with rows put in before it."""
    role = _ROLE_OF[symbol]
    gone, cut = symbol in _SYMBOLS["gone"], CUT_OFF * (symbol in _SYMBOLS["cut"])
    edits: Matrix = [[None] * 4 for _ in range(4)]
    for state in range(4):
        edits[state][state] = (DELETE, Rope(text="D"))
        if not gone:
            to = _AFTER[_NEXT[state]]
            edits[state][to] = _better(edits[state][to], (REROLE + cut, Rope(text="R")))
            if (role, state) in _KEPT:
                to = _KEPT[role, state]
                edits[state][to] = _better(edits[state][to], (KEEP + cut, Rope(text="K")))
    return product(inserts(), edits)


# --- the grammar


def compress(sequence: str, rules: list[tuple[str, str]]) -> str:
    for symbol, pair in rules:
        sequence = sequence.replace(pair, symbol)
    return sequence


def _pairs(rules: list[tuple[str, str]]) -> Callable:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for sequence in batch.column(0).to_pylist():
                short = compress(sequence, rules)
                seen.update(a + b for a, b in zip(short, short[1:], strict=False))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["pair", "n"])

    return count


def grammar(sequences: DataFrame, rules: int = RULES, rounds: int = ROUNDS) -> list[tuple[str, str]]:
    """Re-Pair rules (symbol, pair), at most ``rules``: in each round the most frequent pairs of ``sequences(seq)``.

    Pairs of a round have no symbol in common, so they do not overlap. Counts are of all sequences;
    the number of different pairs is bounded by that of the symbols.
    """
    found: list[tuple[str, str]] = []
    for _ in range(rounds):
        counts = sequences.select("seq").mapInArrow(_pairs(found), "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n"))
        used: set[str] = set()
        new = 0
        for pair, _n in counts.where("n > 1").orderBy(F.desc("n"), "pair").collect():
            if not used & set(pair) and len(found) < rules and new < RULES_A_ROUND:
                used |= set(pair)
                found.append((chr(0x4E00 + len(found)), pair))
                new += 1
        if not new:
            break
    return found


def matrices(rules: list[tuple[str, str]]) -> dict[str, Matrix]:
    """The matrix of every symbol, bottom-up."""
    known = {c: of_row(c) for c in _ROLE_OF}
    for symbol, pair in rules:
        known[symbol] = product(known[pair[0]], known[pair[1]])
    return known


_VALUED = "seq string, costs array<long>, edits array<string>, illegal long"
_LEGAL = {"su", "ua", "au"}


def _valued(rules: list[tuple[str, str]]) -> Callable:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = matrices(rules)
        for batch in batches:
            costs, edits, illegal = [], [], []
            for sequence in batch.column(0).to_pylist():
                short = compress(sequence, rules)
                whole = known[short[0]]
                for symbol in short[1:]:
                    whole = product(whole, known[symbol])
                flat = [x for line in whole for x in line]
                costs.append([None if x is None else x[0] for x in flat])
                edits.append([None if x is None else str(x[1]) for x in flat])
                illegal.append(sum(_ROLE_OF[a] + _ROLE_OF[b] not in _LEGAL for a, b in zip(sequence, sequence[1:], strict=False)))
            columns = [batch.column(0), pa.array(costs, pa.list_(pa.int64())), pa.array(edits, pa.list_(pa.string())), pa.array(illegal, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["seq", "costs", "edits", "illegal"])

    return rows


# --- conversations


_EDITED = "ckey string, block long, ops array<string>, cost long, audit string, illegal long"


def _edited(ends: Matrix) -> Callable:
    """Of each conversation's blocks in order: its cheapest edits, and those of every row.

    An op is the rows put in before (u, a), then K, D, U or A for kept, deleted and renamed rows, or nothing at the end.
    """

    def close(ckey: str, walks: list, sequences: list[str], illegal: int) -> Iterator[tuple]:
        best = None
        for state, walk in enumerate(walks):
            for end in (START, ASSISTANT):
                if walk is not None and ends[state][end] is not None:
                    cost, rope = ends[state][end]
                    best = _better(best, (walk[0] + cost, Rope(walk[1], rope)))
        audit = str(best[1])
        state, at = START, 0
        for block, sequence in enumerate([*sequences, ""]):
            ops = []
            for symbol in sequence or [""]:
                op = ""
                while at < len(audit) and audit[at] == "I":
                    op, state, at = op + _NEXT[state], _AFTER[_NEXT[state]], at + 1
                if symbol:
                    edit, at = audit[at], at + 1
                    if edit == "K":
                        op, state = op + "K", _KEPT[_ROLE_OF[symbol], state]
                    elif edit == "R":
                        op, state = op + _NEXT[state].upper(), _AFTER[_NEXT[state]]
                    else:
                        op += "D"
                ops.append(op)
            yield (ckey, block, ops, None, None, None)
        yield (ckey, -1, None, best[0], audit, illegal)

    def batch(out: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.list_(pa.string()), pa.int64(), pa.string(), pa.int64()]
        columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays(columns, ["ckey", "block", "ops", "cost", "audit", "illegal"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ckey, walks, sequences, illegal, out = None, [], [], 0, []
        for part in batches:
            for key, sequence, costs, edits, bad in zip(*(part.column(k).to_pylist() for k in range(5)), strict=True):
                if key != ckey:
                    if ckey is not None:
                        for row in close(ckey, walks, sequences, illegal):
                            out.append(row)
                            if len(out) >= 1000:
                                yield batch(out)
                                out = []
                    ckey, walks, sequences, illegal = key, [(0, Rope(text="")), None, None, None], [], 0
                own = [[None if c is None else (c, Rope(text=e)) for c, e in zip(costs[k : k + 4], edits[k : k + 4], strict=True)] for k in (0, 4, 8, 12)]
                walks = product([walks], own)[0]
                if sequences:
                    illegal += _ROLE_OF[sequences[-1][-1]] + _ROLE_OF[sequence[0]] not in _LEGAL
                sequences.append(sequence)
                illegal += bad
        if ckey is not None:
            out += close(ckey, walks, sequences, illegal)
        if out:
            yield batch(out)

    return rows


def conversation_key(id: str) -> Column:
    return F.coalesce(F.concat(F.lit("c"), F.col(id).cast("string")), F.lit("n"))


def faults(rows: DataFrame, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A staged table ``ckey, id, turn, role, text, rank, symbol, fault`` of all rows in order.

    Rows of a conversation are in the order of turn (null first), role and text. The first fault of a row counts: ``blank`` (nothing but
    white space), ``duplicate`` (role and text seen earlier), ``truncated`` (does not end in . ! or ?).
    """
    wide = rows.select(
        conversation_key(id).alias("ckey"), F.col(id).alias("id"), F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role), F.lit(" ")).alias("role"), F.coalesce(F.col(text), F.lit(" ")).alias("text"),
    )
    order = [F.asc("ckey"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("text")]
    placed = row_index(wide, order, "at").withColumns({"d1": F.xxhash64("role", "text"), "d2": F.xxhash64(F.lit(7), "role", "text")})
    placed = stage(placed, "placed")
    starts = placed.groupBy("ckey").agg(F.min("at").alias("start"))
    firsts = placed.groupBy("ckey", "d1", "d2").agg(F.min("at").alias("first"))
    left = F.rtrim("text", F.lit(SPACE))
    fault = F.when(left == "", "blank").when(F.col("at") > F.col("first"), "duplicate").when(~F.right(left, F.lit(1)).isin(".", "!", "?"), "truncated")
    kind = F.when(F.col("fault").isin("blank", "duplicate"), "gone").when(F.col("fault") == "truncated", "cut").otherwise("plain")
    place = F.coalesce(F.nullif(F.position(F.substring("role", 1, 1), F.lit("sua")), F.lit(0)), F.lit(4))
    place = F.when(F.col("role") == "", 4).otherwise(place)
    symbol = F.lit(None).cast("string")
    for name, letters in _SYMBOLS.items():
        symbol = F.when(kind == name, F.substring(F.lit(letters), place, F.lit(1))).otherwise(symbol)
    joined = placed.join(firsts, ["ckey", "d1", "d2"]).join(starts, "ckey").withColumn("fault", fault)
    return stage(joined.select("ckey", "id", "turn", "role", "text", (F.col("at") - F.col("start")).alias("rank"), symbol.alias("symbol"), "fault"), "faults")


def repair(rows: DataFrame, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(report, repaired) of all conversations.

    ``report``: ``id, ckey, gaps, blank, duplicate, truncated, illegal, cost, audit`` per conversation; ``gaps`` counts
    turns that are missing between the first and the last, ``illegal`` neighbours that do not follow each other, ``audit`` the edits
    Keep, Rerole, Delete and Insert of least cost, of equal ones the ASCII-least. ``repaired``:
    ``id, ckey, rank, nth, role, text`` of all rows afterwards, in the order of rank and nth.

    Null texts and roles count as one space, so they are blank or of another role; null ids are one conversation; null turns
    come first and leave no gap. Roles go by their first letter. Equal rows are all
    seen, and all but the first are duplicates. An empty table gives empty results. Other columns are not read.
    """
    bounded_batches(rows.sparkSession)
    judged = faults(rows, id, turn, role, text)
    nth = F.floor(F.col("rank") / block).cast("long")
    letters = F.sort_array(F.collect_list(F.struct("rank", "symbol")))  # at most ``block`` rows
    blocks = judged.groupBy("ckey", nth.alias("block")).agg(F.array_join(F.transform(letters, lambda x: x["symbol"]), "").alias("seq"))
    blocks = stage(blocks, "sequences")
    sequences = stage(blocks.select("seq").distinct(), "distinct-sequences")
    rules = grammar(sequences)
    valued = stage(sequences.mapInArrow(_valued(rules), _VALUED), "matrices")
    ordered = blocks.join(valued, "seq").repartition("ckey").sortWithinPartitions("ckey", "block").select("ckey", "seq", "costs", "edits", "illegal")
    edited = stage(ordered.mapInArrow(_edited(inserts()), _EDITED), "edits")

    count = lambda kind: F.sum((F.coalesce("fault", F.lit("")) == kind).cast("long")).alias(kind)
    figures = judged.groupBy("ckey", "turn").agg(F.min("id").alias("id"), *map(count, ("blank", "duplicate", "truncated")))
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps")
    figures = figures.groupBy("ckey").agg(F.min("id").alias("id"), gaps, *[F.sum(k).alias(k) for k in ("blank", "duplicate", "truncated")])
    report = figures.join(edited.where("block < 0").select("ckey", "illegal", "cost", "audit"), "ckey")
    report = report.select("id", "ckey", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")

    ops = edited.where("block >= 0").select("ckey", "block", F.posexplode("ops").alias("pos", "op"))
    ops = ops.where("op <> 'D'").select("ckey", (F.col("block") * block + F.col("pos")).alias("place"), "op")
    # the op after the last row stands in a block of its own, so its place lies behind all ranks
    own = judged.select("ckey", F.col("rank").alias("place"), "id", "role", "text")
    named = {"u": "user", "a": "assistant", "U": "user", "A": "assistant"}
    letter = lambda c: F.coalesce(*[F.when(c == k, F.lit(v)) for k, v in named.items()], F.col("role"))
    line = lambda c: F.struct(letter(c).alias("role"), F.when(c.isin("u", "a"), F.lit("")).otherwise(F.col("text")).alias("text"))
    kept = F.filter(F.split("op", ""), lambda c: ~c.isin("", "D"))
    repaired = ops.join(own, ["ckey", "place"], "left").select("ckey", F.col("place").alias("rank"), F.posexplode(F.transform(kept, line)).alias("nth", "line"))
    ids = figures.select("ckey", "id")
    repaired = repaired.join(ids, "ckey").select("id", "ckey", "rank", "nth", "line.role", "line.text")
    return report, repaired


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ckey, digest, keys, out = None, hashlib.sha256(), [], []
    for batch in batches:
        for k, key in enumerate(batch.column(0).to_pylist()):
            if key != ckey:
                if ckey is not None:
                    keys.append(ckey)
                    out.append(digest.hexdigest())
                ckey, digest = key, hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(batch.column(1)[k].as_buffer())
    if ckey is not None:
        keys.append(ckey)
        out.append(digest.hexdigest())
    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(out, pa.string())], ["ckey", "repaired_sha256"])


def digests(repaired: DataFrame) -> DataFrame:
    """``ckey, repaired_sha256``: digest of each conversation's lines ``role:text``. A digest needs its lines in order, so one
    conversation is one task's work; it streams, so memory is bounded."""
    lines = repaired.select("ckey", "rank", "nth", F.concat("role", F.lit(":"), "text").cast("binary").alias("line"))
    ordered = lines.repartition("ckey").sortWithinPartitions("ckey", "rank", "nth").select("ckey", "line")
    return ordered.mapInArrow(_digests, "ckey string, repaired_sha256 string")


def damage(rows: DataFrame) -> DataFrame:
    """Conversation rows with known faults, by the checksum of conversation and turn; nulls are one space.

    0 of 20 drops the row, 1 empties its text, 2 takes out . ! and ?, 3 repeats it, 4 makes it a user's.
    """
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(part("text"), "[.!?]", "")).otherwise(part("text"))
    times = F.when(kind == 3, 2).otherwise(1)
    return rows.where(kind != 0).select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(part("role")).alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), times)).alias("copy")
    ).drop("copy")
