"""Repaired conversations against all sequences of edits."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from midmile.llm import structure


def judged(rows):
    """[(role, text, fault)] of the rows of a conversation in order."""
    seen, out = set(), []
    for role, text in rows:
        left = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
        fault = "blank" if not left else "duplicate" if (role, text) in seen else "truncated" if left[-1] not in ".!?" else None
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def follow(rows, edits):
    """(cost, lines) of some edits, or None if they do not give a conversation."""
    cost, lines, at, rest = 0, [], 0, list(rows)
    for e in edits:
        expected = "assistant" if lines and lines[-1][0][:1] == "u" else "user"
        if e == "I":
            cost += 5
            lines.append((expected, ""))
            continue
        if not rest:
            return None
        role, text, fault = rest.pop(0)
        if e == "D":
            cost += 2
            continue
        if fault in ("blank", "duplicate"):
            return None
        cost += (e == "R") + 5 * (fault == "truncated")
        lines.append((role if e == "K" else expected, text))
    at = "".join(r[:1] if r[:1] in ("s", "u", "a") else "o" for r, _ in lines)
    return (cost, lines) if not rest and re.fullmatch("(s?(ua)+)?", at) else None


def cheapest(rows):
    """By trying every sequence of edits, in order of length, up to four rows put in."""
    best = None
    for more in range(5):
        for edits in itertools.product("DIKR", repeat=len(rows) + more):
            if edits.count("I") == more:
                got = follow(rows, edits)
                if got and (best is None or (got[0], "".join(edits)) < best[:2]):
                    best = got[0], "".join(edits), got[1]
    return best


def stepwise(rows):
    """The same for longer conversations: the best edits up to each row and role."""
    state = lambda lines: lines[-1][0][:1] if lines else ""
    best = {"": (0, "", [])}

    def widen(best):
        for _ in range(3):
            for cost, edits, lines in list(best.values()):
                role = "assistant" if state(lines) == "u" else "user"
                new = (cost + 5, edits + "I", [*lines, (role, "")])
                if new[:2] < best.get(role[0], (10**9,))[:2]:
                    best[role[0]] = new
        return best

    for role, text, fault in rows:
        after = {}
        for cost, edits, lines in widen(best).values():
            at = state(lines)
            options = [(2, "D", lines)]
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                to = "assistant" if at == "u" else "user"
                options.append((1 + more, "R", [*lines, (to, text)]))
                if role[:1] == to[0] or (role[:1] == "s" and at == ""):
                    options.append((more, "K", [*lines, (role, text)]))
            for c, e, new in options:
                found = (cost + c, edits + e, new)
                key = state(new)
                if key not in after or found[:2] < after[key][:2]:
                    after[key] = found
        best = after
    ends = [v for k, v in widen(best).items() if k in ("", "a")]
    return min(ends, key=lambda v: v[:2])


def figures(turned, solve=stepwise):
    """Expected report of one conversation from (turn, role, text) in order."""
    rows = judged([r[1:] for r in turned])
    turns = [t for t, *_ in turned if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    kinds = [sum(f == k for *_, f in rows) for k in ("blank", "duplicate", "truncated")]
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    cost, audit, lines = solve(rows)
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()
    return (gaps, *kinds, illegal, cost, audit, digest)


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


TEXTS = ["Fine.", "Is it?", "cut off", " \t\n", "", "Yes!", "no", "long. "]


@pytest.fixture(scope="module")
def conversations():
    dice = random.Random(12)
    rows = []
    for conv in range(160):
        roles = ["system", "user", "assistant", "tool", "user", "assistant", ""]
        rows += [(conv, dice.choice([t, t, t, t + 1, None]), dice.choice(roles), dice.choice([*TEXTS, f"Text {dice.randrange(9)}."])) for t in range(dice.randrange(1, 7))]
    rows += [(None, k, r, "Ok.") for k, r in enumerate(["user", "assistant", "user"])]
    rows += [(900, k, dice.choice(["user", "assistant", "system"]), dice.choice([*TEXTS, f"T{k}."])) for k in range(500)]
    rows += [(901, k, "user" if k % 2 == 0 else "assistant", f"T{k}.") for k in range(2000)]
    rows += [(902, 0, None, None), (902, 1, "user", None), (903, 5, "assistant", "x" * 1_000_000 + "."), (903, 5, "assistant", "x" * 1_000_000 + ".")]
    return rows


def by_conversation(rows):
    out = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    return {k: in_order(v) for k, v in out.items()}


@pytest.mark.parametrize("block", [structure.BLOCK, 3])
def test_like_all_edits(spark, conversations, block):
    table = spark.createDataFrame([(*r, 1, "x") for r in conversations], "conv_id long, turn long, role string, text string, rank int, symbol string")
    report, repaired = structure.repair(table.repartition(5), block=block)
    digests = {r.ckey: r.repaired_sha256 for r in structure.digests(repaired).collect()}
    nothing = hashlib.sha256(b"").hexdigest()
    got = {r.id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, digests.get(r.ckey, nothing)) for r in report.collect()}
    want = {k: figures(v) for k, v in by_conversation(conversations).items()}
    assert got == want


def test_step_by_step_is_the_least_of_all(conversations):
    for conv, rows in list(by_conversation(conversations).items())[:90]:
        if len(rows) <= 4:
            rows = judged([r[1:] for r in rows])
            assert stepwise(rows) == cheapest(rows), conv


def test_rules_are_worth_their_pairs():
    """A rule's matrix is that of its spelled-out rows."""
    dice = random.Random(1)
    rules = [("一", "ua"), ("丁", "一一"), ("丂", "U3"), ("七", "丁丂")]
    known = structure.matrices(rules)
    spelled = {"一": "ua", "丁": "uaua", "丂": "U3", "七": "uauaU3"}
    plain = lambda m: [[None if x is None else (x[0], str(x[1])) for x in line] for line in m]
    for symbol, text in spelled.items():
        whole = structure.of_row(text[0])
        for c in text[1:]:
            whole = structure.product(whole, structure.of_row(c))
        assert plain(known[symbol]) == plain(whole)
    for _ in range(200):
        text = "".join(dice.choice("suaoSUAO1234") for _ in range(dice.randrange(1, 30)))
        assert "".join(spelled.get(c, c) for c in structure.compress(text, rules)) == text


def test_rules_of_frequent_pairs(spark):
    table = spark.createDataFrame([("ua" * 50,), ("sua",), ("UAo",), ("ua1",)], "seq string")
    rules = structure.grammar(table)
    assert rules[0][1] == "ua" and len(structure.compress("ua" * 50, rules)) <= 4
    assert structure.grammar(table.where("false")) == []


def test_no_conversations(spark):
    report, repaired = structure.repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert report.count() == 0 and repaired.count() == 0


def test_the_query(spark, conversations, tmp_path):
    from midmile.llm.queries import QUERIES

    rows = [(900 + k, 0, "user", "Gone.") for k in range(1000, 1040)] + [r for r in conversations if r[0] != 900]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    damaged = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text, role = " " if text is None else text, " " if role is None else role
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        damaged += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    kept = by_conversation(damaged)
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    want = {conv: figures(kept[conv]) if conv in kept else nothing for conv in {r[0] for r in rows}}
    got = QUERIES["op12_structure"](spark, str(tmp_path))
    assert {r.conv_id: tuple(r)[1:] for r in got.collect()} == want
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert nothing in want.values()
