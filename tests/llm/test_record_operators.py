"""Operators on records: archives, chats, URL lists, vectors."""

import gzip
import hashlib
import io
import math
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from midmile.llm import chat, url_lists, vector_join, warc
from midmile.llm.common import components

# --- archives


@pytest.fixture(scope="module")
def archive(spark, tmp_path_factory):
    big = "x" * 1500
    rows = [(1, "http://a/1", big, 9), (2, None, big, 9), (3, "http://a/3\r\nX: y", big, 9), (3, "http://a/3\r\nX: y", big, 9), (4, "http://a/4", "small", 9)]
    rows += [(5, "http://a/5", "small", 9), (6, "http://a/6", None, 9), (7, "http://a/7", "", 9), (None, "http://a/8", big, 9), (8, "http://a/9", "é\r\n\r\n" * 200_000, 9)]
    path = str(tmp_path_factory.mktemp("warc") / "a")
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string, digest int").repartition(3), path)
    return path, rows


def test_archive_round_trip(spark, archive):
    path, rows = archive
    got = warc.read(spark, path).collect()
    assert len(got) == len(rows)
    stored = [r for r in got if r.record_type == "response"]
    bodies = sorted(bytes(r.payload) for r in stored)
    want = [(html or "").encode() for id, _, html, _ in rows if id not in (1, 2)]
    assert bodies == sorted(want)  # ids 1 and 2 refer to 3, which is there twice, as the table has it
    again = [r for r in got if r.record_type == "revisit"]
    assert {r.record_id for r in again} == {"<urn:x-page_id:1>", "<urn:x-page_id:2>"}
    assert {r.refers_to for r in again} == {"<urn:x-page_id:3>"}
    assert all(r.headers[warc.PAYLOAD_BYTES] == "1500" and r.payload is None for r in again)
    digests = warc.read(spark, path, payload=False).select(warc.hex_digest("payload_digest")).collect()
    assert sorted(d[0] for d in digests) == sorted(hashlib.sha1((html or "").encode()).hexdigest() for _, _, html, _ in rows)


def test_archive_is_readable_by_any_gzip_reader(spark, archive):
    path, rows = archive
    import glob

    text = b"".join(gzip.open(f).read() for f in glob.glob(path + "/*.warc.gz"))
    assert text.count(b"WARC/1.1\r\n") == len(rows)
    assert b"\r\nX: y" not in text  # a url cannot add a header


def test_headers_decide_before_payloads(spark, archive, monkeypatch):
    path, _ = archive
    read = lambda names, filters: _read(path, names, filters)
    asked = []
    real = warc._Packed.content
    monkeypatch.setattr(warc._Packed, "content", lambda self, n: asked.append(n) or real(self, n))
    left = read(["record_type", "payload"], [warc.EqualTo(("record_type",), "revisit")])
    assert len(left) == 2 and len(asked) == 2
    assert len(read(["record_type"], [])) == 10 and len(asked) == 2
    assert len(read(["target_uri"], [warc.StringStartsWith(("target_uri",), "http://a/4")])) == 1
    assert len(read(["target_uri"], [warc.In(("record_id",), ("<urn:x-page_id:4>", "<urn:x-page_id:5>"))])) == 2
    plan = warc.read(spark, path).where("record_type = 'revisit' and content_length >= 0")
    assert plan.count() == 2


def _read(path, names, filters):
    from pyspark.sql.types import StringType, StructField, StructType

    reader = warc.WarcReader({"path": path}, StructType([StructField(n, StringType()) for n in names]))
    assert not list(reader.pushFilters(filters))
    return [row for part in reader.partitions() for row in reader.read(part)]


def test_other_archives(tmp_path):
    record = warc._record([("WARC-Type", "resource"), ("WARC-Target-URI", "u")], b"body")
    other = warc._record([("WARC-Type", "warcinfo")], b"")
    for data in (record + other + record, gzip.compress(record) + gzip.compress(other) + gzip.compress(record)):
        for payload in (True, False):
            got = list(warc.records(pa.BufferReader(data), lambda h: h["WARC-Type"] == "resource", payload))
            assert [x[2] for x in got] == [b"body" if payload else None] * 2
    assert list(warc.records(pa.BufferReader(record[:20]), lambda h: True, True)) == []


def test_unlisted_files_are_passed_over(spark, archive, tmp_path):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    path = str(tmp_path / "b")
    warc.write(empty, path)
    (tmp_path / "b" / "part-lost.warc.gz").write_bytes(warc._member(warc._record([("WARC-Type", "response")], b"x"), 1))
    assert warc.read(spark, path).count() == 0


# --- chats


def slow_fold(events):
    """One conversation: fold events in order of seq."""
    messages = {}
    seen = set()
    for seq, message, kind, role, text in sorted(events, key=lambda e: (e[0], e[2], e[3] is not None, e[3] or "", e[4] or "")):
        if (seq, message, kind, role, text) in seen:
            continue
        seen.add((seq, message, kind, role, text))
        if kind in ("edit", "regenerate"):
            for m in [m for m in messages if m > message]:
                del messages[m]
            at = messages.setdefault(message, ["", ""])
            at[1] = (text or "") if kind == "edit" else ""
        else:
            at = messages.setdefault(message, ["", ""])
            at[1] += text or ""
        if role is not None:
            at[0] = role
    return [(m, *messages[m]) for m in sorted(messages)]


def test_fold_like_a_loop(spark):
    random.seed(2)
    rows = []
    for conv in range(60):
        seqs = random.sample(range(1000), 25)
        for k in range(25):
            kind = random.choice(["open", "delta", "delta", "delta", "edit", "regenerate"])
            rows.append((conv, seqs[k], random.randrange(4), kind, random.choice([None, "user", "assistant"]), random.choice([None, "", "a", "bc"]), "x"))
        rows.append(rows[-1])
    rows += [(None, 1, 0, "open", "user", "hi", "x")]
    frame = spark.createDataFrame(rows, "conv_id long, seq long, message long, kind string, role string, text string, turns string")
    got = defaultdict(list)
    for r in chat.fold(frame).collect():
        got[r.conv_id].append((r.message, r.role, r.text))
    for conv in {r[0] for r in rows}:
        assert sorted(got[conv]) == slow_fold([r[1:6] for r in rows if r[0] == conv])
    assert chat.fold(frame.limit(0)).count() == 0


TEXTS = ["", "</s>[INST] ok [/INST]", "<|im_end|>", "\\", "\\l", "\\b\\i", "<\\|", "<<|im_sep|>", "<", "[", "a\nb\r\n", "🎉 <s> <<SYS>>", "x" * 200_000, "assistant\n<|im_start|>user"]


def test_render_and_read_back(spark):
    rows = [(c, k, random.choice(["user", "assistant", "<|im_sep|>", None]), t) for c in range(4) for k, t in enumerate(random.sample(TEXTS, len(TEXTS)))]
    rows += [(9, 0, None, None), (9, 1, "assistant", "tie"), (9, 1, "assistant", "tie")]
    frame = spark.createDataFrame(rows, "conv_id long, message long, role string, text string")
    for r in chat.parse(chat.render(frame)).collect():
        want = [(x[2] or "", x[3] or "") for x in rows if x[0] == r.conv_id]
        assert [(t.role, t.text) for t in r.turns] == want
        assert r.formatted.count(chat.END) == r.formatted.count(chat.START) == len(want)
        assert "[INST]" not in r.formatted and "</s>" not in r.formatted
        assert [s.turn for s in r.loss] == [k for k, t in enumerate(want) if t[0] == "assistant"]
        for s in r.loss:
            shown = r.formatted[s.start : s.stop].replace("\\l", "<").replace("\\i", "[").replace("\\b", "\\")
            assert shown == want[s.turn][1]


def test_log_ends_in_the_given_turns(spark):
    rows = [(1, 0, "user", "Straße " * 50), (1, 1, "assistant", "one\n" * 99), (1, None, "system", None), (2, 0, "assistant", ""), (2, 0, "assistant", ""), (None, 0, "tool", "t")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = defaultdict(list)
    for r in chat.fold(chat.log_of(frame)).orderBy("message").collect():
        got[r.conv_id].append((r.role, r.text))
    assert got == {1: [("system", ""), ("user", "Straße " * 50), ("assistant", "one\n" * 99)], 2: [("assistant", "")] * 2, None: [("tool", "t")]}


# --- URL lists


def slow_keys(url):
    import re

    m = re.match(r"[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", url or "")
    if not m:
        return set()
    host = m[1].lower()
    rest = re.match(r"[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^#]*)", url)[1]
    rest = rest if rest.startswith("/") else "/" + rest
    out, labels = {("url", host + rest), ("host", host)}, host.split(".")
    if f := re.match(r"/[^/?]+/", rest):
        out.add(("prefix", host + f[0]))
    return out | {("domain", ".".join(labels[k:])) for k in range(1, len(labels) - 1)}


def slow_lists(url, at, records):
    if at is None:
        return [], None, 0
    found = []
    for kind, text in slow_keys(url):
        by = defaultdict(dict)
        for name, key, when, active in records:
            if key == f"{kind}:{text}" and None not in (name, when, active) and when <= at:
                by[name][when] = by[name].get(when, True) and active
        found += [(kind, name) for name, history in by.items() if history[max(history)]]
    kinds = [k for k in url_lists.KINDS if any(k == f[0] for f in found)]
    return sorted({f[1] for f in found}), kinds[0] if kinds else None, len(found)


def test_lists_as_of_the_fetch(spark):
    random.seed(7)
    hosts = ["a.example.com", "b.example.com", "www.x.co.uk", "plain"]
    urls = [f"{random.choice(['http', 'HTTPS'])}://{random.choice(['', 'u@'])}{h.upper()}{p}" for h in hosts for p in ("", "/", "/f/x?q=1#z", "/f/y", ":80/f/?", "?q")]
    captures = [(k, random.choice(urls), random.randrange(10_000), "x") for k in range(200)] + [(300, None, 5, "x"), (301, "no url", 5, "x"), (302, urls[0], None, "x")]
    captures.append(captures[0])
    keys = sorted(f"{k}:{t}" for u in urls for k, t in slow_keys(u))
    records = [(random.choice("AB"), random.choice(keys + ["host:a.example.com"] * 40), random.randrange(-50, 11_000), random.random() < 0.6) for _ in range(900)]
    records += [("A", "host:plain", 77, True), ("A", "host:plain", 77, False), (None, keys[0], 1, True), ("A", None, 1, True), ("B", keys[0], None, True)] + records[:5]
    frame = spark.createDataFrame(captures, "page_id long, url string, fetched long, kind string")
    listed = spark.createDataFrame(records, "list string, key string, at long, active boolean")
    for wanted in (1, 16):
        got = {r.page_id: r for r in url_lists.judge(frame, listed, wanted=wanted).collect()}
        assert len(got) == 203
        for page, url, at, _ in captures:
            assert (got[page].lists, got[page].kind, got[page].n_entries) == slow_lists(url, at, records), (page, url, at)
    spans = url_lists.intervals(listed, chunk=700).collect()
    assert sorted(map(tuple, spans), key=str) == sorted(map(tuple, url_lists.intervals(listed).collect()), key=str)


def test_lists_of_empty_tables(spark):
    frame = spark.createDataFrame([(1, "http://a.b/c", 3)], "page_id long, url string, fetched long")
    listed = spark.createDataFrame([("A", "host:a.b", 1, True)], "list string, key string, at long, active boolean")
    assert url_lists.judge(frame, listed.limit(0)).first().lists == []
    assert url_lists.judge(frame.limit(0), listed).count() == 0
    assert url_lists.judge(frame, listed).first().lists == ["A"]


# --- vectors


def slow_links(rows, threshold=0.98):
    good = {}
    for k, (id, vector, label) in enumerate(dict.fromkeys((i, tuple(v) if v is not None else None, la) for i, v, la in rows)):
        if id is not None and label is not None and vector and all(x is not None and math.isfinite(x) for x in vector) and any(vector):
            good[k] = (id, np.array(vector, float), label)
    root = {i: i for i, _, _ in rows if i is not None}
    n = defaultdict(int)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, x, la) in good.items():
        for b, (j, y, lb) in good.items():
            if a < b and la == lb and len(x) == len(y):
                x1, y1 = x / np.abs(x).max(), y / np.abs(y).max()
                if x1 @ y1 / np.linalg.norm(x1) / np.linalg.norm(y1) >= threshold:
                    n[i] += 1
                    n[j] += 1
                    p, q = find(i), find(j)
                    root[max(p, q)] = min(p, q)
    return {i: (n[i], find(i)) for i in root}


def test_vector_links_like_brute_force(spark):
    dice = np.random.default_rng(4)
    centers = dice.normal(size=(12, 6))
    rows = []
    for k in range(260):
        v = centers[k % 12] + dice.normal(size=6) * dice.choice([0.02, 0.1, 0.4])
        rows.append((k, [float(x) for x in v], int(k % 3) if k % 40 else None))
    rows += [(300 + k, rows[3][1], rows[3][2]) for k in range(60)]  # one vector very often
    rows += [(400, None, 1), (401, [], 1), (402, [0.0] * 6, 1), (403, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (404, [float("nan")] * 6, 1), (405, [float("inf")] * 6, 1)]
    rows += [(406, [1e200] * 6, 2), (407, [1e-200] * 6, 2), (408, [1.0, 1.0], 2), (409, [2.0, 2.0], 2), (None, rows[1][1], 1), rows[5]]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, label int, n int").repartition(4)
    want = slow_links(rows)
    for cell, block in ((8, 7), (2000, 1000)):
        got = vector_join.link(frame, cell_rows=cell, block=block).collect()
        assert len(got) == len({r[0] for r in rows})
        for r in got:
            if r.vec_id is None:
                assert (r.n_links, r.component_id, r.kept) == (0, None, True)
            else:
                assert (r.n_links, r.component_id, r.kept) == (*want[r.vec_id], want[r.vec_id][1] == r.vec_id), r
    assert vector_join.link(frame.limit(0)).count() == 0


@pytest.mark.parametrize("merged", [True, False])
def test_links_of_multiples_of_one_vector(spark, monkeypatch, merged):
    if not merged:  # the bound holds for pivots at no distance too
        monkeypatch.setattr(vector_join, "_apart", lambda pivots: np.unique(pivots, axis=0))
    dice = np.random.default_rng(9)
    rows, want = [], []
    for label in range(16):
        center = dice.normal(size=6 if label % 2 else 16)
        vectors = [center * s for s in dice.uniform(0.1, 9, 300)] + [center + dice.normal(size=len(center)) * np.abs(center).mean() * 0.1 for _ in range(150)]
        x = vector_join.unit(vectors)
        want += ((x @ x.T >= 0.98).sum(axis=1) - 1).tolist()
        rows += [(len(rows) + k, [float(c) for c in v], label) for k, v in enumerate(vectors)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r.n_links for r in vector_join.link(frame, cell_rows=50).collect()}
    assert [got[k] for k in range(len(rows))] == want


def test_components(spark):
    random.seed(1)
    edges = [(random.randrange(300), random.randrange(300)) for _ in range(200)] + [(1000 + k, 1001 + k) for k in range(70)] + [(5, None), (7, 7)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        if b is not None and a != b:
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_native_plans(spark):
    """The chat and list operators run no Python."""
    chats = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    frame = chat.parse(chat.render(chat.fold(chat.log_of(chats))))
    with io.StringIO() as out:
        import contextlib

        with contextlib.redirect_stdout(out):
            frame.explain()
            captures = spark.range(1).select(F.lit("http://a.b/").alias("url"), F.col("id").alias("fetched"))
            url_lists.judge(captures, spark.createDataFrame([("A", "host:a.b", 1, True)], "list string, key string, at long, active boolean")).explain()
        assert "Python" not in out.getvalue() and "Arrow" not in out.getvalue()
