"""Near-duplicate vectors by an exact range join in a metric space.

Cosine similarity of at least t is a distance of at most r = sqrt(2 - 2t) between unit vectors.
Pivots split the vectors of a label into cells; a vector is copied to every other cell that may
hold one within r, by the triangle inequality, and each cell is then joined by itself. Cells
larger than a block are joined block by block, so that no task holds a whole cell.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from midmile.llm.common import bounded_batches, components
from midmile.runtime import stage

THRESHOLD = 0.98
CELL_ROWS = 2000  # distinct vectors of a label for one pivot
MOST_PIVOTS = 8000  # of all labels together: they travel with every task
BLOCK = 1000  # rows of a side in one comparison
_SLACK = 1e-6  # distances are widened by more than rounding can take: the root of what a product of unit vectors is off by
_GROUP = ["label", "dim"]


def usable(embedding: str = "embedding"):
    """The vector has components, all of them finite numbers and not all zero."""
    e = F.col(embedding)
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return e.isNotNull() & ~F.exists(e, bad) & F.exists(e, lambda x: x != 0)


def unit(rows: list[np.ndarray]) -> np.ndarray:
    """Rows of length 1, in double precision; scaled first, so that no square over- or underflows."""
    x = np.vstack(rows).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _vectors(column: pa.ListArray) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _pivots(classes: DataFrame, cell_rows: int, most: int) -> dict[tuple, np.ndarray]:
    """Pivot vectors by label and length: those of least hash, one for every ``cell_rows`` vectors.

    Where that makes more than ``most`` in all, cells are made larger. Labels of one cell have none.
    """
    sizes = classes.groupBy(*_GROUP).agg(F.count("*").alias("size"))
    total = classes.count()
    each = max(cell_rows, -(-total // most))
    large = stage(sizes.where(F.col("size") >= 2 * each), "labels")  # at most total / each rows
    share = F.floor(F.col("size") / each) / F.col("size")
    dice = F.pmod(F.xxhash64("class_id"), F.lit(1 << 30)) / float(1 << 30)
    chosen = classes.join(large, _GROUP).where(dice < share).select(*_GROUP, "embedding", "class_id")
    found: dict[tuple, list] = {}
    for row in chosen.orderBy(*_GROUP, "class_id").collect():  # a hash share that makes about ``most`` rows at most
        found.setdefault((row["label"], row["dim"]), []).append(np.array(row["embedding"]))
    return {key: _apart(unit(rows)) for key, rows in found.items() if len(rows) > 1}


def _apart(pivots: np.ndarray) -> np.ndarray:
    """One of the pivots that differ by rounding only, as multiples of one vector do."""
    _, first = np.unique(pivots.round(7), axis=0, return_index=True)
    return pivots[np.sort(first)]


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (x @ pivots.T), 0))


def _by_label(batch: pa.RecordBatch) -> Iterator[tuple[tuple, np.ndarray]]:
    frame = pd.DataFrame({"label": batch.column("label").to_pandas(), "dim": batch.column("dim").to_pandas()})
    for key, at in frame.groupby(_GROUP, sort=True).indices.items():
        yield key, np.sort(at)


def _placed(classes: DataFrame, pivots: dict, r: float) -> DataFrame:
    """Rows (label, dim, cell, home, class_id, n, unit): every vector in its own cell, and in those near it."""

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for (label, dim), at in _by_label(batch):
                p = pivots.get((label, dim))
                if p is not None:
                    x = unit(list(_vectors(batch.column("embedding").take(pa.array(at)))))
                    d = _distances(x, p)
                    cell = d.argmin(axis=1)
                    frame = pd.DataFrame({"cell": cell, "far": d[np.arange(len(d)), cell]}).groupby("cell")["far"].max()
                    yield pa.RecordBatch.from_pydict({"label": pa.array([label] * len(frame), batch.column("label").type), "dim": pa.array([dim] * len(frame), pa.int32()), "cell": pa.array(frame.index.to_numpy().astype(np.int32)), "far": frame.to_numpy()})

    kind = classes.schema["label"].dataType.simpleString()
    radii: dict[tuple, np.ndarray] = {key: np.full(len(p), -np.inf) for key, p in pivots.items()}
    if pivots:
        rows = classes.mapInArrow(nearest, f"label {kind}, dim int, cell int, far double").groupBy(*_GROUP, "cell").agg(F.max("far").alias("far"))
        for row in rows.collect():  # one for each pivot
            radii[row["label"], row["dim"]][row["cell"]] = row["far"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for (label, dim), at in _by_label(batch):
                part = batch.take(pa.array(at))
                x = unit(list(_vectors(part.column("embedding"))))
                p = pivots.get((label, dim))
                if p is None:
                    rows, cells = np.arange(len(x)), np.zeros(len(x), np.int32)
                    home = np.ones(len(x), bool)
                else:
                    d = _distances(x, p)
                    own = d.argmin(axis=1)
                    nearest_d = d[np.arange(len(x)), own][:, None]
                    gap = _distances(p, p)[own]
                    # y in another cell lies beyond the bisector of both pivots, and within its cell's radius
                    # (not divided by the gap, which may be nothing but rounding)
                    near = (d**2 - nearest_d**2 <= 2 * (gap + _SLACK) * (r + _SLACK)) & (d <= radii[label, dim][None, :] + r + _SLACK)
                    near[np.arange(len(x)), own] = True
                    rows, cells = np.nonzero(near)
                    home = own[rows] == cells
                data = x.astype("<f8")
                yield pa.RecordBatch.from_pydict({
                    "label": pa.array([label] * len(rows), batch.column("label").type), "dim": pa.array([dim] * len(rows), pa.int32()),
                    "cell": pa.array(cells.astype(np.int32)), "home": pa.array(home),
                    "class_id": part.column("class_id").take(pa.array(rows)), "n": part.column("n").take(pa.array(rows)),
                    "unit": pa.array([data[k].tobytes() for k in rows], pa.binary()),
                })

    return classes.mapInArrow(place, f"label {kind}, dim int, cell int, home boolean, class_id long, n long, unit binary")


def similar(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of unit rows reach the threshold; pairs within rounding of it are summed exactly."""
    cos = x @ y.T
    linked = cos >= threshold
    for i, j in zip(*np.nonzero(np.abs(cos - threshold) < 1e-13), strict=True):
        linked[i, j] = math.fsum(x[i] * y[j]) >= threshold - 2e-16
    return linked


def _compare(threshold: float):
    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        x, y = rows[rows["side"]], rows[~rows["side"]]
        if not len(x) or not len(y):
            return pd.DataFrame({"class_id": [], "n_links": [], "root": []}).astype("int64")
        mats = [np.frombuffer(b"".join(s["unit"]), "<f8").reshape(len(s), -1) for s in (x, y)]
        xi, yi = x["class_id"].to_numpy(), y["class_id"].to_numpy()
        linked = similar(*mats, threshold) & (xi[:, None] != yi[None, :])
        links = linked @ y["n"].to_numpy()
        used = linked.any(axis=0)
        linked, yi = linked[:, used], yi[used]
        lx, ly, last = xi.copy(), yi.copy(), None
        big = np.iinfo(np.int64).max
        while last != (lx.sum(), ly.sum()) and len(yi):  # the least id that the block's links reach
            last = (lx.sum(), ly.sum())
            ly = np.minimum(ly, np.where(linked, lx[:, None], big).min(axis=0))
            lx = np.minimum(lx, np.where(linked, ly[None, :], big).min(axis=1))
        return pd.DataFrame({"class_id": np.concatenate([xi, yi]), "n_links": np.concatenate([links, np.zeros(len(yi), np.int64)]), "root": np.concatenate([lx, ly])})

    return compare


def link(
    vectors: DataFrame, id: str = "vec_id", embedding: str = "embedding", label: str = "label",
    threshold: float = THRESHOLD, cell_rows: int = CELL_ROWS, block: int = BLOCK,
) -> DataFrame:
    """Rows (id, n_links, component_id, kept): links of cosine ``threshold`` or more within a label.

    Only vectors with equal labels and lengths are compared, and no null ids or labels; null, empty,
    zero and non-finite vectors link with nothing and are their own components. Equal vectors link
    with each other; they are joined as one. ``n_links`` counts other vectors, ``component_id`` is
    the least id that links reach. Equal rows are one vector and come out once; rows of one id with
    different vectors count together. Other columns are not read. ``threshold`` must be in (0, 1].
    """
    bounded_batches(vectors.sparkSession)
    rows = vectors.select(F.col(id).alias("id"), F.col(label).alias("label"), F.col(embedding).cast("array<double>").alias("embedding"))
    key = lambda seed: F.xxhash64(F.lit(seed), "label", "embedding")  # noqa: E731  together 128 bits
    rows = rows.withColumns({"k1": key(1), "k2": key(2), "ok": F.col("id").isNotNull() & F.col("label").isNotNull() & usable()})
    rows = stage(rows.dropDuplicates(["id", "label", "k1", "k2"]), "vectors")
    good = rows.where("ok")
    classes = good.groupBy("k1", "k2").agg(
        F.min("id").cast("long").alias("class_id"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("embedding").alias("embedding")
    )
    classes = stage(classes.withColumn("dim", F.size("embedding")), "classes")
    pivots = _pivots(classes, cell_rows, MOST_PIVOTS)
    r = math.sqrt(2 - 2 * threshold)
    placed = stage(_placed(classes.select("label", "dim", "class_id", "n", "embedding"), pivots, r), "cells")
    cell = [*_GROUP, "cell"]
    sizes = placed.groupBy(*cell).agg(F.count("*").alias("all"), F.count_if("home").alias("homes"))
    parts = lambda c: F.greatest(F.lit(1), F.ceil(F.col(c) / block)).cast("int")
    placed = placed.join(sizes.select(*cell, parts("homes").alias("a"), parts("all").alias("b")), cell)
    mine = lambda c: F.pmod(F.xxhash64("class_id"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    out = [*cell, "class_id", "n", "unit"]
    left = placed.where("home").select(*out, F.lit(True).alias("side"), mine("a").alias("i"), every("b").alias("j"))
    right = placed.select(*out, F.lit(False).alias("side"), every("a").alias("i"), mine("b").alias("j"))
    met = left.union(right).groupBy(*cell, "i", "j").applyInPandas(_compare(threshold), "class_id long, n_links long, root long")
    met = stage(met.groupBy("class_id", "root").agg(F.sum("n_links").alias("n_links")), "links")
    groups = components(met, "class_id", "root")
    links = met.groupBy("class_id").agg(F.sum("n_links").alias("n_links"))
    found = classes.select("k1", "k2", "class_id", "n").join(links, "class_id", "left").join(groups, F.col("class_id") == F.col("node"), "left")
    found = found.select("k1", "k2", "class_id", (F.coalesce("n_links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "class_id").alias("component"))
    joined = rows.join(found.withColumn("ok", F.lit(True)), ["k1", "k2", "ok"], "left")
    return joined.select(
        F.col("id").alias(id),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "id").cast("long").alias("component_id"),
        F.coalesce(F.coalesce("component", "id") == F.col("id"), F.lit(True)).alias("kept"),
    )
