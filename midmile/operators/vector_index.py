"""Stored vector index: an inverted file of cells around centroids, searched by cell.

Vectors lie in one folder per cell, so a search reads the folders it asks for. With ``probes`` it takes the cells
nearest to each query; without, it goes on with every cell that the triangle inequality does not rule out, so
the hits are those of the exact scan. Cosine search compares unit vectors by their distance.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from midmile.operators import retrieval as R
from midmile.runtime import stage

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no installed copy of this package

SAMPLE = 16_384  # vectors that centroids are fitted on: the driver holds no more
CENTROID_BYTES = 32 << 20  # of the centroids that travel with tasks
SLICE_ROWS = 16_384  # vectors of a cell that meet queries in one task
QUERY_ROWS = 512  # queries that they meet there
SLACK = 1e-7  # of a bound, for rounding

_SCORES = {"cosine": R._cosine, "l2": R._negative_l2}
ZERO = -1  # the cell of zero vectors, which have no direction


@dataclass(frozen=True)
class Index:
    """What a search needs of a stored index: where it is, and its centroids, a bounded table."""

    path: str
    metric: str
    centroids: np.ndarray
    id_type: str  # of chunk ids, as in a schema


def _placed(vectors: np.ndarray, metric: str) -> np.ndarray:
    """Where vectors lie for the purpose of cells: unit vectors for cosine."""
    if metric == "l2":
        return vectors
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, norm, out=np.zeros_like(vectors), where=norm > 0)


def _distances(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    square = (points**2).sum(axis=1)[:, None] + (centroids**2).sum(axis=1)[None] - 2 * points @ centroids.T
    return np.sqrt(np.maximum(square, 0))


def _fit(points: np.ndarray, lists: int, seed: int, rounds: int = 10) -> np.ndarray:
    """Centroids by Lloyd's algorithm; an empty cell takes the point that lies farthest from its own."""
    dice = np.random.default_rng(seed)
    centroids = points[dice.choice(len(points), min(lists, len(points)), replace=False)].copy()
    for _ in range(rounds):
        apart = _distances(points, centroids)
        own = apart.argmin(axis=1)
        far = iter(np.argsort(-apart[np.arange(len(points)), own]).tolist())
        for cell in range(len(centroids)):
            inside = own == cell
            centroids[cell] = points[inside].mean(axis=0) if inside.any() else points[next(far)]
    return centroids


def _finite(vectors: pd.Series) -> np.ndarray:
    return np.array([v is not None and np.isfinite(np.asarray(v, "float64")).all() for v in vectors], bool)


def _in_cells(index: Index, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        pdf = pdf[_finite(pdf["vector"])]
        if len(pdf):
            points = _placed(R._matrix(pdf["vector"]), index.metric)
            apart = _distances(points, index.centroids)
            cell = apart.argmin(axis=1)
            away = apart[np.arange(len(pdf)), cell]
            if index.metric == "cosine":
                zero = ~points.any(axis=1)
                cell, away = np.where(zero, ZERO, cell), np.where(zero, 0.0, away)
            yield pdf.assign(cell=cell.astype("int32"), away=away)


def _add(index: Index, chunks: DataFrame, batch: int) -> None:
    """Write a batch of vectors and then its summary, which makes it part of the index; a repeated batch replaces itself."""
    vectors = chunks.select("chunk_id", F.col("embedding").cast("array<double>").alias("vector")).where("vector is not null")
    schema = T.StructType([*vectors.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("away", T.DoubleType())])
    rows = vectors.mapInPandas(partial(_in_cells, index), schema)
    rows.write.mode("overwrite").partitionBy("cell").parquet(f"{index.path}/vectors/batch={batch}")
    written = chunks.sparkSession.read.schema(schema).parquet(f"{index.path}/vectors/batch={batch}")
    summary = written.groupBy("cell").agg(F.max("away").alias("radius"), F.count("*").alias("rows"))
    summary.coalesce(1).write.mode("overwrite").parquet(f"{index.path}/cells/batch={batch}")


def build(chunks: DataFrame, path: str, lists: int | None = None, metric: str = "cosine", sample: int = SAMPLE, seed: int = 7) -> Index:
    """Fit cells on at most ``sample`` vectors and store all ``chunks(chunk_id, embedding)``.

    ``lists`` defaults to the square root of their number, as far as centroids take ``CENTROID_BYTES``. Null vectors and those with a component that
    is not finite are no hits and are left out; zero vectors have a cell of their own under cosine.
    """
    if metric not in _SCORES:
        raise ValueError(f"metric must be one of {sorted(_SCORES)}")
    known = chunks.where(F.col("embedding").isNotNull())
    key = F.xxhash64(F.col("chunk_id").cast("string"), F.lit(seed))
    taken = known.orderBy(key, F.col("chunk_id")).limit(sample).select(F.col("embedding").alias("vector")).toArrow().to_pandas()
    points = R._matrix(taken["vector"][_finite(taken["vector"])]) if len(taken) else np.empty((0, 1))
    points = np.unique(_placed(points, metric), axis=0)
    width = points.shape[1]
    lists = lists or max(1, int(known.count() ** 0.5))
    lists = max(1, min(lists, CENTROID_BYTES // (8 * width)))
    centroids = _fit(points, lists, seed) if len(points) else np.zeros((1, width))
    index = Index(path, metric, centroids, chunks.schema["chunk_id"].dataType.simpleString())
    spark = chunks.sparkSession
    table = pd.DataFrame({"cell": range(len(centroids)), "metric": metric, "id_type": index.id_type, "centroid": [c.tolist() for c in centroids]})
    spark.createDataFrame(table, "cell int, metric string, id_type string, centroid array<double>").coalesce(1).write.parquet(f"{path}/centroids")
    _add(index, chunks, 0)
    return index


def load(spark: SparkSession, path: str) -> Index:
    table = spark.read.parquet(f"{path}/centroids").orderBy("cell").toArrow().to_pandas()
    return Index(path, table["metric"][0], R._matrix(table["centroid"]), table["id_type"][0])


def add(index: Index, chunks: DataFrame, batch: int) -> None:
    """Store new ``chunks`` under a batch number above 0; the cells stay as they are, so nothing that is stored is written again."""
    if batch < 1:
        raise ValueError("batch must be 1 or more")
    _add(index, chunks, batch)


def cells(spark: SparkSession, index: Index) -> DataFrame:
    """``batch, cell, radius, rows`` of the stored batches."""
    return spark.read.schema("cell int, radius double, rows long, batch int").parquet(f"{index.path}/cells")


def _nearest(index: Index, probes: int, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The cells nearest to every query, the nearest at place 0."""
    for pdf in batches:
        if len(pdf):
            apart = _distances(_placed(R._matrix(pdf["vector"]), index.metric), index.centroids)
            near = np.argsort(apart, axis=1, kind="stable")[:, :probes]
            place = np.tile(np.arange(near.shape[1]), len(near))
            yield pd.DataFrame({"query_id": np.repeat(pdf["query_id"].to_numpy(), near.shape[1]), "cell": near.ravel().astype("int32"), "place": place})


def _open(index: Index, probes: int, radius: np.ndarray, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The other cells in which a query may still have a hit, given its ``kth`` score so far (null: fewer than k hits)."""
    for pdf in batches:
        if not len(pdf):
            continue
        points = _placed(R._matrix(pdf["vector"]), index.metric)
        apart = _distances(points, index.centroids)
        near = np.argsort(apart, axis=1, kind="stable")[:, :probes]
        least = np.maximum(apart - radius[None] - SLACK, 0)
        best = -least if index.metric == "l2" else 1 - least**2 / 2
        if index.metric == "cosine":
            best[~points.any(axis=1)] = 0  # a query without direction has score 0 everywhere
        kth = pdf["kth"].astype("float64").fillna(-np.inf).to_numpy()
        may = (best >= kth[:, None] - SLACK) & (radius >= 0)[None]
        np.put_along_axis(may, near, False, axis=1)
        query, cell = np.nonzero(may)
        yield pd.DataFrame({"query_id": pdf["query_id"].to_numpy()[query], "cell": cell.astype("int32")})


def _score(index: Index, k: int, chunks: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
    best = R._Best(k)
    if len(chunks) and len(asked):
        best.add(chunks["chunk_id"].to_numpy(), _SCORES[index.metric](R._matrix(chunks["vector"]), R._matrix(asked["vector"])))
    return best.rows(asked["query_id"].to_numpy())


def stored(spark: SparkSession, index: Index, wanted: list[int]) -> DataFrame:
    """Vectors of the wanted cells in all finished batches; other folders are not read."""
    schema = f"chunk_id {index.id_type}, vector array<double>, away double, batch int, cell int"
    done = [r.batch for r in cells(spark, index).select("batch").distinct().collect()]
    return spark.read.schema(schema).parquet(f"{index.path}/vectors").where(F.col("cell").isin(wanted) & F.col("batch").isin(done))


def _meet(spark: SparkSession, index: Index, asked: DataFrame, queries: DataFrame, rows: dict[int, int], k: int, schema: str) -> DataFrame:
    """Best ``k`` per query and task of ``asked(query_id, cell)``: slices of a cell meet blocks of its queries."""
    asked = stage(asked, "asked-cells")
    counts = {r.cell: r["n"] for r in asked.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # at most one row per cell
    wanted = [cell for cell in counts if rows.get(cell)]
    if not wanted:
        return spark.createDataFrame([], schema)
    cuts = [(cell, max(1, -(-rows[cell] // SLICE_ROWS)), max(1, -(-counts[cell] // QUERY_ROWS))) for cell in wanted]
    cuts = F.broadcast(spark.createDataFrame(cuts, "cell int, slices int, blocks int"))  # at most one row per centroid
    part = lambda key, n: F.pmod(F.xxhash64(F.col(key).cast("string")), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    chunks = stored(spark, index, wanted).join(cuts, "cell")
    chunks = chunks.select("cell", part("chunk_id", "slices").alias("slice"), each("blocks").alias("block"), "chunk_id", "vector")
    left = asked.join(cuts, "cell").join(queries, "query_id")
    left = left.select("cell", each("slices").alias("slice"), part("query_id", "blocks").alias("block"), "query_id", "vector")
    keys = ["cell", "slice", "block"]
    return chunks.groupBy(*keys).cogroup(left.groupBy(*keys)).applyInPandas(partial(_score, index, k), schema)


def search(queries: DataFrame, index: Index, k: int = 5, probes: int | None = None, first: int = 2) -> DataFrame:
    """``query_id, chunk_id, score, rank`` for ``queries(query_id, embedding)``: cosine, or negative distance for l2.

    With ``probes``, the best of the cells nearest to each query. Without, the same hits as the exact scan: the ``first`` nearest cells give a
    score to beat, and every cell that may hold as good a vector is searched too.
    """
    spark = queries.sparkSession
    asked = queries.select("query_id", F.col("embedding").cast("array<double>").alias("vector")).where("vector is not null")
    asked = stage(asked.where(~F.exists("vector", lambda x: F.isnan(x) | x.isin(float("inf"), float("-inf")))), "index-queries")
    count = cells(spark, index).groupBy("cell").agg(F.max("radius").alias("radius"), F.sum("rows").alias("rows")).collect()  # a row per cell
    rows = {r.cell: r["rows"] for r in count}
    radius = np.full(len(index.centroids), -1.0)
    for r in count:
        if r.cell >= 0:
            radius[r.cell] = r.radius
    query_id = f"query_id {asked.schema['query_id'].dataType.simpleString()}"
    schema = f"{query_id}, chunk_id {index.id_type}, score double"
    if not rows:
        return R.rank_hits(spark.createDataFrame([], schema), k)
    near = asked.mapInPandas(partial(_nearest, index, probes or first), f"{query_id}, cell int, place long")
    found = _meet(spark, index, near.select("query_id", "cell"), asked, rows, k, schema)
    if ZERO in rows:  # all of them have score 0, so the k least ids stand for all
        zero = [r.chunk_id for r in stored(spark, index, [ZERO]).select("chunk_id").orderBy("chunk_id").limit(k).collect()]
        ids = F.explode(F.array(*[F.lit(c).cast(index.id_type) for c in zero])).alias("chunk_id")
        found = found.unionByName(asked.select("query_id", ids, F.lit(0.0).alias("score")))
    if probes is None:
        found = stage(found, "near-hits")
        kth = R.rank_hits(found, k).where(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))
        rest = asked.join(kth, "query_id", "left").mapInPandas(partial(_open, index, first, radius), f"{query_id}, cell int")
        found = found.unionByName(_meet(spark, index, rest, asked, rows, k, schema))
    return R.rank_hits(found, k)


def tune(queries: DataFrame, index: Index, k: int = 5, target: float = 0.95) -> int:
    """The least number of probes that would have found ``target`` of the exact hits of some ``queries(query_id, embedding)``.

    Give a bounded sample: it is searched exactly, and how near each hit's cell is to its query comes to the driver.
    """
    spark = queries.sparkSession
    asked = stage(queries.select("query_id", "embedding"), "tuning-queries")
    exact = stage(search(asked, index, k).select("query_id", "chunk_id"), "exact-hits")
    homes = stored(spark, index, list(range(len(index.centroids)))).select("chunk_id", "cell")
    query_id = f"query_id {asked.schema['query_id'].dataType.simpleString()}"
    vectors = asked.select("query_id", F.col("embedding").cast("array<double>").alias("vector")).where("vector is not null")
    near = vectors.mapInPandas(partial(_nearest, index, len(index.centroids)), f"{query_id}, cell int, place long")
    places = exact.join(homes, "chunk_id").join(near, ["query_id", "cell"]).select("place").toPandas()["place"].to_numpy()
    return int(np.quantile(places, target, method="higher")) + 1 if len(places) else 1


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """``query_id, recall``: the share of each query's exact hits that ``found`` has too."""
    hit = found.select("query_id", "chunk_id", F.lit(1).alias("hit")).distinct()
    joined = exact.select("query_id", "chunk_id").join(hit, ["query_id", "chunk_id"], "left")
    return joined.groupBy("query_id").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
