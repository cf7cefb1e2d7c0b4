"""Ordering, numbering and joining that stay balanced when one key is very large."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from midmile.runtime import is_staged, stage

_ROW_BITS = 33  # monotonically_increasing_id keeps the row position in its lower 33 bits


def top_n(df: DataFrame, by: Sequence[Column], keys: Sequence[str], n: int) -> DataFrame:
    """First ``n`` rows by ``by``; ``keys`` make the order total, so ties repeat."""
    return df.orderBy(*by, *keys).limit(n)


TRIMMED_RANKS = 1000  # Spark trims groups before the shuffle up to this many ranks
TRIM_SLICES = 64


def top_per_group(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank"
) -> DataFrame:
    """First ``n`` rows of every group.

    Spark trims each group to ``n`` rows per input partition before the shuffle
    (WindowGroupLimit), so a hot group never lands whole in one task. It does so for
    small ``n`` only; beyond that, slices of each group are trimmed first.
    """
    number = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    if n > TRIMMED_RANKS:
        home = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(TRIM_SLICES))
        sliced = df.withColumn("_slice", home).withColumn(rank, number(*group, "_slice"))
        df = sliced.filter(F.col(rank) <= n).drop("_slice", rank)
    return df.withColumn(rank, number(*group)).filter(F.col(rank) <= n)


def row_index(
    df: DataFrame, order: Sequence[Column], name: str = "row_index", group: str | None = None, from_files: bool = False
) -> DataFrame:
    """0-based position of every row in the total order ``order``.

    With ``group`` the count restarts at every value of that column, which must have
    few values (a record type, a source); its rows may be as uneven as they like. Rows are
    staged first, so that a repeated task finds them in the same order, unless they are a staged
    table or the caller says that they come ``from_files`` without a shuffle. One range
    shuffle sorts the rows, each partition numbers its own, and per-partition
    offsets (one row per partition) are added; no window ever holds a whole group.
    """
    lead = [F.col(group)] if group else []
    # equal rows may be many, so they need a tie that splits them; the same one after a retry
    keyed = (df if from_files or is_staged(df) else stage(df, "row-index-input")).withColumn("_tie", F.monotonically_increasing_id())
    placed = (
        keyed.repartitionByRange(*lead, *order, F.col("_tie"))
        .sortWithinPartitions(*lead, *order, F.col("_tie"))
        .drop("_tie")
        .withColumn("_at", F.monotonically_increasing_id())
    )
    placed = stage(placed, "row-index")
    part = F.shiftrightunsigned("_at", _ROW_BITS)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    # one row per partition: the window below sees at most as many rows as there were tasks
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    local = F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    out = (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + local)
        .drop("_part", "_offset", "_at")
    )
    if group is None:
        return out
    counts = placed.groupBy(group).agg(F.count("*").alias("_n"))
    earlier = Window.orderBy(F.col(group).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        F.col(group).alias("_group"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start")
    )
    return (
        out.join(starts, F.col(group).eqNullSafe(F.col("_group")))
        .withColumn(name, F.col(name) - F.col("_start"))
        .drop("_group", "_start")
    )


def balanced_join(
    left: DataFrame, right: DataFrame, key: str, target_rows: int = 100_000, target_pairs: int = 4_000_000
) -> DataFrame:
    """Inner equi-join on ``key`` that splits every hot key over several tasks.

    A key is hot when a side has more than ``target_rows`` rows of it or both together
    make more than ``target_pairs`` pairs. Its left rows are spread over ``l`` fragments,
    its right rows over ``r``, and each pair of fragments meets exactly once. The list of
    hot keys is staged, so its real size decides how it is joined; when there are none,
    this is a plain sort-merge join. The number of tasks follows the number of pairs, as
    the bytes that adaptive execution goes by say nothing of them. Both inputs are read
    twice: stage them if they are costly.
    """
    size = lambda df, name: df.groupBy(key).agg(F.count("*").alias(name))
    rows = size(left, "_nl").join(size(right, "_nr"), key, "full_outer").na.fill(0, ["_nl", "_nr"])
    nl, nr = F.col("_nl").cast("double"), F.col("_nr").cast("double")
    seen = Observation()
    rows = rows.observe(seen, F.sum(nl * nr).alias("pairs"))
    hot = rows.where((nl > target_rows) | (nr > target_rows) | (nl * nr > target_pairs))
    side = float(target_pairs) ** 0.5

    def pieces(own: Column, other: Column) -> Column:
        """Fragments of a side: of at most ``target_rows`` rows, smaller where the other side is large."""
        each = F.least(F.lit(float(target_rows)), F.greatest(F.lit(side), target_pairs / F.greatest(other, F.lit(1.0))))
        return F.greatest(F.lit(1), F.ceil(own / each)).cast("int")

    cuts = stage(hot.select(key, pieces(nl, nr).alias("_lcuts"), pieces(nr, nl).alias("_rcuts")), "hot-keys")
    needed = int((seen.get["pairs"] or 0) / target_pairs)

    def spread(df: DataFrame, own: str, other: str, own_name: str, other_name: str) -> DataFrame:
        place = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.coalesce(own, F.lit(1)))
        copies = F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1)
        return (
            df.join(cuts, key, "left")
            .withColumn(own_name, place.cast("int"))
            .withColumn(other_name, F.explode(copies))
            .drop("_lcuts", "_rcuts")
        )

    on = [key]
    if not cuts.isEmpty():
        left, right = spread(left, "_lcuts", "_rcuts", "_l", "_r"), spread(right, "_rcuts", "_lcuts", "_r", "_l")
        on = [key, "_l", "_r"]
    if needed:
        least = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        tasks = max(least, needed)
        left, right = left.repartition(tasks, *on), right.repartition(tasks, *on)
    # an estimate made before an explode says little, hence no broadcast of either side
    return left.join(right.hint("merge"), on).drop("_l", "_r")
