import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from midmile.functions import columns as C
from midmile.functions import geo
from midmile.operators import silver as S


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


def test_names_are_cleaned_and_collisions_raise(spark):
    df = spark.createDataFrame([(1, 2)], " `Start Time` int, `Late-(risk)` int")
    assert C.normalize_upper(df).columns == ["START_TIME", "LATE_RISK"]
    assert C.normalize_lower(df).columns == ["start_time", "late-(risk)"]
    with pytest.raises(ValueError):
        C.normalize_upper(spark.createDataFrame([(1, 2)], "`a b` int, `a-b` int"))


def test_first_source_wins_its_target(spark):
    df = spark.createDataFrame([(1.0, 2.0, "x", "y")], "cost double, total_cost double, notes string, description string")
    row = C.map_columns(df, S.SOURCE_COLUMNS).first()
    assert (row.cost, row.description) == (2.0, "y")


def test_conform_pads_and_nulls_bad_cells(spark):
    schema = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.DateType())])
    row = C.conform(spark.createDataFrame([("x1", 5)], "a string, c int"), schema).first()
    assert row.asDict() == {"a": None, "b": None}


@pytest.mark.parametrize(
    "prcp, sndp, visib, label",
    [
        (51.0, 99.0, 0.0, C.PRECIPITATION),
        (50.0, 11.0, 0.0, C.SNOWFALL),
        (50.0, 10.0, 0.9, C.VISIBILITY),
        (50.0, 10.0, 1.0, C.NORMAL),
        (None, None, None, C.NORMAL),
        (None, 11.0, None, C.SNOWFALL),
    ],
)
def test_weather_label(spark, prcp, sndp, visib, label):
    df = spark.createDataFrame([(prcp, sndp, visib)], "p double, s double, v double")
    assert df.select(C.weather_alert(F.col("p"), F.col("s"), F.col("v")).alias("x")).first().x == label


def test_missing_snow_reading_is_no_snowfall(spark):
    df = spark.createDataFrame([("a", dt.date(2023, 1, 1), 0.0, 999.9, 5.0)], "station string, date date, prcp double, sndp double, visib double")
    assert S.weather_alerts(df).first().weather_alert == C.NORMAL


@pytest.mark.parametrize(
    "reply, score, reason",
    [
        ("0.85, Heavy snowfall alert", 0.85, "Heavy snowfall alert"),
        ("n/a, unknown", 0.5, "unknown"),
        ("1.7, pileup, icing", 1.0, "pileup, icing"),
        ("-0.2, below", 0.0, "below"),
        ("0.45", 0.45, C.DEFAULT_REASON),
        ("", 0.5, C.DEFAULT_REASON),
    ],
)
def test_parse_risk(spark, reply, score, reason):
    got = one(spark, C.parse_risk(F.lit(reply)))
    assert (got.score, got.reason) == (score, reason)


def test_risk_class_limits(spark):
    got = [one(spark, C.risk_class(F.lit(s))) for s in (0.7, 0.69, 0.4, 0.39)]
    assert got == ["HIGH RISK", "MODERATE RISK", "MODERATE RISK", "LOW RISK"]


def test_limits_are_strict_and_unknown_never_fails(spark):
    rows = [(30.0, 40.0, 5.0, 4.5), (40.0, 40.0, 4.5, 4.5), (None, 40.0, None, 4.5), (50.0, 40.0, 3.8, 4.5)]
    df = spark.createDataFrame(rows, "l double, w double, c double, h double")
    got = [r.x for r in df.select(C.violates(*[F.col(c) for c in "lwch"]).alias("x")).collect()]
    assert got == [True, False, False, True]


def test_zero_weight_and_speed(spark):
    assert one(spark, C.weight_margin(F.lit(30.0), F.lit(0.0))) is None
    assert one(spark, C.transit_hours(F.lit(110.0), F.lit(55.0))) == 2.0
    assert one(spark, C.transit_hours(F.lit(110.0), F.lit(0.0))) is None
    assert one(spark, C.transit_error(F.lit(-1.0))) == "Speed must be > 0"


def test_user_text_is_not_a_pattern(spark):
    df = spark.createDataFrame([("100% sure",), ("100 sure",)], "t string")
    assert df.where(C.contains_ci(F.col("t"), "0% S")).count() == 1
    assert df.where(C.contains_ci(F.col("t"), "_")).count() == 0


def test_years_become_ranges(spark):
    assert C._runs([2023, 2024, 2026]) == [(2023, 2024), (2026, 2026)]
    df = spark.createDataFrame([(dt.date(y, 12, 31),) for y in (2022, 2023, 2024, 2025)], "d date")
    assert df.where(C.in_years(F.col("d"), [2023, 2025])).count() == 2


def test_unknown_flag_counts_as_zero(spark):
    df = spark.createDataFrame([(True,), (False,), (None,)], "f boolean")
    assert [r.x for r in df.select(C.flag01(F.col("f")).alias("x")).collect()] == [1, 0, 0]


def test_seeded_order_does_not_depend_on_partitions(spark):
    ids = spark.range(100)
    order = lambda df: [r.id for r in df.orderBy(C.seeded_order(F.col("id")), "id").collect()]
    assert order(ids.repartition(1)) == order(ids.repartition(7))


def test_point_needs_both_parts(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, 2.0), (1.0, None)], "lat double, lon double")
    got = [r.x for r in df.select(C.point(F.col("lat"), F.col("lon")).alias("x")).collect()]
    assert got[0].lat == 1.0 and got[1:] == [None, None]


def test_parse_linestring(spark):
    good = one(spark, geo.parse_linestring(F.lit("LINESTRING(-87.6298 41.8781, -90.1994 38.6270,-91 38)")))
    assert [(p.lat, p.lon) for p in good] == [(41.8781, -87.6298), (38.6270, -90.1994), (38.0, -91.0)]
    for bad in ("POINT(1 2)", "LINESTRING(a b, 1 2)", "", "LINESTRING(1 2"):
        assert one(spark, geo.parse_linestring(F.lit(bad))) is None


def test_record_sections_need_all_parts(spark):
    schema = S.UNIFIED
    row = {f.name: None for f in schema.fields} | {"record_type": "load", "origin_city": "A", "destination_city": "B", "distance_miles": 12.0, "description": "late"}
    df = spark.createDataFrame([tuple(row[f.name] for f in schema.fields)], schema)
    assert df.select(S.record_sentence().alias("x")).first().x == "Record type: load. Route: A → B, 12.00 miles. Notes: late."
    assert df.select(S.record_sentence_typed().alias("x")).first().x.startswith("Load unknown: A → B, 12.00 miles, revenue $unknown")
    assert "truck_id" not in df.select(S.chunk_metadata().alias("x")).first().x
