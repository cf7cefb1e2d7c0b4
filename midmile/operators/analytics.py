"""Heatmaps, fleet, fuel, safety, delay and log figures.

Money is summed as decimals, so results do not depend on the order of the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from midmile.functions import columns as C
from midmile.operators.ranking import top_n
from midmile.runtime import stage

FLEET_KEYS = ["truck_id", "truck_make", "truck_year", "fuel_type", "driver_name", "driver_terminal"]
FLEET_FUELS = ("Diesel", "CNG", "Electric")  # fixed values
KPI_TRUCKS, KPI_ROUTES, KPI_LOCATIONS, KPI_LOG_ROWS = 30, 25, 50, 25  # fixed values: rows behind each dashboard summary


def _mean(column: Column | str) -> Column:
    """Mean of an exact sum, so it does not depend on the order of the rows."""
    return F.sum(column).cast("double") / F.nullif(F.count(column), F.lit(0))


# ---- heatmap -----------------------------------------------------------------------


def risk_heatmap(accidents: DataFrame) -> DataFrame:
    """Incidents and mean severity by state, city and hour."""
    return accidents.groupBy("state", "city", C.hour_bucket(F.col("start_time")).alias("hour")).agg(
        F.count("*").alias("incident_count"), F.avg("severity").alias("avg_severity")
    )


def heatmap_by_city(heat: DataFrame) -> DataFrame:
    """All hours of a city together; severity weighted by incidents."""
    return heat.groupBy("state", "city").agg(
        (F.sum(F.col("incident_count") * F.col("avg_severity")) / F.sum("incident_count")).alias("avg_severity"),
        F.sum("incident_count").alias("incident_count"),
    )


def risk_score(heat: DataFrame, w_count: float = 0.5, w_sev: float = 0.5) -> DataFrame:
    """Weighted mean of min-max scaled count and severity, in [0, 1]; a constant scales to 0."""
    if not 0 < w_count + w_sev:
        raise ValueError("weights must sum to more than 0")

    ends = [f(c).alias(f"{n}_{c}") for c in ("incident_count", "avg_severity") for n, f in (("lo", F.min), ("hi", F.max))]
    bounds = heat.agg(F.struct(*ends)).scalar()

    def scaled(c: str) -> Column:
        lo, hi = bounds[f"lo_{c}"], bounds[f"hi_{c}"]
        return F.coalesce((F.col(c) - lo) / F.nullif((hi - lo).cast("double"), F.lit(0.0)), F.lit(0.0))

    both = w_count * scaled("incident_count") + w_sev * scaled("avg_severity")
    return heat.withColumn("risk_score", both / F.lit(w_count + w_sev))


def blackspots(heat: DataFrame, min_count: int = 100, n: int = 50, keys: Sequence[str] = ("state", "city")) -> DataFrame:
    """Rows with more than ``min_count`` incidents, most first; ``keys`` name a row and order ties."""
    return top_n(heat.where(F.col("incident_count") > min_count), [F.desc("incident_count")], keys, n)


def state_heatmap(heat: DataFrame, state: str) -> DataFrame:
    keys = [c for c in ("city", "hour") if c in heat.columns]
    return heat.where(F.col("state") == state).orderBy(F.desc("incident_count"), *keys)


def city_lookup(heat: DataFrame, city: str, state: str) -> DataFrame:
    """Busiest heatmap row whose city and state contain the given texts."""
    hit = heat.where(C.contains_all_ci({"city": city, "state": state}))
    return top_n(hit, [F.desc("incident_count")], ["state", "city"], 1)


def severity_histogram(accidents: DataFrame) -> DataFrame:
    return accidents.groupBy("severity").agg(F.count("*").alias("incidents"))


def alert_timeline(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("date", "weather_alert").agg(F.count("*").alias("alerts"))


def condition_rollup(bridges: DataFrame) -> DataFrame:
    """Bridges by state and condition with subtotals; ``level`` 0 = both keys, 1 = state, 3 = all."""
    return bridges.rollup("state_code", "condition").agg(
        F.count("*").alias("bridges"), F.grouping_id().cast("int").alias("level")
    )


# ---- fleet, routes, fuel -----------------------------------------------------------


def completed_trips(trips: DataFrame, fuels: Sequence[str] = FLEET_FUELS) -> DataFrame:
    return trips.where((F.col("trip_status") == "Completed") & F.col("fuel_type").isin(*fuels))


def min_group(df: DataFrame, n: int = 5, count: str = "trips") -> DataFrame:
    return df.where(F.col(count) >= n)


def fleet_table(trips: DataFrame, n: int = KPI_TRUCKS, keys: Sequence[str] = FLEET_KEYS) -> DataFrame:
    """Trucks with five or more completed trips, by revenue."""
    if missing := [k for k in keys if k not in trips.columns]:
        raise ValueError(f"trips lack {', '.join(missing)}: grouping without them would merge trucks")
    grouped = completed_trips(trips).groupBy(*keys).agg(
        F.count("*").alias("trips"),
        F.round(F.sum(F.col("actual_distance_miles").cast("decimal(18,4)")), 0).alias("total_miles"),
        F.round(_mean(F.col("average_mpg").cast("decimal(18,6)")), 2).alias("avg_mpg"),
        F.round(F.sum("revenue"), 2).alias("total_revenue"),
    )
    return top_n(min_group(grouped), [F.desc("total_revenue")], keys, n)


def fleet_kpis(trips: DataFrame, n: int = KPI_TRUCKS, keys: Sequence[str] = FLEET_KEYS) -> DataFrame:
    return fleet_table(trips, n, keys).agg(
        F.count("*").alias("total_trucks"),
        F.sum("total_revenue").alias("total_revenue"),
        F.avg("avg_mpg").alias("avg_mpg"),
    )


def route_scorecard(trips: DataFrame) -> DataFrame:
    """Loads, revenue, gross profit, margin and mileage of every route."""
    profit = F.sum("revenue") - F.sum("cost")
    return trips.groupBy("route_id").agg(
        F.count("*").alias("total_loads"),
        F.sum("revenue").alias("total_revenue"),
        profit.alias("gross_profit"),
        (profit.cast("double") / F.nullif(F.sum("revenue").cast("double"), F.lit(0.0)) * 100).alias("margin_pct"),
        _mean(F.col("average_mpg").cast("decimal(18,6)")).alias("avg_mpg"),
    )


def profitable(scorecard: DataFrame, min_loads: int = 5, min_margin: float = 0, n: int | None = KPI_ROUTES) -> DataFrame:
    """Routes above both floors; with ``n`` the most profitable ones."""
    kept = scorecard.where((F.col("total_loads") >= min_loads) & (F.col("margin_pct") >= min_margin))
    return kept if n is None else top_n(kept, [F.desc("gross_profit")], ["route_id"], n)


def route_kpis(scorecard: DataFrame, n: int = KPI_ROUTES) -> DataFrame:
    """Mean margin, revenue and mean mileage of the ``n`` most profitable routes, each route counting once."""
    return profitable(scorecard, n=n).agg(
        F.count("*").alias("total_routes"),
        F.avg("margin_pct").alias("avg_margin_pct"),
        F.sum("total_revenue").alias("total_revenue"),
        F.avg("avg_mpg").alias("avg_mpg"),
    )


def by_route(df: DataFrame, route_id: int | str) -> DataFrame:
    return df.where(F.col("route_id") == route_id)


def transit_times(trips: DataFrame, mph: Column) -> DataFrame:
    miles = F.col("actual_distance_miles")
    return trips.withColumn("transit_hours", C.transit_hours(miles, mph)).withColumn("error", C.transit_error(mph))


def fuel_by_location(fuel: DataFrame) -> DataFrame:
    """Spend, gallons and the mean of the prices paid (not spend over gallons)."""
    return fuel.groupBy("location", "location_state").agg(
        F.sum("fuel_cost").alias("total_spend"),
        F.sum(F.col("fuel_gallons").cast("decimal(18,4)")).alias("total_gallons"),
        _mean("price_per_gallon").alias("avg_price_per_gallon"),
    )


def top_fuel_locations(fuel: DataFrame, n: int = KPI_LOCATIONS) -> DataFrame:
    return top_n(fuel_by_location(fuel), [F.desc("total_spend")], ["location", "location_state"], n)


def fuel_kpis(fuel: DataFrame, n: int = KPI_LOCATIONS) -> DataFrame:
    """Spend, gallons and mean price over the ``n`` locations that spend most, each location counting once."""
    return top_fuel_locations(fuel, n).agg(
        F.sum("total_spend").alias("total_spend"),
        F.sum("total_gallons").alias("total_gallons"),
        F.avg("avg_price_per_gallon").alias("avg_price_per_gallon"),
    )


def fuel_by_state(fuel: DataFrame, n: int = KPI_LOCATIONS) -> DataFrame:
    """Spend by state over the ``n`` locations that spend most."""
    return top_fuel_locations(fuel, n).groupBy("location_state").agg(F.sum("total_spend").alias("total_spend"))


def fuel_by_route(fuel: DataFrame) -> DataFrame:
    return fuel.groupBy("route_id").agg(
        _mean("fuel_cost").alias("avg_fuel_cost"),
        _mean(F.col("fuel_gallons").cast("decimal(18,4)")).alias("avg_fuel_gallons"),
    )


# ---- safety, delays, log -----------------------------------------------------------


def safety_kpis(incidents: DataFrame) -> DataFrame:
    rate = lambda c: F.round(F.avg(C.flag01(F.col(c))) * 100, 1)
    return incidents.agg(
        F.count("*").alias("total_incidents"),
        F.round(F.sum("claim_amount"), 0).alias("total_claims"),
        rate("at_fault_flag").alias("at_fault_pct"),
        rate("injury_flag").alias("injury_pct"),
        F.round(F.sum("vehicle_damage_cost"), 0).alias("total_vehicle_damage"),
        rate("preventable_flag").alias("preventable_pct"),
    )


def safety_by_type(incidents: DataFrame) -> DataFrame:
    return (
        incidents.groupBy("incident_type")
        .agg(
            F.count("*").alias("incidents"),
            F.round(F.sum("claim_amount"), 0).alias("claims"),
            F.round(_mean("claim_amount"), 0).alias("avg_claim"),
        )
        .orderBy(F.desc("incidents"), "incident_type")
    )


def global_late_risk(shipments: DataFrame) -> DataFrame:
    return shipments.agg(F.avg(C.risk_flag(F.col("late_delivery_risk"))).alias("global_risk"))


def delay_by_mode(shipments: DataFrame) -> DataFrame:
    delay = C.delay_days(F.col("days_for_shipping_real"), F.col("days_for_shipment_scheduled"))
    return (
        shipments.groupBy("shipping_mode")
        .agg(F.avg(delay).alias("avg_delay_days"), F.count("*").alias("shipments"))
        .orderBy(F.desc("avg_delay_days"), "shipping_mode")
    )


def latest(log: DataFrame, n: int = KPI_LOG_ROWS) -> DataFrame:
    return top_n(log, [F.desc("created_at")], ["query_id"], n)


def log_summary(log: DataFrame, n: int = KPI_LOG_ROWS) -> DataFrame:
    return latest(log, n).agg(
        F.count("*").alias("total"),
        (F.avg(C.flag01(F.col("is_grounded"))) * 100).alias("grounded_pct"),
        F.avg("execution_time_ms").alias("avg_ms"),
    )


def preview(df: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    return df.orderBy(*keys).limit(n)


def latency_quantiles(
    log: DataFrame, qs: Sequence[float] = (0.5, 0.9, 0.99), value: str = "execution_time_ms"
) -> DataFrame:
    """Exact quantiles: the smallest value with at least a share ``q`` of the rows at or below it.

    Values are counted, then range-partitioned; running totals over the partitions (one
    row each) tell which of them hold a quantile, and only those are looked at value by
    value. Use ``approx_quantiles`` where an estimate will do.
    """
    counts = log.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(
        F.count("*").alias("n")
    )
    placed = stage(counts.repartitionByRange("v").withColumn("part", F.spark_partition_id()), "value-counts")
    sums = placed.groupBy("part").agg(F.sum("n").alias("n"))
    run = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)  # one row per partition
    total = placed.agg(F.sum("n")).scalar()
    homes = (
        sums.select("part", F.sum("n").over(run).alias("upto"), "n")
        .withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in qs])))
        .withColumn("rank", F.greatest(F.lit(1), F.ceil(F.col("q") * total)))
        .where((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("n") < F.col("rank")))
        .select("part", "q", "rank", (F.col("upto") - F.col("n")).alias("before"))
    )
    within = Window.partitionBy("q").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    # homes has one row per quantile
    found = placed.join(F.broadcast(homes), "part").withColumn("upto", F.col("before") + F.sum("n").over(within))
    return found.where(F.col("upto") >= F.col("rank")).groupBy("q").agg(F.min("v").alias("value"))


def approx_quantiles(log: DataFrame, qs: Sequence[float] = (0.5, 0.9, 0.99), value: str = "execution_time_ms") -> DataFrame:
    est = F.percentile_approx(value, [float(q) for q in qs], 10_000)
    pairs = F.arrays_zip(F.array(*[F.lit(float(q)) for q in qs]).alias("q"), F.col("value"))
    return log.agg(est.alias("value")).select(F.inline(pairs))


def enrich_ops(fact: DataFrame, dims: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Left-join dimensions on their key: ``{foreign key: (dimension, primary key)}``.

    Whether a dimension is broadcast is left to its size.
    """
    for fk, (dim, pk) in dims.items():
        fact = fact.join(dim, fact[fk] == dim[pk], "left").drop(dim[pk])
    return fact
