import os
import uuid

import pytest
from pyspark.sql import functions as F

from midmile.operators import gate as G
from midmile.operators import spatial
from midmile.plans import medallion as M
from midmile.runtime import fresh_path


def put(folder, name, text, encoding="utf-8"):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "w", encoding=encoding) as f:
        f.write(text)
    return f"{folder}/{name}"


@pytest.fixture(scope="module")
def layers(spark):
    names = []
    for layer in ("bronze", "silver"):
        db = f"{layer}_{uuid.uuid4().hex}"
        spark.sql(f"CREATE DATABASE {db} LOCATION '{fresh_path(spark, db)}'")
        names.append(db)
    return names


def test_files_to_verified_silver_tables(spark, layers):
    bronze, silver = layers
    src = fresh_path(spark, "files")
    accidents = put(src, "acc.csv", "ID,Severity,Start_Time,Start_Lat,Start_Lng,Distance(mi),City,State\nA-1,2,2023-02-08 05:46:00,39.8,-84.0,0.01,Dayton,OH\nA-2,4,2023-02-08 05:59:59,39.8,-84.0,0.01,Dayton,OH\nA-3,bad,2023-02-08 06:07:00,,,0.01,Dayton,OH\n")
    bridges = put(src, "nbi.csv", "STATE_CODE_001,STRUCTURE_NUMBER_008,FEATURES_DESC_006A,VERT_CLR_OVER_MT_053,OPERATING_RATING_064,LATDD,LONGDD,BRIDGE_CONDITION\n39,00012A ,Creek,4.57,36.0,39.80,-84.00,G\n39,B2,River,N,,,,F\n")
    orders = put(src, "dataco.csv", 'Order Id,order date (DateOrders),shipping date (DateOrders),Shipping Mode,Days for shipping (real),Days for shipment (scheduled),Late_delivery_risk\n1,1/31/2018 22:56,2/3/2018 22:56,Día estándar,3,4,0\n2,1/13/2018 12:27,1/18/2018 12:27,Día estándar,5,4,1\n', "latin-1")
    weather = "STATION,DATE,LATITUDE,LONGITUDE,ELEVATION,NAME,TEMP,T,DEWP,D,SLP,S,STP,P,VISIB,V,WDSP,W,MXSPD,GUST,MAX,X,MIN,N,PRCP,R,SNDP,FRSHTT\n"
    cells = lambda day, prcp, sndp: f'010010,{day},70.9,-8.6,9.0,"JAN MAYEN, NO",24.0,24,20,24,1000,24,999,24,6.2,6,10,24,20,30,30," ",20,*,{prcp},G,{sndp},001000\n'
    station = put(src, "gsod.csv", weather + cells("01/05/2023", 60.0, 999.9) + cells("2024-01-01", 0.0, 12.0) + cells("01/05/2019", 99.0, 1.0))
    ops = fresh_path(spark, "ops")
    put(ops, "loads.csv", "Load ID,Origin City,Destination City,Distance Miles,Revenue,Total Cost,Status\nL1,Chicago,St. Louis,297,4200,3100,Delivered\nL2,Chicago,,12,100,90,\n")
    put(ops, "drivers.csv", "Driver ID,Notes\nD1,night shifts\n")

    for _ in range(2):  # a second run replaces the first
        M.ingest_accidents(spark, accidents, bronze)
        M.ingest_bridges(spark, bridges, bronze)
        M.ingest_orders(spark, orders, bronze)
        M.ingest_weather(spark, station, bronze)
        M.ingest_operations(spark, ops, bronze)
        M.preprocess_accidents(spark, bronze, silver)
        M.preprocess_bridges(spark, bronze, silver)
        M.preprocess_orders(spark, bronze, silver)
        M.preprocess_weather(spark, bronze, silver, [2023, 2024])
        M.preprocess_operations(spark, bronze, silver)

    heat = {str(r.hour): (r.incident_count, r.avg_severity) for r in spark.table(f"{silver}.risk_heatmap").collect()}
    assert heat == {"2023-02-08 05:00:00": (2, 3.0), "2023-02-08 06:00:00": (1, None)}
    geo = {r.bridge_id.strip(): r for r in spark.table(f"{silver}.bridge_inventory_geo").collect()}
    assert geo["00012A"].location.lat == 39.8 and geo["B2"].location is None and geo["B2"].clearance_mt is None
    clean = {r.order_id: r for r in spark.table(f"{silver}.cleaned_logistics").collect()}
    assert (clean["1"].shipping_mode, clean["1"].delay_days, clean["2"].late_delivery_risk_score) == ("Día estándar", -1, 1)
    assert str(clean["1"].order_date) == "2018-01-31" and clean["1"].delay_propensity == 4.0 and clean["1"].delivery_date is None
    alerts = {str(r.date): r.weather_alert for r in spark.table(f"{silver}.weather_alerts").collect()}
    assert alerts == {"2023-01-05": "Heavy precipitation expected", "2024-01-01": "Significant snowfall"}
    chunks = {r.chunk_id: r for r in spark.table(f"{silver}.logistics_vectorized").collect()}
    assert set(chunks) == {"load_0", "load_1", "driver_0"} and len(chunks["load_0"].embedding) == 768
    assert "Route: Chicago → St. Louis, 297.00 miles." in chunks["load_0"].text_content
    assert "Route" not in chunks["load_1"].text_content and "night shifts" in chunks["driver_0"].text_content

    report = M.verify(spark, silver, {"risk_heatmap": 1, "bridge_inventory_geo": 3})
    failed = [(r.table, r.check) for r in report.where("status = 'FAIL'").collect()]
    assert failed == [("bridge_inventory_geo", "min_rows")]

    routes = spark.createDataFrame([(1, [{"lat": 39.7, "lon": -84.0}, {"lat": 39.9, "lon": -84.0}])], "route_id int, points array<struct<lat:double,lon:double>>")
    hits = G.bridge_hits(routes, spark.table(f"{silver}.bridge_inventory_geo"), 100.0)
    vehicle = spark.createDataFrame([(1, 1, 40.0, 4.0)], "request_id int, route_id int, vehicle_weight_tons double, vehicle_height_mt double")
    assert G.bridge_verdict(vehicle, hits).first().verdict == "HARD_VETO"


def test_no_operation_file_is_an_error(spark, layers):
    with pytest.raises(FileNotFoundError):
        M.ingest_operations(spark, fresh_path(spark, "nothing"), layers[0])
