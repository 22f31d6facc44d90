"""Readers, joins, streams and the query registry."""

import os
from datetime import date, datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidebar.operators import quality, series
from tidebar.plans.preprocess import preprocess
from tidebar.sources import ingest
from tidebar.streaming import bars as sbars, monitors as smon


def test_csv_scan(spark, tmp_path):
    for name, rows in (("EURUSD", ["0,2020-01-02,1,2,0.5,1.5,10,0,0", "1,2020-01-03,1,2,0.5,,10,0,0"]), ("Oro_H4", ["0,2020-01-02 04:00:00,1,2,0.5,9.5,10,0,0"])):
        (tmp_path / f"{name}_daily.csv").write_text("Unnamed: 0,time,open,high,low,close,tick_volume,real_volume,spread\n" + "\n".join(rows) + "\n")
    got = {(r.symbol, r.close, r.time) for r in ingest.read_bar_csv(spark, str(tmp_path)).collect()}
    assert got == {("EURUSD", 1.5, datetime(2020, 1, 2)), ("Oro_H4", 9.5, datetime(2020, 1, 2, 4))}


def test_series_json(spark, tmp_path):
    (tmp_path / "2020.json").write_text('{"serie": [{"fecha": "2020-05-01T04:00:00.000Z", "valor": 0.5}, {"fecha": "2020-01-01T03:00:00.000Z", "valor": 1.75}]}')
    got = ingest.read_series_json(spark, str(tmp_path)).orderBy("date").collect()
    assert [(r.date, r.TPM) for r in got] == [(date(2020, 1, 1), 1.75), (date(2020, 5, 1), 0.5)]


def test_gap_of_31_days(spark):
    days = [date(2020, 1, 1), date(2020, 1, 2), date(2020, 2, 2), date(2020, 2, 3), date(2020, 3, 4)]
    d = series.with_bar_idx(spark.createDataFrame([("A", t) for t in days], "symbol string, time date"))
    assert [r.time for r in quality.newest_segment(d).orderBy("time").collect()] == days[2:]
    row = quality.continuity(d).first()
    assert row.max_gap == 31 and row.has_gap and row.n_rows == 5


def test_duplicate_times_keep_last_batch(spark):
    old = spark.createDataFrame([("A", date(2020, 1, 1), 1.0), ("A", date(2020, 1, 2), 2.0)], "symbol string, time date, close double")
    new = spark.createDataFrame([("A", date(2020, 1, 2), 9.0)], "symbol string, time date, close double")
    assert {(r.time.day, r.close) for r in ingest.upsert(old, new).collect()} == {(1, 1.0), (2, 9.0)}


def test_intraday_macro_has_no_holes(spark):
    times = pd.date_range("2020-01-01", periods=12, freq="4h")
    b = spark.createDataFrame(pd.DataFrame({"symbol": "A", "time": times, "bar_idx": range(12), "n_bars": 12, "close": 1.0}))
    m = spark.createDataFrame([(date(2020, 1, 1), 15.0), (date(2020, 1, 2), 18.0), (date(2020, 1, 2), 18.0)], "date date, VIX_close double")
    got = ingest.join_macro(b, m, ["VIX_close"])
    assert got.count() == 12 and got.filter("VIX_close is null").count() == 0


def test_leading_holes_need_backfill(spark):
    b = spark.createDataFrame(pd.DataFrame({"symbol": "A", "time": pd.date_range("2020-01-01", periods=4).date, "bar_idx": range(4), "n_bars": 4}))
    m = spark.createDataFrame([(date(2020, 1, 3), 7.0)], "date date, v double")
    assert ingest.join_macro(b, m, ["v"]).filter("v is null").count() == 0
    assert ingest.join_macro(b, m, ["v"], backfill=False).filter("v is null").count() == 2


def test_asof_keeps_left_rows(spark):
    left = spark.createDataFrame([(date(2020, 1, d),) for d in (1, 5, 9)], "time date")
    right = spark.createDataFrame([(date(2020, 1, 5), 1.0), (date(2020, 1, 7), 2.0)], "time date, v double")
    got = [r.v for r in ingest.asof_backward(left, right, ["v"]).orderBy("time").collect()]
    assert got == [1.0, 1.0, 2.0]


def test_business_days(spark):
    assert ingest.business_days(spark, "2020-01-01", "2020-01-07").count() == 5


def test_status_events_only_on_change(spark):
    old = spark.createDataFrame([("a", True, False), ("b", False, False), ("c", False, True)], smon.STATUS)
    new = spark.createDataFrame([("a", True, False), ("b", True, False), ("c", False, False), ("d", False, True)], smon.STATUS)
    assert {(r.symbol, r.event) for r in smon.status_events(old, new).collect()} == {("b", "quarantine"), ("c", "drift_over"), ("d", "drift")}


def test_monitor_job_over_two_batches(spark, tmp_path):
    table = smon.VersionedTable(spark, str(tmp_path / "state"), smon.STATUS)
    job = smon.monitor_job(lambda b: b, table, str(tmp_path / "events"))
    job(spark.createDataFrame([("a", True, False)], smon.STATUS), 0)
    job(spark.createDataFrame([("a", False, False), ("b", False, True)], smon.STATUS), 1)
    got = {(r.symbol, r.event, r.batch_id) for r in spark.read.parquet(str(tmp_path / "events")).collect()}
    assert got == {("a", "quarantine", 0), ("a", "lift", 1), ("b", "drift", 1)}
    assert table.current().count() == 2


def test_recalibration_waits_for_thirty(spark):
    live = spark.createDataFrame([("a", i, 0.01 if i % 3 else -0.02) for i in range(65)] + [("b", i, 0.01) for i in range(29)], smon.LIVE)
    got = smon.recalibrate(spark.createDataFrame([], smon.LIVE), live, n_sims=50).collect()
    assert [(r.symbol, r.n_live) for r in got] == [("a", 60)]
    assert 0.01 <= got[0].optimal_risk_pct <= 0.0675 and got[0].kill_switch_mdd <= -0.20


def test_stream_equals_batch_bars(spark):
    from conftest import SF
    from tidebar.session import scratch_path
    from tidebar.sources import market
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    out = sbars.drain(sbars.stream_bars(sbars.tick_stream(spark, SF)), scratch_path(spark, "t"))
    batch = ingest.bars_from_ticks(market.ticks(spark, SF)).select(*out.columns)
    extra = out.exceptAll(batch).count()
    assert extra == 0 and 0 < batch.count() - out.count() <= 5


def test_preprocess_end_to_end(spark):
    from conftest import walk
    pdf = pd.concat([walk(5, 1300, 0.0, 0.006, 100.0, "AAA"), walk(6, 1250, 0.0, 0.006, 50.0, "BBB")]).drop(columns=["EGARCH_Vol"])
    d = preprocess(spark.createDataFrame(pdf), ["open", "close"]).toPandas()
    assert set(d["symbol"]) == {"AAA", "BBB"} and {"Label", "RSI", "EGARCH_Vol", "close_FFD", "open_FFD"} <= set(d.columns)
    assert not d[["RSI", "EGARCH_Vol", "close_FFD"]].isna().any().any()


def test_registry_and_smoke(spark):
    import __spark_entry__ as entry
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 120
    assert entry.entry(spark).count() > 0


duckdb = pytest.importorskip("duckdb")
CHECKED = ["s4_bars_from_ticks", "p2_gap_segment", "j3_asof_join", "w5_add_indicators", "w14_triple_barrier_label", "w16_non_overlapping_trades",
           "a17_cpcv_audit", "w22_journal_equity", "t3_position_lifecycle"]


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, name):
    import __spark_entry__ as entry
    from conftest import SF
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    got = entry.queries()[name](spark, SF).toPandas()
    want = con.execute(entry.oracle_sql()[name]).fetchdf()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    norm = lambda d: sorted(map(repr, (tuple(None if pd.isna(v) else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
                                             for v in r) for r in d[cols].astype(object).itertuples(index=False))))
    assert norm(got) == [x.replace(" 00:00:00", "") for x in norm(want)] or norm(got) == norm(want)


def test_headers_in_different_order(spark, tmp_path):
    (tmp_path / "AAA_daily.csv").write_text("time,open,close\n2020-01-01,1,2\n")
    (tmp_path / "BBB_daily.csv").write_text(",close,time,open\n0,4,2020-01-02,3\n")
    got = {r.symbol: (r.open, r.close, r.high) for r in ingest.read_bar_csv(spark, str(tmp_path)).collect()}
    assert got == {"AAA": (1.0, 2.0, None), "BBB": (3.0, 4.0, None)}


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace
    from tidebar.session import shared_dir
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        context = SimpleNamespace(master=master, getCheckpointDir=lambda: None)
        session = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=context)
        with pytest.raises(ValueError):
            shared_dir(session)


def test_extraction_takes_every_year(spark, tmp_path):
    from tidebar import catalog
    run = catalog.load().QUERIES["s3_chunked_extraction"]
    days = [datetime(1998, 1, 1), datetime(1998, 12, 31), datetime(1999, 6, 1), datetime(1999, 6, 1), datetime(2000, 1, 1), datetime(2000, 12, 31), None]

    def counted(name, days):
        (spark.createDataFrame([("A", "F", d) for d in days], "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz")
         .write.parquet(str(tmp_path / name / "lineitem.parquet")))
        return {(r.symbol, r.time): r.n_rows for r in run(spark, str(tmp_path / name)).collect()}
    assert counted("years", days) == {("AF", d.date()): days.count(d) for d in days if d}
    assert counted("one_year", days[:2]) == {("AF", d.date()): 1 for d in days[:2]}
    assert counted("none", [None]) == {}
