"""CSV, Parquet and JSON in and out."""

import json
from datetime import date, datetime
from decimal import Decimal

import pytest

from revspan import METRICS, Calendar, MetricSuite
from revspan.sources import tables as io
from revspan.sources.schemas import TABLES
from revspan.sources.shared import stored
from tests.conftest import make_tables


def write(path, text):
    path.write_text(text)
    return str(path)


def test_accounts_csv_is_positional_and_keeps_text_ids(spark, tmp_path):
    path = write(tmp_path / "a.csv", (
        "some,other,header,names,here,are,ignored,x,y,z\n"
        "007,Acme,DevTools,US,2023-01-05,ads,Pro,12,True,False\n"
        '008,"Say ""hi"", Ltd",,"",2023-02-01,,Basic,,False,\n'
    ))
    a, b = io.read_table_csv(spark, path, TABLES["accounts"]).orderBy("account_id").collect()
    assert (a.account_id, a.signup_date, a.seats, a.is_trial) == ("007", date(2023, 1, 5), 12, True)
    assert b.account_name == 'Say "hi", Ltd'
    assert b.industry is None and b.country == "" and b.seats is None and b.churn_flag is None


def test_money_is_rounded_to_cents_half_up(spark, tmp_path):
    path = write(tmp_path / "s.csv", (
        "h\n"
        "s1,a1,2023-01-01,,Pro,1,12.345,100,False,False,False,False,monthly,True\n"
    ))
    r = io.read_table_csv(spark, path, TABLES["subscriptions"]).first()
    assert r.mrr_amount == Decimal("12.35") and r.end_date is None


def test_malformed_rows_fail(spark, tmp_path):
    path = write(tmp_path / "s.csv", "h\ns1,a1,not-a-date,,Pro,1,1,1,,,,,,\n")
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        io.read_table_csv(spark, path, TABLES["subscriptions"]).collect()


def test_free_text_may_hold_line_breaks(spark, tmp_path):
    path = write(tmp_path / "c.csv", (
        "h\n"
        'e1,a1,2023-03-01,price,10.00,True,False,False,"too dear,\nsaid ""Bob"""\n'
        "e2,a1,2023-04-01,,,,,,\n"
    ))
    rows = io.read_table_csv(spark, path, TABLES["churn_events"]).orderBy("churn_event_id").collect()
    assert rows[0].feedback_text == 'too dear,\nsaid "Bob"' and rows[1].feedback_text is None


def test_tickets_hold_local_timestamps(spark, tmp_path):
    path = write(tmp_path / "t.csv", (
        "h\nt1,a1,2023-01-01 10:30:00,,1.5,high,12,4.0,False\n"
    ))
    r = io.read_table_csv(spark, path, TABLES["support_tickets"]).first()
    assert r.submitted_at == datetime(2023, 1, 1, 10, 30) and r.closed_at is None
    assert r.satisfaction_score == Decimal("4.0")


def test_usage_gets_a_stored_unique_key(spark, tmp_path):
    path = write(tmp_path / "u.csv", "h\n" + "u1,s1,2023-01-01,f,1,2,0,False\n" * 5)
    target = str(tmp_path / "usage")
    for _ in range(2):  # a refresh replaces the table
        df = io.load_table(spark, path, TABLES["feature_usage"], target)
    assert df.count() == 5 and df.select("usage_pk").distinct().count() == 5


def test_missing_outputs_are_none(spark, tmp_path):
    assert io.read_metric_csv(spark, str(tmp_path / "none"), [("a", "int")]) is None
    schema = spark.range(1).schema
    assert io.read_documents(spark, str(tmp_path / "none"), schema) is None
    assert io.read_pretty_document(spark, str(tmp_path / "none.json"), schema) is None


def test_pretty_document(spark, tmp_path):
    path = write(tmp_path / "d.json", json.dumps({"id": 7}, indent=2))
    assert io.read_pretty_document(spark, path, spark.range(1).schema).first().id == 7


@pytest.fixture(scope="module")
def suite(spark):
    tables = make_tables(
        spark, [("a", "X", "Pro", True), ("b", "Y", "Basic", False)],
        [("1", "a", "01-10", "03-20", 100), ("2", "b", "02-01", None, 50, "Basic")],
    )
    return MetricSuite(tables, Calendar.between("2023-01-01", "2023-06-01")).with_stored_spans()


def test_exported_metrics_read_back(spark, suite, tmp_path):
    suite.export_csv(str(tmp_path))
    for name in METRICS:
        metric = suite.run(name)
        back = io.read_metric_csv(spark, str(tmp_path / name), metric.schema)
        assert sorted(map(str, back.collect())) == sorted(map(str, metric.collect())), name
    assert suite.run("mrr_waterfall").count() == 6


def test_exported_snapshots_read_back(spark, suite, tmp_path):
    suite.export_snapshots(str(tmp_path / "snapshots"))
    back = io.read_documents(spark, str(tmp_path / "snapshots"), suite.snapshots.schema)
    assert sorted(map(str, back.collect())) == sorted(map(str, suite.snapshots.collect()))


def test_month_partitions_are_pruned(spark, suite, tmp_path):
    path = str(tmp_path / "by_month")
    io.write_by_month(suite.by_attribute, path)
    one = spark.read.parquet(path).where("month_start = '2023-02-01'")
    assert one.count() == 2
    assert "PartitionFilters: [isnotnull(month_start" in one._jdf.queryExecution().toString()


def test_stored_tables_live_in_the_shared_folder(spark):
    df = stored(spark.range(3), "three")
    folder = spark.conf.get("spark.checkpoint.dir")
    assert df.count() == 3 and all(folder in f for f in df.inputFiles())
