"""Schemas at the boundary, snapshots, sinks and the two jobs."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from fixtures import project as p
from fixtures.project import AS_OF, CONFIG, LOW_VOLUME
from seqpulse.operators import feed as feeds
from seqpulse.plans import run_alerts, run_digest, run_marts
from seqpulse.session import durable
from seqpulse.sources import SCHEMAS, conform, read_feed, read_tables, snapshot, validate, write_csv, write_feed

SF = "/root/testdata/sf0.001"
NAMES = ("checkpoints", "steps", "comms", "email_msgs", "activity", "eligible", "leads", "account_map", "changes")


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stored")
    source = p.Source(spark, SF)
    for name in NAMES:
        getattr(source, name).write.parquet(f"{folder}/{name}")
    return {name: f"{folder}/{name}" for name in NAMES}


def test_projection_has_the_fixed_schemas(spark, stored):
    tables = read_tables(spark, stored)
    for name in NAMES:
        assert validate(getattr(tables, name), name) is getattr(tables, name)


def test_validate_names_what_is_wrong(make):
    df = make("leads", []).drop("status").withColumn("id", F.lit(1))
    with pytest.raises(ValueError, match="id: int instead of string; status: missing"):
        validate(df, "leads")
    assert validate(df, "leads", ["lost_lead_reason__c"]) is df


def test_zone_less_times_become_instants(spark):
    raw = spark.sql("SELECT 'a' AS id, 'f' AS field, 'x' AS old_value, 'y' AS new_value, TIMESTAMP_NTZ '2024-01-01 10:00:00' AS changed_at")
    assert conform(raw, "changes").schema["changed_at"].dataType.typeName() == "timestamp"
    with pytest.raises(ValueError, match="missing changed_at"):
        conform(raw.drop("changed_at"), "changes")


def test_tables_from_csv_and_catalog(spark, stored, tmp_path):
    leads = spark.read.parquet(stored["leads"])
    write_csv(leads, f"{tmp_path}/leads")
    back = read_tables(spark, {"leads": f"{tmp_path}/leads"}, "csv", header=True).leads
    assert back.schema == SCHEMAS["leads"] and back.count() == leads.count()
    leads.createOrReplaceTempView("crm_leads")
    assert read_tables(spark, {"leads": "crm_leads"}).leads.count() == leads.count()


def test_snapshot_cuts_every_table(spark, stored):
    cut = read_tables(spark, stored).as_of(AS_OF)
    assert cut.activity.agg(F.max("activity_date")).first()[0] <= AS_OF
    assert cut.checkpoints.agg(F.max(F.to_date("event_timestamp"))).first()[0] <= AS_OF
    assert cut.steps.agg(F.max(F.to_date("result_date_time__c"))).first()[0] <= AS_OF
    assert cut.leads.count() == spark.read.parquet(stored["leads"]).count()


def test_alert_job_replaces_its_own_run_only(spark, stored, tmp_path):
    tables = read_tables(spark, stored)
    out = str(tmp_path)
    run_alerts(spark, tables, AS_OF, LOW_VOLUME, out)
    run_alerts(spark, tables, AS_OF + timedelta(days=1), LOW_VOLUME, out, previous_day=AS_OF)
    again = run_alerts(spark, tables, AS_OF, LOW_VOLUME, out)
    per_run = {r.run_date: r["count"] for r in again.groupBy("run_date").count().collect()}
    assert set(per_run) == {AS_OF, AS_OF + timedelta(days=1)}
    direct = feeds.alert_feed(tables, AS_OF, LOW_VOLUME)
    assert per_run[AS_OF] == direct.count() == direct.select("id").distinct().count() > 0
    tomorrow = feeds.alert_feed(tables, AS_OF + timedelta(days=1), LOW_VOLUME)
    carried = again.filter(F.col("run_date") > F.lit(AS_OF)).drop("run_date")
    assert sorted(map(str, carried.collect())) == sorted(map(str, tomorrow.collect()))
    history = feeds.upsert(again.filter(F.col("run_date") == F.lit(AS_OF)), again.filter(F.col("run_date") != F.lit(AS_OF)))
    assert history.count() == again.select("id").distinct().count()


def test_digest_job(spark, make, tmp_path):
    day = date(2024, 6, 5)
    base = {"check_name": "Double Starts", "check_number": 2, "detail": "d", "metric_value": 0.5, "reference_value": 0.1}
    rows = [{**base, "id": f"2|S{i}|{day}", "cadence_id": f"S{i}", "as_of": day} for i in range(2)]
    write_feed(make("alert_feed", rows), f"{tmp_path}/alert_feed", day)
    ledger = make("alert_ledger", [{"check_number": 2, "cadence_id": "S0", "key": "", "thread": "t"}])
    run_digest(spark, day, CONFIG, str(tmp_path), ledger)
    def read(name):
        return spark.read.parquet(f"{tmp_path}/digest/{name}/run_date={day}")
    assert {r.cadence_id: r.action for r in read("actions").collect()} == {"S0": "reply", "S1": "post"}
    assert "1 of the 9 checks flagged: Double Starts" in read("digest_message").first().message
    assert read("urgent_messages").count() == 2 and read("check_overview").count() == 9
    assert read("staleness").first().is_stale is False


def test_an_empty_run_replaces_an_earlier_one(spark, make, tmp_path):
    day = date(2024, 6, 5)
    row = {"id": "1", "check_number": 1, "check_name": "x", "as_of": day}
    write_feed(make("alert_feed", [row]), f"{tmp_path}/feed", day)
    assert read_feed(spark, f"{tmp_path}/feed").first().run_date == day
    write_feed(make("alert_feed", []), f"{tmp_path}/feed", day)
    assert read_feed(spark, f"{tmp_path}/feed").count() == 0


def test_mart_job(spark, stored, tmp_path):
    run_marts(spark, read_tables(spark, stored), AS_OF, CONFIG, str(tmp_path))
    entries = spark.read.parquet(f"{tmp_path}/detail_cadence_entries")
    performance = spark.read.parquet(f"{tmp_path}/cohort_cadence_performance")
    assert entries.count() == performance.count() > 0
    assert entries.select("unique_id", "cadence_id").distinct().count() == entries.count()
    assert performance.agg(F.sum("calls_60_days")).first()[0] >= performance.agg(F.sum("calls_30_days")).first()[0] > 0
    facts = spark.read.parquet(f"{tmp_path}/fact_cadence_checkpoints")
    assert facts.count() == snapshot(spark.read.parquet(stored["checkpoints"]), "checkpoints", AS_OF).count()


def test_durable_without_a_folder_stays_lazy(spark):
    df = spark.range(3)
    if spark.sparkContext.getCheckpointDir() is None:
        assert durable(df) is df


def test_durable_uses_the_named_folder(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    kept = durable(spark.range(3))
    assert kept.count() == 3 and "Range" not in kept._jdf.queryExecution().toString()


def test_marts_replace_the_months_of_a_run_only(spark, stored, tmp_path):
    """A later run writes the months since; late rows land in theirs, and all other folders stay untouched."""
    from seqpulse import Tables

    tables = read_tables(spark, stored)
    out, before = str(tmp_path), date(2001, 5, 20)
    old_day = date(1997, 3, 9)
    is_late = F.to_date("event_timestamp").between(F.lit(old_day), F.lit(old_day + timedelta(days=9)))
    late = tables.checkpoints.filter(is_late)
    early = Tables(**{**vars(tables), "checkpoints": tables.checkpoints.filter(~is_late)})
    run_marts(spark, early, before, CONFIG, out)

    def files():
        return {f.parent.name: sorted(x.name for x in f.parent.glob("*.parquet")) for f in (tmp_path / "fact_cadence_checkpoints").glob("*/*.parquet")}

    first = files()
    run_marts(spark, tables, AS_OF, CONFIG, out, previous_day=before, late=late)
    second = files()
    touched = {f"event_dt_month={m}" for m in ("1997-03-01", "2001-05-01", "2001-06-01")}
    assert late.count() > 0 and {k for k in second if first.get(k) != second[k]} <= touched
    assert "event_dt_month=1997-03-01" in second and first.get("event_dt_month=1997-03-01") != second["event_dt_month=1997-03-01"]
    facts = spark.read.parquet(f"{out}/fact_cadence_checkpoints")
    whole = snapshot(tables.checkpoints, "checkpoints", AS_OF)
    assert facts.count() == whole.count()
    assert facts.filter("valid_entry").count() == whole.filter("cadence_step = 'Start'").count()


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from seqpulse import session

    class Elsewhere:
        conf = spark.conf
        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    if spark.conf.get("spark.checkpoint.dir", None) is None:
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            session.shared_folder(Elsewhere)
