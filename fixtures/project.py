"""The generic test tables seen as outreach data (FIXTURES.md, section 2). `projection_sql.py` says the same in SQL."""

from __future__ import annotations

from dataclasses import replace
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from seqpulse import Config
from seqpulse.sources import SCHEMAS, conform

AS_OF = date(2001, 6, 6)
AS_OF_EVENTS = date(2024, 1, 24)

CONFIG = Config(
    internal_domains=("internal.example",),
    recurring_substrings=("Recurring",),
    quiet_substrings=("Warming",),
    name_prefixes=("Pre-Enroll:", "Post-Enroll:"),
)
# weekly volumes are small here: a lower floor keeps the comparison from being between two empty sets
LOW_VOLUME = replace(CONFIG, min_mean=1.0, recent_days=182)


class Source:
    """The projected tables of one folder; each is built when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._sf_dir, self._read = spark, sf_dir, {}

    def read(self, name: str) -> DataFrame:
        if name not in self._read:
            self._read[name] = self._spark.read.parquet(f"{self._sf_dir}/{name}.parquet")
        return self._read[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name not in BUILDERS:
            raise AttributeError(name)
        frame = BUILDERS[name](self)
        setattr(self, name, frame)
        return frame


def _text(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def _orders(src: Source) -> DataFrame:
    customer = F.col("o_custkey")
    name = (
        F.when(customer % 40 == 0, "Demo Attendance")
        .when(F.startswith("o_orderpriority", F.lit("1")), "Pre-Enroll: Inbound")
        .when(F.startswith("o_orderpriority", F.lit("2")), "Pre-Enroll: Inbound Demo")
        .when(F.startswith("o_orderpriority", F.lit("3")), "Post-Enroll: Upsell")
        .when(F.startswith("o_orderpriority", F.lit("4")), "Post-Enroll: Warming")
        .otherwise("Recurring Survey")
    )
    domain = F.when(customer % 50 == 1, "internal.example").when(customer % 50 == 2, "placeholder.example").otherwise("pro.example")
    return src.read("orders").withColumns({
        "seq": name, "mail": F.concat(F.lit("u"), _text("o_custkey"), F.lit("@"), domain),
    })


def checkpoints(src: Source) -> DataFrame:
    key, customer, status = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderstatus")
    step = (
        F.when(status == "O", "Start").when(status == "F", "Exit")
        .when(key % 4 == 0, "Test").when(key % 4 == 1, "Break")
        .when(key % 23 == 0, "call disposition").otherwise("Call Disposition")
    )
    reason = (
        F.when(key % 5 == 0, "enrolled").when(key % 5 == 1, "lost").when(key % 5 == 2, "LDS")
        .when(key % 5 == 3, "sequence end").otherwise("Cadence break - no task created")
    )
    before, after = F.startswith("seq", F.lit("Pre-")), F.startswith("seq", F.lit("Post-"))
    return conform(
        src.orders.withColumn("step", step).select(
            F.when(key % 101 != 0, F.col("mail")).alias("email"),
            F.when(before & (customer % 13 != 0), F.concat(F.lit("00Q"), _text("o_custkey"))).alias("lead_id"),
            F.when(after | (before & (customer % 4 == 0)), _text("o_custkey")).alias("user_id"),
            F.when(F.col("seq") == "Demo Attendance", F.concat(F.lit("org"), _text(F.floor(customer / 3)))).alias("anonymous_id"),
            F.concat(F.when(key % 53 == 0, "00Q").otherwise("a1n"), _text("o_custkey")).alias("object_record_id"),
            F.concat(F.when(key % 7 == 0, "  ").otherwise(""), F.col("seq"), F.when(key % 11 == 0, " ").otherwise("")).alias("cadence_id"),
            F.col("step").alias("cadence_step"),
            F.when((F.col("step") == "Call Disposition") & (key % 4 == 2), "Break")
            .when(key % 17 == 0, "success").otherwise("Success").alias("cadence_step_status"),
            F.when(F.col("step") == "Exit", reason).when(F.col("step") == "Test", "Control group: held out")
            .when(F.col("step") == "Break", "No call made").alias("cadence_step_value"),
            _text(key % 39).alias("workflow_id"),
            F.concat(F.lit("g"), _text(customer % 2)).alias("entry_group"),
            F.col("o_orderdate").alias("event_timestamp"),
            F.concat(F.lit("r"), _text(key % 9)).alias("rep_id"), F.concat(F.lit("s"), _text(customer % 7)).alias("sdr_id"),
            F.concat(F.lit("Rep "), _text(customer % 7)).alias("sdr_name"), F.when(key % 3 > 0, F.concat(F.lit("pod "), _text(key % 3))).alias("sdr_pod_role"),
            F.when(key % 6 == 0, F.concat(F.lit("o"), _text("o_orderkey"))).alias("opportunity_id"), F.concat(F.lit("c"), _text(key % 12)).alias("case_id"),
            F.concat(F.lit("w"), _text(key % 5)).alias("case_owner_id"), _text(key % 4).alias("cadence_time_required"),
        ),
        "checkpoints",
    )


def checkpoints_ev(src: Source) -> DataFrame:
    kind = F.col("event_type")
    step = (
        F.when(kind == "signup", "Start").when(kind == "purchase", "Exit").when(kind == "error", "Break")
        .when(kind == "view", "Test").otherwise("Call Disposition")
    )
    none = F.lit(None).cast("string")
    return conform(
        src.read("events").select(
            F.concat(F.lit("e"), _text("user_id"), F.lit("@pro.example")).alias("email"),
            none.alias("lead_id"), _text("user_id").alias("user_id"), none.alias("anonymous_id"),
            F.concat(F.lit("a1n"), _text("user_id")).alias("object_record_id"),
            F.concat(F.lit("Seq "), _text(F.col("user_id") % 5)).alias("cadence_id"),
            step.alias("cadence_step"), F.lit("Success").alias("cadence_step_status"), none.alias("cadence_step_value"),
            _text(F.col("event_id") % 7).alias("workflow_id"),
            F.concat(F.lit("g"), _text(F.col("user_id") % 2)).alias("entry_group"),
            F.col("ts").alias("event_timestamp"),
        ),
        "checkpoints",
    )


def _lines(src: Source) -> DataFrame:
    return src.read("lineitem").join(
        src.orders.select("o_orderkey", "o_custkey", "seq", "mail"), F.col("l_orderkey") == F.col("o_orderkey")
    )


def steps(src: Source) -> DataFrame:
    flag = F.col("l_returnflag")
    result = (
        F.when(flag == "A", "Displayed")
        .when((flag == "R") & (F.col("l_partkey") % 10 == 0), "")
        .when((flag == "R") & (F.col("l_partkey") % 2 == 0), "No contact - No Voicemail")
        .when(flag == "R", "No contact - No voicemail")
    )
    return conform(
        src.lines.select(
            F.col("seq").alias("cadence_id__c"),
            F.when(F.col("l_linenumber") <= 5, "Call attempt").otherwise("Email").alias("step_id__c"),
            F.lit("Lead").alias("object_type__c"),
            F.concat(F.lit("00Q"), _text("o_custkey")).alias("object_record_id__c"),
            F.col("l_shipdate").alias("createddate"),
            result.alias("result__c"),
            F.when(flag.isin("A", "R"), F.col("l_shipdate") + F.make_dt_interval(F.col("l_linenumber"))).alias("result_date_time__c"),
            F.col("mail").alias("email__c"),
            F.when(F.col("l_suppkey") % 10 == 0, "clear_step").otherwise("step").alias("name"),
        ),
        "steps",
    )


def _comm_id() -> Column:
    return _text(F.col("l_orderkey") * 10 + F.col("l_linenumber"))


def comms(src: Source) -> DataFrame:
    line = F.col("l_linenumber") % 3
    none = F.lit(None).cast("string")
    return conform(
        src.lines.select(
            _comm_id().alias("comm_id"),
            F.when(line == 0, "email").when(line == 1, "sms").otherwise("push notification").alias("comm_type"),
            none.alias("campaign_id"), none.alias("campaign_name"),
            _text(F.col("l_suppkey") % 50 + 30).alias("workflow_id"),
            F.concat(_text(F.col("l_partkey") % 3), F.lit("Q "), F.col("seq"), F.lit(" - v"), _text(F.col("l_suppkey") % 2)).alias("workflow_name"),
            _text("o_custkey").alias("pro_uuid"), F.concat(F.lit("00Q"), _text("o_custkey")).alias("lead_id"),
            F.col("l_shipdate").alias("comm_date"),
        ),
        "comms",
    )


def email_msgs(src: Source) -> DataFrame:
    return src.lines.select(_comm_id().alias("message_id"), F.col("mail").alias("pro_email_address")).distinct()


def activity(src: Source) -> DataFrame:
    line = F.col("l_linenumber")
    flags = {
        "call_flag": line >= 1, "connected_call_flag": line >= 2, "contact_call_flag": line >= 3,
        "conversation_call_flag": line >= 4, "demo_created_flag": line >= 5, "demo_attended_flag": line == 6,
        "enroll_flag": (line == 6) & (F.col("l_quantity") > 25),
    }
    made = {
        "activity_id": F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.to_date("l_shipdate"), "l_extendedprice"),
        "lead_id": F.when(line % 2 == 0, F.concat(F.lit("00Q"), _text("o_custkey"))),
        "account_id": F.when(line % 3 == 0, F.concat(F.lit("A"), _text(F.floor(F.col("o_custkey") / 3)))),
        "activity_date": F.to_date("l_shipdate"),
        "enroll_type": F.when(F.col("l_returnflag") == "N", "Type 3").when(F.col("l_returnflag") == "A", "Lite").otherwise("Type 2"),
        **flags,
    }
    return src.lines.select(
        *[made.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in SCHEMAS["activity"].fields]
    )


def account_map(src: Source) -> DataFrame:
    org = _text(F.floor(F.col("c_custkey") / 3))
    return src.read("customer").select(
        _text("c_custkey").alias("pro_uuid"), org.alias("organization_id"), F.concat(F.lit("A"), org).alias("account_id")
    )


def leads(src: Source) -> DataFrame:
    key = F.col("c_custkey")
    status = F.when(key % 4 == 0, "New").when(key % 4 == 1, "Exhausted").when(key % 4 == 2, "Lost Lead").otherwise("Working")
    return src.read("customer").select(
        F.concat(F.lit("00Q"), _text("c_custkey")).alias("id"), status.alias("status"),
        F.when(key % 6 == 0, "Not Ready").alias("lost_lead_reason__c"),
    )


def eligible(src: Source) -> DataFrame:
    made = {
        "eligible_dt": F.to_date("o_orderdate"), "id": _text("o_custkey"),
        "lead_specialization_segment": F.col("c_mktsegment"),
        "object_type": F.when(F.col("o_custkey") % 2 == 0, "Lead").otherwise("Account"),
        "assigned_flag": F.col("o_orderkey") % 2,
    }
    joined = src.read("orders").join(src.read("customer"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.select(*[made.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in SCHEMAS["eligible"].fields])


def changes(src: Source) -> DataFrame:
    none = F.lit(None).cast("string")
    return conform(
        src.read("events").select(
            _text("user_id").alias("id"), F.col("event_type").alias("field"), none.alias("old_value"),
            none.alias("new_value"), F.col("ts").alias("changed_at"),
        ),
        "changes",
    )


BUILDERS = {
    "orders": _orders, "lines": _lines,
    "checkpoints": checkpoints, "checkpoints_ev": checkpoints_ev, "steps": steps, "comms": comms,
    "email_msgs": email_msgs, "activity": activity, "eligible": eligible, "leads": leads,
    "account_map": account_map, "changes": changes,
}
