"""Fixed input schemas, checked at the boundary. Nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

_STRING, _TS, _DATE, _INT = T.StringType(), T.TimestampType(), T.DateType(), T.IntegerType()
_MONEY = T.DecimalType(18, 2)


def _schema(*groups: tuple[T.DataType, str]) -> T.StructType:
    fields = [T.StructField(name, kind) for kind, names in groups for name in names.split()]
    return T.StructType(fields)


SCHEMAS: dict[str, T.StructType] = {
    "checkpoints": _schema(
        (_STRING, "email lead_id user_id anonymous_id object_record_id cadence_id cadence_step"
                  " cadence_step_status cadence_step_value workflow_id entry_group"),
        (_TS, "event_timestamp"),
    ),
    "steps": _schema(
        (_STRING, "cadence_id__c step_id__c object_type__c object_record_id__c result__c email__c name"),
        (_TS, "createddate result_date_time__c"),
    ),
    "comms": _schema(
        (_STRING, "comm_id comm_type campaign_id campaign_name workflow_id workflow_name pro_uuid lead_id"),
        (_TS, "comm_date"),
    ),
    "email_msgs": _schema((_STRING, "message_id pro_email_address")),
    "activity": _schema(
        (_STRING, "activity_id lead_id account_id organization_id opportunity_id demo_id call_id"),
        (_DATE, "activity_date"),
        (_INT, "call_flag connected_call_flag contact_call_flag conversation_call_flag demo_created_flag"
               " demo_attended_flag demo_failed_contact_flag enroll_flag same_day_enrolled"),
        (_STRING, "enroll_type industry industry_segment marketing_channel lead_category account_type"
                  " sales_motion"),
        (_MONEY, "gross_mrr net_mrr saas_mrr feature_mrr enrollment_eltv"),
    ),
    "eligible": _schema(
        (_DATE, "eligible_dt"),
        (_STRING, "id previous_assignment lead_category object_type assignment_priority_text"
                  " lead_specialization_segment sdr_segment industry eltv_cac_bucket"),
        (_INT, "assignment_priority_number lead_segment_priority assigned_flag sdr_decile"),
    ),
    "leads": _schema((_STRING, "id status lost_lead_reason__c")),
    "account_map": _schema((_STRING, "pro_uuid organization_id account_id")),
    "changes": _schema((_STRING, "id field old_value new_value"), (_TS, "changed_at")),
    "alert_feed": T.StructType([
        T.StructField("id", T.StringType(), False),
        T.StructField("check_number", T.IntegerType(), False),
        T.StructField("check_name", T.StringType(), False),
        T.StructField("cadence_id", T.StringType()),
        T.StructField("sub_key", T.StringType()),
        T.StructField("metric_value", T.DoubleType()),
        T.StructField("reference_value", T.DoubleType()),
        T.StructField("detail", T.StringType()),
        T.StructField("as_of", T.DateType(), False),
    ]),
    "alert_ledger": T.StructType([
        T.StructField("check_number", T.IntegerType(), False),
        T.StructField("cadence_id", T.StringType()),
        T.StructField("key", T.StringType(), False),
        T.StructField("thread", T.StringType()),
        T.StructField("last_reply", T.DateType()),
    ]),
}

# columns a source may lack: the marts carry them as NULL
REP_FIELDS = (
    "rep_id", "sdr_id", "sdr_name", "sdr_pod_role", "opportunity_id", "case_id", "case_owner_id",
    "cadence_time_required",
)


def validate(df: DataFrame, table: str, required: list[str] | None = None) -> DataFrame:
    """Raise unless `df` has the columns of `table` (or the `required` ones) with the right types."""
    have = {f.name: f.dataType for f in df.schema.fields}
    problems = []
    for field in SCHEMAS[table].fields:
        if required is not None and field.name not in required:
            continue
        kind = have.get(field.name)
        if kind is None:
            problems.append(f"{field.name}: missing")
        elif kind != field.dataType:
            problems.append(f"{field.name}: {kind.simpleString()} instead of {field.dataType.simpleString()}")
    if problems:
        raise ValueError(f"{table}: " + "; ".join(problems))
    return df


def conform(df: DataFrame, table: str) -> DataFrame:
    """Cast to the schema of `table`; zone-less timestamps become instants of the session zone."""
    known = {f.name: f.dataType for f in SCHEMAS[table].fields}
    missing = [name for name in known if name not in df.columns]
    if missing:
        raise ValueError(f"{table}: missing " + ", ".join(missing))
    extra = [name for name in REP_FIELDS if table == "checkpoints" and name in df.columns]
    return df.select(*[F.col(n).cast(kind).alias(n) for n, kind in known.items()], *extra)
