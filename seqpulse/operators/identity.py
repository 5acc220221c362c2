"""Who a row is about."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from seqpulse.config import Config
from seqpulse.functions import identity_kind, norm_cadence, spread_null, unique_id


def with_unique_id(df: DataFrame) -> DataFrame:
    return df.withColumn("unique_id", unique_id())


def with_user_type(df: DataFrame, cfg: Config) -> DataFrame:
    return df.withColumn("user_type", identity_kind(norm_cadence(), cfg))


def identity_audit(checkpoints: DataFrame, cfg: Config) -> DataFrame:
    """Per sequence: rows whose ids disagree with the kind its name announces."""
    kind = F.col("user_type")
    lead, user, org = (F.col(c).isNotNull() for c in ("lead_id", "user_id", "anonymous_id"))
    expected = (
        F.when(kind == "lead", lead).when(kind == "user", user).when(kind == "organisation", org)
        .otherwise(F.col("email").isNotNull())
    )
    other = (
        F.when(kind == "lead", user | org).when(kind == "user", lead | org).when(kind == "organisation", lead | user)
        .otherwise(lead | user | org)
    )
    return (
        with_user_type(checkpoints, cfg)
        .groupBy(norm_cadence().alias("cadence_id"), "user_type")
        .agg(
            F.count("*").alias("rows"),
            F.count_if(~expected).alias("missing_expected_id"),
            F.count_if(other).alias("carries_other_id"),
            F.count_if(F.col("email").isNull()).alias("missing_email"),
            F.count_if(~F.startswith("lead_id", F.lit("00Q"))).alias("lead_id_not_a_lead"),
            F.count_if(F.startswith("object_record_id", F.lit("00Q"))).alias("lead_id_as_object_id"),
        )
    )


def resolve_account(df: DataFrame, account_map: DataFrame, key: str = "user_id") -> DataFrame:
    """Add `organization_id` and `account_id` of the pro; one map row per pro is used, so rows never multiply."""
    one_each = (
        account_map.groupBy(F.col("pro_uuid").alias("_pro"))
        .agg(F.min(F.struct("organization_id", "account_id")).alias("m"))
        .select("_pro", "m.organization_id", "m.account_id")
    )
    return (
        df.withColumn("_pro", spread_null(df, key))
        .join(one_each, "_pro", "left").drop("_pro")
    )


def conversion_date(activity: DataFrame) -> DataFrame:
    """A lead becomes an account on the day a demo is attended, not the day it is booked."""
    return (
        activity.filter((F.col("demo_attended_flag") == 1) & F.col("lead_id").isNotNull())
        .groupBy("lead_id").agg(F.min("activity_date").alias("converted_on"))
    )
