"""Messages, which carry the sequence only inside the name of their workflow."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, functions as F

from seqpulse.functions import bucket, norm_cadence
from seqpulse.sources import snapshot


def name_bridge(names: DataFrame, cadences: DataFrame) -> DataFrame:
    """Pairs of workflow name and sequence whose name occurs in it, ignoring case.

    A workflow name is cut into the pieces whose length some sequence name has, and these are looked up by equality: pieces
    grow with the name times the number of distinct lengths, and names are never compared with all sequences. A
    short name may lie inside a longer one; the workflow then counts for both.
    """
    wanted = cadences.select("cadence_id").filter("cadence_id IS NOT NULL").distinct()
    lengths = wanted.select(F.length(F.lower("cadence_id")).alias("n")).distinct()
    low, n = F.col("low"), F.col("n")
    pieces = (
        names.select("workflow_name").filter("workflow_name IS NOT NULL").distinct()
        .withColumn("low", F.lower("workflow_name"))
        .withColumn("n", F.explode(F.sequence(F.lit(0), F.length("low"))))
        .join(lengths, "n")
        .withColumn("first", F.explode(F.sequence(F.lit(1), F.length(low) - n + 1)))
        .select("workflow_name", F.substring(low, F.col("first"), n).alias("piece"))
        .distinct()
    )
    return pieces.join(wanted, F.col("piece") == F.lower("cadence_id")).select("workflow_name", "cadence_id")


def per_cadence(counts: DataFrame, cadences: DataFrame, keys: list[str], metric: str) -> DataFrame:
    """Counts per workflow name as counts per sequence.

    The names come from the counted rows, so that the messages are read and shuffled once for both.
    """
    names = counts.filter("n > 0")
    return (
        counts.join(name_bridge(names, cadences), "workflow_name")
        .groupBy("cadence_id", *keys).agg(F.sum("n").alias(metric))
    )


def comms_volume(comms: DataFrame, cadences: DataFrame, as_of: date, floor: date | None = None) -> DataFrame:
    """Messages per sequence, kind and day. Messages are counted per workflow name before any join."""
    sent = snapshot(comms, "comms", as_of, floor).filter("workflow_name IS NOT NULL")
    daily = (
        sent.groupBy("workflow_name", "comm_type", F.to_date("comm_date").alias("comm_day"))
        .agg(F.count("*").alias("n"))
    )
    return per_cadence(daily, cadences, ["comm_type", "comm_day"], "messages")


def weekly_email_volume(comms: DataFrame, cadences: DataFrame, as_of: date, weeks: list[date], tz: str | None = None) -> DataFrame:
    """E-mails per sequence in the given weeks."""
    first, last = F.lit(weeks[0]), F.lit(weeks[-1])
    sent = snapshot(comms, "comms", as_of, weeks[0], tz).filter("workflow_name IS NOT NULL AND comm_type = 'email'")
    weekly = (
        sent.withColumn("week_start", bucket("comm_date", "week", tz))
        .filter(F.col("week_start").between(first, last))
        .groupBy("workflow_name", "week_start").agg(F.count("*").alias("n"))
    )
    return per_cadence(weekly, cadences, ["week_start"], "email_volume")


def workflow_coverage(checkpoints: DataFrame, comms: DataFrame) -> DataFrame:
    """Per sequence: how many of its workflow ids occur among the messages at all."""
    ids = checkpoints.filter("workflow_id IS NOT NULL").select(norm_cadence().alias("cadence_id"), "workflow_id").distinct()
    known = comms.filter("workflow_id IS NOT NULL").select("workflow_id", F.lit(1).alias("known")).distinct()
    return (
        ids.join(known, "workflow_id", "left").groupBy("cadence_id")
        .agg(F.count("*").alias("workflow_ids"), F.count("known").alias("in_comms"))
    )


def workflows_per_cadence(checkpoints: DataFrame) -> DataFrame:
    return (
        checkpoints.groupBy(norm_cadence().alias("cadence_id"))
        .agg(F.count_distinct("workflow_id").alias("workflows"))
    )
