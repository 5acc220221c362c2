"""Column expressions shared by the operators."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from seqpulse.config import Config

STEP = "cadence_step"
STATUS = "cadence_step_status"
VALUE = "cadence_step_value"


def norm_cadence(column: str | Column = "cadence_id") -> Column:
    """Sequence names are free text with padding; case is kept."""
    return F.trim(F.col(column) if isinstance(column, str) else column)


def contains_any(column: Column, substrings: tuple[str, ...]) -> Column:
    """Case-insensitive literal containment (`%` and `_` are ordinary characters)."""
    lowered = F.lower(column)
    return reduce(or_, [F.contains(lowered, F.lit(s.lower())) for s in substrings], F.lit(False))


def starts_with_any(column: Column, prefixes: tuple[str, ...]) -> Column:
    lowered = F.lower(column)
    return reduce(or_, [F.startswith(lowered, F.lit(p.lower())) for p in prefixes], F.lit(False))


def is_internal(email: Column, domains: tuple[str, ...]) -> Column:
    """NULL for a NULL e-mail, so that a filter on the negation drops it. The domain's case matters."""
    domain = F.split_part(email, F.lit("@"), F.lit(2))
    return domain.isin(*domains) if domains else F.when(email.isNotNull(), F.lit(False))


def is_break_exit(cfg: Config) -> Column:
    """A break recorded as the reason of an exit."""
    return (F.col(STEP) == "Exit") & contains_any(F.col(VALUE), (cfg.break_substring,))


def is_break(cfg: Config) -> Column:
    """A break is written in one of three ways; which one depends on the sequence. Never NULL."""
    status = F.lower(F.col(STATUS)) == "break" if cfg.fold_status else F.col(STATUS) == "Break"
    return F.coalesce((F.col(STEP) == "Break") | status | is_break_exit(cfg), F.lit(False))


def rep_facing(cfg: Config) -> Column:
    """Call instructions shown to a rep, without the system's own rows."""
    return (F.col("step_id__c") == cfg.step_type) & (F.col("name") != cfg.system_step)


def is_completed(blank_is_open: bool = False) -> Column:
    result = F.col("result__c")
    open_values = ("", "Displayed") if blank_is_open else ("Displayed",)
    return result.isNotNull() & ~result.isin(*open_values)


def step_state(blank_is_open: bool = False) -> Column:
    result = F.col("result__c")
    open_step = result.isNull() | (result == "") if blank_is_open else result.isNull()
    return F.when(open_step, "open").when(result == "Displayed", "displayed").otherwise("completed")


def unique_id() -> Column:
    return F.coalesce("lead_id", "user_id", "anonymous_id", "email")


def identity_kind(cadence: Column, cfg: Config) -> Column:
    """Which id a sequence is keyed on, by the start of its name."""
    return (
        F.when(starts_with_any(cadence, cfg.lead_prefixes), "lead")
        .when(starts_with_any(cadence, cfg.user_prefixes), "user")
        .when(starts_with_any(cadence, cfg.organisation_prefixes), "organisation")
        .otherwise("email")
    )


def ratio(numerator: Column, denominator: Column, digits: int = 4) -> Column:
    """NULL where the denominator is 0."""
    return F.round(numerator / F.nullif(denominator, F.lit(0)), digits)


def spread_null(df: DataFrame, key: str) -> Column:
    """A join key whose NULLs land in many partitions instead of one. The stand-ins match no real key."""
    salt = [c for c in ("email", "event_timestamp", "entry_timestamp") if c in df.columns] or [c for c, kind in df.dtypes if "map<" not in kind]
    stand_in = F.concat(F.lit("\0"), F.pmod(F.xxhash64(*salt), F.lit(4096)).cast("string"))
    return F.coalesce(F.col(key), stand_in)
