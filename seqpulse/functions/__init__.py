from seqpulse.functions.calendar import bucket, fill_days, fill_weeks, monday, weeks_back, zero_fill
from seqpulse.functions.columns import (
    contains_any, identity_kind, is_break, is_break_exit, is_completed, is_internal, norm_cadence, ratio,
    rep_facing, spread_null, starts_with_any, step_state, unique_id,
)

__all__ = [
    "bucket", "contains_any", "fill_days", "fill_weeks", "identity_kind", "is_break", "is_break_exit",
    "is_completed", "is_internal", "monday", "norm_cadence", "ratio", "rep_facing", "spread_null",
    "starts_with_any", "step_state", "unique_id", "weeks_back", "zero_fill",
]
