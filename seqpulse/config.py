"""Parameters of the operators. Names and domains are the caller's; numbers default to the standard rules."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    # who and what is left out
    internal_domains: tuple[str, ...] = ()
    recurring_substrings: tuple[str, ...] = ()
    quiet_substrings: tuple[str, ...] = ()

    # sequences whose e-mail volume is watched (check 9); matched case-insensitively at the start, empty: all
    name_prefixes: tuple[str, ...] = ()

    # identity by name prefix
    lead_prefixes: tuple[str, ...] = ("Pre-Enroll",)
    user_prefixes: tuple[str, ...] = ("Post-Enroll",)
    organisation_prefixes: tuple[str, ...] = ("Demo Attendance",)

    # The words the source tables use.
    break_substring: str = "cadence break"
    fold_status: bool = False
    step_type: str = "Call attempt"
    system_step: str = "clear_step"
    lost_status: str = "Lost Lead"
    known_steps: tuple[str, ...] = (
        "Start", "Test", "Break", "Exit", "Call Disposition", "Stage Update", "Request failed",
    )
    known_statuses: tuple[str, ...] = ("Success", "Failure", "Break")
    lite_enroll_types: tuple[str, ...] = ("Lite", "Type 1")
    type_3_excludes: tuple[str, ...] = ("Lite", "Type 1", "Type 2")

    # weekly series and baselines
    n_weeks: int = 26
    baseline_weeks: int = 8
    n_sd: float = 2.0
    min_mean: float = 10.0
    recent_days: int = 28
    tz: str | None = None

    # checks 1-4, 6
    silent_days: int = 7
    alive_months: int = 4
    double_days: int = 7
    double_pct: float = 0.10
    stuck_days: int = 100
    stuck_window: int = 120
    stuck_pct: float = 0.10
    exit_rule: str = "first"  # or "any_after"
    engage_band: tuple[int, int] = (3, 10)
    engage_pct: float = 0.10

    # diagnostics
    wow_drop: float = 0.5
    payload_days: int = 30

    # feed
    stale_days: int = 8

    # marts
    horizons: tuple[int, int] = (30, 60)

    # width of the time slices in which one person's events are scanned
    slice_seconds: int = 3600

    def __post_init__(self):
        if self.min_mean <= 0:
            raise ValueError("min_mean must be positive: a silent sequence has no baseline to fall from")
        if self.exit_rule not in ("first", "any_after"):
            raise ValueError(f"unknown exit_rule {self.exit_rule!r}")
