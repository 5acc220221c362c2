from seqpulse.operators import (
    alerts, baseline, breaks, clean, cohort, comms, diagnostics, feed, funnel, identity, marts, sequence,
)

__all__ = [
    "alerts", "baseline", "breaks", "clean", "cohort", "comms", "diagnostics", "feed", "funnel", "identity",
    "marts", "sequence",
]
