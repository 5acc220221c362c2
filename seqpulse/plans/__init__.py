from seqpulse.plans.batch import run_alerts, run_digest, run_marts

__all__ = ["run_alerts", "run_digest", "run_marts"]
