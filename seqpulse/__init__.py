"""Outreach-sequence analytics as PySpark DataFrame operators."""

from seqpulse.config import Config
from seqpulse.sources.tables import Tables

__all__ = ["Config", "Tables"]
