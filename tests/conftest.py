import sys
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from seqpulse.session import SETTINGS  # noqa: E402
from seqpulse.sources import SCHEMAS  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    builder = (
        SparkSession.builder.master("local[8]").appName("tests")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.default.parallelism", "2")
        .config("spark.driver.memory", "6g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make(spark):
    """Rows given as dicts, completed to the schema of a table; times may be strings."""
    def build(table, rows):
        schema = SCHEMAS[table]

        def value(row, field):
            v = row.get(field.name)
            if field.dataType.typeName() == "timestamp" and v is not None and not isinstance(v, datetime):
                return datetime.fromisoformat(str(v))
            if isinstance(v, str) and field.dataType.typeName() == "date":
                return datetime.fromisoformat(v).date()
            return v

        return spark.createDataFrame([tuple(value(r, f) for f in schema.fields) for r in rows], schema)
    return build


@pytest.fixture(scope="session")
def cp(make):
    """Checkpoints from (sequence, e-mail, step, time[, value[, status]])."""
    def build(*rows, **common):
        names = ("cadence_id", "email", "cadence_step", "event_timestamp", "cadence_step_value", "cadence_step_status")
        return make("checkpoints", [{**common, **dict(zip(names, r))} for r in rows])
    return build


@pytest.fixture(scope="session")
def st(make):
    """Steps from (sequence, e-mail, created[, result[, result time[, name[, kind]]]])."""
    def build(*rows):
        names = ("cadence_id__c", "email__c", "createddate", "result__c", "result_date_time__c", "name", "step_id__c")
        base = {"name": "step", "step_id__c": "Call attempt"}
        return make("steps", [{**base, **{k: v for k, v in zip(names, r) if v is not None}} for r in rows])
    return build


@pytest.fixture(scope="session")
def rows():
    def as_dicts(df):
        return [r.asDict(recursive=True) for r in df.collect()]
    return as_dicts
