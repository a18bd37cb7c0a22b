import json
import os
import sys

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pactline.session import configure  # noqa: E402
from pactline.sources.contracts_io import parse_contracts  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[8]")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("OFF")
    return configure(s)


@pytest.fixture(scope="session")
def make_events(spark):
    """Payloads per `source@type` to an events table; ids and times count up over all of them."""

    def build(payloads: dict):
        rows, n = [], 0
        for key, details in payloads.items():
            source, event_type = key.split("@", 1)
            for detail in details:
                rows.append((n, source, event_type, detail if isinstance(detail, str) else json.dumps(detail)))
                n += 1
        df = spark.createDataFrame(rows, "event_id long, source string, event_type string, text string")
        return df.select(
            "event_id", F.timestamp_seconds(F.col("event_id") + 1_700_000_000).alias("ts"), "source", "event_type",
            F.parse_json("text").alias("detail"),
        )

    return build


@pytest.fixture(scope="session")
def make_contracts(spark):
    """`name -> component types` to a contracts table; the payload type is `Payload`."""

    def build(types: dict):
        rows = []
        for name, schemas in types.items():
            envelope = {"type": "object", "properties": {"detail": {"$ref": "#/components/schemas/Payload"}}}
            doc = {"openapi": "3.0.0", "components": {"schemas": {"AWSEvent": envelope, **schemas}}}
            rows.append((name, 1, json.dumps(doc)))
        return parse_contracts(spark.createDataFrame(rows, "name string, version int, content string"))[0]

    return build
