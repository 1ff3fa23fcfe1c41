import os
import sys
from datetime import datetime, timedelta

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

from tianguis.schema import OBSERVATION, TARGET  # noqa: E402

NOW = datetime(2026, 9, 30, 12)


# columns can be written at the top of a test module once there is a session
SESSION = (
    SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
    .config("spark.driver.memory", "4g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
)
SESSION.sparkContext.setLogLevel("ERROR")


@pytest.fixture(scope="session")
def spark():
    return SESSION


FIELDS = [f.split(" ")[0] for f in OBSERVATION.split(", ")]


def listing(i, **given):
    base = {
        "observation_id": f"s1:{i}", "source_id": "s1", "title": "Aceite de girasol Ole 1 L", "seller": f"v{i}", "province": "La Habana", "price": 1000.0, "currency": "CUP",
        "captured_at": NOW - timedelta(days=1),
    }
    return {**base, **given, "row_uid": i}


@pytest.fixture(scope="session")
def observations(spark):
    def make(rows):
        return spark.createDataFrame([tuple(r.get(f) for f in FIELDS) + (r["row_uid"],) for r in rows], OBSERVATION + ", row_uid long")

    return make


@pytest.fixture(scope="session")
def targets(spark):
    def make(*rows):
        names = [f.split(" ")[0] for f in TARGET.split(", ")]
        return spark.createDataFrame([tuple({"target_id": f"t{k}", "keywords": [], "exclude_keywords": [], "provinces": [], **r}.get(n) for n in names) for k, r in enumerate(rows)], TARGET)

    return make


OIL = {"name": "aceite de girasol", "brand": "Ole", "quantity": 1.0, "unit": "L"}
COLA = {"name": "refresco cola", "brand": "Coca-Cola", "quantity": 330.0, "unit": "ml"}
