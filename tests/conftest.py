import os
import sys
from datetime import datetime, timedelta
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ":".join(p for p in (ROOT, os.environ.get("PYTHONPATH", "")) if p)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from loomgrid.session import build

    s = build(
        "tests", "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "6g", "spark.default.parallelism": "4",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoints")), "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
        },
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def panel_of(spark):
    """panel_of({entity: loads}, start): an hourly panel with site, use and zone."""

    def make(loads, start="2024-01-01", **more):
        t0, rows = datetime.fromisoformat(start), []
        for b, xs in loads.items():
            rows += [(t0 + timedelta(hours=i), b, None if x is None else float(x), more.get("site", "s"), "Office", "UTC") for i, x in enumerate(xs)]
        return spark.createDataFrame(rows, "timestamp timestamp_ntz, building_id string, load double, site_id string, primary_use string, timezone string")

    return make
