"""All queries of the library by name, each with its oracle SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.detectors import QualityConfig
from ..operators.repair import repair
from . import inputs
from .queries_detect import ORACLES as _DETECT_SQL
from .queries_detect import QUERIES as _DETECT
from .queries_files import ORACLES as _FILES_SQL
from .queries_files import QUERIES as _FILES
from .queries_forecast import ORACLES as _FORECAST_SQL
from .queries_forecast import QUERIES as _FORECAST
from .queries_panel import ORACLES as _PANEL_SQL
from .queries_panel import QUERIES as _PANEL

QUERIES = {**_PANEL, **_DETECT, **_FORECAST, **_FILES}
ORACLES = {**_PANEL_SQL, **_DETECT_SQL, **_FORECAST_SQL, **_FILES_SQL}


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Repair actions of the hourly value panel by status and reason."""
    config = QualityConfig(run_flagging="whole_run", stuck_calibration_quantile=0.999, zero_profile_min_ratio=0.25, profile_weeks=3, calibration_end=inputs.CUTOFF)
    done = repair(inputs.corrupted_panel(spark, d), config, repair_before=inputs.CUTOFF, strategy="forward_then_profile", profile_weeks=3)
    return done.groupBy("status", "reason").agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("load"), 4).alias("load"))
