"""Quality checks as issue records, thresholds and the gate.

All row masks of a panel are counted in one aggregation; every check becomes a
row of the issue table (``schemas.ISSUE``), passing checks included. The gate
works on that table, which has one row a check.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import flag, hours_between, season
from ..schemas import ISSUE, STATUS_RANK
from .detectors import QualityConfig, anomaly_masks

# Issue code -> (check, status when not zero, repairable, columns, mask, action).
ROW_CHECKS = {
    "TIMESTAMP_PARSE_ERROR": ("timestamp parseability", "fail", False, ["timestamp"], "quarantine"),
    "TIMESTAMP_ORDER_ERROR": ("monotonic per-building timestamps", "fail", True, ["timestamp"], "stable_sort"),
    "DUPLICATE_OBSERVATION_KEY": ("unique timestamp/building key", "fail", True, ["timestamp", "building_id"], "aggregate_duplicate"),
    "LOAD_MISSING": ("non-missing load", "warn", True, ["load"], "past_only_fill_or_quarantine"),
    "LOAD_INFINITE": ("finite load", "fail", True, ["load"], "convert_to_null_then_repair"),
    "NEGATIVE_LOAD": ("non-negative load", "fail", True, ["load"], "convert_to_null_then_repair"),
    "ROBUST_OUTLIER": ("robust causal load range", "warn", True, ["load"], "review_or_past_only_repair"),
    "LONG_ZERO_RUN": ("short zero run", "warn", True, ["load"], "past_only_repair_or_quarantine"),
    "STUCK_SENSOR": ("changing sensor values", "warn", True, ["load"], "past_only_repair_or_quarantine"),
    "LEVEL_OR_UNIT_SHIFT": ("stable causal level", "warn", False, ["load"], "quarantine_ambiguous_scale"),
    "METADATA_JOIN_MISSING": ("complete metadata join", "fail", False, ["site_id", "primary_use"], "quarantine"),
    "TIMEZONE_MISSING": ("documented source timezone", "warn", False, ["timezone"], "document_utc_normalization_caveat"),
    "COVERAGE_RARE_GROUP": ("group coverage", "warn", False, ["site_id", "primary_use"], "report"),
}
# The codes of checks that do not count rows of the panel.
OTHER_CODES = (
    "SCHEMA_REQUIRED_COLUMN_MISSING",
    "INTERVAL_CONTINUITY_GAP",
    "SUBGROUP_METADATA_INSTABILITY",
    "SPLIT_BUILDING_COVERAGE",
    "SUBGROUP_SPLIT_COVERAGE",
    "METADATA_DUPLICATE_KEY",
    "METADATA_MISSING_KEY",
    "METADATA_REQUIRED_VALUE_MISSING",
)
ISSUE_CODES = frozenset(ROW_CHECKS) | frozenset(OTHER_CODES)
# Codes that fail whenever they count anything, whatever the thresholds.
HARD_CODES = frozenset(
    {
        "SCHEMA_REQUIRED_COLUMN_MISSING",
        "TIMESTAMP_PARSE_ERROR",
        "DUPLICATE_OBSERVATION_KEY",
        "METADATA_JOIN_MISSING",
        "METADATA_DUPLICATE_KEY",
        "METADATA_MISSING_KEY",
        "SUBGROUP_METADATA_INSTABILITY",
        "SPLIT_BUILDING_COVERAGE",
    }
)
REQUIRED = ("timestamp", "building_id", "load", "site_id", "primary_use")
SAMPLE = 5


def totals(panel: DataFrame) -> Column:
    """rows, entities of a panel as one scalar subquery; Spark runs equal ones once."""
    return panel.groupBy().agg(F.struct(F.count(F.lit(1)).alias("rows"), F.count_distinct("building_id").alias("entities"))).scalar()


def row_flags(panel: DataFrame, config: QualityConfig, order_by: str | None = None) -> DataFrame:
    """The panel with one boolean column for each row check (named by its code).

    ``order_by`` names the ordinal of the input order; without it the order
    check has nothing to compare and flags nothing.
    """
    df = anomaly_masks(panel, config)
    key = Window.partitionBy("building_id", "timestamp")
    if order_by:
        seen = Window.partitionBy("building_id").orderBy(order_by).rowsBetween(Window.unboundedPreceding, -1)
        late = flag(F.col("timestamp") < F.last("timestamp", ignorenulls=True).over(seen))
    else:
        late = F.lit(False)
    rare, total = F.lit(False), totals(panel)
    for c in ("site_id", "primary_use"):
        # shares from one row a value; the panel itself is not gathered anywhere
        shares = panel.groupBy(F.col(c).alias(f"{c}__v")).agg(F.count(F.lit(1)).alias(f"{c}__n"))
        low = shares.where(F.col(f"{c}__n") / total["rows"] < config.rare_group_fraction).select(f"{c}__v", F.lit(True).alias(f"{c}__rare"))
        df = df.join(low, F.col(c) == F.col(f"{c}__v"), "left").drop(f"{c}__v")
        rare = rare | F.coalesce(F.col(f"{c}__rare"), F.lit(False))
    zone = F.col("timezone").isNull() if "timezone" in panel.columns else F.lit(True)
    flags = {
        "TIMESTAMP_PARSE_ERROR": F.col("timestamp").isNull(),
        "TIMESTAMP_ORDER_ERROR": late,
        "DUPLICATE_OBSERVATION_KEY": F.col("timestamp").isNotNull() & (F.count(F.lit(1)).over(key) > 1),
        "LOAD_MISSING": F.col("is_missing"),
        "LOAD_INFINITE": F.col("is_infinite"),
        "NEGATIVE_LOAD": F.col("is_negative"),
        "ROBUST_OUTLIER": F.col("is_outlier"),
        "LONG_ZERO_RUN": F.col("is_long_zero"),
        "STUCK_SENSOR": F.col("is_stuck"),
        "LEVEL_OR_UNIT_SHIFT": F.col("is_level_shift"),
        "METADATA_JOIN_MISSING": F.col("site_id").isNull() | F.col("primary_use").isNull(),
        "TIMEZONE_MISSING": zone,
        "COVERAGE_RARE_GROUP": rare,
    }
    return df.select(*panel.columns, *[c.alias(n) for n, c in flags.items()])


def _issues(counted: DataFrame, codes: list[tuple], source: str) -> DataFrame:
    """Turn one row of counters into issue rows; codes: (code, check, severity, repairable, columns, rule, action)."""
    made = [
        F.struct(
            F.lit(code).alias("code"), F.lit(check).alias("check"),
            F.when(F.col(f"{code}_n") > 0, severity).otherwise("pass").alias("status"),
            F.col(f"{code}_n").cast("long").alias("count"), F.col(f"{code}_d").cast("long").alias("denominator"),
            (F.col(f"{code}_n") / F.greatest(F.col(f"{code}_d"), F.lit(1))).alias("rate"),
            F.lit(repairable).alias("repairable"), F.array(*[F.lit(c) for c in columns]).alias("columns"),
            F.lit(rule).alias("expected_rule"), F.lit(action).alias("action"), F.lit(source).alias("source_condition"),
            F.col(f"{code}_s").alias("sample"),
        )
        for code, check, severity, repairable, columns, rule, action in codes
    ]
    return counted.select(F.inline(F.array(*made)))


def violations_by_code(flags: DataFrame, codes: list[str], columns: list[str]) -> DataFrame:
    """code, hits, sample: how many rows violate each check, and the first SAMPLE of them.

    One pass over the flags, which are costly: counted and ranked within salted
    parts first, so that no window holds all violations of a check that many
    rows violate.
    """
    entry = F.create_map(*[x for c in columns for x in (F.lit(c), F.col(c).cast("string"))])
    hits = flags.select(
        "timestamp", "building_id", entry.alias("entry"),
        F.explode(F.array_compact(F.array(*[F.when(F.col(c), F.lit(c)) for c in codes]))).alias("code"),
        F.pmod(F.xxhash64("building_id", "timestamp"), F.lit(32)).alias("salt"),
    )
    by = [F.col("timestamp").asc_nulls_first(), F.col("building_id").asc_nulls_first()]
    part = Window.partitionBy("code", "salt")
    top = hits.withColumns({"rn": F.row_number().over(part.orderBy(*by)), "n": F.count(F.lit(1)).over(part)}).where(F.col("rn") <= SAMPLE)
    top = top.withColumn("place", F.row_number().over(Window.partitionBy("code").orderBy(*by)))
    first = F.collect_list(F.when(F.col("place") <= SAMPLE, F.struct("place", "entry")))
    return top.groupBy("code").agg(
        F.sum(F.when(F.col("rn") == 1, F.col("n"))).alias("hits"),
        F.transform(F.array_sort(first, lambda x, y: x["place"] - y["place"]), lambda x: x["entry"]).alias("sample"),
    )


def gaps(panel: DataFrame, frequency_hours: int = 1) -> DataFrame:
    """building_id, expected, observed, missing: how far each entity is from its own grid.

    Grid positions are counted in closed form; only observations on the grid
    that starts at the entity's first timestamp fill a position.
    """
    dated = panel.where("timestamp IS NOT NULL").select("building_id", "timestamp").distinct()
    first = Window.partitionBy("building_id")
    step = hours_between(F.col("timestamp"), F.min("timestamp").over(first)) / frequency_hours
    steps = dated.withColumn("step", step)
    return steps.groupBy("building_id").agg(
        (F.floor(F.max("step")) + 1).alias("expected"),
        F.count_if(F.col("step") == F.floor("step")).alias("observed"),
    ).withColumn("missing", F.col("expected") - F.col("observed"))


def unstable_entities(panel: DataFrame) -> DataFrame:
    """Entities with more than one site, use or time zone."""
    columns = [c for c in ("site_id", "primary_use", "timezone") if c in panel.columns]
    counted = panel.where("building_id IS NOT NULL").groupBy("building_id").agg(
        *[F.count_distinct(c).alias(c) for c in columns]
    )
    return counted.where(" OR ".join(f"{c} > 1" for c in columns))


def quality_checks(panel: DataFrame, config: QualityConfig | None = None, *, source: str = "natural", order_by: str | None = None) -> DataFrame:
    """The issue table of a panel: fifteen checks, or one if columns are missing."""
    config = config or QualityConfig()
    spark = panel.sparkSession
    lacking = sorted(set(REQUIRED) - set(panel.columns))
    if lacking:
        return spark.createDataFrame(
            [(
                "SCHEMA_REQUIRED_COLUMN_MISSING", "required output schema", "fail", len(lacking), len(REQUIRED),
                len(lacking) / len(REQUIRED), False, lacking, "all required columns are present", "stop_publication", source, [],
            )],
            ISSUE,
        )
    flags = row_flags(panel, config, order_by)
    found = violations_by_code(flags, list(ROW_CHECKS), ["building_id", "timestamp", "load", "site_id", "primary_use"])
    specs = spark.createDataFrame(
        [(c, check, severity, repairable, columns, _rule(c, config), action) for c, (check, severity, repairable, columns, action) in ROW_CHECKS.items()],
        "code string, check string, severity string, repairable boolean, columns array<string>, expected_rule string, action string",
    )
    names = [f.split()[0] for f in ISSUE.split(", ")]
    none = F.array().cast("array<map<string,string>>")
    total = totals(panel)
    issues = specs.join(found, "code", "left").withColumns(
        {"count": F.coalesce("hits", F.lit(0)), "denominator": total["rows"], "source_condition": F.lit(source), "sample": F.coalesce("sample", none)}
    )
    issues = issues.withColumns(
        {"status": F.when(F.col("count") > 0, F.col("severity")).otherwise("pass"), "rate": F.col("count") / F.greatest("denominator", F.lit(1))}
    ).select(*names)
    holes = gaps(panel, config.frequency_hours).agg(F.coalesce(F.sum("missing"), F.lit(0)).alias("INTERVAL_CONTINUITY_GAP_n"))
    holes = holes.withColumns(
        {
            "INTERVAL_CONTINUITY_GAP_d": F.col("INTERVAL_CONTINUITY_GAP_n") + total["rows"],
            "INTERVAL_CONTINUITY_GAP_s": F.lit(None).cast("array<map<string,string>>"),
        }
    )
    holes = _issues(holes, [("INTERVAL_CONTINUITY_GAP", "continuous observations", "warn", True, ["timestamp"], f"one observation every {config.frequency_hours}h per building", "preserve_key_as_null_when_materialized")], source)
    unstable = unstable_entities(panel).agg(F.count(F.lit(1)).alias("SUBGROUP_METADATA_INSTABILITY_n"))
    unstable = unstable.withColumns(
        {
            "SUBGROUP_METADATA_INSTABILITY_d": total["entities"],
            "SUBGROUP_METADATA_INSTABILITY_s": F.lit(None).cast("array<map<string,string>>"),
        }
    )
    unstable = _issues(unstable, [("SUBGROUP_METADATA_INSTABILITY", "stable subgroup metadata per building", "fail", False, ["building_id", "site_id", "primary_use", "timezone"], "each building maps to one site, primary use and time zone", "stop_publication_and_review_metadata")], source)
    return issues.unionByName(holes.withColumn("sample", none)).unionByName(unstable.withColumn("sample", none))


def _rule(code: str, config: QualityConfig) -> str:
    return {
        "ROBUST_OUTLIER": f"causal median/MAD z <= {config.outlier_mad_z:g}",
        "LONG_ZERO_RUN": f"fewer than {config.long_zero_threshold} consecutive zeros",
        "STUCK_SENSOR": f"fewer than {config.stuck_threshold} repeated nonzero values",
        "LEVEL_OR_UNIT_SHIFT": f"within {config.level_shift_ratio:g}x recent median",
        "COVERAGE_RARE_GROUP": f"groups hold at least {config.rare_group_fraction:.1%} of rows",
        "DUPLICATE_OBSERVATION_KEY": "one row per timestamp and building",
    }.get(code, f"no rows violate {ROW_CHECKS[code][0]}")


def split_checks(panel: DataFrame, cutoff: str, *, source: str = "natural") -> DataFrame:
    """Do entities and subgroups occur on both sides of a boundary?"""
    dated = panel.where("timestamp IS NOT NULL AND building_id IS NOT NULL")
    groups = [c for c in ("site_id", "primary_use", "timezone") if c in panel.columns]
    boundary = F.lit(cutoff).cast("timestamp_ntz")

    def sides(keys: list[Column]) -> DataFrame:
        return dated.groupBy(*keys).agg(
            F.bool_or(F.col("timestamp") < boundary).alias("before"), F.bool_or(F.col("timestamp") >= boundary).alias("after")
        )

    out = []
    for code, check, severity, keys, action in (
        ("SPLIT_BUILDING_COVERAGE", "building coverage across split boundary", "fail", [F.col("building_id")], "stop_publication_or_change_scope"),
        ("SUBGROUP_SPLIT_COVERAGE", "reported subgroup coverage across split boundary", "warn",
         [F.coalesce(c, F.lit("<missing>")).alias(c) for c in groups], "report_coverage_limitation"),
    ):
        part = sides(keys)
        names = [c for c in part.columns if c not in ("before", "after")]
        one_side = ~(F.col("before") & F.col("after"))
        listed = part.where(one_side).orderBy(*names).limit(SAMPLE).agg(
            F.collect_list(F.create_map(*[x for c in names for x in (F.lit(c), F.col(c))])).alias("s")
        )
        counted = part.agg(F.count_if(one_side).alias(f"{code}_n"), F.count(F.lit(1)).alias(f"{code}_d")).withColumn(f"{code}_s", listed.scalar())
        out.append(_issues(counted, [(code, check, severity, False, names, f"both sides of {cutoff} in wall-clock time", action)], source))
    return out[0].unionByName(out[1])


def metadata_checks(metadata: DataFrame, *, source: str = "natural") -> DataFrame:
    """Key and value checks of the metadata table before it is joined."""
    copies = metadata.groupBy("building_id").agg(F.count(F.lit(1)).alias("n"))
    masked = metadata.agg(
        F.count_if(F.col("building_id").isNull()).alias("METADATA_MISSING_KEY_n"),
        F.count_if(F.col("site_id").isNull() | F.col("primary_use").isNull()).alias("METADATA_REQUIRED_VALUE_MISSING_n"),
        F.greatest(F.count(F.lit(1)), F.lit(1)).alias("d"),
    ).withColumn(
        "METADATA_DUPLICATE_KEY_n",
        F.coalesce(copies.where("building_id IS NOT NULL AND n > 1").agg(F.sum("n")).scalar(), F.lit(0)),
    )
    specs = [
        ("METADATA_DUPLICATE_KEY", "metadata key cardinality", "fail", False, ["building_id"], "one row per building", "stop_publication"),
        ("METADATA_MISSING_KEY", "metadata building identifier", "fail", False, ["building_id"], "every row has a building", "stop_publication"),
        ("METADATA_REQUIRED_VALUE_MISSING", "metadata required values", "warn", False, ["site_id", "primary_use"], "site and use are known", "report"),
    ]
    masked = masked.withColumns({f"{s[0]}_d": F.col("d") for s in specs} | {f"{s[0]}_s": F.array().cast("array<map<string,string>>") for s in specs})
    return _issues(masked, specs, source)


def issue_log(issues: DataFrame) -> DataFrame:
    """One row a sample (one row for none); counters stand on the first row only."""
    rows = issues.select("*", F.posexplode_outer("sample").alias("pos", "entry")).drop("sample")
    first = F.coalesce(F.col("pos"), F.lit(0)) == 0
    get = lambda k: F.try_element_at(F.col("entry"), F.lit(k)).alias(k)
    return rows.select(
        "code", "check", "status", F.coalesce("pos", F.lit(0)).alias("sample_index"),
        *[F.when(first, F.col(c)).alias(c) for c in ("count", "denominator", "rate")],
        "repairable", F.array_join("columns", ";").alias("columns"), "expected_rule", "action", "source_condition",
        get("building_id"), get("timestamp"), get("load"), get("site_id"), get("primary_use"),
    )


def check_rules(rules: Mapping[str, Any] | None) -> dict[str, tuple[str, float | None, float | None]]:
    """Validate threshold rules: code -> (basis, warn_above, fail_above)."""
    rules = rules or {}
    if not isinstance(rules, Mapping):
        raise ValueError("check thresholds are an object keyed by issue code")
    if unknown := sorted(set(map(str, rules)) - ISSUE_CODES):
        raise ValueError(f"unknown issue codes: {unknown}")
    out = {}
    for code, rule in rules.items():
        if not isinstance(rule, Mapping):
            raise ValueError(f"the rule for {code} is not an object")
        basis = str(rule.get("basis", "rate"))
        if basis not in ("count", "rate"):
            raise ValueError(f"the basis for {code} is 'count' or 'rate'")
        limits = []
        for name in ("warn_above", "fail_above"):
            v = rule.get(name)
            if v is not None:
                try:
                    v = float(v)
                except (TypeError, ValueError):
                    raise ValueError(f"{code}.{name} is not a number") from None
                if not math.isfinite(v) or v < 0 or (basis == "rate" and v > 1):
                    raise ValueError(f"{code}.{name} is out of range")
            limits.append(v)
        if None not in limits and limits[1] < limits[0]:
            raise ValueError(f"{code}.fail_above lies below warn_above")
        out[str(code)] = (basis, *limits)
    return out


def apply_thresholds(issues: DataFrame, rules: Mapping[str, Any] | None) -> DataFrame:
    """Issue statuses under configured limits (strictly above); hard codes cannot be eased."""
    checked = check_rules(rules)
    hard = F.col("code").isin(*sorted(HARD_CODES)) & (F.col("count") > 0)
    table = issues.sparkSession.createDataFrame(
        [(c, *r) for c, r in checked.items()], "code string, threshold_basis string, warn_above double, fail_above double"
    )
    df = issues.join(F.broadcast(table), "code", "left")
    value = F.when(F.col("threshold_basis") == "count", F.col("count").cast("double")).otherwise(F.col("rate"))
    configured = F.when(value > F.col("fail_above"), "fail").when(value > F.col("warn_above"), "warn").otherwise("pass")
    status = F.when(hard, "fail").when(F.col("threshold_basis").isNotNull(), configured).otherwise(F.col("status"))
    comparison = F.when(hard, "hard_structural_count_greater_than_zero").when(F.col("threshold_basis").isNotNull(), "strictly_greater_than")
    return df.withColumns({"status": status, "threshold_comparison": comparison})


def gate(issues: DataFrame) -> DataFrame:
    """One row: the worst status, how many checks have which, the hard failures."""
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in STATUS_RANK.items() for x in kv]), F.col("status"))
    hard = F.col("code").isin(*sorted(HARD_CODES)) & (F.col("count") > 0)
    return issues.agg(
        F.coalesce(F.max_by("status", rank), F.lit("pass")).alias("status"),
        F.count(F.lit(1)).alias("checks"),
        *[F.count_if(F.col("status") == s).alias(f"{s}_checks") for s in STATUS_RANK],
        F.coalesce(F.sum("count"), F.lit(0)).alias("affected_observations"),
        F.array_join(F.array_sort(F.collect_set(F.when(hard, F.col("code")))), ";").alias("hard_failures"),
    )


def coverage(panel: DataFrame) -> DataFrame:
    """dimension, value, rows for site, use, season and time zone, in one grouping-sets pass."""
    groups = {"site_id": F.coalesce("site_id", F.lit("<missing>")), "primary_use": F.coalesce("primary_use", F.lit("<missing>")), "season": season(F.col("timestamp"))}
    if "timezone" in panel.columns:
        groups["timezone"] = F.coalesce("timezone", F.lit("<missing>"))
    names = list(groups)
    counted = panel.select(*[c.alias(n) for n, c in groups.items()]).groupingSets([[n] for n in names], *names).agg(
        F.count(F.lit(1)).alias("rows"), F.grouping_id().alias("gid")
    )
    last = len(names) - 1
    dimension = F.coalesce(*[F.when(F.col("gid") == (2 ** len(names) - 1) - 2 ** (last - i), n) for i, n in enumerate(names)])
    value = F.coalesce(*[F.col(n) for n in names])
    return counted.select(dimension.alias("dimension"), value.alias("value"), "rows")


def coverage_totals(panel: DataFrame) -> DataFrame:
    return panel.agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("building_id").alias("buildings"),
        F.min("timestamp").alias("timestamp_min"), F.max("timestamp").alias("timestamp_max"),
        F.count_if(F.col("load").isNull() | F.isnan("load")).alias("load_missing"),
    )
