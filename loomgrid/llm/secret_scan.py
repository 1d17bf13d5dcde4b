"""Secret scans with multipart credential linking, native operations only.

The scan finds base secrets (strong on their own) and weak parts: identifiers,
endpoints and unlabelled tokens. A weak part is reported only when a
complementary part starts within ``SCOPE`` code points of it in the same text:
tokens need an identifier or an endpoint, identifiers and endpoints need a
secret. The interval join goes by cells of ``SCOPE`` code points: the anchors
of a cell are first folded to their least and greatest start, so a weak part
meets at most three rows for each complementary group, however many anchors a
text has, and a semi join reports it once.

Offsets come from the lengths of the pieces between matches: only these
lengths leave the scan, not the texts. They are checkpointed with a row number,
so all later steps work on small rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

SCOPE = 200
_ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: kind: (pattern, group whose length counts, least length, group of parts, base?).
#: A run of 24 hex digits or more is what is left of [0-9a-f]+ after shorter
#: matches drop, and likewise AKIA with 16 or more; for assign a dropped match
#: still uses up its text, so there the length is tested afterwards.
KINDS = {
    "assign": (_ASSIGN, 2, 6, "secret", True),
    "access": (r"AKIA[A-Z0-9]{16,}", 0, 20, "identifier", True),
    "hex": (r"[0-9a-f]{24,}", 0, 24, "secret", True),
    "ident": (
        r"""(?i)(access_?key_?id|client_?id|account_?id|user_?name|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.@-]+)""",
        2, 3, "identifier", False,
    ),
    "endpoint": (r"(https?|postgres|mysql|mongodb|redis|amqp|ftp)://[A-Za-z0-9_.:@-]+", 0, 8, "endpoint", False),
    "blob": (r"[A-Za-z0-9+/]{20,}", 0, 20, "secret", False),
}
_ORDER = list(KINDS)
#: A weak token has a digit, a small and a capital letter.
_MIXED = r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])"
_PART = "array<struct<kind:int,i:int,gap:int,len:int,ok:boolean>>"


def _matches(text: Column, kind: str) -> Column:
    pattern, group, least, _, _ = KINDS[kind]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)

    def part(m: Column, i: Column) -> Column:
        value = F.regexp_extract(m, pattern, group) if group else m
        ok = F.length(value) >= least
        if kind == "blob":
            ok = ok & m.rlike(_MIXED)
        return F.struct(
            F.lit(_ORDER.index(kind)).alias("kind"), i.alias("i"),
            F.length(F.get(gaps, i)).alias("gap"), F.length(m).alias("len"), ok.alias("ok"),
        )

    # gaps are only split off where something matched
    return F.when(text.rlike(pattern), F.transform(found, part)).otherwise(F.array().cast(_PART))


def scan_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_assign, n_access, n_hex,
    base_sha256, spans.

    Null text counts as empty and has no spans: counts 0, the digest of the
    empty string, spans ''. Spans are kind:start:end in code points, end
    exclusive, of whole matches. Weak spans that touch a base span are left
    out. Repeated rows and null ids are judged each by itself; other columns
    do not matter.
    """
    text = F.col("text")
    scanned = cut(
        docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        .select("doc_id", F.concat(*[_matches(text, k) for k in KINDS]).alias("parts"))
        .withColumn("row", F.monotonically_increasing_id())
    )
    in_text = Window.partitionBy("row", "kind").orderBy("i")
    by_start = Window.partitionBy("row").orderBy("start", "kind")
    base = F.col("kind") < 3
    spans = (
        scanned.select("row", F.inline("parts"))
        .withColumn("stop", F.sum(F.col("gap") + F.col("len")).over(in_text).cast("long"))
        .withColumn("start", F.col("stop") - F.col("len"))
        .where("ok")
        .withColumn("before", F.max(F.when(base, F.col("stop"))).over(by_start))
        .withColumn(
            "after",
            F.min(F.when(base, F.col("start"))).over(by_start.rowsBetween(1, Window.unboundedFollowing)),
        )
        .where(
            base
            | (
                (F.coalesce("before", F.lit(-1)) <= F.col("start"))
                & (F.coalesce("after", F.lit(1 << 60)) >= F.col("stop"))
            )
        )
        .select("row", "kind", "start", "stop", F.floor(F.col("start") / scope).alias("cell"))
    )
    groups = F.element_at(
        F.create_map(*[F.lit(x) for i, k in enumerate(_ORDER) for x in (i, KINDS[k][3])]), F.col("kind")
    )
    anchors = (
        spans.groupBy("row", "cell", groups.alias("part"))
        .agg(F.min("start").alias("low"), F.max("start").alias("high"))
    )
    wants = F.when(groups == "secret", F.array(F.lit("identifier"), F.lit("endpoint"))).otherwise(
        F.array(F.lit("secret"))
    )
    weak = (
        spans.where(~base)
        .withColumn("part", F.explode(wants))
        .withColumn("cell", F.explode(F.sequence(F.col("cell") - 1, F.col("cell") + 1)))
    )
    near = (F.col("w.start") - F.col("a.high") <= scope) & (F.col("a.low") - F.col("w.start") <= scope)
    linked = (
        weak.alias("w")
        .join(
            anchors.alias("a"),
            (F.col("w.row") == F.col("a.row")) & (F.col("w.cell") == F.col("a.cell"))
            & (F.col("w.part") == F.col("a.part")) & near,
            "left_semi",
        )
        .select("row", "kind", "start", "stop")
        .distinct()
    )
    kept = spans.where(base).select("row", "kind", "start", "stop").unionByName(linked)
    name = F.array(*[F.lit(k) for k in _ORDER])
    listed = lambda xs: F.array_join(
        F.transform(xs, lambda x: F.concat_ws(":", F.get(name, x["kind"]), x["start"], x["stop"])), ","
    )
    per_row = kept.groupBy("row").agg(
        *[F.count_if(F.col("kind") == i).alias(f"n_{k}") for i, k in enumerate(_ORDER[:3])],
        F.array_sort(F.collect_list(F.struct("start", "kind", "stop"))).alias("all"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    text_of = lambda xs: F.coalesce(listed(xs), F.lit(""))
    return scanned.select("row", "doc_id").join(per_row, "row", "left").select(
        "doc_id", zero("n_assign"), zero("n_access"), zero("n_hex"),
        F.sha2(text_of(F.filter("all", lambda x: x["kind"] < 3)), 256).alias("base_sha256"),
        text_of(F.col("all")).alias("spans"),
    )


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    """Every kind's matches and the pieces between them; weak spans by comparing all parts of a text."""

    def plain(pattern: str) -> str:
        # (?i) of RE2 also folds two letters beyond ASCII; both cases written out do not
        if not pattern.startswith("(?i)"):
            return pattern.replace("'", "''")
        words, rest = pattern[5:].split(")", 1)
        both = "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in words)
        return f"({both}){rest}".replace("'", "''")

    found = []
    for n, (kind, (pattern, group, least, part, base)) in enumerate(KINDS.items()):
        p = plain(pattern)
        ok = f"length(regexp_extract(m[i], '{p}', {group})) >= {least}"
        if kind == "blob":
            ok += " AND regexp_matches(m[i], '[0-9]') AND regexp_matches(m[i], '[a-z]') AND regexp_matches(m[i], '[A-Z]')"
        found.append(
            f"SELECT rid, {n} AS k, '{kind}' AS kind, '{part}' AS part, {base} AS base, "
            f"(list_sum(list_transform(g[1:i], lambda s: length(s))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda s: length(s))), 0))::BIGINT AS a, length(m[i]) AS n "
            f"FROM (SELECT rid, m, g, unnest(range(1, len(m) + 1)) AS i FROM (SELECT rid, regexp_extract_all(x, '{p}') AS m, string_split_regex(x, '{p}') AS g FROM t)) WHERE {ok}"
        )
    spans = " UNION ALL ".join(found)
    return f"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS x FROM documents),
every AS (SELECT *, a + n AS b FROM ({spans})),
parts AS (SELECT * FROM every e WHERE base OR NOT EXISTS (SELECT 1 FROM every o WHERE o.rid = e.rid AND o.base AND o.a < e.b AND e.a < o.b)),
kept AS (SELECT * FROM parts e WHERE base OR EXISTS (SELECT 1 FROM parts o WHERE o.rid = e.rid AND abs(o.a - e.a) <= {SCOPE} AND (e.part = 'secret') <> (o.part = 'secret'))),
r AS (SELECT rid, count(*) FILTER (k = 0) AS n0, count(*) FILTER (k = 1) AS n1, count(*) FILTER (k = 2) AS n2,
  string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k, b) FILTER (base) AS bs, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k, b) AS s FROM kept GROUP BY rid)
SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(bs, '')) AS base_sha256, coalesce(s, '') AS spans
FROM t LEFT JOIN r USING (rid)
"""


ORACLE_SQL = _oracle()
