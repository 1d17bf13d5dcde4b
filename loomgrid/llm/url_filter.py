"""URL filters: a blocked Bloom filter passes possible hits to an exact join.

A policy of rules (host and path starts) decides first. What no rule decides is
held against a listing, a table of canonical URLs: host in small letters and
path, without scheme, query and fragment. A listed URL blocks the page of that
canonical URL; a listed site (its path is ``/``) blocks every page of its host
and subdomains of one label more, such as ``www.``. So a page has three keys at
most: itself, its site, and the site its host belongs to.

The filter is an array of 64-bit blocks, four bits in one block for a key, sized
to the listing (16 bits a key up to ``MAX_BLOCKS`` blocks), computed by two
aggregations and read by the scan as a scalar subquery. URLs without a possible
hit end there, with no exchange; only possible hits meet the listing in a hash
join by the whole key, which removes the filter's false positives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HOT_SHARE, LEAST_HOT, cut, left_join_hot, table

#: 32 MB of filter. Above 16 million keys the filter has fewer bits a key and
#: passes more to the join: 2% of URLs at 30 million keys, 16% at 67 million.
MAX_BLOCKS = 1 << 22
_CHUNK = 4096
#: A listing is broadcast up to so many entries of so many characters together.
BROADCAST_ENTRIES, BROADCAST_CHARS = 200_000, 16_000_000
#: (host, path, verdict) of the contract.
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
#: Sites of the query's listing: advertising and spam farms of the ``pages`` table, under each of its domains.
FARMS = ["adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm"]
DOMAINS = ["example.com", "example.net", "example.org"]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _farms(spark: SparkSession) -> DataFrame:
    """The query's listing as a table, made in the JVM."""
    names = lambda xs: F.explode(F.array(*map(F.lit, xs)))
    sites = spark.range(1).select(names(FARMS).alias("farm")).select("farm", names(DOMAINS).alias("domain"))
    return sites.select(F.concat(F.lit("http://"), F.col("farm"), F.lit("."), F.col("domain"), F.lit("/")).alias("url"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def listing(urls: DataFrame) -> DataFrame:
    """key: the distinct canonical URLs of the column ``url``; nulls and texts without ``://`` are no URLs.

    An empty path counts as ``/``, in the listing and in pages.
    """
    host, path = host_and_path(F.col("url"))
    return urls.where(F.instr("url", "://") > 0).select(_canonical(host, path).alias("key")).distinct()


def _canonical(host: Column, path: Column) -> Column:
    return F.concat(host, F.when(path == "", F.lit("/")).otherwise(path))


def _rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(length, rule, verdict) of the longest rule that fits, or null.

    The host's endings look up a map of the policy, so work follows the labels
    of a host (as many as the longest rule has), not the number of rules. Of two
    rules of one length the greater text wins; of two verdicts for one rule the
    smaller.
    """
    by_host: dict[str, dict[str, str]] = {}
    for h, p, v in rules:
        paths = by_host.setdefault(h, {})
        paths[p] = min(v, paths.get(p, v))
    if not by_host:
        return F.lit(None).cast("struct<n:int,rule:string,verdict:string>")
    known = F.create_map(*[
        x for h, paths in by_host.items()
        for x in (F.lit(h), F.array(*[F.struct(F.lit(p).alias("p"), F.lit(v).alias("v")) for p, v in paths.items()]))
    ])
    labels = F.sequence(F.lit(1), F.lit(max(h.count(".") + 1 for h in by_host)))

    def of_ending(k: Column) -> Column:
        end = F.call_function("substring_index", host, F.lit("."), k)
        fits = F.filter(F.coalesce(F.try_element_at(known, end), F.array().cast("array<struct<p:string,v:string>>")), lambda x: F.startswith(path, x["p"]))
        return F.transform(fits, lambda x: F.struct((F.length(end) + F.length(x["p"])).alias("n"), F.concat(end, x["p"]).alias("rule"), x["v"].alias("verdict")))

    return F.array_max(F.flatten(F.transform(labels, lambda k: of_ending(-k))))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _bits(key: Column) -> Column:
    h = F.xxhash64(key, F.lit(1))
    bit = lambda n: F.call_function(
        "shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, n).bitwiseAND(F.lit(63)).cast("int")
    )
    return bit(0).bitwiseOR(bit(6)).bitwiseOR(bit(12)).bitwiseOR(bit(18))


def filter_blocks(count: int) -> int:
    """Blocks for so many keys: 16 bits a key, a power of two."""
    blocks = 64
    while blocks * 4 < count and blocks < MAX_BLOCKS:
        blocks *= 2
    return blocks


def bloom_filter(keys: DataFrame, blocks: int) -> DataFrame:
    """One row: ``words``, the blocks in order. ``keys`` has the column key."""
    words = keys.groupBy(_block(F.col("key"), blocks).alias("b")).agg(F.bit_or(_bits(F.col("key"))).alias("w"))
    # the chunks are put together in tasks of their own; the last task sees one row a chunk
    every = keys.sparkSession.range(blocks).select(F.col("id").cast("int").alias("b")).join(words, "b", "left")
    in_order = lambda x, of: F.transform(F.array_sort(F.collect_list(x)), lambda y: y[of])
    chunks = every.groupBy(F.floor(F.col("b") / _CHUNK).alias("chunk")).agg(
        in_order(F.struct("b", F.coalesce("w", F.lit(0).cast("long")).alias("w")), "w").alias("ws")
    )
    return chunks.agg(F.flatten(in_order(F.struct("chunk", "ws"), "ws")).alias("words"))


def filter_urls(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]] = RULES, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict for every row of ``pages``.

    ``listed`` has the column key, distinct (see ``listing``). A null URL or
    one without ``://`` has an empty host and path and fits no rule and no
    listed URL. The longest rule that fits decides; without one, a listed URL or
    site blocks, and else ``default`` holds. Repeated rows are judged each by
    itself; an empty table gives an empty result; other columns do not matter.
    """
    listed = cut(listed.select("key"))
    host, path = host_and_path(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    urls = urls.withColumn("best", _rule(F.col("host"), F.col("path"), rules))
    count, chars = listed.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("key")), F.lit(0))).first()
    out = lambda df, verdict: df.select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", verdict).alias("verdict")
    )
    if not count:
        return out(urls, F.lit(default))
    blocks = filter_blocks(count)
    words = cut(bloom_filter(listed, blocks)).scalar()  # built once, read by every test below
    own = _canonical(F.col("host"), F.col("path"))
    site = F.concat("host", F.lit("/"))
    parent = F.concat(F.regexp_extract("host", r"^[^.]*\.(.+)$", 1), F.lit("/"))
    maybe = lambda key: F.get(words, _block(key, blocks)).bitwiseAND(_bits(key)) == _bits(key)
    asked = F.col("best").isNull() & (F.col("host") != "")
    possible = F.coalesce(asked & (maybe(own) | maybe(site) | maybe(parent)), F.lit(False))
    hits = urls.where(possible)
    small = count <= BROADCAST_ENTRIES and chars <= BROADCAST_CHARS
    if small:
        for n, key in enumerate((own, site, parent)):
            hits = hits.join(F.broadcast(listed.select(F.col("key").alias(f"hit{n}"))), key == F.col(f"hit{n}"), "left")
    else:
        for n, key in enumerate((own, site, parent)):
            hits = hits.withColumn("key", key)
            # a key with many pages is served by a broadcast; fewer than HOT_SHARE such keys can be
            seen = cut(hits.groupBy("key").agg(F.count(F.lit(1)).alias("n")))
            total = seen.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
            hot = seen.where(F.col("n") > max(LEAST_HOT, total / HOT_SHARE)).select("key")
            found = listed.withColumn(f"hit{n}", F.col("key"))
            hits = left_join_hot(hits, found, "key", found.join(F.broadcast(hot), "key", "left_semi")).drop("key")
    blocked = F.coalesce("hit0", "hit1", "hit2").isNotNull()
    return out(urls.where(~possible), F.lit(default)).unionByName(out(hits, F.when(blocked, "block").otherwise(default)))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), listing(_farms(spark)))


def _oracle() -> str:
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    listed = ", ".join(f"('{f}.{d}/')" for f in FARMS for d in DOMAINS)
    return rf"""
WITH rules(rh, rp, rv) AS (VALUES {rules}), listed(k) AS (VALUES {listed}),
r AS (SELECT row_number() OVER () AS rid, page_id,
        CASE WHEN instr(coalesce(url, ''), '://') > 0
             THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT rid, page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
m AS (SELECT rid, rh || rp AS rule, rv,
             row_number() OVER (PARTITION BY rid ORDER BY length(rh || rp) DESC, rh || rp DESC) AS k
      FROM u JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, m.rule,
       coalesce(m.rv, CASE WHEN host <> '' AND (host || CASE WHEN path = '' THEN '/' ELSE path END IN (SELECT k FROM listed)
         OR host || '/' IN (SELECT k FROM listed) OR regexp_extract(host, '^[^.]*\.(.+)$', 1) || '/' IN (SELECT k FROM listed))
         THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN m ON m.rid = u.rid AND m.k = 1
"""


ORACLE_SQL = _oracle()
