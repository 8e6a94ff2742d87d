"""URL filters: host-suffix and path-prefix expressions, joined to the rules by short hash prefixes.

Each URL is expanded into (host suffix, path prefix) expressions of the shapes (number of host labels,
length of path) that occur among the rules, so a URL gives a handful of rows however long it is. The
expressions meet the rules in an equi-join on the first hex digits of their SHA-256; a hit counts only
if the whole digests agree. Of several rules the longest wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.shared import LOWER, UPPER, stored, table

PREFIX_HEX = 8
#: Bytes of hits (host, path, rule, verdict) that may be broadcast, with ROW for what a row takes besides its texts.
HIT_BYTES, ROW = 16 << 20, 64
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"

#: The rules of the contract, as (host, path, action).
RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


def url_host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, PARTS, 1), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def labels(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """Verdict of each page.

    pages: url, and any other columns, which are kept. rules: host, path, action (allow or block).
    Adds host, path, rule and verdict. A null url, or one without ``://``, has an empty host and path;
    it matches no rule. A url that no rule fits has rule null and the default verdict. Repeated pages each
    keep their row; of equal rules with different actions, block wins, of different rules of one length the greater
    text (host, then path). Null fields of a rule drop the rule.
    """
    known = (
        rules.select("host", "path", "action")
        .dropna()
        .select(
            F.concat("host", "path").alias("rule"),
            "action",
            labels(F.col("host")).alias("n_labels"),
            F.length("path").alias("n_path"),
        )
        .groupBy("rule", "n_labels", "n_path")
        .agg(F.max("action").alias("action"))
        .withColumn("digest", F.sha2("rule", 256))
    )
    # distinct shapes: at most labels of a host name times lengths of a URL path, whatever the number of rules
    shapes = known.agg(F.collect_set(F.struct("n_labels", "n_path"))).scalar()
    judged = pages.drop("host", "path", "rule", "verdict").withColumns(
        {"host": url_host(F.col("url")), "path": url_path(F.col("url"))}
    )
    placed = judged.where(F.length("host") > 0)
    sites = placed.select("host", "path").distinct()
    expressions = (
        sites.select("host", "path", F.explode(shapes).alias("shape"))
        .where((labels(F.col("host")) >= F.col("shape.n_labels")) & (F.length("path") >= F.col("shape.n_path")))
        .select(
            "host",
            "path",
            F.sha2(
                F.concat(
                    F.expr("substring_index(host, '.', -shape.n_labels)"), F.expr("left(path, shape.n_path)")
                ),
                256,
            ).alias("seen"),
        )
        .withColumn("prefix", F.substring("seen", 1, PREFIX_HEX))
    )
    hits = (
        expressions.join(known.withColumn("prefix", F.substring("digest", 1, PREFIX_HEX)), "prefix")
        .where(F.col("seen") == F.col("digest"))
        .groupBy("host", "path")
        .agg(F.max(F.struct(F.length("rule").alias("n"), "rule", "action")).alias("best"))
        .select("host", "path", F.col("best.rule").alias("rule"), F.col("best.action").alias("verdict"))
    )
    # urls without host have nothing to look up; as one key they would meet in one task
    without = judged.where(F.length("host") == 0).withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(None).cast("string")})
    hits = stored(hits, "url-hits")
    size = hits.agg(F.sum(F.octet_length("host") + F.octet_length("path") + F.octet_length("rule") + ROW)).first()[0] or 0
    looked_up = placed.join(F.broadcast(hits) if size <= HIT_BYTES else hits, ["host", "path"], "left")
    return looked_up.unionByName(without).fillna({"verdict": default})


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    judged = filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return judged.select("page_id", "host", "path", "rule", "verdict")


OP4_SQL = f"""
WITH rules(rhost, rpath, action) AS (VALUES {", ".join(str(r) for r in RULES)}),
p AS (
  SELECT page_id, row_number() OVER () AS n,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
m AS (
  SELECT n, arg_max(rhost || rpath, length(rhost || rpath)) AS rule,
    arg_max(action, length(rhost || rpath)) AS action
  FROM p JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY n)
SELECT page_id, host, path, m.rule AS rule, coalesce(m.action, 'allow') AS verdict
FROM p LEFT JOIN m USING (n)
"""
