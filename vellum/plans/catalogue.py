"""Named queries: each applies an operator of the library to the driver's tables, with equivalent SQL beside it.

The tables stand for the clinical ones: customers are patients, orders encounters, line items mentions, parts a
vocabulary, events observations, documents notes, benchmark items identifiers, conversations instructions and responses.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import scalars as S
from vellum.functions import vocabulary as V
from vellum.operators import analytics, curate, dataset, deid, evaluate, lineage, normalize, omop, quality_gate
from vellum.operators import relational as R
from vellum.sources.tables import materialised as checkpointed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
Tables = Callable[[str], DataFrame]


def query(sql: str = ""):
    """Registers a function of a table reader as a query under its name."""

    def register(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, d: f(lambda name: spark.read.parquet(f"{d}/{name}.parquet"))
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def day(column: str):
    return F.date_format(column, "yyyy-MM-dd")


# --- scans and flattening ---------------------------------------------------


@query("SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def scan_json_flatten(t):
    return t("events").select("event_id", "event_type", F.from_json("props", "k bigint")["k"].alias("k"))


@query("""
SELECT l_orderkey, l_linenumber, 'quantity' AS measure, l_quantity AS value FROM lineitem
UNION ALL SELECT l_orderkey, l_linenumber, 'price' AS measure, l_extendedprice AS value FROM lineitem""")
def component_explode(t):
    parts = F.array(*(F.struct(F.lit(m).alias("measure"), F.col(c).alias("value")) for m, c in (("quantity", "l_quantity"), ("price", "l_extendedprice"))))
    return t("lineitem").select("l_orderkey", "l_linenumber", F.inline(parts))


@query("""
SELECT c_custkey, count(o_orderkey) AS n_orders, coalesce(max(o_orderkey), -1) AS last_order
FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey""")
def cogroup_nest(t):
    orders = t("orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    nested = R.cogroup_nest(t("customer").select("c_custkey"), {"orders": orders}, "c_custkey")
    last = F.coalesce(F.array_max(F.transform("orders", lambda o: o["o_orderkey"])), F.lit(-1))
    return nested.select("c_custkey", F.size("orders").cast("long").alias("n_orders"), last.alias("last_order"))


# --- terminology and the star schema ----------------------------------------


def mapped_parts(t) -> DataFrame:
    """A vocabulary that lacks some codes: parts of small size are unmapped."""
    return t("part").where("p_size > 10").select(F.col("p_partkey").alias("l_partkey"), (F.col("p_partkey") + 1000000).alias("concept_id"))


@query("""
SELECT l_orderkey, l_linenumber, coalesce(p_partkey + 1000000, 0) AS concept_id
FROM lineitem LEFT JOIN part ON l_partkey = p_partkey AND p_size > 10""")
def concept_lookup_sentinel(t):
    return R.lookup(t("lineitem"), mapped_parts(t), ["l_partkey"], {"concept_id": 0}).select("l_orderkey", "l_linenumber", "concept_id")


BINDING = """
SELECT p_brand AS system, count(*) AS total, sum(CASE WHEN p_size > 10 THEN 1 ELSE 0 END) AS matched,
  round(100.0 * sum(CASE WHEN p_size > 10 THEN 1 ELSE 0 END) / count(*), 2) AS pct
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY {0}"""


@query(BINDING.format("GROUPING SETS ((p_brand), ())"))
def binding_report(t):
    parts = t("part").select("p_partkey", "p_brand", "p_size")
    codes = t("lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_brand").alias("system"), F.col("p_partkey").alias("code"))
    known = parts.where("p_size > 10").select(F.col("p_brand").alias("system"), F.col("p_partkey").alias("code"))
    return omop.binding_report(codes, known)


@query("SELECT p_brand AS section, count(*) AS total, sum(CASE WHEN p_size > 10 THEN 1 ELSE 0 END) AS mapped FROM part GROUP BY p_brand")
def vocab_coverage(t):
    concepts = t("part").select(F.col("p_brand").alias("section"), F.when(F.col("p_size") > 10, F.col("p_partkey") + 1000000).otherwise(0).alias("concept"))
    return omop.coverage(concepts, "section", "concept")


@query("SELECT row_number() OVER (ORDER BY c_nationkey, c_custkey) AS person_id, c_custkey AS person_source_value, c_nationkey FROM customer")
def omop_person(t):
    people = t("customer").select(F.col("c_custkey").alias("person_source_value"), "c_nationkey")
    return R.numbered(people, ["c_nationkey", "person_source_value"], "person_id", checkpointed)


@query("""
SELECT row_number() OVER (ORDER BY o_custkey, l_orderkey, l_linenumber, l_partkey, l_suppkey, part, value) AS measurement_id, o_custkey AS person_id, part, value
FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 0 AS part, l_quantity AS value FROM lineitem
      UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 1, l_discount FROM lineitem) JOIN orders ON l_orderkey = o_orderkey""")
def omop_measurement(t):
    rows = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    parts = rows.select(F.col("o_custkey").alias("person_id"), *keys, F.posexplode(F.array("l_quantity", "l_discount")).alias("part", "value"))
    keyed = R.numbered(parts, ["person_id", *keys, "part", "value"], "measurement_id", checkpointed)
    return keyed.select("measurement_id", "person_id", "part", "value")


@query("""
SELECT o_custkey AS person, strftime(min(d), '%Y-%m-%d') AS first_date, strftime(max(d), '%Y-%m-%d') AS last_date FROM (
  SELECT o_custkey, o_orderdate AS d FROM orders
  UNION ALL SELECT o_custkey, l_shipdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey) GROUP BY o_custkey""")
def observation_period(t):
    orders = t("orders").select(F.col("o_custkey").alias("person"), "o_orderkey", day("o_orderdate").alias("date"))
    ships = t("lineitem").select("l_orderkey", day("l_shipdate").alias("date")).join(orders.select("person", "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    spans = omop.observation_period([orders, ships], "person", lambda df, order, name: df)
    return spans.select("person", F.col("observation_period_start_date").alias("first_date"), F.col("observation_period_end_date").alias("last_date"))


# --- de-identification -------------------------------------------------------

OFFSET = """list_reduce(list_prepend(0::HUGEINT, [CAST('0x' || substr(sha256({0}), 8 * i + 1, 8) AS HUGEINT) FOR i IN range(8)]),
  lambda r, x: (r * 4294967296 + x) % 730)"""
OFFSET_DAYS = "CAST(CASE WHEN {0} < 365 THEN {0} - 365 ELSE {0} - 364 END AS INTEGER)"


@query(f"""
SELECT c_custkey, category, {OFFSET_DAYS.format("r")} AS days FROM (
  SELECT c_custkey, category, {OFFSET.format("CAST(c_custkey AS VARCHAR) || ':' || category")} AS r
  FROM customer CROSS JOIN (VALUES ('dob'), ('visit')) v(category))""")
def patient_offset(t):
    rows = t("customer").select("c_custkey", F.explode(F.array(F.lit("dob"), F.lit("visit"))).alias("category"))
    return rows.select("c_custkey", "category", S.patient_offset(F.col("c_custkey"), F.col("category")).alias("days"))


@query(f"""
SELECT o_orderkey, strftime(o_orderdate + to_days({OFFSET_DAYS.format("r")}), '%Y-%m-%d') AS "onsetDateTime" FROM (
  SELECT o_orderkey, o_orderdate, {OFFSET.format("CAST(o_custkey AS VARCHAR) || ':visit'")} AS r FROM orders)""")
def date_shift(t):
    dated = t("orders").select("o_orderkey", "o_custkey", day("o_orderdate").alias("onsetDateTime"))
    return deid.shift_dates(dated, "o_custkey").drop("o_custkey")


@query(f"""
SELECT o_custkey, {OFFSET_DAYS.format("r")} AS least, {OFFSET_DAYS.format("r")} AS most, true AS kept FROM (
  SELECT DISTINCT o_custkey, {OFFSET.format("CAST(o_custkey AS VARCHAR) || ':visit'")} AS r FROM orders)""")
def interval_invariant(t):
    """Within a patient all dates move by the same days, and never by none."""
    dated = t("orders").select("o_orderkey", "o_custkey", day("o_orderdate").alias("onsetDateTime"))
    return deid.moved_days(dated, deid.shift_dates(dated, "o_custkey"), "o_orderkey", "onsetDateTime", "o_custkey")


@query("SELECT c_custkey, 'DEID-' || upper(substr(sha256(CAST(c_custkey AS VARCHAR)), 1, 10)) AS pseudonym FROM customer")
def pseudonym(t):
    return t("customer").select("c_custkey", S.pseudonym(F.col("c_custkey")).alias("pseudonym"))


@query("SELECT c_custkey, substr(regexp_replace(c_name, '[^0-9]', '', 'g'), 1, 3) || '**' AS zip3 FROM customer")
def geo_generalize(t):
    return t("customer").select("c_custkey", S.zip3(F.regexp_replace("c_name", "[^0-9]", "")).alias("zip3"))


MAIL, DIGITS = "[A-Za-z0-9.]+@[A-Za-z0-9.]+", "[0-9]{3,}"


@query(f"SELECT doc_id, regexp_replace(text, '{MAIL}', '[EMAIL]', 'g') AS text FROM documents WHERE regexp_matches(text, '{MAIL}')")
def span_redact(t):
    """Notes rewritten by known spans; here the spans are those of an expression, so that one replacement gives the same."""
    docs = t("documents").where(F.col("text").rlike(MAIL)).select("doc_id", "text")
    pieces, found = F.split("text", MAIL), F.regexp_extract_all("text", F.lit(MAIL), F.lit(0))
    docs = docs.withColumns({"pieces": pieces, "found": found})
    upto = lambda i: F.aggregate(F.slice("found", 1, i), F.lit(0), lambda a, m: a + F.length(m)) + F.aggregate(F.slice("pieces", 1, i + 1), F.lit(0), lambda a, p: a + F.length(p))
    spans = F.transform("found", lambda m, i: F.struct(upto(i).alias("start"), (upto(i) + F.length(m)).alias("end"), F.lit("EMAIL").alias("type")))
    return docs.withColumn("spans", spans).select("doc_id", deid.rewrite_spans(F.col("text"), F.col("spans"), F.col("doc_id")).alias("text"))


@query("""
WITH truth AS (SELECT l_orderkey, l_linenumber * 10 AS s, l_linenumber * 10 + CAST(l_quantity AS BIGINT) % 10 + 1 AS e, l_returnflag AS type FROM lineitem),
found AS (SELECT l_orderkey, l_linenumber * 10 + 5 AS s, l_linenumber * 10 + 8 AS e FROM lineitem WHERE l_linestatus = 'O'),
flagged AS (SELECT t.type, EXISTS (SELECT 1 FROM found f WHERE f.l_orderkey = t.l_orderkey AND t.s < f.e AND f.s < t.e) AS hit FROM truth t)
SELECT type, count(*) AS total, count(*) FILTER (hit) AS caught, round(count(*) FILTER (hit) / count(*), 4) AS recall FROM flagged GROUP BY type""")
def span_recall(t):
    items = t("lineitem").withColumn("start", F.col("l_linenumber") * 10)
    truth = items.select("l_orderkey", "start", (F.col("start") + F.col("l_quantity").cast("long") % 10 + 1).alias("end"), F.col("l_returnflag").alias("type"))
    found = items.where("l_linestatus = 'O'").select("l_orderkey", (F.col("start") + 5).alias("start"), (F.col("start") + 8).alias("end"))
    return deid.span_recall(truth, found, "l_orderkey")


@query("""
SELECT DISTINCT c_custkey AS patient, c_mktsegment AS value FROM customer JOIN orders ON c_custkey = o_custkey
WHERE contains(o_orderpriority || ' ' || CASE WHEN o_orderkey % 3 = 0 THEN c_mktsegment ELSE '' END, c_mktsegment)""")
def leak_contains(t):
    people = t("customer").select(F.col("c_custkey").alias("patient"), F.col("c_mktsegment").alias("value"))
    said = t("orders").join(people, F.col("o_custkey") == F.col("patient"))
    texts = said.select("patient", F.concat_ws(" ", "o_orderpriority", F.when(F.col("o_orderkey") % 3 == 0, F.col("value")).otherwise("")).alias("text"))
    return deid.leaked_identifiers(people, texts, "patient")


KINDS = [("email", MAIL), ("phone", r"\+1 \([0-9]{3}\)"), ("placeholder", r"\[[A-Z_]+\]"), ("license", "Licensed under")]


@query(" UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind FROM documents WHERE regexp_matches(text, '{p}')" for k, p in KINDS))
def phi_pattern_scan(t):
    return deid.phi_patterns_found(t("documents").select("doc_id", "text"), "text", KINDS).select("doc_id", "kind")


# --- normalization -----------------------------------------------------------


@query(r"""
SELECT p_partkey, regexp_replace(p_name || ', first diagnosed 2019-01-30', '(?i)[ ]*,[ ]*(first[ ]+)?diagnosed[ ]+[0-9]{4}-[0-9]{2}-[0-9]{2}[ ]*$', '') AS name
FROM part""")
def strip_suffix(t):
    return t("part").select("p_partkey", S.without_date_clause(F.concat("p_name", F.lit(", first diagnosed 2019-01-30"))).alias("name"))


@query("""
WITH v AS (SELECT DISTINCT p_type AS canonical FROM part UNION SELECT DISTINCT left(p_type, 3) FROM part)
SELECT p_partkey, arg_max(canonical, length(canonical)) AS canonical
FROM part LEFT JOIN v ON starts_with(lower(upper(p_type) || ' management'), lower(canonical)) GROUP BY p_partkey""")
def prefix_canonical(t):
    parts = t("part").select("p_partkey", F.concat(F.upper("p_type"), F.lit(" management")).alias("raw"))
    kinds = t("part").select(F.col("p_type").alias("canonical")).union(t("part").select(F.left(F.col("p_type"), F.lit(3)))).distinct()
    return R.longest_prefix(parts, kinds, "raw", "canonical").select("p_partkey", "canonical")


@query("""
SELECT l_orderkey, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN round(l_quantity / 2.20462, 1)
  WHEN 1 THEN round((l_quantity - 32) * 5 / 9, 1) ELSE round(l_quantity * 2.54, 1) END AS value FROM lineitem""")
def unit_convert(t):
    unit = F.element_at(F.array(F.lit("lb_av"), F.lit("degf"), F.lit("in_i")), (F.col("l_linenumber") % 3 + 1).cast("int"))
    return t("lineitem").select("l_orderkey", "l_linenumber", S.to_metric(unit, F.col("l_quantity")).alias("value"))


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN l_shipmode = 'w' THEN 'Body weight' WHEN l_shipmode = 'hr' THEN 'Heart rate' ELSE 'pulse' END AS name,
  CASE WHEN l_shipmode = 'w' AND l_returnflag = 'R' THEN round(l_quantity / 2.20462, 1) ELSE l_quantity END AS value_num,
  CASE WHEN l_shipmode = 'w' THEN 'kg' WHEN l_shipmode = 'hr' THEN CASE WHEN l_returnflag = 'R' THEN 'LBS' ELSE '/min' END
    ELSE CASE WHEN l_returnflag = 'R' THEN 'LBS' END END AS unit,
  l_shipmode = 'w' OR l_shipmode = 'hr' AND l_returnflag <> 'R' AS matched
FROM (SELECT *, CASE l_linenumber % 3 WHEN 0 THEN 'w' WHEN 1 THEN 'hr' ELSE 'p' END AS l_shipmode FROM lineitem)""")
def alias_lookup(t):
    name = F.element_at(F.array(F.lit(" body weight"), F.lit("HR"), F.lit("pulse")), (F.col("l_linenumber") % 3 + 1).cast("int"))
    rows = t("lineitem").select("l_orderkey", "l_linenumber", name.alias("name"), F.col("l_quantity").cast("string").alias("value"), F.when(F.col("l_returnflag") == "R", "LBS").alias("unit"))
    return normalize.normalize_vitals(rows).drop("value_text")


@query("""
SELECT l_orderkey, l_linenumber, 'Amlodipine 5 MG Oral Tablet' AS name,
  CASE l_linenumber % 4 WHEN 0 THEN 'Take 5 mg by mouth once daily' WHEN 1 THEN 'Take 5 mg by mouth once daily' WHEN 2 THEN NULL ELSE 'as directed' END AS dosage,
  l_linenumber % 4 < 3 AS matched FROM lineitem""")
def dosage_variant(t):
    said = [F.lit("5mg PO QD"), F.lit("5 MG Oral Tablet - 5 mg by mouth once daily"), F.lit("N/A"), F.lit("as directed")]
    rows = t("lineitem").select("l_orderkey", "l_linenumber", F.lit("amlodipine").alias("name"), F.element_at(F.array(*said), (F.col("l_linenumber") % 4 + 1).cast("int")).alias("dosage"))
    return normalize.normalize_dosages(rows)


@query("SELECT l_orderkey, l_returnflag, min(l_linenumber) AS l_linenumber FROM lineitem GROUP BY l_orderkey, l_returnflag")
def mention_dedup(t):
    return R.first_seen(t("lineitem").select("l_orderkey", "l_returnflag", "l_linenumber"), ["l_orderkey", "l_returnflag"], ["l_linenumber"])


@query("""
SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC NULLS LAST, event_id DESC) AS n FROM events) WHERE n = 1""")
def latest_wins(t):
    return R.latest(t("events"), ["user_id", "event_type"], F.col("ts"), ["event_id"]).select("user_id", "event_type", "event_id")


@query("""
SELECT l_returnflag AS field, count(*) AS total, count(*) FILTER (l_discount < 0.05) AS matched, count(*) FILTER (l_discount >= 0.05) AS unmatched,
  round(avg(CASE WHEN l_discount < 0.05 THEN 1 ELSE 0 END), 4) AS rate
FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), ())""")
def normalize_metrics(t):
    return normalize.match_metrics(t("lineitem").select(F.col("l_returnflag").alias("field"), (F.col("l_discount") < 0.05).alias("matched")))


@query("SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem WHERE l_discount >= 0.05 ORDER BY l_orderkey, l_linenumber LIMIT 50")
def unmatched_examples(t):
    return t("lineitem").where("l_discount >= 0.05").select("l_orderkey", "l_linenumber", "l_returnflag").orderBy("l_orderkey", "l_linenumber").limit(50)


# --- class balance -----------------------------------------------------------


@query("SELECT o_orderpriority AS category, count(DISTINCT o_custkey) AS n FROM orders GROUP BY o_orderpriority")
def category_counts(t):
    return curate.category_counts(t("orders").withColumnRenamed("o_orderpriority", "category"), "o_custkey", "category")


@query("""
WITH c AS (SELECT o_orderpriority AS category, count(DISTINCT o_custkey) AS n FROM orders GROUP BY 1)
SELECT category, max(n) OVER () - n AS needed FROM c QUALIFY needed > 0
UNION ALL SELECT 'none such', (SELECT max(n) FROM c)""")
def deficits(t):
    orders = t("orders").withColumnRenamed("o_orderpriority", "category")
    vocabulary = orders.select("category").distinct().union(orders.sparkSession.createDataFrame([("none such",)], "category string"))
    return curate.deficits(curate.category_counts(orders, "o_custkey", "category"), vocabulary, "category")


REBALANCE = """
WITH RECURSIVE r AS (SELECT DISTINCT o_custkey AS rec, o_orderpriority AS category FROM orders),
c AS (SELECT category, count(*) AS n, min(rec) AS template, list(rec) AS recs FROM r GROUP BY category),
p AS (SELECT *, row_number() OVER (ORDER BY category) AS place, max(n) OVER () AS target FROM c),
f(place, done) AS (
  SELECT 0::BIGINT, []::STRUCT(category VARCHAR, template BIGINT, k BIGINT)[]
  UNION ALL
  SELECT p.place, list_append(f.done, {'category': p.category, 'template': p.template, 'k': CAST(greatest(0, p.target - p.n -
    coalesce(list_sum([d.k FOR d IN f.done IF list_contains(p.recs, d.template)]), 0)) AS BIGINT)})
  FROM f JOIN p ON p.place = f.place + 1)
SELECT d.category, d.template, d.k AS n_copies FROM (SELECT unnest(done) AS d FROM f WHERE place = (SELECT max(place) FROM p))"""


def _needed(t) -> DataFrame:
    orders = t("orders").select(F.col("o_custkey").alias("rec"), F.col("o_orderpriority").alias("category"))
    categories = orders.select("category").distinct().withColumn("place", F.col("category"))
    return curate.duplicates_needed(orders.withColumn("ord", F.col("rec")), categories, "rec", "category", "ord")


@query(REBALANCE)
def rebalance(t):
    return _needed(t)


@query(f"""
SELECT category, template, CAST(copy AS BIGINT) AS copy, row_number() OVER (PARTITION BY template ORDER BY category, copy) AS dup
FROM (SELECT category, template, unnest(range(1, n_copies + 1)) AS copy FROM ({REBALANCE}))""")
def rebalance_dups(t):
    return curate.duplicate_rows(_needed(t), "category")


# --- data quality ------------------------------------------------------------

RULES = [("in_range", "l_quantity", "l_quantity < 2 OR l_quantity > 49"), ("ge", "l_discount", "l_discount < 0.01"), ("isin", "l_returnflag", "l_returnflag NOT IN ('A', 'N')")]


def _failures(t) -> DataFrame:
    rules = [quality_gate.in_range("l_quantity", 2, 49), quality_gate.at_least("l_discount", 0.01), quality_gate.one_of("l_returnflag", ["A", "N"])]
    return quality_gate.rule_failures(t("lineitem"), "l_orderkey", rules)


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"check\", '{f}' AS \"column\", l_orderkey AS row_key FROM lineitem WHERE {bad}" for c, f, bad in RULES))
def dq_failures(t):
    return _failures(t).drop("failure_case")


@query("SELECT \"check\", \"column\", count(*) AS n_failures FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS \"check\", '{f}' AS \"column\" FROM lineitem WHERE {bad}" for c, f, bad in RULES) + ") GROUP BY 1, 2")
def dq_report(t):
    return quality_gate.report(_failures(t)).drop("examples")


@query("SELECT 'unique' AS \"check\", 'o_custkey' AS \"column\", CAST(o_custkey AS VARCHAR) AS failure_case, o_custkey AS row_key FROM orders GROUP BY o_custkey HAVING count(*) > 1")
def dq_unique(t):
    return quality_gate.duplicate_keys(t("orders"), "o_custkey")


# --- data sets ---------------------------------------------------------------

SPLIT_SQL = """
WITH RECURSIVE g AS (SELECT o_custkey AS grp, count(*) AS n, min(o_orderkey) AS f FROM orders GROUP BY 1),
o AS (SELECT grp, n, row_number() OVER (ORDER BY n DESC, f) AS i, sum(n) OVER () AS total FROM g),
w(i, grp, n, a, b, c, split) AS (
  SELECT 0::BIGINT, NULL::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, NULL::VARCHAR
  UNION ALL
  SELECT i, grp, n, a + CASE WHEN s = 'train' THEN n ELSE 0 END, b + CASE WHEN s = 'val' THEN n ELSE 0 END, c + CASE WHEN s = 'test' THEN n ELSE 0 END, s
  FROM (SELECT o.i, o.grp, o.n, w.a, w.b, w.c, CASE
      WHEN o.total * 0.8::DOUBLE - w.a >= o.total * 0.1::DOUBLE - w.b AND o.total * 0.8::DOUBLE - w.a >= o.total * 0.1::DOUBLE - w.c THEN 'train'
      WHEN o.total * 0.1::DOUBLE - w.b >= o.total * 0.1::DOUBLE - w.c THEN 'val' ELSE 'test' END AS s
    FROM w JOIN o ON o.i = w.i + 1))
SELECT grp AS patient, n, split FROM w WHERE i > 0"""


def _splits(t) -> DataFrame:
    sizes = t("orders").groupBy(F.col("o_custkey").alias("patient")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"))
    return dataset.split_groups(sizes, "patient", checkpointed)


@query(SPLIT_SQL)
def group_split(t):
    return _splits(t)


@query(f"SELECT split, CAST(sum(n) AS BIGINT) AS n, round(sum(n) / sum(sum(n)) OVER (), 4) AS share FROM ({SPLIT_SQL}) GROUP BY split")
def split_ratio(t):
    rows = t("orders").join(_splits(t).select("patient", "split"), F.col("o_custkey").eqNullSafe(F.col("patient")))  # all without a patient are a group
    return dataset.split_shares(rows)


@query("SELECT o_custkey, count(DISTINCT o_orderkey % 2) AS n_splits FROM orders GROUP BY o_custkey HAVING n_splits > 1")
def split_leakage(t):
    return dataset.crossing_groups(t("orders").withColumn("split", F.col("o_orderkey") % 2), "o_custkey")


@query("""
SELECT u.conv_id, u.turn, u.text AS instruction, a.text AS response
FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'""")
def format_pairs(t):
    said = t("conversations")
    user = said.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("instruction"))
    answer = said.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response"))
    return user.join(answer, ["conv_id", "turn"])


@query("SELECT o_orderkey, o_orderstatus AS status, o_totalprice AS price FROM orders")
def response_json_fields(t):
    response = F.to_json(F.struct(F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price")), {"ignoreNullFields": "false"})
    return t("orders").select("o_orderkey", F.from_json(response, "status string, price double").alias("r")).select("o_orderkey", "r.*")


@query("SELECT count(*) AS n_examples, sha256(string_agg(sha256(text), '' ORDER BY item_id)) AS sha256 FROM benchmark")
def gold_manifest(t):
    return dataset.frozen(t("benchmark"), "item_id", F.col("text"), checkpointed)


# --- evaluation --------------------------------------------------------------

SCORES = """
WITH t AS (SELECT doc_id, quality AS category FROM labels),
p AS (SELECT doc_id, CASE WHEN contains(text, '***') OR contains(text, '!!') THEN 0 ELSE 1 END AS category FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)),
b AS (SELECT coalesce(t.category, p.category) AS category, t.doc_id IS NOT NULL AS t, p.doc_id IS NOT NULL AS p FROM t FULL JOIN p ON t.doc_id = p.doc_id AND t.category = p.category),
s AS (SELECT category, count(*) FILTER (t AND p) AS tp, count(*) FILTER (NOT t) AS fp, count(*) FILTER (NOT p) AS fn FROM b GROUP BY category)"""
RATES = "tp, fp, fn, round(tp / (tp + fp), 4) AS precision, round(tp / (tp + fn), 4) AS recall, round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 4) AS f1"


def _scores(t) -> DataFrame:
    truth = t("labels").select("doc_id", F.col("quality").alias("category"))
    junk = F.contains("text", F.lit("***")) | F.contains("text", F.lit("!!"))
    predicted = t("documents").join(truth.select("doc_id"), "doc_id", "left_semi").select("doc_id", F.when(junk, 0).otherwise(1).alias("category"))
    return evaluate.score_pairs(truth, predicted, "doc_id", "category")


@query(f"{SCORES} SELECT category, {RATES} FROM s")
def per_category(t):
    return _scores(t)


@query(f"{SCORES}, a AS (SELECT CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM s) SELECT {RATES} FROM a")
def score_field(t):
    return evaluate.overall(_scores(t))


@query(f"{SCORES} SELECT category, fp, fn FROM s WHERE fp > 0 OR fn > 0")
def failing_categories(t):
    return _scores(t).where("fp > 0 or fn > 0").select("category", "fp", "fn")


@query("SELECT l_shipped AS name, count(*) AS n FROM (SELECT l_returnflag AS l_shipped FROM lineitem) WHERE l_shipped NOT IN ('A', 'N') GROUP BY 1")
def non_canonical(t):
    canon = t("lineitem").sparkSession.createDataFrame([("A",), ("N",)], "name string")
    return t("lineitem").select(F.col("l_returnflag").alias("name")).join(canon, "name", "left_anti").groupBy("name").agg(F.count("*").alias("n"))


@query("SELECT 'props' AS field, avg(CASE WHEN json_valid(props) AND json_type(props) = 'OBJECT' THEN 1 ELSE 0 END) AS rate FROM events UNION ALL SELECT 'text', avg(CASE WHEN json_valid(text) AND json_type(text) = 'OBJECT' THEN 1 ELSE 0 END) FROM documents")
def json_validity(t):
    rate = lambda df, c, name: df.agg(F.lit(name).alias("field"), F.avg(evaluate.json_object(F.col(c)).cast("int")).alias("rate"))
    return rate(t("events"), "props", "props").union(rate(t("documents"), "text", "text"))


@query("""
SELECT kind, count(*) AS n FROM (SELECT CASE WHEN e IS NOT DISTINCT FROM g THEN 'exact' WHEN g IS NULL THEN 'missing' WHEN e IS NULL THEN 'hallucinated' ELSE 'wrong' END AS kind
FROM (SELECT CASE WHEN l_linenumber <> 2 THEN l_discount END AS e, CASE WHEN l_linenumber <> 3 THEN round(l_tax, 2) END AS g FROM lineitem)) GROUP BY kind""")
def dosage_match_kinds(t):
    expected, got = F.when(F.col("l_linenumber") != 2, F.col("l_discount")), F.when(F.col("l_linenumber") != 3, F.round("l_tax", 2))
    return t("lineitem").select(evaluate.match_kind(expected, got).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


# --- analytics ---------------------------------------------------------------

FACTS = """
WITH tbl AS (SELECT o_custkey AS patient_id, o_orderstatus AS split, o_orderpriority AS diagnosis, n AS n_diagnoses, n % 3 AS n_medications, price / 1000 AS confidence, o_orderkey % 5 = 0 AS is_rebalance_duplicate
FROM orders JOIN (SELECT o_custkey AS k, count(*) AS n, round(min(o_totalprice), 0) AS price FROM orders GROUP BY 1) ON k = o_custkey)"""


def _facts(t) -> DataFrame:
    whole = t("orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n"), F.round(F.min("o_totalprice"), 0).alias("price"))
    rows = t("orders").join(whole, F.col("o_custkey") == F.col("k"))
    return rows.select(
        F.col("o_custkey").alias("patient_id"), F.col("o_orderstatus").alias("split"), F.col("o_orderpriority").alias("diagnosis"), F.col("n").alias("n_diagnoses"),
        (F.col("n") % 3).alias("n_medications"), (F.col("price") / 1000).alias("confidence"), (F.col("o_orderkey") % 5 == 0).alias("is_rebalance_duplicate"),
    )


@query(f"{FACTS} SELECT diagnosis, count(DISTINCT patient_id) AS patients, round(avg(confidence), 3) AS avg_confidence FROM tbl GROUP BY diagnosis")
def prevalence(t):
    return analytics.prevalence(_facts(t))


@query(f"{FACTS} SELECT split, count(*) AS rows, count(DISTINCT patient_id) AS patients, count(*) FILTER (is_rebalance_duplicate) AS rebalance_dupes FROM tbl GROUP BY split")
def split_distribution(t):
    return analytics.split_distribution(_facts(t))


COMORBIDITY = "SELECT diagnosis, round(avg(n_diagnoses), 2) AS avg_dx_per_record, round(avg(n_medications), 2) AS avg_meds FROM tbl GROUP BY diagnosis"


@query(f"{FACTS} {COMORBIDITY}")
def comorbidity(t):
    return analytics.comorbidity(_facts(t))


@query(f"{FACTS} {COMORBIDITY} ORDER BY avg_dx_per_record DESC, diagnosis LIMIT 3")
def sql_over_view(t):
    return analytics.query_facts(_facts(t), f"{COMORBIDITY} ORDER BY avg_dx_per_record DESC, diagnosis LIMIT 3")


@query("""
WITH c AS (SELECT o_custkey AS patient_id, CASE WHEN o_custkey % 2 = 0 THEN 'train' ELSE 'test' END AS split, list(DISTINCT o_orderpriority) AS d, count(*) AS m FROM orders GROUP BY 1)
SELECT patient_id, split, unnest(d) AS diagnosis, len(d) AS n_diagnoses, m AS n_medications, 0 AS n_vitals, 1.0::DOUBLE AS confidence, patient_id % 7 = 0 AS is_rebalance_duplicate FROM c""")
def analytics_flatten(t):
    records = t("orders").groupBy(F.col("o_custkey").alias("patient_id")).agg(
        F.collect_set(F.struct(F.col("o_orderpriority").alias("name"))).alias("diagnoses"), F.collect_list("o_orderkey").alias("medications")
    )
    records = records.withColumns({"vitals": F.lit(None).cast("array<string>"), "confidence": F.lit(1.0), "rebalance_duplicate_of": F.when(F.col("patient_id") % 7 == 0, F.lit("x"))})
    return analytics.flatten_records({"train": records.where("patient_id % 2 = 0"), "test": records.where("patient_id % 2 <> 0")})


@query("SELECT l_discount AS value, count(*) AS n FROM lineitem GROUP BY l_discount ORDER BY value")
def value_histogram(t):
    return t("lineitem").groupBy(F.col("l_discount").alias("value")).agg(F.count("*").alias("n")).orderBy("value")


@query("""
SELECT a.category, coalesce(b.n, 0) AS before, a.n AS after FROM (SELECT event_type AS category, count(*) AS n FROM events GROUP BY 1) a
LEFT JOIN (SELECT event_type AS category, count(*) AS n FROM events WHERE value > 50 GROUP BY 1) b ON a.category = b.category""")
def before_after(t):
    events = t("events").withColumnRenamed("event_type", "category")
    before = events.where("value > 50").groupBy("category").agg(F.count("*").alias("before"))
    return R.lookup(events.groupBy("category").agg(F.count("*").alias("after")), before, ["category"], {"before": 0})


# --- lineage -----------------------------------------------------------------


@query(" UNION ALL ".join(f"SELECT '{n}' AS artifact, count(*) AS record_count FROM {n}" for n in ("customer", "orders", "lineitem", "events", "documents")))
def provenance_counts(t):
    parts = [t(n).agg(F.lit(n).alias("artifact"), F.count("*").alias("record_count")) for n in ("customer", "orders", "lineitem", "events", "documents")]
    out = parts[0]
    for more in parts[1:]:
        out = out.union(more)
    return out


@query("SELECT arg_max(event_id, (ts, event_id)) AS event_id, arg_max(user_id, (ts, event_id)) AS user_id FROM events")
def registry_latest(t):
    return lineage.latest_run(t("events").select("event_id", "user_id", F.struct("ts", "event_id").alias("at")), "at").select("event_id", "user_id")


@query("SELECT user_id AS run, epoch, loss FROM (SELECT user_id, event_id AS epoch, value AS loss, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS n FROM events) WHERE n = 1")
def best_epoch(t):
    return lineage.best_epoch(t("events").select(F.col("user_id").alias("run"), F.col("event_id").alias("epoch"), F.col("value").alias("loss")), "run")


@query("SELECT round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS mean FROM lineitem")
def weighted_mean(t):
    return lineage.weighted_mean(t("lineitem"), "l_discount", "l_quantity", "mean").select(F.round("mean", 6).alias("mean"))


@query("SELECT DISTINCT sha256(text) AS key FROM documents EXCEPT SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0")
def cache_miss(t):
    keyed = t("documents").select("doc_id", F.sha2("text", 256).alias("key"))
    return R.missing_from(keyed, keyed.where("doc_id % 2 = 0"), "key").select("key")


@query("""
SELECT 'both' AS side, count(*) AS n FROM (SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders)
UNION ALL SELECT 'left', count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)""")
def exact_set_ops(t):
    left, right = t("customer").select(F.col("c_custkey").alias("k")), t("orders").select(F.col("o_custkey").alias("k"))
    counted = lambda df, name: df.agg(F.lit(name).alias("side"), F.count("*").alias("n"))
    return counted(left.intersect(right), "both").union(counted(left.subtract(right), "left"))
