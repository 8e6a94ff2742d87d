"""Personal data: base expressions, and bootstrapped contextual extraction of what they miss.

The base spans are the seeds. The words around seeds are lexical patterns; patterns and the identifiers they
surround form a bipartite graph over the whole corpus. Seeds score 1, any other identifier what the best accepted pattern
around it scores, or 0. A pattern scores the mean of its identifiers, and is accepted with the score it then has, if that
is high enough and enough different identifiers stand behind it. Rounds go on until no further pattern is accepted; as scores
of identifiers only rise, that is the one fixed point. Identifiers in contexts of accepted patterns are added as spans.

Places of matches come from two facts: split() and regexp_extract_all() walk a text in the same way,
so a match starts after the pieces and matches before it. The expressions are possessive where that
cannot change a match, so that time is linear in the text whatever it holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions.spans import rewritten, united
from vellum.llm.shared import SPACE_RUN, SPACES, counted, fresh, row_key, small, span_list, stored, table

#: The base expressions, in the order of kinds. \G lets a match begin where the last one ended.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
#: Chains of digits with single separators, whole, of 13 to 19 digits; longer and shorter chains fail anyway.
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){12,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ["email", "ip", "card", "phone"]
PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"

#: What may be an identifier: a word with an @ sign or with six digits or more.
IDENTIFIER = (
    r"(?<![^\x20\x09-\x0D])(?=[^\x20\x09-\x0D@]*+@|(?:[^\x20\x09-\x0D0-9]*+[0-9]){6})[^\x20\x09-\x0D]++"
)
#: A pattern is accepted if it surrounds so many different identifiers of a score above zero, and at this mean score.
LEAST_KNOWN, LEAST_SCORE = 3, 0.8
#: Identifiers and patterns longer than this stand in the graph by their SHA-256.
LONGEST = 64
BLOCK = 256


def n_digits(x: Column) -> Column:
    return F.length(F.regexp_replace(x, "[^0-9]", ""))


def luhn(x: Column) -> Column:
    """Whether the digits of x, the last one the check digit, pass Luhn's test."""
    digits = F.reverse(F.filter(F.split(F.regexp_replace(x, "[^0-9]", ""), ""), lambda d: d != ""))
    worth = F.transform(
        digits,
        lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d >= "5", 9).otherwise(0)),
    )
    return F.aggregate(worth, F.lit(0), lambda a, b: a + b) % 10 == 0


CHECKS = {
    "email": lambda x: F.lit(True),
    "ip": lambda x: x.rlike(rf"^{PART}(?:\.{PART}){{3}}$"),
    "card": lambda x: (n_digits(x) >= 13) & (n_digits(x) <= 19) & luhn(x),
    "phone": lambda x: (n_digits(x) >= 9) & (n_digits(x) <= 15),
}
#: What a text must contain to be searched at all.
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}


def with_matches(df: DataFrame, name: str, pattern: str, needs: str = "") -> DataFrame:
    """Adds <name>: array<struct<start, end, text, before, after>> of the pattern's matches in text.

    before and after are the text back to the last match and up to the next one. Prefix sums go by blocks, so that a
    text with very many matches takes little more than linear time.
    """
    found = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    if needs:
        found = F.when(F.contains("text", F.lit(needs)), found).otherwise(F.array().cast("array<string>"))
    df = df.withColumn("_found", found)
    df = df.withColumn("_pieces", F.when(F.size("_found") > 0, F.split("text", pattern)))
    df = df.withColumn(
        "_steps",
        F.when(F.size("_found") > 0, F.zip_with("_pieces", "_found", lambda p, m: F.length(p) + F.coalesce(F.length(m), F.lit(0)))),
    )
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size("_found") - 1) / BLOCK).cast("int")),
        lambda b: total(F.slice("_steps", b * BLOCK + 1, F.lit(BLOCK))),
    )
    upto = F.aggregate(
        blocks, F.array(F.lit(0)), lambda a, n: F.array_append(a, F.element_at(a, -1) + n)
    )
    df = df.withColumn("_upto", F.when(F.size("_found") > 0, upto))

    def span(match: Column, i: Column) -> Column:
        block = F.floor(i / BLOCK).cast("int")
        start = F.get("_upto", block) + total(F.slice("_steps", block * BLOCK + 1, i % BLOCK)) + F.length(F.get("_pieces", i))
        return F.struct(
            start.alias("start"),
            (start + F.length(match)).alias("end"),
            match.alias("text"),
            F.get("_pieces", i).alias("before"),
            F.get("_pieces", i + 1).alias("after"),
        )

    none = F.array().cast("array<struct<start:int,end:int,text:string,before:string,after:string>>")
    return df.withColumn(name, F.when(F.size("_found") > 0, F.transform("_found", span)).otherwise(none)).drop(
        "_found", "_pieces", "_steps", "_upto"
    )


def checked(kind: str) -> Column:
    """Of the matches in _all those that pass the check of this kind, as spans."""
    passing = F.filter("_all", lambda m: CHECKS[kind](m["text"]))
    return F.transform(passing, lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end")))


def base_spans(docs: DataFrame) -> DataFrame:
    """Replaces text by base: array<struct<kind, start, end>> by kind as listed, then start, and counts by kind;
    adds candidates: identifiers with their context."""
    df = docs.withColumn("text", F.coalesce("text", F.lit("")))
    for kind, pattern in zip(KINDS, [EMAIL, IP, CARD, PHONE], strict=True):
        df = with_matches(df, "_all", pattern, NEEDS[kind])
        df = df.withColumn(f"_{kind}", checked(kind)).drop("_all")
    df = with_matches(df, "_words", IDENTIFIER)
    context = F.transform(
        "_words",
        lambda m: F.struct(
            m["start"].alias("start"),
            m["end"].alias("end"),
            short(F.lower(m["text"])).alias("text"),
            lexical_patterns(m["before"], m["after"]).alias("patterns"),
        ),
    )
    counts = {f"n_{kind}": F.size(f"_{kind}").cast("long") for kind in KINDS}
    return df.withColumns(counts | {"base": F.concat(*(f"_{kind}" for kind in KINDS)), "candidates": context}).drop(
        "text", "_words", *(f"_{kind}" for kind in KINDS)
    )


def short(x: Column) -> Column:
    return F.when(F.length(x) <= LONGEST, x).otherwise(F.sha2(x, 256))


def lexical_patterns(before: Column, after: Column) -> Column:
    """The two words before; the word before and the word after; the word before. Words are whole, digits in them folded; a missing
    word (also where an identifier stands in its place) gives no pattern."""
    folded = lambda x: F.nullif(F.regexp_replace(F.lower(x), "[0-9]+", "0"), F.lit(""))
    back = F.split(F.ltrim(F.reverse(before), F.lit(SPACES)), SPACE_RUN, 3)  # from the identifier on, as far as two words go
    one, two = (folded(F.reverse(F.get(back, i))) for i in range(2))
    nxt = folded(F.get(F.split(F.ltrim(after, F.lit(SPACES)), SPACE_RUN, 2), 0))
    made = [("b2 ", two, one), ("ba ", one, nxt), ("b1 ", one)]
    return F.array_compact(F.array(*(short(F.concat(F.lit(kind + " "), *(x for w in words for x in (w, F.lit(" "))))) for kind, *words in made)))


def trusted_patterns(edges: DataFrame) -> DataFrame:
    """pattern, score of the patterns that bootstrapping ends with. edges, a stored table: distinct (pattern, identifier, seed).

    A pattern that very many identifiers share meets its score in a join whose other side has one row for each pattern, and is broadcast
    if these are few; else skewed partitions are split.
    """
    accepted, n = None, 0
    while True:
        scored = edges.withColumn("score", F.col("seed").cast("double"))
        if accepted is not None:
            reached = edges.join(accepted, "pattern").groupBy("identifier").agg(F.max("score").alias("reached"))
            scored = scored.join(reached, "identifier", "left").withColumn("score", F.greatest("score", F.coalesce("reached", F.lit(0.0))))
        means = scored.groupBy("pattern").agg(F.sum((F.col("score") > 0).cast("int")).alias("known"), F.avg("score").alias("score"))
        # a margin for the order of sums, so that a mean at the bound doesn't depend on it
        passing = means.where((F.col("known") >= LEAST_KNOWN) & (F.col("score") >= LEAST_SCORE - 1e-9)).select("pattern", "score")
        if accepted is not None:  # those accepted before keep the score they had
            passing = accepted.union(passing.join(accepted, "pattern", "left_anti"))
        before, (accepted, n) = n, counted(passing, "trusted")
        accepted = small(accepted, n)
        if n == before:
            return accepted


def find_pii(docs: DataFrame, *keep: str) -> DataFrame:
    """Spans of personal data in each row of docs (doc_id, text); of other columns only those in keep are read, and kept.

    Gives doc_id, counts of the base kinds, base and spans (arrays of kind, start, end; places in code points, end
    exclusive). spans holds the base spans by kind as listed, then start, then added ones of kind context by start;
    an added span touches no base span. A null text counts as empty and has no spans. Rows with equal doc_id and
    equal candidates (so repeated rows) share their added spans; a null doc_id stays null. An empty table gives an empty result.
    """
    found = stored(
        base_spans(docs.select("doc_id", "text", *keep)).withColumn(
            "row", F.when(F.size("candidates") > 0, F.sha2(F.concat_ws("\x1f", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.to_json("candidates"), F.to_json("base")), 256))
        ),
        "pii",
    )
    instances = stored(
        found.where(F.size("candidates") > 0)
        .select("row", "base", F.explode("candidates").alias("c"))
        .select(
            "row",
            F.col("c.start").alias("start"),
            F.col("c.end").alias("end"),
            F.col("c.text").alias("identifier"),
            F.exists("base", lambda b: (b["start"] < F.col("c.end")) & (F.col("c.start") < b["end"])).alias("seed"),
            F.explode("c.patterns").alias("pattern"),
        ),
        "pii-instances",
    )
    edges = stored(instances.groupBy("pattern", "identifier").agg(F.max("seed").alias("seed")), "pii-edges")
    added = (
        instances.where(~F.col("seed"))
        .join(trusted_patterns(edges).select("pattern"), "pattern")
        .select("row", F.struct(F.lit("context").alias("kind"), "start", "end").alias("span"))
        .groupBy("row")
        .agg(F.sort_array(F.collect_set("span")).alias("added"))
    )
    bare = found.where(F.col("row").isNull())  # nothing to join; as one null key, they would meet in one task
    judged = found.where(F.col("row").isNotNull()).join(added, "row", "left")
    return (
        judged.unionByName(bare, allowMissingColumns=True)
        .withColumn("spans", F.when(F.col("added").isNull(), F.col("base")).otherwise(F.concat("base", "added")))
        .drop("candidates", "row", "added")
    )


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span of find_pii() in text replaced by its kind, as [EMAIL]; n_chars follows the text.

    All rows and columns stay. Overlapping spans are replaced as one, from the first start to the last end, by the kind
    that starts first (of those that start together, the one that ends first). A text without spans is unchanged, as is a null one. Rows are matched by doc_id and text, so null and repeated ids do no harm.
    """
    key, found_spans, cut = (fresh(docs, name) for name in ("row_key", "pii_spans", "pii_cut"))
    keyed = docs.withColumn(key, row_key())
    found = find_pii(keyed, key).where(F.size("spans") > 0)
    spans = found.groupBy(key).agg(F.first("spans").alias(found_spans))
    ordered = F.sort_array(F.transform(found_spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    out = keyed.join(spans, key, "left").withColumn(cut, united(ordered, ["start", "end", "kind"]))
    masked = rewritten(F.col("text"), F.col(cut), lambda s, _: F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
    out = out.withColumn("text", masked)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(cut).isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *(f"n_{kind}" for kind in KINDS),
        F.sha2(span_list(F.col("base")), 256).alias("base_sha256"),
        span_list(F.col("spans")).alias("spans"),
    )
