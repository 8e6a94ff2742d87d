"""Quality rules as weak supervision.

Each rule votes for good (1), for bad (-1) or abstains (0). Expectation-maximisation over the counts of
vote patterns estimates how often each rule is right when it votes, and the share of good documents. A
document is kept if its posterior probability of being good is at least one half. The patterns are at
most 3 to the power of the number of rules, whatever the number of documents; the iterations are one
expression over that bounded array, and go on until the likelihood no longer grows.

Rules are written to be one-sided: each sees a few kinds of bad documents, and next to no good one. The model is told so by a
floor under the rates on good documents (LEAST_ON_GOOD). Without it the likeliest model of a corpus with much junk that
only one rule sees has this rule for a poor one and the junk for good; a test shows both outcomes on labelled documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.shared import SPACES, stored, table, words

SYMBOLS = "#*$%&|<>"
#: More than any place of a word: arrays have fewer elements.
PLACES = 1 << 31
#: Iteration ends once the mean log-likelihood of a document grows by less than TOLERANCE; ROUNDS is far beyond what that takes.
TOLERANCE, ROUNDS = 1e-9, 2000
#: Bounds of the estimated rates.
LEAST, MOST, LEAST_ON_GOOD = 0.02, 0.999, 0.995
#: Rates to start from, also the prior of each rule with a weight of so many votes: a rule is nearly always
#: right to call a good document good; each kind of bad document is seen by few of the rules.
START_GOOD, START_BAD, PRIOR_VOTES = 0.995, 0.3, 10.0


def characters(text: Column, runs: str) -> Column:
    """How many characters the matches of an expression hold."""
    return F.length(F.array_join(F.regexp_extract_all(text, F.lit(runs), F.lit(0)), "")).cast("long")


def text_measures(docs: DataFrame) -> DataFrame:
    """Replaces text by the counts that rules look at; all of them are taken within the row."""
    read = docs.withColumn("text", F.coalesce("text", F.lit("")))
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0)
    split = read.withColumns({"words": words(F.col("text")), "lines": lines})
    split = split.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    window = lambda x, i: [F.get(x, i + k) for k in range(3)]
    # a window's hash, cut to 33 bits, and its place in one number: sorted, windows of like hashes are neighbours
    packed = F.transform(
        F.sequence(F.lit(0), F.size("words") - 3),
        lambda i: F.xxhash64(*window("hashes", i)).bitwiseAND(-PLACES).bitwiseOR(i.cast("long")),
    )
    windows = F.when(F.size("words") >= 3, F.sort_array(packed)).otherwise(F.array().cast("array<long>"))
    counted = split.select(
        *[c for c in docs.columns if c != "text"],
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        characters(F.col("text"), f"[{SYMBOLS}]+").alias("n_symbols"),
        characters(F.col("text"), "[A-Z]+").alias("n_upper"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.array_distinct("hashes")).cast("long").alias("n_distinct"),
        "words",
        windows.alias("windows"),
    )
    # only those with a neighbour of like hash are compared as words
    alike = lambda x, j: F.coalesce(x.bitwiseAND(-PLACES) == F.get("windows", j).bitwiseAND(-PLACES), F.lit(False))
    some = F.transform(F.filter("windows", lambda x, j: alike(x, j - 1) | alike(x, j + 1)), lambda x: x.bitwiseAND(PLACES - 1).cast("int"))
    spelled = F.transform(some, lambda i: F.struct(F.concat_ws(" ", *window("words", i)).alias("w"), i.alias("i")))
    placed = counted.withColumn("places", F.sort_array(spelled))
    equal = lambda x, j: F.coalesce(F.get("places", j)["w"] == x["w"], F.lit(False))
    starts = F.sort_array(F.transform(F.filter("places", lambda x, j: equal(x, j - 1) | equal(x, j + 1)), lambda x: x["i"]))
    covered = F.aggregate(
        starts,
        F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda a, s: F.struct(s.alias("last"), (a["n"] + F.least(F.lit(3), s - a["last"])).alias("n")),
        lambda a: a["n"],
    )
    return placed.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("words", "windows", "places")


def vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rule_votes() -> dict[str, Column]:
    """The rules over the measures of one document; where there are no words, shares are null and rules abstain."""
    n = F.nullif(F.col("n_words"), F.lit(0))
    repeat, symbols = F.col("n_repeat_words") / n, F.col("n_symbols") / n
    upper = F.col("n_upper") / F.nullif(F.col("word_chars"), F.lit(0))
    mean, variety = F.col("word_chars") / n, F.col("n_distinct") / n
    same_lines = F.col("n_dup_lines") / F.nullif(F.col("n_lines"), F.lit(0))
    return {
        "length": vote(F.col("n_words") >= 80, F.col("n_words") < 50),
        "repeats": vote(repeat < 0.15, repeat > 0.4),
        "symbols": vote(symbols < 0.05, symbols > 0.2),
        "lines": vote(same_lines < 0.1, same_lines > 0.4),
        "word_length": vote((mean >= 3) & (mean <= 11), (mean < 2) | (mean > 20)),
        "shouting": vote(upper < 0.15, upper > 0.4),
        "variety": vote(variety > 0.3, (variety < 0.08) & (F.col("n_words") > 40) & (F.col("n_words") < 2000)),
    }


def likelihood(votes: Column, right: Column, label: int) -> Column:
    """Of the votes cast, given the label; right: how often each rule's vote is right on that label."""
    each = F.zip_with(votes, right, lambda v, a: F.when(v == 0, 1.0).when(v == label, a).otherwise(1 - a))
    return F.aggregate(each, F.lit(1.0), lambda x, y: x * y)


def joint(votes: Column, model: Column) -> tuple[Column, Column]:
    """Probability of these votes and a good document; of these votes and a bad one."""
    good = model["share"] * likelihood(votes, model["on_good"], 1)
    return good, (1 - model["share"]) * likelihood(votes, model["on_bad"], -1)


def posterior(votes: Column, model: Column) -> Column:
    """Probability that a document with these votes is good."""
    good, bad = joint(votes, model)
    return good / (good + bad)


def bound(value: Column, body) -> Column:
    """body(value), with value taken once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fit(voted: DataFrame, n_rules: int, rounds: int = ROUNDS, least_on_good: float = LEAST_ON_GOOD) -> DataFrame:
    """One row: model (share of good documents; how often each rule, when it votes, is right on good and on
    bad ones; mean log-likelihood, rounds taken, and whether it has converged) and the patterns counted."""
    patterns = voted.groupBy("votes").agg(F.count("*").alias("n"))
    gathered = patterns.agg(F.sort_array(F.collect_list(F.struct("votes", "n"))).alias("patterns"))

    def total(patterns: Column, value) -> Column:
        return F.aggregate(F.transform(patterns, value), F.lit(0.0), lambda x, y: x + y)

    def scored(model: Column) -> Column:
        def one(p: Column) -> Column:
            good, bad = joint(p["votes"], model)
            weights = lambda x: F.struct(
                p["votes"].alias("votes"),
                (p["n"] * x["good"] / (x["good"] + x["bad"])).alias("good"),
                (p["n"] * x["bad"] / (x["good"] + x["bad"])).alias("bad"),
                (p["n"] * F.ln(x["good"] + x["bad"])).alias("ll"),
            )
            return bound(F.struct(good.alias("good"), bad.alias("bad")), weights)

        return F.transform("patterns", one)

    def step(model: Column, turn: Column) -> Column:
        def rates(scored: Column, label: int, weight: str, start: float, least: float) -> Column:
            def rule(j: Column) -> Column:
                cast = lambda p: F.get(p["votes"], j)
                agree = total(scored, lambda p: F.when(cast(p) == label, p[weight]).otherwise(0.0))
                voting = total(scored, lambda p: F.when(cast(p) != 0, p[weight]).otherwise(0.0))
                rate = (agree + PRIOR_VOTES * start) / (voting + PRIOR_VOTES)
                return F.greatest(F.least(rate, F.lit(MOST)), F.lit(least))

            return F.transform(F.sequence(F.lit(0), F.lit(n_rules - 1)), rule)

        def renewed(scored: Column) -> Column:
            n = total(F.col("patterns"), lambda p: p["n"].cast("double"))
            ll = total(scored, lambda p: p["ll"]) / n
            share = (total(scored, lambda p: p["good"]) + 1) / (n + 2)
            return F.struct(
                F.greatest(F.least(share, F.lit(0.95)), F.lit(0.05)).alias("share"),
                rates(scored, 1, "good", START_GOOD, least_on_good).alias("on_good"),
                rates(scored, -1, "bad", START_BAD, LEAST).alias("on_bad"),
                ll.alias("ll"),
                turn.alias("rounds"),
                F.coalesce(F.abs(ll - model["ll"]) < TOLERANCE, F.lit(False)).alias("converged"),
            )

        return F.when(model["converged"], model).otherwise(bound(scored(model), renewed))

    start = F.struct(
        F.lit(0.8).alias("share"),
        F.array_repeat(F.lit(START_GOOD), n_rules).alias("on_good"),
        F.array_repeat(F.lit(START_BAD), n_rules).alias("on_bad"),
        F.lit(float("-inf")).alias("ll"),
        F.lit(0).alias("rounds"),
        F.lit(False).alias("converged"),
    )
    return gathered.select("patterns", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step).alias("model"))


def scored_patterns(voted: DataFrame, n_rules: int, rounds: int = ROUNDS) -> DataFrame:
    """votes, posterior: a row for each pattern of votes that occurs, so 3 to the power of n_rules at most. A model that still
    moves after all rounds is an error."""
    each = fit(voted, n_rules, rounds).select("model", F.explode("patterns").alias("p")).select("model", "p.votes")
    unsettled = F.raise_error(F.lit(f"expectation-maximisation did not converge in {rounds} rounds"))
    said = F.when(F.col("model.converged"), posterior(F.col("votes"), F.col("model"))).otherwise(unsettled.cast("double"))
    return each.select("votes", said.alias("posterior"))


def judge_quality(docs: DataFrame, *keep: str) -> DataFrame:
    """Measures, votes, posterior and kept of each row of docs (doc_id, text).

    A null text counts as empty: no words, so base_failed. Repeated rows are judged each; a null doc_id
    stays null; of other columns only those in keep are read, and kept. An empty table gives an empty result.
    """
    rules = rule_votes()
    measured = stored(text_measures(docs.select("doc_id", "text", *keep)).withColumn("votes", F.array(*rules.values())), "quality")
    scored = F.broadcast(scored_patterns(measured, len(rules)))  # 2187 rows at most
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (
        measured.join(scored, "votes")
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= 0.5))
    )


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_quality(table(spark, sf_dir, "documents"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior"
    )
