"""Quality rules with risk-controlled thresholds. DataFrame functions only.

Every text gets counts (words, symbols, repeated lines and words) and from them rule scores. A text
fails the base rules when it is too short or mostly repeats itself. Beyond these, each rule rejects
texts whose score exceeds a cutoff, one per stratum (language). Cutoffs come from a labelled
holdout, for all rules together: step by step every rule is tightened along its grid, and of all
labelled good texts of the stratum ``k`` of ``n`` are rejected by some rule. A step is safe when the
exact binomial tail P(Bin(n, risk) <= k) is at most the allowed error, that is, when rules that
reject more than ``risk`` of all good texts would hardly ever look this harmless. The steps are
tested from the loosest on up to the first that is not safe (a fixed sequence needs no correction);
the error is divided by the strata that have labelled good texts (Bonferroni). So with probability
1 - ``error`` the rules reject at most ``risk`` of the good texts of every stratum. In a stratum
without a safe step they reject nothing.

Defined results: a null text has no words and fails the base rules; a null or unlisted language
belongs to the stratum ``other``; a document labelled twice is good only if every label says so;
labels of null ids or null quality are left out; repeated rows are judged independently and all
stay; an empty table gives an empty result, and without labels only the base rules reject; only the
named columns are read, so other columns may have any name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verdictflow.llm.packed import without
from verdictflow.session import materialize

BLANK = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"
STRATA = ("en", "de", "fr", "es")  # fixes the number of strata; other languages share one
MIN_WORDS = 50
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

#: Rules: score -> grid of cutoffs. A text is rejected when its score exceeds the cutoff.
RULES = {
    "symbols_per_word": tuple(i / 50 for i in range(1, 51)),
    "dup_line_share": tuple(i / 40 for i in range(2, 40)),
    "repeat_word_share": tuple(i / 100 for i in range(2, 50)),
    "capital_share": tuple(i / 50 for i in range(2, 50)),
}


def with_counts(df: DataFrame, text_col: str = "text", name: str = "q") -> DataFrame:
    """Adds one struct column ``name`` with the counts and rule scores of the text."""
    # Each step is a column of its own: what a lambda reads must not be computed again per element.
    keep = [F.col(f"`{c}`") for c in df.columns]
    text = F.coalesce(F.col(text_col), F.lit(""))
    step = df.select(*keep, text.alias("_t"))
    step = step.select(*keep, "_t", F.regexp_extract_all("_t", F.lit(WORD), F.lit(0)).alias("_w"),
                       F.filter(F.split("_t", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias("_l"))
    step = step.select(*keep, "_t", "_w", "_l", F.transform("_w", lambda x: F.xxhash64(x)).alias("_h"))
    three = F.transform(F.slice("_h", F.lit(1), F.greatest(F.size("_h") - 2, F.lit(0))),
                        lambda x, i: F.xxhash64(x, F.get("_h", i + 1), F.get("_h", i + 2)))
    step = step.select(*keep, "_t", "_w", "_l", three.alias("_g"))
    again = F.size(F.array_distinct("_g")) < F.size("_g")
    # windows sorted by hash: equal ones are neighbours
    order = F.when(again, F.sort_array(F.transform("_g", lambda x, i: F.struct(x.alias("h"), i.alias("p")))))
    step = step.select(*keep, "_t", "_w", "_l", order.alias("_s"))
    twice = F.filter("_s", lambda x, i: (x.h == F.get("_s", i - 1).h) | (x.h == F.get("_s", i + 1).h))
    covered = F.aggregate(
        F.sort_array(F.transform(twice, lambda x: x.p)), F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
        lambda a, p: F.struct(p.alias("last"), (a.n + F.least(F.lit(3), p - a["last"])).alias("n")), lambda a: a.n)
    step = step.select(
        *keep, F.size("_w").cast("long").alias("_n"), F.length(F.array_join("_w", "")).cast("long").alias("_c"),
        F.regexp_count("_t", F.lit(SYMBOLS)).cast("long").alias("_y"), F.size("_l").alias("_k"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("_d"),
        F.regexp_count("_t", F.lit(r"\p{Lu}")).alias("_u"), F.coalesce(covered, F.lit(0)).cast("long").alias("_r"))

    def share(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)

    return step.select(*keep, F.struct(
        F.col("_n").alias("n_words"), F.col("_c").alias("word_chars"), F.col("_y").alias("n_symbols"),
        F.col("_d").alias("n_dup_lines"), F.col("_r").alias("n_repeat_words"),
        ((F.col("_n") < MIN_WORDS) | (100 * F.col("_r") > 50 * F.col("_n"))).alias("base_failed"),
        share("_y", "_n").alias("symbols_per_word"), share("_d", "_k").alias("dup_line_share"),
        share("_r", "_n").alias("repeat_word_share"), share("_u", "_c").alias("capital_share")).alias(name))


def stratum(lang: Column, strata: tuple = STRATA) -> Column:
    return F.when(lang.isin(*strata), lang).otherwise("other")


def log_factorial(x: Column) -> Column:
    """ln x! for x >= 0: Stirling's series at x + 9, where its error is below 1e-12."""
    z = x + 10.0
    series = (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z ** 3) \
        + 1 / (1260 * z ** 5) - 1 / (1680 * z ** 7)
    product = F.lit(0.0)
    for i in range(1, 10):
        product = product + F.log(x + i)
    return series - product


def binomial_tail(k: Column, n: Column, p: float, terms: int = 300) -> Column:
    """P(Bin(n, p) <= k) for k < n p, else 1. Sums ``terms`` terms down from k; the rest is bounded
    by a geometric series, so the value is never too small."""
    k, n = k.cast("double"), n.cast("double")
    top = log_factorial(n) - log_factorial(k) - log_factorial(n - k) + k * math.log(p) + (n - k) * math.log1p(-p)
    # from i to i - 1 successes a term shrinks by i (1 - p) / ((n - i + 1) p)
    steps = F.sequence(F.lit(0), F.least(k, F.lit(float(terms))).cast("int"))
    state = F.aggregate(
        steps, F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("ratio")),
        lambda a, j: F.struct(
            (a.term * (k - j) * (1 - p) / ((n - k + j + 1) * p)).alias("term"), (a["sum"] + a.term).alias("sum"),
            ((k - j) * (1 - p) / ((n - k + j + 1) * p)).alias("ratio")))
    rest = F.when(state.ratio > 0, state.term / (1 - state.ratio)).otherwise(0.0)
    return F.when(n == 0, 1.0).when(k >= n * p, 1.0).otherwise(F.least(F.lit(1.0), F.exp(top) * (state["sum"] + rest)))


def tightening(rules: dict = RULES) -> dict[str, tuple[float, ...]]:
    """The cutoffs of every rule, step by step from the loosest to the tightest, all rules at once."""
    steps = max(map(len, rules.values()))
    return {r: tuple(g[round((len(g) - 1) * (1 - i / max(steps - 1, 1)))] for i in range(steps)) for r, g in rules.items()}


def thresholds(scored: DataFrame, labels: DataFrame, risk: float = 0.01, error: float = 0.05,
               rules: dict = RULES) -> DataFrame:
    """Safe cutoffs: one row per stratum that has any, with one column per rule.

    ``scored``: doc_id, stratum, q. All rules of a stratum together reject at most ``risk`` of its good texts.
    """
    good = (labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id")
            .agg(F.min("quality").alias("quality")).filter("quality >= 1")
            .select(F.col("doc_id").cast(scored.schema["doc_id"].dataType).alias("doc_id")))
    held, path = scored.join(good, "doc_id"), tightening(rules)
    # the first step at which some rule rejects the text: as many as have a cutoff that its score does not exceed
    first = [F.expr(f"size(filter(array({', '.join(f'{c!r}D' for c in g)}), c -> NOT q.{r} > c))") for r, g in path.items()]
    first = F.least(*first) if len(first) > 1 else first[0]
    counts = held.select("stratum", first.alias("first")).groupBy("stratum", "first").agg(F.count(F.lit(1)).alias("m"))
    # one row per stratum with labels and step: at most strata x steps rows
    cut = (counts.groupBy("stratum").agg(F.collect_list(F.struct("first", "m")).alias("seen"), F.sum("m").alias("n"))
           .withColumn("strata", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))))
           .select("*", F.explode(F.sequence(F.lit(0), F.lit(len(next(iter(path.values()))) - 1))).alias("i"))
           .withColumn("k", F.aggregate(F.filter("seen", lambda x: x["first"] <= F.col("i")), F.lit(0).cast("long"),
                                        lambda a, x: a + x.m)))
    unsafe = (binomial_tail(F.col("k"), F.col("n"), risk) > F.lit(error) / F.col("strata")).cast("int")
    earlier = Window.partitionBy("stratum").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    last = cut.withColumn("unsafe", F.max(unsafe).over(earlier)).filter("unsafe = 0").groupBy("stratum").agg(F.max("i").alias("i"))
    return last.select("stratum", *[F.expr(f"element_at(array({', '.join(f'{c!r}D' for c in g)}), i + 1)").alias(r)
                                    for r, g in path.items()])


def judged(scored: DataFrame, cutoffs: DataFrame, rules: dict = RULES) -> DataFrame:
    """Adds ``kept``. The cutoffs are one row per stratum, whose number is a parameter: broadcast."""
    named = cutoffs.select(F.col("stratum").alias("_s"), *[F.col(r).alias(f"_{r}") for r in rules])
    over = F.lit(False)
    for r in rules:
        over = over | F.coalesce(F.col(f"q.{r}") > F.col(f"_{r}"), F.lit(False))
    return (scored.join(F.broadcast(named), F.col("stratum") == F.col("_s"), "left")
            .withColumn("kept", ~F.col("q.base_failed") & ~over).drop("_s", *[f"_{r}" for r in rules]))


def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          strata: tuple = STRATA) -> DataFrame:
    """doc_id, stratum, q (counts and scores) of every text, written once to the shared folder."""
    narrow = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
                       stratum(F.col(lang_col), strata).alias("stratum"))
    return materialize(with_counts(narrow).drop("text"), "quality-scores")


def quality_filter(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   lang_col: str = "lang", **limits) -> DataFrame:
    """The rows of ``df`` that are kept, unchanged. Scores travel without texts, and only rows whose id
    may be rejected are moved. Rows without id are told apart by their text."""
    key = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("#"), F.md5(F.col(text_col))), F.lit("#"))
    rows = df.withColumn("_key", key)
    scored = score(rows, "_key", text_col, lang_col)
    gone = judged(scored, thresholds(scored, labels, **limits)).filter("NOT kept").select("doc_id").distinct()
    return without(rows, materialize(gone, "quality-rejected"), "_key").drop("_key")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    cutoffs = thresholds(scored, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judged(scored, cutoffs).select("doc_id", *[f"q.{c}" for c in COUNTS], "q.base_failed", "kept")
