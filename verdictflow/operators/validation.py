"""Dataset validation and label handling.

All checks are one aggregation over the data; only the one-row summary
reaches the driver, which raises the reference's errors from it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdictflow.functions.parsing import ident, lit, py_strip_sql

# The accepted label spellings and their meaning.
VALID_LABELS = ("yes", "no", "true", "false", "1", "0")
POSITIVE_LABELS = ("yes", "true", "1")
NEGATIVE_LABELS = ("no", "false", "0")


def _in(c: str, values) -> str:
    return f"{c} IN ({', '.join(lit(v) for v in values)})"


def check_alignment(claims: DataFrame, labels: DataFrame, key: str = "claim_id") -> DataFrame:
    """B1 on keyed data: one row ``matched, claims_only, labels_only`` (full outer equi-join)."""
    a = claims.select(F.col(key).alias("__k"), F.lit(True).alias("__a"))
    b = labels.select(F.col(key).alias("__k"), F.lit(True).alias("__b"))
    j = a.join(b, "__k", "full_outer")
    return j.agg(F.count_if(F.col("__a") & F.col("__b")).alias("matched"),
                 F.count_if(F.col("__b").isNull()).alias("claims_only"),
                 F.count_if(F.col("__a").isNull()).alias("labels_only"))


def label_summary(df: DataFrame, label_col: str = "label") -> DataFrame:
    """B2-B4 in one pass: size, invalid rows and distinct invalid labels (exact,
    case-sensitive, before normalising), positive / negative counts and whether
    the set is balanced (|pos - neg| <= 1). The invalid labels themselves stay
    distributed (:func:`invalid_labels`): their number is not bounded."""
    c = ident(label_col)
    valid = F.expr(_in(c, VALID_LABELS))
    pos = F.expr(_in(c, POSITIVE_LABELS))
    s = df.agg(F.count(F.lit(1)).alias("size"),
               F.count_if(~F.coalesce(valid, F.lit(False))).alias("invalid"),
               F.count_distinct(F.when(~valid, F.col(label_col))).alias("invalid_distinct"),
               F.count_if(F.coalesce(pos, F.lit(False))).alias("positive"))
    return s.select("size", "invalid", "invalid_distinct", "positive",
                    (F.col("size") - F.col("positive")).alias("negative"),
                    (F.abs(2 * F.col("positive") - F.col("size")) <= 1).alias("balanced"))


def invalid_labels(df: DataFrame, label_col: str = "label") -> DataFrame:
    """The distinct labels outside the domain (anti-join with the 6-row domain)."""
    spark = df.sparkSession
    domain = spark.createDataFrame([(v,) for v in VALID_LABELS], "__v string")
    d = df.select(F.col(label_col).alias("label")).distinct()
    return d.join(F.broadcast(domain), d["label"] == domain["__v"], "left_anti")


def validate_dataset(df: DataFrame, label_col: str = "label", require_balanced: bool = False,
                     claims: DataFrame | None = None, key: str = "claim_id") -> dict:
    """B1-B4 as the reference raises them; returns the summary row as a dict."""
    if claims is not None:
        al = check_alignment(claims, df, key).first()
        if al["claims_only"] or al["labels_only"]:
            raise ValueError(f"Claims and labels must match: {al['claims_only']} claims without label, "
                             f"{al['labels_only']} labels without claim")
    s = label_summary(df, label_col).first().asDict()
    if s["size"] == 0:
        raise ValueError("Dataset cannot be empty")
    if s["invalid"]:
        shown = [r[0] for r in invalid_labels(df, label_col).orderBy("label").limit(20).collect()]
        more = f" (+{s['invalid_distinct'] - len(shown)} more)" if s["invalid_distinct"] > len(shown) else ""
        raise ValueError(f"Invalid labels found: {set(shown)}{more}. Use: {set(VALID_LABELS)}")
    if require_balanced and not s["balanced"]:
        raise ValueError(f"Dataset not balanced: {s['positive']} positive, {s['negative']} negative")
    return s


def normalize_label_sql(c: str) -> str:
    t = f"lower({py_strip_sql(c)})"  # str(label).strip().lower()
    return (f"CASE WHEN {_in(t, POSITIVE_LABELS)} THEN 'yes' WHEN {_in(t, NEGATIVE_LABELS)} THEN 'no' END")


def normalize_labels(df: DataFrame, label_col: str = "label", out_col: str | None = None,
                     mode: str = "strict") -> DataFrame:
    """Strip + lower; yes/true/1 -> 'yes', no/false/0 -> 'no'.

    ``strict`` fails the job on any other label (like the reference); ``lenient``
    leaves NULL (see :func:`label_rejects`).
    """
    c = ident(label_col)
    e = F.expr(normalize_label_sql(f"CAST({c} AS STRING)"))
    if mode == "strict":  # a filter, so that no choice of columns can prune the check away
        failed = F.raise_error(F.concat(F.lit("Cannot normalize label: "),
                                        F.coalesce(F.col(label_col).cast("string"), F.lit("None"))))
        df = df.filter(F.when(e.isNull(), failed.cast("boolean")).otherwise(True))
    elif mode != "lenient":
        raise ValueError("mode must be 'strict' or 'lenient'")
    return df.withColumn(out_col or label_col, e)


def label_rejects(df: DataFrame, label_col: str = "label") -> DataFrame:
    """Rows whose label cannot be normalised (the lenient mode's reject table)."""
    return df.filter(F.expr(normalize_label_sql(f"CAST({ident(label_col)} AS STRING)")).isNull())


def label_binary(label: Column) -> Column:
    """1 if the label is exactly 'yes' else 0."""
    return F.when(label == "yes", F.lit(1)).otherwise(F.lit(0))
