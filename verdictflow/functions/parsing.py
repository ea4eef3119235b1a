"""Verdict and confidence parsing as native Spark SQL expressions (no UDFs).

Every parser is an ordinary Catalyst expression, so parsing stays inside
whole-stage code generation and runs where the rows already are: no shuffle,
no Python worker. The expressions are written as Spark SQL text and turned
into Columns with one ``F.expr`` call each; building them from thousands of
small Column operations cost one py4j round trip per operation (seconds of
driver time per query).

Inputs are column names, or SQL text prefixed with ``expr:``. Three parser
generations exist, selected by ``policy``:

* ``p1`` - lexical verdict normaliser plus the confidence chain
  structured value -> percent phrase -> confidence word -> 0.6;
* ``p2`` - "yes" xor "no", fixed confidence 0.8 (clear) / 0.5 (unclear);
* ``p3`` - "yes" xor "no", an unclear answer is a seeded coin flip, no confidence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# These must equal the reference parser's vocabulary and order.
# ---------------------------------------------------------------------------
YES_WORDS = ("yes", "true", "correct", "valid")
NO_WORDS = ("no", "false", "incorrect", "invalid")
# words counted when a verdict carries both signals ("valid"/"invalid" are not counted)
YES_COUNTED = ("yes", "true", "correct")
NO_COUNTED = ("no", "false", "incorrect")
# words in the reasoning that turn an ambiguous verdict into "yes"
REASONING_YES_WORDS = ("correct", "true", "accurate")

# percent patterns, tried in this order (Python regex syntax)
PERCENT_PATTERNS = (
    r"([0-9.]+)%\s*confident",
    r"confident.*?([0-9.]+)%",
    r"([0-9.]+)%\s*confidence",
    r"confidence.*?([0-9.]+)%",
    r"([0-9.]+)%\s*certain",
    r"certain.*?([0-9.]+)%",
    r"([0-9.]+)%\s*sure",
    r"sure.*?([0-9.]+)%",
    r"probability.*?([0-9.]+)%",
    r"([0-9.]+)%\s*probability",
)

# confidence words; the first one (in this order) found as a substring wins
CONFIDENCE_LEXICON = (
    ("certain", 0.9),
    ("definitely", 0.85),
    ("absolutely", 0.9),
    ("completely", 0.85),
    ("totally", 0.8),
    ("very confident", 0.85),
    ("highly confident", 0.9),
    ("extremely confident", 0.95),
    ("very sure", 0.85),
    ("quite sure", 0.8),
    ("positive", 0.8),
    ("convinced", 0.85),
    ("confident", 0.75),
    ("sure", 0.7),
    ("likely", 0.7),
    ("probably", 0.7),
    ("fairly confident", 0.7),
    ("reasonably sure", 0.7),
    ("believe", 0.65),
    ("think", 0.6),
    ("might", 0.4),
    ("maybe", 0.4),
    ("perhaps", 0.4),
    ("possibly", 0.4),
    ("uncertain", 0.3),
    ("unsure", 0.3),
    ("doubtful", 0.3),
    ("not sure", 0.3),
    ("might be wrong", 0.3),
    ("could be wrong", 0.3),
    ("not certain", 0.4),
)
DEFAULT_CONFIDENCE = 0.6
P2_CLEAR_CONFIDENCE = 0.8
P2_UNCLEAR_CONFIDENCE = 0.5
FALLBACK_CONFIDENCE = 0.1
# ---------------------------------------------------------------------------

# A number Python's float() accepts, without inf/nan/underscores (quirks Q4/Q5).
NUMERIC_RE = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"
# what float() accepts out of a "[0-9.]+" capture
DOTTED_NUMBER_RE = r"^([0-9]+\.?[0-9]*|\.[0-9]+)$"


def java_regex(py_pattern: str) -> str:
    """Python ``re`` percent pattern -> Java pattern with the same first match, found in linear time.

    Python's ``.`` stops only at ``\\n`` (Java's also at ``\\r`` and others) and Python's ``\\s`` is
    Unicode-aware (Java's needs ``(?U)``). A number is tried at its first character only. Of a line only
    the first occurrence of a word before ``.*?`` is tried (if a number follows any, it follows that one):
    a text with many of them and no number behind would be scanned to the line's end from each.
    """
    number = "(?<![0-9.])([0-9.]+)%"
    word, gap, _ = py_pattern.partition(".*?")
    if gap:
        return f"(?dm)^(?>[^\\n]*?{word})[^\\n]*?{number}"
    return "(?U)" + py_pattern.replace("([0-9.]+)%", number)


# ----------------------------------------------------------------- SQL text helpers
def lit(s: str) -> str:
    """Spark SQL string literal."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\r", "\\r") + "'"


def ident(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def sql_of(x: str) -> str:
    """A column name -> quoted identifier; ``expr:<sql>`` -> the SQL text."""
    return x[5:] if x.startswith("expr:") else ident(x)


def _any(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, {lit(w)})" for w in words) + ")"


def _count(text: str, words) -> str:
    return "(" + " + ".join(f"regexp_count({text}, {lit(w)})" for w in words) + ")"


def py_strip_sql(x: str) -> str:
    """``str.strip()``: trim all leading/trailing whitespace, not just spaces."""
    return f"regexp_replace({x}, {lit(r'(?U)^\s+|\s+$')}, '')"


# ----------------------------------------------------------------- C1 / C2
def verdict_p1_sql(vt: str, reasoning: str) -> str:
    t = f"lower(coalesce({vt}, ''))"
    r = f"lower(coalesce({reasoning}, ''))"
    hy, hn = _any(t, YES_WORDS), _any(t, NO_WORDS)
    return (f"CASE WHEN {hy} AND {hn} THEN CASE WHEN {_count(t, YES_COUNTED)} > {_count(t, NO_COUNTED)} "
            f"THEN 'yes' ELSE 'no' END WHEN {hy} THEN 'yes' WHEN {hn} THEN 'no' "
            f"WHEN {_any(r, REASONING_YES_WORDS)} THEN 'yes' ELSE 'no' END")


def verdict_conflict_sql(vt: str) -> str:
    t = f"lower(coalesce({vt}, ''))"
    return f"({_any(t, YES_WORDS)} AND {_any(t, NO_WORDS)})"


def verdict_ambiguous_sql(vt: str) -> str:
    t = f"lower(coalesce({vt}, ''))"
    return f"(NOT {_any(t, YES_WORDS)} AND NOT {_any(t, NO_WORDS)})"


def verdict_p1(verdict_text: str, reasoning: str) -> Column:
    """Lexical verdict normaliser -> 'yes' / 'no'."""
    return F.expr(verdict_p1_sql(sql_of(verdict_text), sql_of(reasoning)))


def verdict_conflict(verdict_text: str) -> Column:
    """The verdict carries both a yes-word and a no-word."""
    return F.expr(verdict_conflict_sql(sql_of(verdict_text)))


def verdict_ambiguous(verdict_text: str) -> Column:
    """The verdict carries neither a yes-word nor a no-word."""
    return F.expr(verdict_ambiguous_sql(sql_of(verdict_text)))


# ----------------------------------------------------------------- C7 - C10
def confidence_structured_sql(ct: str) -> str:
    s = py_strip_sql(ct)
    return (f"CASE WHEN {s} RLIKE {lit(NUMERIC_RE)} THEN "
            f"least(greatest(try_cast({s} AS DOUBLE), 0.0D), 1.0D) END")


def percent_number_sql(text: str) -> str:
    """The number of the first percent pattern whose capture parses (NULL if none)."""
    vals = []
    for p in PERCENT_PATTERNS:
        g = f"regexp_extract({text}, {lit(java_regex(p))}, 1)"
        vals.append(f"CASE WHEN {g} RLIKE {lit(DOTTED_NUMBER_RE)} THEN try_cast({g} AS DOUBLE) END")
    # every pattern needs a '%': texts without one skip the ten regexes
    return f"CASE WHEN contains({text}, '%') THEN coalesce({', '.join(vals)}) END"


def percent_scale_sql(v: str) -> str:
    return f"CASE WHEN {v} IS NOT NULL THEN least(CASE WHEN {v} > 1 THEN {v} / 100 ELSE {v} END, 1.0D) END"


def confidence_percent_sql(text: str) -> str:
    return percent_scale_sql(f"({percent_number_sql(text)})")


def confidence_lexicon_sql(text: str) -> str:
    arr = "array(" + ", ".join(f"named_struct('w', {lit(w)}, 'v', {float(v)}D)" for w, v in CONFIDENCE_LEXICON) + ")"
    return f"get(filter({arr}, e -> contains({text}, e.w)), 0).v"


def confidence_text_sql(reasoning: str, raw_output: str) -> str:
    """The searched text: ``f"{reasoning} {raw_output}".lower()``."""
    return f"lower(concat(coalesce({reasoning}, ''), ' ', coalesce({raw_output}, '')))"


def confidence_full_sql(ct: str, text: str, percent: str | None = None) -> str:
    pct = percent_scale_sql(percent) if percent else confidence_percent_sql(text)
    return (f"coalesce({confidence_structured_sql(ct)}, {pct}, {confidence_lexicon_sql(text)}, "
            f"{DEFAULT_CONFIDENCE}D)")


def confidence_structured(conf_text: str) -> Column:
    """A numeric structured confidence clamped to [0, 1]; else NULL."""
    return F.expr(confidence_structured_sql(sql_of(conf_text)))


def confidence_percent(text: str) -> Column:
    """First percent pattern (in order) whose number parses; x/100 if x > 1, capped at 1.
    ``text`` is the lower-cased search text."""
    return F.expr(confidence_percent_sql(sql_of(text)))


def confidence_lexicon(text: str) -> Column:
    """Value of the first lexicon phrase (declared order) contained in ``text`` (lower-cased)."""
    return F.expr(confidence_lexicon_sql(sql_of(text)))


def confidence_text(reasoning: str, raw_output: str) -> Column:
    return F.expr(confidence_text_sql(sql_of(reasoning), sql_of(raw_output)))


def confidence_full(conf_text: str, text: str) -> Column:
    """Structured -> percent -> lexicon -> 0.6 (``text`` lower-cased)."""
    return F.expr(confidence_full_sql(sql_of(conf_text), sql_of(text)))


# ----------------------------------------------------------------- C4 - C6
def strict_sql(v: str, err: str = "NULL") -> str:
    """'yes' xor 'no' (after strip + lower) -> that word; else NULL; NULL too when ``err`` is set."""
    t = f"lower({py_strip_sql(f'coalesce({v}, {lit("")})')})"
    return (f"CASE WHEN {err} IS NULL AND contains({t}, 'yes') AND NOT contains({t}, 'no') THEN 'yes' "
            f"WHEN {err} IS NULL AND contains({t}, 'no') AND NOT contains({t}, 'yes') THEN 'no' END")


def verdict_strict(verdict_text: str) -> Column:
    """'yes' xor 'no' -> that word; otherwise NULL (unclear)."""
    return F.expr(strict_sql(sql_of(verdict_text)))


def coin_flip_sql(seed: int, role: str, key: str) -> str:
    h = f"md5(concat_ws(':', {lit(str(seed))}, {lit(role)}, CAST({key} AS STRING)))"
    return f"CASE WHEN substring({h}, 1, 1) < '8' THEN 'yes' ELSE 'no' END"


def coin_flip(seed: int, role: str, key: str) -> Column:
    """Reproducible stand-in for ``random.choice(['yes','no'])`` (md5 of seed, role, key)."""
    return F.expr(coin_flip_sql(seed, role, sql_of(key)))


def result_sql(verdict: str, conf: str, reasoning: str, raw_output: str, err: str) -> str:
    """C11: the result struct."""
    return (f"named_struct('verdict', {verdict}, 'prediction', CASE WHEN {verdict} = 'yes' THEN 1 ELSE 0 END, "
            f"'confidence', {conf}, 'reasoning', {reasoning}, 'raw_output', {raw_output}, 'error', {err})")


def parse_p2_sql(raw: str) -> str:
    err = f"{raw}.error"
    s = strict_sql(f"{raw}.verdict", err)
    return result_sql(f"CASE WHEN {s} = 'yes' THEN 'yes' ELSE 'no' END",
                      f"CASE WHEN {s} IS NOT NULL THEN {P2_CLEAR_CONFIDENCE}D ELSE {P2_UNCLEAR_CONFIDENCE}D END",
                      f"CASE WHEN {err} IS NOT NULL THEN 'Parse error' ELSE coalesce({raw}.reasoning, '') END",
                      "CAST(NULL AS STRING)", err)


def parse_p3_sql(raw: str, key: str, role: str, seed: int = 0) -> str:
    err = f"{raw}.error"
    v = f"coalesce({strict_sql(f'{raw}.verdict', err)}, {coin_flip_sql(seed, role, key)})"
    return result_sql(v, "CAST(NULL AS DOUBLE)", f"coalesce({raw}.reasoning, '')", "CAST(NULL AS STRING)", err)


def parse_biased_sql(raw: str, bias: str) -> str:
    if bias not in ("yes", "no"):
        raise ValueError("bias must be 'yes' or 'no'")
    err = f"{raw}.error"
    v = f"coalesce({strict_sql(f'{raw}.verdict', err)}, {lit(bias)})"
    return result_sql(v, "CAST(NULL AS DOUBLE)", f"coalesce({raw}.reasoning, '')", "CAST(NULL AS STRING)", err)


def parse_p2(raw: str) -> Column:
    """C4: strict parser with fixed confidences; a failed call is a parse error (0, 0.5)."""
    return F.expr(parse_p2_sql(sql_of(raw)))


def parse_p3(raw: str, key: str, role: str, seed: int = 0) -> Column:
    """C5: 'yes' xor 'no', else (and on failure) a seeded coin flip; no confidence."""
    return F.expr(parse_p3_sql(sql_of(raw), sql_of(key), role, seed))


def parse_biased(raw: str, bias: str) -> Column:
    """C6: 'yes' xor 'no', else (and on failure) the verifier's own bias."""
    return F.expr(parse_biased_sql(sql_of(raw), bias))


def fallback_result_sql(message: str) -> str:
    """The result every role gets when a row fails as a whole."""
    return (f"named_struct('verdict', 'no', 'prediction', 0, 'confidence', {FALLBACK_CONFIDENCE}D, "
            f"'reasoning', concat('Error: ', {message}), 'raw_output', '', 'error', {message})")


def printed_answer_sql(reasoning: str, verdict: str, confidence: str) -> str:
    """Printed form of an answer, one field per line, when the verifier gives none. It shows the
    normalised verdict, as that replaces the model's own words before the answer is printed."""
    return (f"concat({lit("Prediction(" + chr(10) + "    reasoning='")}, {reasoning}, "
            f"{lit("'," + chr(10) + "    verdict='")}, {verdict}, {lit("'," + chr(10) + "    confidence='")}, "
            f"coalesce({confidence}, ''), {lit("'" + chr(10) + ")")})")


# ----------------------------------------------------------------- C11 assembly
def parse_role(df: DataFrame, raw_col: str, out_col: str, policy: str = "p1", key_col: str = "claim_id",
               seed: int = 0, bias: str | None = None) -> DataFrame:
    """Add ``out_col`` = result struct ``(verdict, prediction, confidence, reasoning, raw_output, error)``
    parsed from the raw answer struct in ``raw_col`` (C1-C11, C3 for failed calls)."""
    return parse_roles(df, [(raw_col, out_col, policy, bias)], key_col, seed)


def parse_roles(df: DataFrame, roles, key_col: str = "claim_id", seed: int = 0) -> DataFrame:
    """Parse several roles ``[(raw_col, out_col, policy, bias), ...]`` side by side.

    Intermediate values are *flat* top-level columns, each stage its own
    projection: the optimizer does not merge a costly expression into a
    projection that uses it several times, but it does dissolve struct columns
    into their field expressions, which duplicated the eleven-regex search text
    into every use and made planning time explode. Roles share the stages, so
    parsing A and B costs as many plan operations as parsing one.
    """
    p1 = [(ident(raw), f"__{out}", out) for raw, out, pol, _ in roles if pol == "p1"]
    temps = []
    if p1:
        st1, st1b, st1c, st2, st3, st4, st5 = {}, {}, {}, {}, {}, {}, {}
        for raw, t, out in p1:
            err = f"{raw}.error"
            failed = f"({err} IS NOT NULL OR {raw}.verdict IS NULL)"
            reason = (f"CASE WHEN {err} IS NOT NULL THEN concat('Error: ', {err}) "
                      f"WHEN {raw}.verdict IS NULL THEN 'Model output error' ELSE coalesce({raw}.reasoning, '') END")
            st1.update({
                f"{t}_reason": F.expr(reason),
                f"{t}_vt": F.expr(f"CASE WHEN {failed} THEN 'no' ELSE {raw}.verdict END"),
                f"{t}_ct": F.expr(f"CASE WHEN NOT {failed} THEN {raw}.confidence END"),
                f"{t}_err": F.expr(err),
            })
            st1b[f"{t}_verdict"] = F.expr(verdict_p1_sql(ident(f"{t}_vt"), ident(f"{t}_reason")))
            printed = printed_answer_sql(ident(f"{t}_reason"), ident(f"{t}_verdict"), ident(f"{t}_ct"))
            st1c[f"{t}_ro"] = F.expr(f"coalesce(CASE WHEN NOT {failed} THEN {raw}.raw_output END, {printed})")
            st2[f"{t}_text"] = F.expr(confidence_text_sql(ident(f"{t}_reason"), ident(f"{t}_ro")))
            st3[f"{t}_pct"] = F.expr(percent_number_sql(ident(f"{t}_text")))
            st4[f"{t}_conf"] = F.expr(confidence_full_sql(ident(f"{t}_ct"), ident(f"{t}_text"),
                                                          percent=ident(f"{t}_pct")))
            st5[out] = F.expr(result_sql(ident(f"{t}_verdict"), ident(f"{t}_conf"), ident(f"{t}_reason"),
                                         ident(f"{t}_ro"), ident(f"{t}_err")))
            temps += [f"{t}_{x}" for x in ("reason", "vt", "ct", "err", "ro", "text", "verdict", "pct", "conf")]
        for stage in (st1, st1b, st1c, st2, st3, st4):
            df = df.withColumns(stage)
        # the result structs and dropping the temporaries: one projection
        keep = [F.col(ident(c)) for c in df.columns if c not in temps and c not in st5]
        df = df.select(*keep, *[e.alias(k) for k, e in st5.items()])
        temps = []
    other = {}
    for raw, out, pol, bias in roles:
        r = ident(raw)
        if pol == "p1":
            continue
        if pol == "p2":
            other[out] = F.expr(parse_p2_sql(r))
        elif pol == "p3":
            other[out] = F.expr(parse_p3_sql(r, ident(key_col), out, seed))
        elif pol == "biased":
            other[out] = F.expr(parse_biased_sql(r, bias or "no"))
        else:
            raise ValueError(f"unknown parser policy: {pol}")
    if other:
        df = df.withColumns(other)
    return df.drop(*temps) if temps else df
