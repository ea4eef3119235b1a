"""DuckDB SQL restatements of the registered queries (the correctness oracle).

These strings are only run by the external checker against the same Parquet
tables; the library itself never uses them. They restate the semantics
independently (CASE chains, list indexing, a cross join for the sweep) so
that a bug in the Spark expressions does not hide in both sides.
"""

from __future__ import annotations

from verdictflow.sources.derived import FIXTURE_REASONINGS, FIXTURE_VERDICTS

# Fixed values, written out once more: a wrong word or number in the library must not be right here too.
YES_WORDS = ["yes", "true", "correct", "valid"]
NO_WORDS = ["no", "false", "incorrect", "invalid"]
YES_COUNTED = ["yes", "true", "correct"]
NO_COUNTED = ["no", "false", "incorrect"]
REASONING_YES_WORDS = ["correct", "true", "accurate"]
PERCENT_PATTERNS = [
    r"([0-9.]+)%\s*confident", r"confident.*?([0-9.]+)%", r"([0-9.]+)%\s*confidence", r"confidence.*?([0-9.]+)%",
    r"([0-9.]+)%\s*certain", r"certain.*?([0-9.]+)%", r"([0-9.]+)%\s*sure", r"sure.*?([0-9.]+)%",
    r"probability.*?([0-9.]+)%", r"([0-9.]+)%\s*probability"]
CONFIDENCE_LEXICON = [
    ("certain", 0.9), ("definitely", 0.85), ("absolutely", 0.9), ("completely", 0.85), ("totally", 0.8),
    ("very confident", 0.85), ("highly confident", 0.9), ("extremely confident", 0.95), ("very sure", 0.85),
    ("quite sure", 0.8), ("positive", 0.8), ("convinced", 0.85), ("confident", 0.75), ("sure", 0.7), ("likely", 0.7),
    ("probably", 0.7), ("fairly confident", 0.7), ("reasonably sure", 0.7), ("believe", 0.65), ("think", 0.6),
    ("might", 0.4), ("maybe", 0.4), ("perhaps", 0.4), ("possibly", 0.4), ("uncertain", 0.3), ("unsure", 0.3),
    ("doubtful", 0.3), ("not sure", 0.3), ("might be wrong", 0.3), ("could be wrong", 0.3), ("not certain", 0.4)]
DEFAULT_CONFIDENCE = 0.6
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"  # what float() reads
DOTTED = r"^(\d+\.?\d*|\.\d+)$"  # and of digits and dots
BANDS = {
    "aggressive": "CASE WHEN {r} > 0.8 THEN 'maximum' WHEN {r} > 0.6 THEN 'high' WHEN {r} > 0.4 THEN 'moderate' ELSE 'low' END",
    "contested": "CASE WHEN {r} >= 0.5 THEN 'excellent' WHEN {r} >= 0.3 THEN 'good' WHEN {r} > 0 THEN 'low' ELSE 'none' END",
    "edge": "CASE WHEN {r} > 0.2 THEN 'good' WHEN {r} > 0 THEN 'low' ELSE 'none' END",
    "forced": "CASE WHEN {r} >= 0.8 THEN 'success' ELSE 'unexpected' END",
    "demo": "CASE WHEN {r} >= 0.4 THEN 'excellent' WHEN {r} > 0 THEN 'good' ELSE 'limited' END",
}

ROLES = (("a", 0), ("b", 1), ("j", 2))
ROLE_NAME = {"a": "a", "b": "b", "j": "judge"}


def q(s: str) -> str:
    """SQL string literal (newlines via chr(10))."""
    parts = s.split("\n")
    lits = ["'" + p.replace("'", "''") + "'" for p in parts]
    return " || chr(10) || ".join(lits) if len(lits) > 1 else lits[0]


def _list(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def text_key_sql(col: str) -> str:
    return f"CAST('0x' || substr(md5(coalesce({col}, '')), 1, 7) AS BIGINT)"


def claims_sql(with_text: bool = True) -> str:
    """Every document; truth only where a label is given."""
    label = "(SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id)"
    text = "d.text AS claim, " if with_text else ""
    return (f"SELECT d.doc_id AS claim_id, {text}CASE WHEN l.quality = 1 THEN 'yes' WHEN l.quality IS NOT NULL THEN 'no' END "
            f"AS ground_truth, d.lang AS lang, d.source AS source, {text_key_sql('d.text')} AS text_key "
            f"FROM documents d LEFT JOIN {label} l ON d.doc_id = l.doc_id")


def labelled_claims_sql(with_text: bool = True) -> str:
    return f"SELECT * FROM ({claims_sql(with_text)}) every WHERE ground_truth IS NOT NULL"


def answers_cols(key: str = "text_key", roles=ROLES, errors: bool = False) -> str:
    """Fixture answers ``{p}_v, {p}_r, {p}_c, {p}_e`` per (prefix, role index or SQL for it)."""
    out = []
    for p, x in roles:
        x = f"({x})"
        v = f"({_list(FIXTURE_VERDICTS)})[({key} * (2 * {x} + 1) + 3 * {x}) % 20 + 1]"
        e = "CAST(NULL AS VARCHAR)"
        if errors:
            v = f"CASE WHEN ({key} + {x}) % 11 = 5 THEN CAST(NULL AS VARCHAR) ELSE {v} END"
            e = f"CASE WHEN ({key} + {x}) % 7 = 3 THEN 'timeout' END"
        out.append(f"{v} AS {p}_v")
        sentences = "string_split(coalesce(claim, ''), '.')"
        out.append(f"({_list(FIXTURE_REASONINGS)})[({key} * (2 * {x} + 3) + 5 * {x}) % 17 + 1] || ' ' || "
                   f"{sentences}[({key} + {x}) % len({sentences}) + 1] AS {p}_r")
        out.append(f"CASE ({key} + {x}) % 5 WHEN 0 THEN '0.9' WHEN 1 THEN '0.55' WHEN 2 THEN 'x%' END AS {p}_c")
        out.append(f"{e} AS {p}_e")
    return ", ".join(out)


def answers_raw_cols(roles=ROLES) -> str:
    return ", ".join(f"CAST(NULL AS VARCHAR) AS {p}_o" for p, _ in roles)


def _any(col: str, words) -> str:
    return "(" + " OR ".join(f"contains({col}, {q(w)})" for w in words) + ")"


def _count(col: str, words) -> str:
    return "(" + " + ".join(f"((length({col}) - length(replace({col}, {q(w)}, ''))) // {len(w)})"
                            for w in words) + ")"


def strip_sql(col: str) -> str:
    return f"regexp_replace({col}, '^\\s+|\\s+$', '', 'g')"


def p1_stages(p: str) -> list[str]:
    """Select lists (each applied over the previous stage) parsing role ``p`` the P1 way."""
    failed = f"({p}_e IS NOT NULL OR {p}_v IS NULL)"
    reason = (f"CASE WHEN {p}_e IS NOT NULL THEN 'Error: ' || {p}_e WHEN {p}_v IS NULL THEN 'Model output error' "
              f"ELSE coalesce({p}_r, '') END")
    s1 = [f"{reason} AS {p}_reason",
          f"CASE WHEN {failed} THEN 'no' ELSE {p}_v END AS {p}_vt",
          f"CASE WHEN NOT {failed} THEN {p}_c END AS {p}_ct"]
    s2 = [f"lower(coalesce({p}_vt, '')) AS {p}_t", f"{strip_sql(p + '_ct')} AS {p}_cs"]
    t, text = f"{p}_t", f"{p}_text"
    hy, hn = _any(t, YES_WORDS), _any(t, NO_WORDS)
    verdict = (f"CASE WHEN {hy} AND {hn} THEN CASE WHEN {_count(t, YES_COUNTED)} > {_count(t, NO_COUNTED)} "
               f"THEN 'yes' ELSE 'no' END WHEN {hy} THEN 'yes' WHEN {hn} THEN 'no' "
               f"WHEN {_any(f'lower({p}_reason)', REASONING_YES_WORDS)} THEN 'yes' ELSE 'no' END")
    extracts = []
    for pat in PERCENT_PATTERNS:
        g = f"regexp_extract({text}, {q(pat)}, 1)"
        extracts.append(f"CASE WHEN regexp_matches({g}, {q(DOTTED)}) THEN TRY_CAST({g} AS DOUBLE) END")
    lex = "CASE " + " ".join(f"WHEN contains({text}, {q(w)}) THEN CAST({float(v)} AS DOUBLE)"
                             for w, v in CONFIDENCE_LEXICON) + " END"
    structured = (f"CASE WHEN regexp_matches({p}_cs, {q(NUMBER)}) THEN "
                  f"least(greatest(TRY_CAST({p}_cs AS DOUBLE), 0.0), 1.0) END")
    s2b = [f"{verdict} AS {p}_verdict", f"{structured} AS {p}_conf_structured"]
    # the printed answer: one field per line, the verdict already reduced to yes / no
    printed = (f"'Prediction(' || chr(10) || '    reasoning=''' || {p}_reason || ''',' || chr(10) || '    verdict=''' || "
               f"{p}_verdict || ''',' || chr(10) || '    confidence=''' || coalesce({p}_ct, '') || '''' || chr(10) || ')'")
    s2c = [f"lower({p}_reason || ' ' || coalesce(CASE WHEN NOT {failed} THEN {p}_o END, {printed})) AS {p}_text"]
    s3 = [f"CASE WHEN contains({text}, '%') THEN coalesce({', '.join(extracts)}) END AS {p}_pf",
          f"{lex} AS {p}_conf_lexicon"]
    s4 = [f"CASE WHEN {p}_verdict = 'yes' THEN 1 ELSE 0 END AS {p}_prediction",
          f"CASE WHEN {p}_pf IS NOT NULL THEN least(CASE WHEN {p}_pf > 1 THEN {p}_pf / 100 ELSE {p}_pf END, 1.0) "
          f"END AS {p}_conf_percent"]
    s5 = [f"coalesce({p}_conf_structured, {p}_conf_percent, {p}_conf_lexicon, {DEFAULT_CONFIDENCE}) AS {p}_confidence",
          f"{p}_reason AS {p}_reasoning"]
    return [", ".join(s) for s in (s1, s2, s2b, s2c, s3, s4, s5)]


def p2_cols(p: str) -> str:
    t = f"lower({strip_sql(f"coalesce({p}_v, '')")})"
    sy = f"(contains({t}, 'yes') AND NOT contains({t}, 'no'))"
    sn = f"(contains({t}, 'no') AND NOT contains({t}, 'yes'))"
    return ", ".join([
        f"CASE WHEN {p}_e IS NULL AND {sy} THEN 1 ELSE 0 END AS {p}_prediction",
        f"CASE WHEN {p}_e IS NULL AND {sy} THEN 'yes' ELSE 'no' END AS {p}_verdict",
        f"CASE WHEN ({sy} OR {sn}) AND {p}_e IS NULL THEN CAST(0.8 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END "
        f"AS {p}_confidence",
        f"CASE WHEN {p}_e IS NOT NULL THEN 'Parse error' ELSE coalesce({p}_r, '') END AS {p}_reasoning",
    ])


def coin_sql(role: str, key: str = "claim_id", seed: int = 0) -> str:
    return (f"CASE WHEN substr(md5('{seed}:{role}:' || CAST({key} AS VARCHAR)), 1, 1) < '8' "
            f"THEN 'yes' ELSE 'no' END")


def strict_verdict_sql(p: str) -> str:
    t = f"lower({strip_sql(f"coalesce({p}_v, '')")})"
    return (f"CASE WHEN {p}_e IS NULL AND contains({t}, 'yes') AND NOT contains({t}, 'no') THEN 'yes' "
            f"WHEN {p}_e IS NULL AND contains({t}, 'no') AND NOT contains({t}, 'yes') THEN 'no' END")


def p3_cols(p: str, seed: int = 0, bias: str | None = None, role: str | None = None) -> str:
    fallback = coin_sql(role or ROLE_NAME[p], seed=seed) if bias is None else q(bias)
    v = f"coalesce({strict_verdict_sql(p)}, {fallback})"
    return ", ".join([
        f"{v} AS {p}_verdict",
        f"CASE WHEN {v} = 'yes' THEN 1 ELSE 0 END AS {p}_prediction",
        f"CAST(NULL AS DOUBLE) AS {p}_confidence",
        f"coalesce({p}_r, '') AS {p}_reasoning",
    ])


def cascade_ctes(prefix: str = "", gamma: float | str = 0.7, policy: str = "p1", claims: str | None = None,
                 answers: str | None = None, row_error: str | None = None, parsers=None, biases=(None, None),
                 seed: int = 0, cross_gammas=None, errors: bool = False, raw_given: bool = False) -> str:
    """CTE chain ending in ``{prefix}res`` (flattened cascade results).

    With ``cross_gammas`` every claim is paired with every gamma (columns
    ``pos``, ``gamma_in``) and the gate uses that column.
    """
    P = prefix
    claims = claims or claims_sql()
    ans_from = answers or f"SELECT *, {answers_cols(errors=errors)} FROM {P}claims"
    ctes = [f"{P}claims AS ({claims})", f"{P}ans0 AS ({ans_from})"]
    if raw_given:
        ctes.append(f"{P}ans AS (SELECT * FROM {P}ans0)")
    elif cross_gammas is not None:
        gl = " UNION ALL ".join(f"SELECT {i} AS pos, CAST({g} AS DOUBLE) AS gamma_in"
                                for i, g in enumerate(cross_gammas))
        ctes.append(f"{P}ans AS (SELECT *, {answers_raw_cols()} FROM {P}ans0 CROSS JOIN ({gl}) gl)")
        gamma = "gamma_in"
    else:
        ctes.append(f"{P}ans AS (SELECT *, {answers_raw_cols()} FROM {P}ans0)")
    prev = f"{P}ans"
    pa, pb, pj = parsers or (policy, policy, policy)
    bias_of = {"a": biases[0], "b": biases[1], "j": None}
    for p, pol in (("a", pa), ("b", pb), ("j", pj)):
        if pol == "p1":
            stages = p1_stages(p)
            for i, st in enumerate(stages):
                name = f"{P}{p}s{i}"
                # the last parser stage is materialised: DuckDB would otherwise inline the regex
                # chain into every later reference of the confidence
                mat = "MATERIALIZED " if i == len(stages) - 1 else ""
                ctes.append(f"{name} AS {mat}(SELECT *, {st} FROM {prev})")
                prev = name
        else:
            cols = p2_cols(p) if pol == "p2" else p3_cols(p, seed, bias_of[p] if pol == "biased" else None)
            name = f"{P}{p}_parsed"
            ctes.append(f"{name} AS (SELECT *, {cols} FROM {prev})")
            prev = name
    err = row_error or "CAST(NULL AS VARCHAR)"
    fb = "0"
    ctes.append(f"{P}fb AS (SELECT *, {err} AS row_error FROM {prev})")
    ctes.append(
        f"{P}fb2 AS (SELECT * REPLACE ("
        f"CASE WHEN row_error IS NOT NULL THEN {fb} ELSE a_prediction END AS a_prediction, "
        f"CASE WHEN row_error IS NOT NULL THEN 0.1 ELSE a_confidence END AS a_confidence, "
        f"CASE WHEN row_error IS NOT NULL THEN 'no' ELSE a_verdict END AS a_verdict, "
        f"CASE WHEN row_error IS NOT NULL THEN {fb} ELSE b_prediction END AS b_prediction, "
        f"CASE WHEN row_error IS NOT NULL THEN 0.1 ELSE b_confidence END AS b_confidence, "
        f"CASE WHEN row_error IS NOT NULL THEN 'no' ELSE b_verdict END AS b_verdict) FROM {P}fb)")
    g = f"CAST({gamma} AS DOUBLE)"
    gate = "(a_prediction <> b_prediction)" if policy == "p3" else \
        f"(a_prediction <> b_prediction OR least(a_confidence, b_confidence) < {g})"
    ctes.append(
        f"{P}g AS (SELECT *, {g} AS gamma, a_prediction = b_prediction AS agree, "
        f"least(a_confidence, b_confidence) AS min_confidence, (a_confidence + b_confidence) / 2 AS mean_confidence, "
        f"(row_error IS NOT NULL OR {gate}) AS escalated FROM {P}fb2)")
    low = "FALSE" if policy == "p3" else f"least(a_confidence, b_confidence) < {g}"
    truth_cmp = ("final_verdict = ground_truth" if policy == "p3"
                 else "final_prediction = (CASE WHEN ground_truth = 'yes' THEN 1 ELSE 0 END)")
    ctes.append(
        f"{P}f AS (SELECT *, "
        f"CASE WHEN row_error IS NOT NULL THEN 0 WHEN escalated THEN j_prediction ELSE a_prediction END "
        f"AS final_prediction, "
        f"CASE WHEN row_error IS NOT NULL THEN 'error' WHEN NOT agree THEN 'disagreement' WHEN {low} "
        f"THEN 'low_confidence_agreement' ELSE 'consensus' END AS reason FROM {P}g)")
    ctes.append(
        f"{P}f2 AS (SELECT *, CASE WHEN final_prediction = 1 THEN 'yes' ELSE 'no' END AS final_verdict FROM {P}f)")
    ctes.append(
        f"{P}res AS MATERIALIZED (SELECT *, "
        f"CASE WHEN row_error IS NOT NULL THEN 'no' WHEN escalated THEN j_verdict END AS judge_verdict, "
        f"CASE WHEN row_error IS NOT NULL THEN 0 WHEN escalated THEN j_prediction END AS judge_prediction, "
        f"CASE WHEN row_error IS NOT NULL THEN 0.1 WHEN escalated THEN j_confidence END AS judge_confidence, "
        f"CASE WHEN ground_truth IS NOT NULL AND ground_truth <> '' THEN {truth_cmp} END AS correct, "
        f"CASE WHEN escalated THEN 3 ELSE 2 END AS calls FROM {P}f2)")
    return ",\n".join(ctes)


FLAT_COLS = ("claim_id, lang, ground_truth, a_verdict, a_prediction, a_confidence, b_verdict, b_prediction, "
             "b_confidence, judge_verdict, judge_prediction, judge_confidence, agree, min_confidence, escalated, "
             "reason, final_prediction, final_verdict, correct, calls")


# ----------------------------------------------------------------- metric SQL
def sums_sql(src: str, keys: str = "") -> str:
    """Counts over all rows; hits and ``n_lab...`` over rows with a truth (comparisons with NULL are not true)."""
    k = (keys + ", ") if keys else ""
    gb = f" GROUP BY {keys}" if keys else ""
    gt = "(CASE ground_truth WHEN 'yes' THEN 1 WHEN 'no' THEN 0 END)"
    cols = {"n": "TRUE", "n_esc": "escalated", "n_agree": "agree", "n_hit": f"final_prediction = {gt}",
            "n_hit_esc": f"escalated AND final_prediction = {gt}", "n_hit_non": f"NOT escalated AND final_prediction = {gt}",
            "n_tp": f"final_prediction = 1 AND {gt} = 1", "n_fp": f"final_prediction = 1 AND {gt} = 0",
            "n_fn": f"final_prediction = 0 AND {gt} = 1", "n_lab": f"{gt} IS NOT NULL",
            "n_lab_esc": f"escalated AND {gt} IS NOT NULL", "n_lab_agree_non": f"agree AND NOT escalated AND {gt} IS NOT NULL"}
    sums = ", ".join(f"count(*) FILTER ({cond}) AS {name}" for name, cond in cols.items())
    return (f"SELECT {k}{sums}, CAST(sum(calls) AS BIGINT) AS n_calls, "
            f"CAST(coalesce(sum(calls) FILTER ({gt} IS NOT NULL), 0) AS BIGINT) AS n_lab_calls FROM {src}{gb}")


def _div(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE) END"


def derive_sql() -> str:
    prec = _div("n_tp", "n_tp + n_fp")
    rec = _div("n_tp", "n_tp + n_fn")
    acc = _div("n_hit", "n_lab")
    calls = _div("n_calls", "n")
    return ", ".join([
        "n AS total_evaluations", "n_esc AS escalations", "n_agree AS agreements",
        "n - n_agree AS disagreements", "n_hit AS correct_predictions",
        f"{acc} AS overall_accuracy",
        f"{_div('n_hit_esc', 'n_lab_esc')} AS escalated_accuracy",
        f"{_div('n_hit_non', 'n_lab - n_lab_esc')} AS non_escalated_accuracy",
        f"{_div('n_esc', 'n')} AS escalation_rate",
        f"{_div('n - n_agree', 'n')} AS disagreement_rate",
        f"{_div('n_agree', 'n')} AS agreement_rate",
        "n_calls AS total_model_calls",
        f"{calls} AS avg_calls_per_evaluation",
        "CASE WHEN n_hit > 0 THEN CAST(n_lab_calls AS DOUBLE) / n_hit ELSE CAST('inf' AS DOUBLE) END AS cost_per_correct",
        f"{_div('n_lab - n_lab_esc - n_hit_non', 'n_lab - n_lab_esc')} AS false_consensus_rate",
        f"{prec} AS precision", f"{rec} AS recall",
        f"CASE WHEN ({prec}) IS NOT NULL AND ({rec}) IS NOT NULL AND ({prec}) + ({rec}) > 0 "
        f"THEN 2 * ({prec}) * ({rec}) / (({prec}) + ({rec})) END AS f1_score",
        f"CASE WHEN ({calls}) > 0 THEN ({acc}) / ({calls}) ELSE 0.0 END AS efficiency",
    ])


def optional_truth_sql(src: str, keys: str = "") -> str:
    """The metric columns over rows with an optional truth, stated per column instead of from sums."""
    k, gb = (keys + ", ", f" GROUP BY {keys}") if keys else ("", "")
    lab = "ground_truth IS NOT NULL"
    right = "avg(CAST(correct AS INTEGER))"  # correct is NULL without a truth
    precision = "avg(CASE WHEN final_verdict = 'yes' THEN CAST(correct AS INTEGER) END)"
    recall = "avg(CASE WHEN ground_truth = 'yes' THEN CAST(correct AS INTEGER) END)"
    cols = {
        "total_evaluations": "count(*)", "escalations": "count(*) FILTER (escalated)",
        "agreements": "count(*) FILTER (agree)", "disagreements": "count(*) FILTER (NOT agree)",
        "correct_predictions": "count(*) FILTER (correct)", "overall_accuracy": right,
        "escalated_accuracy": f"{right} FILTER (escalated)",
        "non_escalated_accuracy": f"{right} FILTER (NOT escalated)",
        "escalation_rate": "avg(CAST(escalated AS INTEGER))", "disagreement_rate": "avg(CAST(NOT agree AS INTEGER))",
        "agreement_rate": "avg(CAST(agree AS INTEGER))", "total_model_calls": "CAST(sum(calls) AS BIGINT)",
        "avg_calls_per_evaluation": "avg(calls)",
        "cost_per_correct": f"coalesce(sum(calls) FILTER ({lab}) / nullif(count(*) FILTER (correct), 0), "
                            "CAST('inf' AS DOUBLE))",
        "false_consensus_rate": "avg(1 - CAST(correct AS INTEGER)) FILTER (NOT escalated)",
        "precision": precision, "recall": recall,
        "f1_score": f"2 * {precision} * {recall} / nullif({precision} + {recall}, 0)",
        "efficiency": f"{right} / avg(calls)",
    }
    return f"SELECT {k}{', '.join(f'{e} AS {c}' for c, e in cols.items())} FROM {src}{gb}"


def harness_sql() -> str:
    return ", ".join([
        f"{_div('n_hit', 'n_lab')} AS accuracy",
        f"{_div('n_esc', 'n')} AS escalation_rate",
        f"{_div('n_hit_esc', 'n_lab_esc')} AS escalated_accuracy",
        f"{_div('n_hit_non', 'n_lab - n_lab_esc')} AS non_escalated_accuracy",
        f"coalesce({_div('n_lab_agree_non - n_hit_non', 'n_lab_agree_non')}, 0.0) AS false_consensus_rate",
        f"{_div('n - n_agree', 'n')} AS disagreement_rate",
        f"{_div('n_calls', 'n')} AS avg_calls_per_evaluation",
        "n AS total_evaluations", "n_esc AS total_escalations", "n_agree AS total_agreements",
        "n - n_agree AS total_disagreements",
    ])


def sweep_ctes(gammas, policy: str = "p1", prefix: str = "", **kw) -> str:
    """Independent restatement of the sweep: the cascade at every gamma via a cross join."""
    return cascade_ctes(prefix, policy=policy, cross_gammas=list(gammas), **kw)


def parse_input_ctes(errors: bool = False, policy: str | None = "p1", role: str = "r") -> str:
    """Every document x role index with its fixture answer, prefix ``r``; then the parser stages."""
    pin = (f"SELECT claim_id, text_key, x, CASE x WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'judge' END AS role, "
           f"{answers_cols(roles=(('r', 'x'),), errors=errors)} "
           f"FROM (SELECT doc_id AS claim_id, text AS claim, {text_key_sql('text')} AS text_key, unnest([0, 1, 2]) AS x FROM documents) d")
    ctes = [f"pin0 AS ({pin})", f"pin AS (SELECT *, {answers_raw_cols((('r', 0),))} FROM pin0)"]
    prev = "pin"
    if policy == "p1":
        for i, st in enumerate(p1_stages("r")):
            ctes.append(f"ps{i} AS (SELECT *, {st} FROM {prev})")
            prev = f"ps{i}"
    elif policy == "p2":
        ctes.append(f"ps AS (SELECT *, {p2_cols('r')} FROM {prev})")
        prev = "ps"
    elif policy == "p3":
        ctes.append(f"ps AS (SELECT *, {p3_cols('r', role=role)} FROM {prev})")
        prev = "ps"
    ctes.append(f"parsed AS (SELECT * FROM {prev})")
    return ",\n".join(ctes)
