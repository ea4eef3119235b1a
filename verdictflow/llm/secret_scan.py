"""Secret scan through a trigram inverted index. DataFrame functions only.

Every rule's regular expression is turned into a Boolean query over trigrams that any match must
contain (lower-cased, as the index is): an OR of ANDs. The index holds the postings (trigram,
document) of every trigram that some query names. A rule's candidates are the intersection of the
postings of one of its ANDs; only they are verified by the regular expression. Rules without a
mandatory trigram, such as runs of hex digits, scan every text.

Spans come from two built-in functions that walk the same matches: the matches themselves and the
text between them; their lengths add up to positions.

Defined results: a null text has no spans; rows that share an id share postings, which only adds
candidates; null ids are one id in the index; repeated rows are scanned independently and all stay;
an empty table gives an empty result; only the named columns are read, so other columns may have any
name. Positions are code points, ends exclusive. Spans of different rules may overlap; those of one
rule do not.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product
from re import _constants as sre
from re import _parser as sre_parser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdictflow.session import materialize


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``pattern`` of which group ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The base rules, in the order in which spans of equal start are listed.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}"),  # whole runs: a shorter run holds no match and hides none
)
#: After the BEGIN line of a private key: all up to its END line (no other line of five dashes between);
#: without one, header lines and the base64 run: long words, and lines that are one word. The repeats
#: are possessive, since Java recurses for others.
KEY_BODY = (r"(?:[^-]*+(?:-{1,4}[^-]++)*+-----END [A-Z ]*PRIVATE KEY-----"
            r"|(?:[\x20\x09-\x0D]*+(?:Proc-Type|DEK-Info):[^\x0A\x0D]*+)*+"
            r"(?:(?:[\x20\x09-\x0D]|\\[rn])*+[A-Za-z0-9+/]{16,}+={0,2}+"
            r"|[\x20\x09]*+[\x0A\x0D][\x20\x09-\x0D]*+[A-Za-z0-9+/]++={0,2}+(?![\x20\x09]*+[^\x20\x09-\x0D]))*+)?")
#: Formats that public services document for their keys.
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----" + KEY_BODY),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("github", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("slack", r"xox[abprs]-[0-9A-Za-z-]{10,}"),
    Rule("stripe", r"[rs]k_live_[0-9A-Za-z]{16,}"),
    Rule("url_login", r"://[^\x20\x09-\x0D/:@]+:[^\x20\x09-\x0D/:@]+@"),
)
RULES = BASE + MORE
MOST_STRINGS = 64  # alternatives followed before a query settles for the trigrams found so far
Query = frozenset  # of frozensets of trigrams: an OR of ANDs; holds the empty set if nothing is mandatory


def either(*queries: Query) -> Query:
    """OR, without ANDs that another one implies."""
    every = frozenset().union(*queries)
    return frozenset(a for a in every if not any(b < a for b in every))


def both(a: Query, b: Query) -> Query:
    return either(frozenset(x | y for x, y in product(a, b)))


def needs(strings: set[str]) -> Query:
    """The trigrams of one of the strings."""
    return either(frozenset(frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in strings))


EVERYTHING: Query = frozenset({frozenset()})


def alternatives(node: tuple) -> set[str] | None:
    """The strings that a regular expression node matches, if they are few."""
    op, arg = node
    if op is sre.LITERAL:
        return {chr(arg).lower()}
    if op is sre.IN:
        chars = set()
        for kind, x in arg:
            if kind is sre.LITERAL:
                chars.add(chr(x).lower())
            elif kind is sre.RANGE and x[1] - x[0] < 8:
                chars |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
            else:
                return None
        return chars if len(chars) <= 8 else None
    if op is sre.SUBPATTERN:
        return joined(list(arg[3]))
    if op is sre.BRANCH:
        parts = [joined(list(x)) for x in arg[1]]
        return None if None in parts else set().union(*parts)
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[1] <= 3:
        one = joined(list(arg[2]))
        if one is not None:
            return {"".join(p) for n in range(arg[0], arg[1] + 1) for p in product(one, repeat=n)}
    return None


def joined(nodes: list[tuple]) -> set[str] | None:
    out = {""}
    for node in nodes:
        part = alternatives(node)
        if part is None or len(out) * len(part) > MOST_STRINGS:
            return None
        out = {a + b for a in out for b in part}
    return out


def query_of(nodes: list[tuple]) -> Query:
    """The trigram query of a sequence of regular expression nodes."""
    query, strings = EVERYTHING, {""}
    for node in nodes:
        part = alternatives(node)
        if part is not None and len(strings) * len(part) <= MOST_STRINGS:
            strings = {a + b for a in strings for b in part}
            continue
        query, strings = both(query, needs(strings)), {""}
        op, arg = node
        if part is not None:
            strings = part
        elif op is sre.SUBPATTERN:
            query = both(query, query_of(list(arg[3])))
        elif op is sre.BRANCH:
            query = both(query, either(*[query_of(list(x)) for x in arg[1]]))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] >= 1:
            query = both(query, query_of(list(arg[2])))
    return both(query, needs(strings))


def trigram_query(pattern: str) -> Query:
    """The trigrams a text must hold, in lower case, for the pattern to match."""
    return query_of(list(sre_parser.parse(pattern)))


def vocabulary(rules: tuple[Rule, ...]) -> list[str]:
    return sorted({t for r in rules for terms in trigram_query(r.pattern) for t in terms})


def build_index(df: DataFrame, rules: tuple[Rule, ...], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Postings (trigram, doc_id), written once to the shared folder, in trigram order per file."""
    lower = df.select(F.col(id_col).alias("doc_id"), F.lower(F.col(text_col)).alias("t"))
    found = F.array_compact(F.array(*[F.when(F.contains("t", F.lit(t)), F.lit(t)) for t in vocabulary(rules)]))
    return materialize(lower.select(F.explode(found).alias("trigram"), "doc_id").sortWithinPartitions("trigram"),
                       "secret-postings")


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """doc_id and the places (bits) of the rules that must be verified there.

    A document brings each trigram of the vocabulary once, so its postings are few; they are folded
    into one bit set before and after the shuffle.
    """
    place = {t: i for i, t in enumerate(vocabulary(rules))}
    words = -(-len(place) // 60)  # bits per long
    spots = F.create_map(*[F.lit(x) for t, i in place.items() for x in (t, i)]) if place else None
    if spots is None:
        return index.select("doc_id", F.lit(0).cast("long").alias("rules")).limit(0)
    bits = F.array(*[F.lit(1 << i).cast("long") for i in range(60)])
    at = F.element_at(spots, F.col("trigram"))
    sets = index.filter(F.col("trigram").isin(*place)).select("doc_id", at.alias("at")).groupBy("doc_id").agg(
        *[F.bit_or(F.when(F.floor(F.col("at") / 60) == w, F.element_at(bits, F.pmod("at", F.lit(60)) + 1)))
          .alias(f"m{w}") for w in range(words)])
    hit = F.lit(0).cast("long")
    for n, rule in enumerate(rules):
        query = trigram_query(rule.pattern)
        if frozenset() in query:
            continue
        some = F.lit(False)
        for terms in query:
            every = F.lit(True)
            for w in range(words):
                mask = sum(1 << place[t] % 60 for t in terms if place[t] // 60 == w)
                if mask:
                    every = every & (F.coalesce(F.col(f"m{w}"), F.lit(0)).bitwiseAND(F.lit(mask)) == mask)
            some = some | every
        hit = hit + F.when(some, 1 << n).otherwise(0)
    return sets.select("doc_id", hit.alias("rules")).filter("rules > 0")


def spans_of(text: Column, rule: Rule, place: int) -> Column:
    """Array of (start, place, end) of a rule's matches."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    pick = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    gaps = F.split(text, rule.pattern, -1)
    parts = F.zip_with(F.zip_with(found, pick, lambda f, p: F.struct(F.length(f).alias("n"), F.length(p).alias("p"))),
                       F.transform(gaps, lambda g: F.length(g)),
                       lambda f, g: F.struct(g.alias("gap"), f.n.alias("n"), f.p.alias("p")))
    kind = "struct<start:int,kind:int,end:int>"
    return F.aggregate(
        parts, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{kind}>").alias("out")),
        lambda a, x: F.struct(
            (a["at"] + x.gap + F.coalesce(x.n, F.lit(0))).alias("at"),
            F.when(x.p >= rule.least, F.concat(a.out, F.array(F.struct(
                (a["at"] + x.gap).alias("start"), F.lit(place).alias("kind"),
                (a["at"] + x.gap + x.n).alias("end")).cast(kind)))).otherwise(a.out).alias("out")),
        lambda a: a.out)


def scan(df: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text",
         name: str = "spans") -> DataFrame:
    """The rows of ``df`` with a column ``name``: array of (start, kind, end) by start, then kind
    (its place in ``rules``)."""
    index = build_index(df, rules, id_col, text_col)
    found = candidates(index, rules).select(F.col("doc_id").alias("_id"), F.col("rules").alias("_rules"))
    rows = df.select(F.struct("*").alias("_row"), F.col(id_col).alias("_key"),
                     F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    rows = rows.join(found.hint("shuffle_hash"), F.col("_key").eqNullSafe(F.col("_id")), "left")
    text, each = F.col("_text"), []
    for n, rule in enumerate(rules):
        if frozenset() in trigram_query(rule.pattern):
            # a cheap look first; such rules are single repeats, so a long match shows as such
            verify = text.rlike(rule.pattern)
        else:
            verify = F.col("_rules").bitwiseAND(F.lit(1 << n)) != 0
        each.append(F.when(verify, spans_of(text, rule, n)))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    spans = F.sort_array(F.concat(*[F.coalesce(x, none) for x in each]))
    taken = [c for c in df.columns if c != name]
    return rows.select(*[F.col(f"_row.`{c}`").alias(c) for c in taken], spans.alias(name))


def written(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s.kind), s.start, s.end)), ",")


def redact(df: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` with every span's characters replaced by ``*``; overlapping spans count once."""
    rows = scan(df, rules, id_col, text_col, "_spans")
    text = F.col(text_col)
    done = F.aggregate(
        "_spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, s: F.when(s.end <= a["at"], a).otherwise(F.struct(
            s.end.alias("at"),
            F.concat(a.out, F.substring(text, a["at"] + 1, F.greatest(s.start - a["at"], F.lit(0))),
                     F.repeat(F.lit("*"), s.end - F.greatest(s.start, a["at"]))).alias("out"))),
        lambda a: F.concat(a.out, F.substring(text, a["at"] + 1, F.length(text))))
    return rows.withColumn(text_col, F.when(F.size("_spans") > 0, done).otherwise(text)).select(*df.columns)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan(docs).select("doc_id", "spans")
    count = [F.aggregate("spans", F.lit(0).cast("long"), counter(n)).alias(f"n_{r.kind}") for n, r in enumerate(BASE)]
    base = F.filter("spans", lambda s: s.kind < len(BASE))
    return found.select("doc_id", *count, F.sha2(written(base), 256).alias("base_sha256"),
                        written(F.col("spans")).alias("spans"))


def counter(n: int):
    return lambda a, s: a + (s.kind == n).cast("long")
