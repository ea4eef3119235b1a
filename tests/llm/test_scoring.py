"""Top-k search, source mix, HTML extraction and the pipeline against brute force, with awkward rows."""

import random
import re
from html import unescape

import duckdb
import numpy as np
import pytest
import public_tokenizers
import sentencepiece

import corpus_pipeline
from verdictflow.llm import html_extract, quality_rules, secret_scan, source_mix, top_k

from .test_matching import join_brute
from .test_native import counts, spans


def best_brute(vectors, queries, k):
    out = []
    for i, q in queries:
        found = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in vectors if j != i and len(v) == len(q))
        out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(found[:k])]
    return sorted(out)


def floors(v):
    return [int(np.floor(256 * float(np.float32(x)))) for x in v]


@pytest.mark.parametrize(("dim", "n", "spread"), [(1, 300, 3.0), (3, 500, 1.0), (16, 400, 1.0), (4, 300, 0.004)])
def test_search_is_exact(spark, dim, n, spread):
    """Low dimensions prune, small spreads bring ties and equal vectors."""
    rng = np.random.default_rng(dim)
    data = [(i, [float(x) for x in rng.normal(0, spread, dim).astype(np.float32)]) for i in range(n)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    got = top_k.top_k(df, df.filter("vec_id % 10 = 0"), 5, shard_rows=64, part_rows=7).collect()
    ints = [(i, floors(v)) for i, v in data]
    assert sorted(map(tuple, got)) == best_brute(ints, [x for x in ints if x[0] % 10 == 0], 5)


def test_search_prunes():
    rng = np.random.default_rng(1)
    points = rng.integers(-1000, 1000, (2000, 2))
    tree = top_k.KdTree(points, 16)
    assert all((points[r] >= tree.low[i]).all() and (points[r] <= tree.high[i]).all() and len(r) <= 16
               for i, r in enumerate(tree.rows) if r is not None)
    seen = []
    plain = top_k.exact_dot

    def counting(a, b):
        seen.append(a.shape[0] * b.shape[0])
        return plain(a, b)

    top_k.exact_dot = counting
    try:
        top_k.search(tree, points, np.arange(2000), points[:1], np.array([0]), np.array([-np.inf]), 5)
    finally:
        top_k.exact_dot = plain
    assert sum(seen) < 2000 * 0.6


def test_search_awkward_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, None), (3, [None, 1.0]), (4, [inf, 1.0]), (5, [nan, 0.0]),
            (None, [9.0, 9.0]), (6, [1.0]), (7, [2.0, 0.0]), (7, [2.0, 0.0]), (8, [-0.001, 0.0]), (9, []), (10, [3e38, 0.0])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows],
                               "vec_id long, embedding array<float>, query_id int, score string")
    got = sorted(map(tuple, top_k.top_k(df, df.filter("vec_id in (0, 6, 9)"), 3).collect()))
    top = 2**63 - 1
    assert got == [(0, 1, 10, top), (0, 2, 7, 131072), (0, 3, 7, 131072)]
    assert top_k.top_k(df.limit(0), df, 3).count() == 0


@pytest.mark.parametrize("high", [2.0**20, 2.0**22, 2.0**36])
def test_search_is_exact_beyond_doubles(spark, high):
    """Scores above 2 ** 53 differ in their last digits, some are beyond a long; shards pass bounds on."""
    rng = random.Random(0)
    data = [(i, [high, float(rng.randrange(-3, 4)) / 256, float(rng.randrange(3))]) for i in range(400)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, top_k.top_k(df, df.filter("vec_id % 10 = 0"), 5, shard_rows=50, part_rows=7).collect()))
    ints = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in data]
    want = best_brute(ints, [x for x in ints if x[0] % 10 == 0], 5)
    scores = {s for *_, s in want}
    assert min(scores) > 2**53 and len(scores) > 5 and len({float(s) for s in scores}) < len(scores)
    assert got == [(*r, min(s, 2**63 - 1)) for *r, s in want]


def test_search_against_sql(spark, sf, by_sql):
    got = top_k.op5_top_k(spark, sf)
    frame = duckdb.sql(f"SELECT * FROM '{sf}/embeddings.parquet'").arrow()
    assert sorted(map(tuple, got.collect()), key=repr) == by_sql(top_k.OP5_SQL, got.columns, embeddings=frame)


def shares_brute(sizes, weights=source_mix.WEIGHTS):
    """Targets by resharing the excess until no source is above its limit."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, left, open_ = {}, 1.5 * sum(sizes.values()), set(order)
    while open_:
        total = sum(w[s] for s in open_)
        over = {s for s in open_ if left * w[s] / total > 2 * sizes[s]}
        if not over:
            return target | {s: left * w[s] / total for s in open_}
        for s in over:
            target[s] = 2.0 * sizes[s]
        left, open_ = left - sum(2.0 * sizes[s] for s in over), open_ - over
    return target


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_mix(spark, documents, seed):
    rng = random.Random(seed)
    names = [None, "", "a", "Z", "é", "🙂", "b"][:rng.randrange(2, 8)]
    rows = [(i, " ".join("w" * 3 for _ in range(rng.randrange(0, 40)))) for i in range(300)]
    from functools import reduce
    parts = [documents(rows[k::len(names)], source=n) for k, n in enumerate(names)]
    df = reduce(lambda a, b: a.unionByName(b), parts)
    plan = {r.doc_id: r for r in source_mix.plan_mix(df, digits=1).collect()}
    size = {i: len(t.split()) for i, t in rows}
    total = {n: sum(size[i] for i, _ in rows[k::len(names)]) for k, n in enumerate(names)}
    want = shares_brute(total)
    for k, n in enumerate(names):
        mine = [plan[i] for i, _ in rows[k::len(names)]]
        assert all(r.target == pytest.approx(want[n]) and r.source_size == total[n] for r in mine)
        assert abs(sum(r.taken for r in mine) - want[n]) <= max(size.values())
    for i, r in plan.items():
        assert r.size == size[i] and r.taken in (0, r.size, 2 * r.size) and r.taken == len(r.positions) * r.size
        assert all(0 <= p <= 1 for p in r.positions) and r.positions == sorted(r.positions)
    again = {r.doc_id: r for r in source_mix.plan_mix(df.repartition(7), digits=1).collect()}
    assert again == plan
    order = source_mix.training_order(source_mix.plan_mix(df)).collect()
    assert [r.position for r in order] == sorted(r.position for r in order)


def test_schedules_invert(spark):
    """At the time given for a share, the integral of the strength has reached that share."""
    from pyspark.sql import functions as F
    grid = spark.range(1, 100).select((F.col("id") / 100).alias("u"))
    for knots in source_mix.SCHEDULES:
        t = np.linspace(0, 1, 20_001)
        w = np.interp(t, *zip(*knots, strict=True))
        reach = np.concatenate([[0], np.cumsum((w[1:] + w[:-1]) / 2)])
        reach /= reach[-1]
        for r in grid.select("u", source_mix.drawn_at(F.col("u"), knots).alias("t")).collect():
            assert np.interp(r.t, t, reach) == pytest.approx(r.u, abs=1e-6)


def test_mix_awkward_rows(spark, documents):
    df = documents([(1, "a b"), (1, "a b"), (None, "c d e"), (None, None), (2, None), (3, "")])
    plan = source_mix.plan_mix(df).collect()
    assert len(plan) == 6 and sum(r.source_size for r in plan) == 7 * 6
    out = source_mix.mixed(df)
    assert out.columns == df.columns and out.count() == sum(len(r.positions) for r in plan)
    assert source_mix.plan_mix(df.limit(0)).count() == 0 and source_mix.mixed(df.limit(0)).count() == 0
    nothing = source_mix.plan_mix(documents([(1, None), (2, "")])).collect()
    assert {(r.size, r.target, r.taken) for r in nothing} == {(0, 0.0, 0)}


def test_mix_against_sql(spark, sf, by_sql):
    got = source_mix.op7_source_mix(spark, sf)
    docs = duckdb.sql(f"SELECT * FROM '{sf}/documents.parquet'").arrow()
    assert sorted(map(tuple, got.collect()), key=repr) == by_sql(source_mix.OP7_SQL, got.columns, documents=docs)


def article(html):
    """The blocks of the article element of the test pages."""
    found = re.search(r"<article>(.*?)(?:</article>|$)", html or "", re.S)
    parts = re.split(r"</?(?:p|h1)[^>]*>", re.sub(r"</?b>", "", found[1])) if found else []
    return "\n\n".join(x for x in (" ".join(unescape(re.sub(r"<[^>]*>", " ", p)).split()) for p in parts) if x)


@pytest.fixture(scope="module")
def model():
    rows = duckdb.sql("SELECT html FROM '/root/testdata/sf0.1/pages.parquet' ORDER BY page_id LIMIT 200").fetchall()
    return html_extract.Extractor([r[0] for r in rows])


def test_held_out_pages(model):
    """Pages not trained on: as they are, and without the tags that give the parts away."""
    htmls = [r[0] for r in duckdb.sql("SELECT html FROM '/root/testdata/sf0.1/pages.parquet' WHERE page_id >= 1500").fetchall()]
    expected = [article(h) for h in htmls]
    assert sum(a != b for a, b in zip(model.texts(htmls), expected, strict=True)) <= 0.002 * len(htmls)
    bare = [re.sub(r"(</?)(article|nav|footer)", r"\1div", h) for h in htmls]
    assert sum(a != b for a, b in zip(model.texts(bare), expected, strict=True)) <= 0.05 * len(htmls)


def test_held_out_layouts(model):
    """Generated pages with side bars, notices, adverts, forms and comments, of another seed."""
    rng, wrong = random.Random(1234), 0
    sentences = [" ".join(f"{rng.choice('aeiou')}{rng.choice('lmnrst')}{i % 7}o" for i in range(rng.randrange(4, 20))) + "."
                 for _ in range(300)]
    for _ in range(200):
        html, _ = html_extract.layout(rng, sentences)
        dom = html_extract.Dom(html)
        y = html_extract.labelled(dom, True)
        wrong += next(model.texts([html])) != "\n\n".join(t for i, t in dom.blocks if y[i])
    assert wrong <= 20


def test_decoding_has_no_contradiction():
    """A node inside an excluded box is not content, although its own score says so."""
    dom = html_extract.Dom("<article><p>one</p><div><p>two</p><section><p>three</p></section></div><p>four</p></article>")
    score = np.array([-3.0, 5, 5, -9, -9, -1, 1, 5])
    assert html_extract.decode(dom, score) == ["one", "four"]


@pytest.mark.parametrize(("html", "blocks"), [
    ("<p>a<p>b<br>c &amp; d&nbsp;e", ["a", "b c & d e"]), ("<ul><li>x<li>y</ul>z", ["x", "y", "z"]),
    ("<div title='a>b'>t</div><!-- x > y --><script>if (a<b) </script>u", ["t", "u"]), ("<p>open <b>bold", ["open bold"]),
    ("a < b <3 <", ["a < b <3 <"]), ("<SCRIPT>x</SCRIPT><Style>y</sTyle >z", ["z"]), ("", []), ("<!-- never closed <p>x", []),
    ("</div></p>x</body>y", ["x", "y"]), ("<table><tr><td>1<td>2<tr><td>3</table>", ["1", "2", "3"]), ('<a href="x>y', ["y"]),
    ("&#233;&#x1F642;&lt;p&gt;&bogus;", ["é🙂<p>&bogus;"])])
def test_reading(html, blocks):
    assert [t for _, t in html_extract.Dom(html).blocks] == blocks


@pytest.mark.parametrize(("html", "blocks"), [
    ('<article><p>One <svg class="i"/> two.</p><p>Three.</p></article>', ["One two.", "Three."]),
    ('<p>One <svg class="i"/> two.</p><p>Three.</p><svg><text>x</text></svg>z', ["One two.", "Three.", "z"]),
    ("<p>a <svg><g><path d='m'/><text>t</text></g></svg> b</p>c", ["a b", "c"]), ("<p>a <math><mi>x</mi></math>b</p>", ["a b"]),
    ("<p>a <svg><title/><style/></svg> b</p>c", ["a b", "c"]), ("<p><a href=x><svg><path></a> b</p>c", ["b", "c"]),
    ("<article><p>a <svg> x<p>b</article>c", ["a", "b", "c"]), ("<div>a <math> x</div>b", ["a", "b"]),
    ("<div>a <object> x</div><p>b</p>", ["a", "b"]), ("<p>a <select><option>x<p>b</p>c", ["a", "b", "c"]),
    ("<ul><li>a <object>x<li>b</ul>c", ["a", "b", "c"]), ("<p>a <object><p>x</p><div>y</div></object> b</p>c", ["a b", "c"]),
    ("<head><noscript><meta x></head><body><p>a</p>", ["a"]), ("<div><noscript><div>x</div>y</noscript>a</div>", ["a"]),
    ("<p>a <object>x <object>y</object> z</object> b</p>", ["a b"]), ("<p>a</p><textarea>x</p><p>y", ["a"]), ("<title>x<p>y", []),
    ("<div><iframe><p>x</iframe><template><li>y</template>a</div>", ["a"])])
def test_reading_left_out_elements(html, blocks):
    assert [t for _, t in html_extract.Dom(html).blocks] == blocks


def test_extract_awkward_rows(spark, model):
    html = "<html><body><nav><a href=x>Home</a></nav><article><h1>Title</h1><p>" + "A sentence, and more. " * 30 + "</p></article></body></html>"
    df = spark.createDataFrame([(1, "u", html, "t", 1), (1, "u", html, "t", 1), (None, None, html, "t", 2), (2, "v", None, "t", 3),
                                (3, "v", "", "t", 4), (4, "w", "<p" * 3000, "t", 5), (5, "w", "<div>" * 3000 + "x", "t", 6)],
                               "page_id long, url string, html string, text string, n_chars int")
    got = html_extract.extract(df, model).collect()
    text = "Title\n\n" + ("A sentence, and more. " * 30).strip()
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in got)[:3] == [(0, text, len(text)), (1, text, len(text)), (1, text, len(text))]
    assert all(r.text == "" and r.n_chars == 0 for r in got if r.page_id in (2, 3, 4))
    empty = df.limit(0)
    assert html_extract.extract(empty, html_extract.train(empty)).count() == 0


def test_pipeline(spark, sf):
    """Every stage's decisions, from plain Python versions of them."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    cutoffs = quality_rules.thresholds(quality_rules.score(docs), spark.read.parquet(f"{sf}/labels.parquet")).count()
    assert cutoffs == 0  # too few labels here for a safe cutoff: the base rules decide
    good = {d: t for d, t in texts.items() if not counts(t)[5]}
    groups = join_brute(list(good.items()))
    single = {d: t for d, t in good.items() if groups[d][1] == d}
    clean = {}
    for d, t in single.items():
        hidden = {i for a, _, b in spans(t) for i in range(a, b)}
        clean[d] = "".join("*" if i in hidden else c for i, c in enumerate(t))
    source = {r.doc_id: r.source for r in docs.collect()}
    total = {}
    for d, t in clean.items():
        total[source[d]] = total.get(source[d], 0) + len(t.split())
    want = shares_brute(total)
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "secrets", "mix", "sentencepiece"]
    out = corpus_pipeline.run(spark, sf).collect()
    taken = {}
    for r in out:
        assert r.ids == lib.encode(clean[r.doc_id]) and r.n_tokens == len(r.ids) and r.round_trip
        taken[source[r.doc_id]] = taken.get(source[r.doc_id], 0) + len(clean[r.doc_id].split())
    longest = {s: max(len(t.split()) for d, t in clean.items() if source[d] == s) for s in total}
    assert all(abs(taken.get(s, 0) - want[s]) <= longest[s] for s in total)
    assert secret_scan.BASE == secret_scan.RULES[:3]


def table_dir(spark, tmp_path, rows, good):
    """Documents (id, text, lang) with awkward further columns, and labels."""
    docs = [(i, t, g, "src", None if t is None else len(t), 1, "x", True, 2.0) for i, t, g in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, size long, q string, "
                                "near boolean, position double").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(good, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def words(rng, n, mark=""):
    return " ".join(f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.randrange(10**6)}{mark}" for _ in range(n))


def test_pipeline_awkward_rows(spark, tmp_path):
    rng = random.Random(3)
    a, b, c = (words(rng, 80) for _ in range(3))
    rows = [(1, a, "en")] * 3 + [(7, a + " end", "en"), (None, b, None), (None, b, "xx"), (None, a, "en"), (2, c, "en"),
                                 (3, None, "en"), (None, None, None), (4, "", ""), (5, "short text", "de")]
    out = corpus_pipeline.run(spark, table_dir(spark, tmp_path, rows, [])).collect()
    assert {r.doc_id for r in out} <= {1, 2, None} and all(r.round_trip for r in out)
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert {tuple(r.ids) for r in out} <= {tuple(lib.encode(t)) for t in (a, b, c)}
    kept = corpus_pipeline.near_duplicates(spark, corpus_pipeline.quality(
        spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)), str(tmp_path))
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == sorted([(1, a), (0, b), (2, c)])
    assert kept.columns == spark.read.parquet(f"{tmp_path}/documents.parquet").columns


def test_pipeline_empty_table(spark, tmp_path):
    assert corpus_pipeline.run(spark, table_dir(spark, tmp_path, [], [])).count() == 0


def test_pipeline_learned_cutoffs(spark, tmp_path):
    """Enough labelled good texts of one language for a cutoff: unlabelled texts above it go, other languages stay."""
    rng = random.Random(8)
    rows = [(i, words(rng, 60), "en") for i in range(500)]
    rows += [(1000 + i, words(rng, 60, "#$%"), g) for i, g in enumerate(["en", "de", "en"])]
    folder = table_dir(spark, tmp_path, rows, [(i, 1, 0) for i in range(500)])
    out = corpus_pipeline.quality(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
    assert sorted(r.doc_id for r in out.collect()) == [*range(500), 1001]
    assert {r.doc_id for r in corpus_pipeline.run(spark, folder).select("doc_id").collect()} <= {*range(500), 1001}


def test_cutoffs_against_exact_bounds(spark):
    """The step that a plain search over all steps finds, per stratum, with exact binomial tails."""
    from math import comb

    rng, rules = random.Random(4), {"symbols_per_word": (0.1, 0.2, 0.4, 0.8), "dup_line_share": (0.2, 0.5, 0.9)}
    data = []
    for name, n in (("en", 700), ("de", 450), ("fr", 300)):
        for i in range(n):
            data.append((f"{name}{i}", name, rng.choice([0.0, 0.05, rng.random() ** 12]), rng.choice([0.0, rng.random() ** 20])))
    rows = [(d, s, (x, y, 0.0, 0.0)) for d, s, x, y in data]
    scored = spark.createDataFrame(rows, "doc_id string, stratum string, q struct<symbols_per_word: double, dup_line_share: double, "
                                         "repeat_word_share: double, capital_share: double>")
    labels = spark.createDataFrame([(d, 1) for d, *_ in data], "doc_id string, quality int")
    path, want = quality_rules.tightening(rules), {}
    assert path == {"symbols_per_word": (0.8, 0.4, 0.2, 0.1), "dup_line_share": (0.9, 0.5, 0.5, 0.2)}
    for name in ("en", "de", "fr"):
        mine = [(x, y) for _, s, x, y in data if s == name]
        for a, b in zip(*path.values(), strict=True):
            k, n = sum(x > a or y > b for x, y in mine), len(mine)
            if sum(comb(n, i) * 0.02 ** i * 0.98 ** (n - i) for i in range(k + 1)) > 0.05 / 3 or k >= n * 0.02:
                break
            want[name] = (a, b)
    got = {r.stratum: (r.symbols_per_word, r.dup_line_share) for r in quality_rules.thresholds(scored, labels, 0.02, 0.05, rules).collect()}
    assert got == want and len(want) >= 1


LONG = "The council met again on Tuesday, and it heard a long report about roads and bridges."
MENU = '<nav><ul><li><a href="/">Home</a></li><li><a href="/news">News</a></li><li><a href="/x">Sport</a></li></ul></nav>'
FOOT = "<footer><p>&copy; 2024 Example. All rights reserved.</p></footer>"
H, P1, P3, LINK = "<h1>Roads report</h1>", f"<p>{LONG}</p>", f"<p>{' '.join([LONG] * 3)}</p>", f'<p><a href="/full">{LONG}</a></p>'
ROADS, ONE, THREE = "Roads report", LONG, " ".join([LONG] * 3)


@pytest.mark.parametrize(("body", "blocks"), [
    # content directly in the body
    (f"{MENU}{H}{P3}{P3}{P3}{FOOT}", [ROADS, THREE, THREE, THREE]), (f"{MENU}{H}{P3}{FOOT}", [ROADS, THREE]),
    (f"{H}{P3}{P3}", [ROADS, THREE, THREE]), (f"{MENU}{H}{P1}<p>The council met again.</p>{P1}{FOOT}", [ROADS, ONE, "The council met again.", ONE]),
    # a plain element
    (f"{MENU}<div>{H}{P3}{P3}{P3}</div>{FOOT}", [ROADS, THREE, THREE, THREE]), (f"<div>{H}{P3}{P3}</div>", [ROADS, THREE, THREE]),
    (f"<header><p>Example Times</p></header>{MENU}<div>{H}{P3 * 6}</div><aside>{P1}</aside>{FOOT}", [ROADS, *[THREE] * 6]),
    # parts of the page inside the article
    (f"{MENU}<article>{H}{P3}{P3}<footer><p>Filed under roads by the news desk.</p></footer></article>{FOOT}", [ROADS, THREE, THREE]),
    (f"{MENU}<article>{H}{P3}{P3}<footer>Posted in News</footer></article>", [ROADS, THREE, THREE]),
    (f'{MENU}<main>{H}{P3}<div class="sidebar"><h3>Related stories</h3>{P1}</div>{P3}</main>{FOOT}', [ROADS, THREE, THREE]),
    (f"{MENU}<article>{H}{P3}<aside><h2>Read also</h2>{P1}</aside>{P3}<div class='ad'>{LONG}</div>{P3}</article>", [ROADS, THREE, THREE, THREE]),
    # paragraphs that are links
    (f"{MENU}<article>{H}{P3}{LINK}{P3}</article>{FOOT}", [ROADS, THREE, ONE, THREE]),
    (f"{MENU}<div class=content>{H}{P3}{LINK}{P3}</div>{FOOT}", [ROADS, THREE, ONE, THREE])])
def test_layouts_beyond_the_tables(model, body, blocks):
    assert next(model.texts([f"<html><body>{body}</body></html>"])) == "\n\n".join(blocks)


def test_decoding_against_all_assignments():
    """Every way of putting the nodes before, inside or out that only moves forward on the way down."""
    from itertools import product

    rng = random.Random(6)
    for _ in range(150):
        html = "".join(rng.choice(["<div>", "<p>t%d</p>", "</div>", "<section>", "x%d", "</section>"]) for _ in range(9))
        dom = html_extract.Dom("".join(part.replace("%d", str(i)) for i, part in enumerate(re.findall(r"<[^>]*>[^<]*|[^<]+", html))))
        n = len(dom.tag)
        if n > 7:
            continue
        score = np.array([rng.gauss(0, 2) for _ in range(n)])
        own = [sum(len(t) for i, t in dom.blocks if i == k) for k in range(n)]
        best = (-1e9, None)
        for state in product(range(3), repeat=n):
            if state[0] == 2 or any(state[i] < state[dom.parent[i]] or state[i] - state[dom.parent[i]] > 1 for i in range(1, n)):
                continue
            moves = (state[0] == 1) + sum(state[i] != state[dom.parent[i]] for i in range(1, n))
            value = sum(score[i] * (0.5 + np.log1p(own[i])) for i in range(n) if state[i] == 1) - moves * html_extract.SWITCH
            best = max(best, (value, state), key=lambda v: v[0])
        assert html_extract.decode(dom, score) == [t for i, t in dom.blocks if best[1][i] == 1]


def test_extraction_query(spark, sf):
    """The query over its table: every page once, its article, and its length."""
    got = html_extract.op10_html_extraction(spark, sf)
    assert [c for c, _ in got.dtypes] == ["page_id", "url", "text", "n_chars"]
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = got.collect()
    assert sorted(r.page_id for r in rows) == sorted(pages)
    wrong = [r.page_id for r in rows if r.text != article(pages[r.page_id].html)]
    assert len(wrong) <= 0.01 * len(rows)
    assert all(r.url == pages[r.page_id].url and r.n_chars == len(r.text) for r in rows)
