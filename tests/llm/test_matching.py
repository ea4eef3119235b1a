"""Substring dedup and Jaccard join against brute force, with copies, ties and awkward rows."""

import hashlib
import random
from itertools import combinations

import duckdb
import numpy as np
import pandas as pd
import pytest

from verdictflow.llm import components, jaccard_join, packed, substring_dedup


def cut_brute(docs, window=50):
    """doc -> (n_words, n_removed, sha) by comparing all windows."""
    words = {d: (t or "").encode().split() for d, t in docs}
    least = {}
    for d in sorted(words):
        for i in range(len(words[d]) - window + 1):
            least.setdefault(tuple(words[d][i:i + window]), d)
    out = {}
    for d, w in words.items():
        gone = {i + j for i in range(len(w) - window + 1) if least[tuple(w[i:i + window])] < d for j in range(window)}
        out[d] = (len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest())
    return out


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def join_brute(docs):
    sets = {d: shingles(t) for d, t in docs}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {d: (len(s), find(d)) for d, s in sets.items()}


def corpus(seed, n=80, vocabulary=400):
    """Texts of many sizes with copies, near copies, shared passages and repeats."""
    rng = random.Random(seed)
    say = lambda k: [rng.choice("abcdefgh") + str(rng.randrange(vocabulary)) for _ in range(k)]
    passage, texts = [say(70), say(55), say(52)], []
    for _ in range(n):
        r = rng.random()
        if texts and r < 0.15:
            texts.append(list(rng.choice(texts)))
        elif texts and r < 0.4:
            near = list(rng.choice(texts))
            for _ in range(rng.randrange(1, 6)):
                if near:
                    near[rng.randrange(len(near))] = rng.choice(say(1))
            texts.append(near)
        else:
            words = say(rng.choice((0, 1, 3, 4, 5, 6, 9, 20, 49, 50, 51, 90, 300, 700, 1500)))
            if rng.random() < 0.5:
                at = rng.randrange(len(words) + 1)
                words[at:at] = rng.choice(passage)
            if rng.random() < 0.1:
                words += ["the"] * 130
            texts.append(words)
    ids = rng.sample(range(10_000), n)
    return [(i, rng.choice((" ", "\n", "\t ")).join(t)) for i, t in zip(ids, texts, strict=True)]


def test_cover_meets_every_difference():
    d, p = substring_dedup.COVER, substring_dedup.PERIOD
    for i in range(p):
        for j in range(p):
            assert any((i + s) % p in d and (j + s) % p in d for s in range(p))


def test_window_hashes():
    h = np.random.default_rng(1).integers(0, 2**63, 300).astype(np.uint64)
    h[100:160] = h[20:80]
    for n in (1, 2, 5, 20, 50):
        x = packed.windows(h, n)
        same = [i for i in range(300 - n + 1) if x[i] == x[20] and i != 20]
        assert same == ([100] if n <= 60 else [])


@pytest.mark.parametrize("seed", [1, 2])
def test_dedup_is_exact(spark, documents, seed):
    docs = corpus(seed)
    got = substring_dedup.dedup(documents(docs).repartition(5)).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == cut_brute(docs) and len(got) == len(docs)


def test_dedup_across_batches(spark, documents, monkeypatch):
    docs = [(i, " ".join(f"w{i}-{j}" for j in range(20)) + " " + " ".join(f"p{j}" for j in range(60))) for i in range(40)]
    got = substring_dedup.dedup(documents(docs).repartition(8)).collect()
    assert {r.doc_id: r.n_removed for r in got} == {i: 60 if i else 0 for i in range(40)}


def test_dedup_awkward_rows(spark, documents):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(5, long), (5, long), (7, long), (None, long), (8, None), (9, ""), (10, long + " end"), (11, "w " * 49)]
    got = sorted(map(tuple, substring_dedup.dedup(documents(rows)).collect()), key=repr)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got == sorted([(5, 60, 0, sha(long)), (5, 60, 0, sha(long)), (7, 60, 60, sha("")), (None, 60, 0, sha(long)),
                          (8, 0, 0, sha("")), (9, 0, 0, sha("")), (10, 61, 60, sha("end")),
                          (11, 49, 0, sha(("w " * 49).strip()))], key=repr)
    assert substring_dedup.dedup(documents(rows).limit(0)).count() == 0


@pytest.mark.parametrize("seed", [3, 4])
def test_join_is_exact(spark, documents, seed):
    docs = corpus(seed, vocabulary=3000)
    got = jaccard_join.join(documents(docs).repartition(5)).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == join_brute(docs) and len(got) == len(docs)


def test_signatures_miss_no_link():
    """Pairs at the threshold share a signature in all bands, also with frequent features last."""
    rng = np.random.default_rng(5)
    for size in (1, 2, 3, 4, 7, 8, 9, 10, 11, 12, 13, 40, 187, 300, 700, 2500):
        base = rng.integers(0, 2**63, size, dtype=np.uint64) * np.uint64(2)
        for drop in range(0, size // 4 + 1, max(1, size // 8)):
            for add in range(0, size // 3 + 1, max(1, size // 8)):
                a, b = np.unique(base), np.unique(np.r_[base[drop:], rng.integers(0, 2**63, add, dtype=np.uint64)])
                inter = len(np.intersect1d(a, b))
                if not jaccard_join.linked(inter, len(a), len(b)):
                    continue
                for hot in (0, size // 5, size // 3, size // 2, 2 * size // 3, size):
                    frequent = np.sort(rng.permutation(base)[:hot])
                    key, owner = jaccard_join.signatures([a, b], frequent)
                    assert set(key[owner == 0]) & set(key[owner == 1])
                assert jaccard_join.least_difference(jaccard_join.sketch(a), jaccard_join.sketch(b)) \
                    <= len(a) + len(b) - 2 * inter <= jaccard_join.most_difference(len(a), len(b))


def test_first_shared_signature_is_within_reach():
    """Linked sets share a signature that reaches both sizes; sets with much of their own do not."""
    rng = np.random.default_rng(6)
    new = lambda k: rng.integers(0, 2**63, k, dtype=np.uint64)

    def candidates(a, b, frequent):
        key, owner, reach = jaccard_join.reaching_signatures([a, b], frequent)
        far = [{k: r for k, o, r in zip(key, owner, reach, strict=True) if o == i} for i in (0, 1)]
        return any(len(b) <= far[0][k] and len(a) <= far[1][k] for k in far[0].keys() & far[1].keys())
    for size in (1, 3, 8, 9, 10, 13, 40, 187, 700):
        base = new(size) * np.uint64(2)
        for drop in range(0, size // 4 + 1, max(1, size // 12)):
            for add in range(0, size // 3 + 1, max(1, size // 12)):
                a, b = np.unique(base), np.unique(np.r_[base[drop:], new(add)])
                if jaccard_join.linked(len(np.intersect1d(a, b)), len(a), len(b)):
                    for hot in (0, size // 5, size // 2, 3 * size // 4, size):
                        assert candidates(a, b, np.sort(rng.permutation(base)[:hot]))
    common = np.sort(new(160))  # as a line that very many documents have
    assert not candidates(np.sort(np.r_[common, new(40)]), np.sort(np.r_[common, new(40)]), common)


def test_signatures_of_a_group_are_one(spark, documents):
    """Documents that share many signatures are one group, not one for each signature."""
    base = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(base + [f"x{i}"])) for i in range(4)]
    shared = jaccard_join.shared_signatures(documents(rows).select("doc_id", "text").repartition(4), np.zeros(0, np.uint64))
    got = shared.collect()
    assert len({r.token for r in got}) <= 11 and len({(r.token, r.doc_id) for r in got}) == len(got)  # 11 subsets of 2 to 4


def test_frequent_features_are_bounded(spark, monkeypatch):
    """Of more features than the bound, those of most sets; the rest never reaches the driver."""
    monkeypatch.setattr(jaccard_join, "HINTS", 100)
    rows = spark.range(0, 5000, 1, 50).selectExpr("id AS feature", "IF(id % 100 = 7, 40, 2) AS sets")
    rows = rows.unionByName(rows.filter("id % 200 = 7"))
    assert sorted(jaccard_join.frequent_features(rows).tolist()) == list(range(7, 5000, 100))
    assert len(jaccard_join.frequent_features(rows.limit(0))) == 0


def test_join_awkward_rows(spark, documents):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(4, text), (4, text), (2, text.upper()), (None, text), (6, None), (7, " \n"), (8, "one two"), (9, "One  two"),
            (10, "two one"), (11, " ".join(["a"] * 500)), (12, " ".join(["A"] * 9))]
    got = sorted(map(tuple, jaccard_join.join(documents(rows)).collect()), key=repr)
    assert got == sorted([(4, 26, 2), (4, 26, 2), (2, 26, 2), (None, 26, None), (6, 0, 6), (7, 0, 7), (8, 1, 8), (9, 1, 8),
                          (10, 1, 10), (11, 1, 11), (12, 1, 11)], key=repr)
    assert jaccard_join.join(documents(rows).limit(0)).count() == 0
    left = jaccard_join.one_of_each(documents(rows))
    assert sorted(r.doc_id if r.doc_id is not None else -1 for r in left.collect()) == [2, 6, 7, 8, 10, 11]  # the row without id is a copy of 2
    assert left.columns == documents(rows).columns


def test_large_group_of_near_copies(spark, documents):
    """One group, in which few pairs share their changes, stays one component."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(300):
        w = list(base)
        w[rng.randrange(200)] = f"x{i}"
        rows.append((i + 100, " ".join(w)))
    got = jaccard_join.join(documents(rows).repartition(6)).collect()
    assert {r.component_id for r in got} == {100}


def family(n_near, n_far, n_words=120):
    """Near copies of one text that link, and texts that share much with all of them but link with none."""
    rng = random.Random(11)
    base, rows = [f"w{i}" for i in range(n_words)], []
    for i in range(n_near + n_far):
        w = list(base)
        for at in rng.sample(range(0, n_words, 12), 1 if i < n_near else 6):  # each changes 5 shingles
            w[at] = f"x{i}-{at}"
        rows.append((i, " ".join(w)))
    return rows


def test_far_members_of_a_group_make_few_pairs(spark, documents, monkeypatch):
    """Texts below the threshold become no rows with every text of their group, also where it is cut into blocks."""
    rows = family(60, 30)
    docs = documents(rows).select("doc_id", "text")
    every = docs.mapInArrow(jaccard_join.profiles, jaccard_join.PROFILE).filter("n IS NOT NULL").select("doc_id", "n", "digest", "sketch")
    shared = jaccard_join.materialize(jaccard_join.shared_signatures(docs, np.zeros(0, np.uint64)))
    found = spark.createDataFrame([(i, 0) for i in range(1, 60)], "doc_id long, component_id long")
    for block in (jaccard_join.BLOCK, 5_000):
        monkeypatch.setattr(jaccard_join, "BLOCK", block)
        assert jaccard_join.apart(shared, found, every).count() < 90  # of 30 * 60 + 30 * 29 / 2


def test_blocks_miss_no_close_pair(spark, documents, monkeypatch):
    """One block or many: the pairs of sets apart that neither sizes nor reaches nor sketches rule out."""
    docs = documents(corpus(6, vocabulary=3000)).select("doc_id", "text").repartition(4)
    every = docs.mapInArrow(jaccard_join.profiles, jaccard_join.PROFILE).filter("n IS NOT NULL").select("doc_id", "n", "digest", "sketch")
    shared = jaccard_join.materialize(jaccard_join.shared_signatures(docs, np.zeros(0, np.uint64)))
    of = {r.doc_id: (r.n, r.sketch) for r in every.collect()}
    groups = {}
    for r in shared.collect():
        groups.setdefault(r.token, []).append(r)
    want = set()
    for rs in groups.values():
        for a, b in combinations(sorted(rs, key=lambda r: r.doc_id), 2):
            (n, s), (m, t) = of[a.doc_id], of[b.doc_id]
            if 4 * min(n, m) >= 3 * max(n, m) and n <= b.reach and m <= a.reach \
                    and jaccard_join.least_difference(s, t) <= jaccard_join.most_difference(n, m):
                want.add((a.doc_id, b.doc_id))
    none = spark.createDataFrame([], "doc_id long, component_id long")
    for block in (jaccard_join.BLOCK, 2_000):
        monkeypatch.setattr(jaccard_join, "BLOCK", block)
        got = [tuple(r) for r in jaccard_join.apart(shared, none, every).collect()]
        assert sorted(got) == sorted(want) and len(want) > 5


def test_equal_sets_count_once_in_a_group(spark, documents, monkeypatch):
    """Copies of a text in many batches are one member of its groups, and stay linked."""
    rows = family(8, 3)
    copies = [(1000 + i, rows[0][1].upper()) for i in range(40)]
    seen, apart = [], jaccard_join.apart
    monkeypatch.setattr(jaccard_join, "apart", lambda shared, *rest: seen.append(shared) or apart(shared, *rest))
    got = jaccard_join.join(documents(rows + copies).repartition(12)).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == join_brute(rows + copies)
    assert {r.doc_id for r in seen[0].collect()} <= set(range(11))


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(40)] + [(900, 900)]
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    root = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {x: r for x, r in root.items() if r != x}


def test_components_with_large_stars(spark, monkeypatch):
    """Vertices with many neighbours are joined in place, the others by a join that repeats no row."""
    rng = random.Random(3)
    monkeypatch.setattr(components, "MANY", 5)
    edges = [(500, i) for i in range(60, 90)] + [(i, i + 1) for i in range(600, 620)] + [(610, 89)]
    edges += [(rng.randrange(700, 760), rng.randrange(700, 760)) for _ in range(50)]
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    root = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {x: r for x, r in root.items() if r != x}
    both = spark.createDataFrame(edges + [(b, a) for a, b in edges], "u long, v long").distinct()
    least = components.with_least(both)
    assert "Generate" not in least._jdf.queryExecution().optimizedPlan().toString()
    near = {u: min([u] + [x + y - u for x, y in edges if u in (x, y)]) for u in root}
    assert sorted(map(tuple, least.collect())) == sorted((r.u, r.v, near[r.u]) for r in both.collect())


def test_packed_signatures():
    """They come back with reaches rounded up by less than a hundredth, in half of the 32 bytes they took."""
    rng = np.random.default_rng(8)
    sets = [np.unique(rng.integers(0, 2**63, k, dtype=np.uint64)) for k in (1, 3, 8, 9, 13, 200, 5000)]
    ids = [5, -3, 2**40, 7, 8, 9, 10]
    for frequent in (np.zeros(0, np.uint64), np.sort(sets[5])[:120]):
        key, owner, reach = jaccard_join.reaching_signatures(sets, frequent)
        want = sorted(zip(key.tolist(), np.array(ids)[owner].tolist(), [len(sets[o]) for o in owner], reach.tolist(), strict=True))
        batch = jaccard_join.packed_signatures(ids, sets, frequent, 4)
        assert sum(batch.column(c).nbytes for c in batch.schema.names) < 16 * len(key)
        got = []
        for row in batch.to_pylist():
            got += zip(*(x.tolist() for x in jaccard_join.unpacked_signatures(pd.DataFrame([row]))), strict=True)
        assert [g[:3] for g in sorted(got)] == [w[:3] for w in want]
        assert all(w[3] <= g[3] <= w[3] + w[2] // 100 for g, w in zip(sorted(got), want, strict=True))
    assert len(jaccard_join.packed_signatures([], [], frequent, 4)) == 0


def test_against_sql(spark, sf, by_sql):
    docs = duckdb.sql(f"SELECT * FROM '{sf}/documents.parquet'").df()
    for op, sql in ((substring_dedup.op1_substring_dedup, substring_dedup.OP1_SQL), (jaccard_join.op6_jaccard_join, jaccard_join.OP6_SQL)):
        got = op(spark, sf)
        assert sorted(map(tuple, got.collect()), key=repr) == by_sql(sql, got.columns, documents=docs)
