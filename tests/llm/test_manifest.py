"""Merkle manifest against a plain construction and SQL, with awkward rows."""

import hashlib
import zlib

import duckdb
import numpy as np
import pytest

from verdictflow.llm import merkle_manifest as M

from .conftest import rows


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(i, text, lang, source, n):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][k:k + 2])) for k in range(0, len(out[-1]), 2)])
    return out


def brute(docs):
    """docs: (doc_id, text, lang, source, n_chars)."""
    langs = sorted({d[2] for d in docs}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for g in langs:
        mine = [(d, leaf(*d)) for d in docs if d[2] == g]
        mine.sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        trees[g] = (mine, levels([h for _, h in mine]))
    top = levels([trees[g][1][-1][0] for g in langs])
    out = []
    for k, g in enumerate(langs):
        mine, tree = trees[g]
        for at, (d, h) in enumerate(mine):
            touched = d[0] is not None and zlib.crc32(str(d[0]).encode()) % 7 == 0 and d[4] is not None
            cur, proof = leaf(*d[:4], d[4] + 1) if touched else h, ""
            for place, part in ((at, tree), (k, top)):
                for nodes in part[:-1]:
                    run = nodes[place // 2 * 2:place // 2 * 2 + 2]
                    proof += "".join(x for j, x in enumerate(run) if j != place % 2)
                    cur = sha("".join(cur if j == place % 2 else x for j, x in enumerate(run)))
                    place //= 2
            out.append((d[0], h, tree[-1][0], top[-1][0], sha(proof), cur, cur == top[-1][0]))
    return sorted(out, key=repr)


def frame(spark, docs):
    return spark.createDataFrame([(*d, 1, "x", b"y") for d in docs],
                                 "doc_id long, text string, lang string, source string, n_chars long, n long, tree string, entries binary")


def query(spark, tmp_path, docs):
    frame(spark, docs).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    return M.op11_merkle_manifest(spark, str(tmp_path))


AWKWARD = [(3, "a", "en", "s", 1), (3, "a", "en", "s", 1), (3, "a", "en", "s", 1), (3, "b", "en", "s", 1), (None, "n1", "en", "s", 2),
           (None, "n2", "en", None, None), (None, "n2", "en", None, None), (-5, "", "en", "", 0), (2**62, None, "en", "s", None),
           (70000, "é" * 5000, "é", "s", 5000), (7, None, None, None, None), (8, "x:1", None, "2:", 3), (9, "z", "", "s", 1),
           (-2**63, "low", "é", "s", 3), (2**63 - 1, "high", "é", "s", 2**63 - 1)]


def test_awkward_rows(spark, tmp_path):
    docs = AWKWARD + [(i * 37, f"t{i}", ["en", "de", None][i % 3], f"s{i % 4}", i) for i in range(300)]
    got = query(spark, tmp_path, docs)
    assert rows(got) == brute(docs)
    assert got.dtypes == [("doc_id", "bigint"), ("leaf", "string"), ("subroot", "string"), ("root", "string"),
                          ("proof_sha256", "string"), ("folded_root", "string"), ("verified", "boolean")]


def test_several_blocks(spark, tmp_path):
    """More leaves than a slot array holds, a row repeated beyond one, sparse and dense ids."""
    docs = [(i, f"t{i}", "en", "s", i) for i in range(9001)] + [(i * 2**40 - 2**50, "x", "de", "s", 1) for i in range(300)]
    docs += [(4, "again", "en", "s", 5)] * 5000 + [(1, "one", "fr", None, 1)]
    assert rows(query(spark, tmp_path, docs)) == brute(docs)


@pytest.mark.parametrize("docs", [[], [(5, "only", "en", "s", 4)], [(5, "a", "en", "s", 4), (6, "b", "de", "s", 4)]])
def test_small_tables(spark, tmp_path, docs):
    assert rows(query(spark, tmp_path, docs)) == (brute(docs) if docs else [])


def test_ranks():
    rng = np.random.default_rng(0)
    for size in (0, 1, 50, 5000, 65536):
        members = np.sort(rng.choice(65536, size, replace=False))
        cut = rng.integers(0, 4, size)
        bitmap = M.RankedBitmap([M.compress(members[cut == k]) for k in range(4)])
        ask = rng.integers(0, 65536, 500)
        assert bitmap.size == size
        assert (bitmap.rank(ask) == np.searchsorted(members, ask)).all()
        assert M.RankedBitmap([bitmap.container()]).size == size


@pytest.mark.parametrize("n", [1, 2, 3, 4095, 4096, 4097, 5000, 12289])
def test_levels_by_slot_arrays(n):
    """Slot arrays, one after the other, give the same root and ways as one tree."""
    nodes = [sha(str(i)).encode() for i in range(n)]
    whole = M.reduced(nodes, (n - 1).bit_length())
    arrays = [M.reduced(nodes[i:i + M.SLOTS], M.height(n)) for i in range(0, n, M.SLOTS)]
    upper = M.reduced([a[-1][0] for a in arrays], M.height(len(arrays)))
    assert upper[-1] == whole[-1]
    for i in {0, n // 3, n // 2, n - 1}:
        path = M.steps(arrays[i // M.SLOTS], i % M.SLOTS) + M.steps(upper, i // M.SLOTS)
        assert path == M.steps(whole, i)
        assert M.folded(nodes[i], path)[0] == whole[-1][0]


def test_against_sql(spark, sf, by_sql):
    got = M.op11_merkle_manifest(spark, sf)
    table = duckdb.sql(f"SELECT * FROM '{sf}/documents.parquet'").arrow()
    assert rows(got) == by_sql(M.OP11_SQL, got.columns, documents=table)


def test_sql_on_awkward_rows(spark, tmp_path, by_sql):
    docs = AWKWARD[4:-1]
    got = query(spark, tmp_path, docs)
    assert by_sql(M.OP11_SQL, got.columns, documents=frame(spark, docs).toArrow()) == brute(docs) == rows(got)
