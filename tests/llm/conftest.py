import duckdb
import pytest


@pytest.fixture
def by_sql():
    """Rows of an oracle over DataFrames given as DuckDB tables, in the column order of a DataFrame."""
    def run(sql, columns, **tables):
        con = duckdb.connect()
        for name, frame in tables.items():
            con.register(name, frame)
        rel = con.sql(sql)
        at = [rel.columns.index(c) for c in columns]
        return sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=repr)
    return run


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture
def documents(spark):
    """Builds ``documents`` with awkward extra columns."""
    def build(pairs, **more):
        schema = "doc_id long, text string, lang string, source string, n_chars long, size long, h string, n_words string, b string"
        return spark.createDataFrame(
            [(i, t, more.get("lang", "en"), more.get("source", "src0"), None if t is None else len(t), 1, "x", "y", "z")
             for i, t in pairs], schema)
    return build
