"""Every query against its SQL in DuckDB, on the smallest tables and on empty ones."""

import datetime
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()


def canonical(rows):
    def one(v):
        if v is None or (isinstance(v, float) and v != v):
            return "null"
        if isinstance(v, float):
            return f"{v + 0.0:.6g}"
        if isinstance(v, (datetime.datetime, datetime.date)):
            return v.isoformat()
        return str(v)

    return sorted(tuple(map(one, r)) for r in rows)


def duck(root):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for p in Path(root).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = canonical(tuple(r[c] for c in cols) for r in df.collect())
    rel = con.execute(SQL[name])
    names = [c[0] for c in rel.description]
    assert sorted(names) == cols
    want = canonical(tuple(r[names.index(c)] for c in cols) for r in rel.fetchall())
    assert got == want


EMPTY = ("p6_found", "tokenize_counts", "graph_stats", "vector_only", "er_exact", "archive_hashes", "label_votes", "top_terms", "path_expand", "repo_health", "windowed_events")


@pytest.fixture(scope="session")
def nothing(spark, sf, tmp_path_factory):
    root = tmp_path_factory.mktemp("empty")
    for p in Path(sf).glob("*.parquet"):
        spark.read.parquet(str(p)).limit(0).write.parquet(str(root / p.name))
    return str(root)


@pytest.mark.parametrize("name", EMPTY)
def test_empty_tables(spark, nothing, name):
    assert QUERIES[name](spark, nothing).count() <= 6  # totals of nothing and the lexicon


def test_pairs_are_counted_as_their_sql_counts_them(spark, tmp_path):
    """Frequent words, large and odd topic sets: the counts equal those of pairs, which aren't listed."""
    from pyspark.sql import functions as F

    word = lambda i: "".join(chr(97 + (i // 26**k) % 26) for k in range(3))
    kinds = ("National Centre for Evidence Research {}", "University of {}", "{} Polytechnic College", "{} Institute of the Walks and Paths of {} Town", "{}", "{} {} Lab")
    names = [kinds[i % 6].format(word(i // 9), word(i // 31)) for i in range(600)] + ["", None, "a", "b c d", "University of the University", "  UNIVERSITY of abc"]
    spark.createDataFrame([(i, f"org:{i}", n) for i, n in enumerate(names)], "row_no long, id string, name string").write.parquet(str(tmp_path / "organizations.parquet"))
    spark.createDataFrame([(i, f"p{i}", f"10.1/{i // 2}") for i in range(20)], "row_no long, id string, doi string").write.parquet(str(tmp_path / "papers.parquet"))
    sets = [[f"t{(i * 7 + j * j) % 23}" for j in range(i % 6)] for i in range(300)] + [[f"t{j}" for j in range(14)], [f"v{j}" for j in range(12)], ["v3", "a,b", "t1"], ["b"], [""], [None], None, ["t1", "t1", "t2"], ["alone"]]
    spark.createDataFrame([(i, f"repo:{i}", s) for i, s in enumerate(sets)], "row_no long, id string, topics array<string>").write.parquet(str(tmp_path / "repos.parquet"))
    for name in ("decision_quality", "edges_similar_repos"):
        df = QUERIES[name](spark, str(tmp_path))
        rel = duck(tmp_path).execute(SQL[name])
        want = [c[0] for c in rel.description]
        assert sorted(df.columns) == sorted(want)
        assert canonical(tuple(r[c] for c in want) for r in df.collect()) == canonical(rel.fetchall())
    assert df.where(F.col("similar") <= 0).count() == 0


def test_crowds_are_counted_in_time(spark, tmp_path):
    """20,000 names of one kind and 12,000 topic sets with one topic in common: 200 and 72 million pairs."""
    import time

    spark.range(20000).selectExpr("id as row_no", "concat('org:', id) as id", "concat('National Centre for Evidence Research n', id) as name").write.parquet(str(tmp_path / "organizations.parquet"))
    spark.createDataFrame([], "row_no long, id string, doi string").write.parquet(str(tmp_path / "papers.parquet"))
    spark.range(12000).selectExpr("id as row_no", "concat('repo:', id) as id", "array('shared', concat('t', id)) as topics").write.parquet(str(tmp_path / "repos.parquet"))
    began = time.monotonic()
    got = QUERIES["decision_quality"](spark, str(tmp_path)).first()
    assert (got.exact_decisions, got.probable_decisions, got.possible_decisions) == (0, 0, 20000 * 19999 // 2)
    assert time.monotonic() - began < 45
    began = time.monotonic()
    assert [tuple(r) for r in QUERIES["edges_similar_repos"](spark, str(tmp_path)).groupBy("similar").count().collect()] == [(11999, 12000)]
    assert time.monotonic() - began < 30


def test_every_query_has_columns_and_a_name():
    assert set(SQL) <= set(QUERIES)
    assert entry.entry.__doc__


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
