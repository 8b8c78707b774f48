"""Dispatch, shapes, stores and layout on small rows."""

import io
import urllib.error

import pytest

from lodestone.sources import dispatch as D


def test_dispatch_of_the_sample(spark):
    out = D.dispatch(D.sample(spark))
    papers = {r.id: r for r in out["papers"].collect()}
    assert {"paper:sample:1", "paper:sample:2", "paper:semanticscholar:s9", "paper:semanticscholar:s8"} <= set(papers)
    assert len([i for i in papers if i.startswith("paper:elsewhere:")]) == 1
    assert papers["paper:semanticscholar:s9"].doi == "10.9999/x"
    assert {r.id for r in out["repos"].select("id").collect()} == {"repo:quill/tracer", "repo:orbell/router"}
    assert out["models"].count() == out["datasets"].count() == 1
    assert {r.name for r in out["authors"].collect()} == {"Marigold Fentworth", "Peregrin Ostwald", "Ida Quill", "Tamsin Orbell"}


def test_dispatch_of_nothing_and_broken_payloads(spark):
    schema = "source_name string, record string, payload string"
    assert D.dispatch(spark.createDataFrame([], schema))["papers"].count() == 0
    rows = [("github", "r", "{broken"), (None, "r", None), (None, "r", "{}"), ("sample", "r", '{"kind": "other"}')]
    out = D.dispatch(spark.createDataFrame(rows, schema))
    assert out["papers"].count() == 1 and out["repos"].count() == 0


def test_shapes(spark):
    rows = [(1, '{"methods": [{"name": "x"}, 3], "claims": "no"}'), (2, "[1]"), (3, None), (4, "{broken"), (5, "{}")]
    got = sorted((r.id, r.section or "", r.reason or "") for r in D.shapes(spark.createDataFrame(rows, "id int, payload string")).collect())
    assert got == [(1, "claims", "section_not_list"), (1, "methods", ""), (1, "methods", "item_not_object"), (2, "", "payload_not_object"), (3, "", "payload_not_object"), (4, "", "payload_not_object")]


def test_fetch():
    def answer(request, timeout):
        assert timeout == 30
        return io.BytesIO(b"text")

    def absent(request, timeout):
        raise urllib.error.HTTPError("u", 404, "absent", {}, None)

    def broken(request, timeout):
        raise urllib.error.HTTPError("u", 500, "x" * 900, {}, None)

    assert D.fetch("http://e.example", answer) == ("text", "")
    assert D.fetch("http://e.example", absent) == ("", "")
    assert len(D.fetch("http://e.example", broken)[1]) == 300
    assert D.first_existing(["a", "b", "c"], lambda u: ("t" if u != "a" else "", "")) == ("b", "t")
    assert D.halves(5) == (3, 2) and D.halves(0) == (0, 0)


def test_stores_and_layout(spark, tmp_path):
    layout = D.Layout(str(tmp_path))
    layout.make()
    assert len(layout.PLACES) == 18 and (tmp_path / "artifacts" / "traces").is_dir()
    made = []
    build = lambda: made.append(1) or spark.range(3).toDF("id")
    assert D.load_or_build(spark, f"{tmp_path}/t", build).count() == D.load_or_build(spark, f"{tmp_path}/t", build).count() == 3 and made == [1]
    D.save({"papers": spark.range(2).toDF("id")}, layout["corpus"])
    assert D.load(spark, layout["corpus"], ("papers", "repos"))["papers"].count() == 2
    D.write_json({"b": 1, "a": [1]}, f"{tmp_path}/x/y.json")
    assert (tmp_path / "x" / "y.json").read_text().index('"a"') < (tmp_path / "x" / "y.json").read_text().index('"b"')
    config, shown = D.connection({"NEO4J_PASSWORD": "secret"})
    assert config["password"] == "secret" and shown["password"] == "***"
    batches = D.numbered_batches(spark.range(1001).selectExpr("id", "'a' as label"), "label", "id").groupBy("batch").count()
    assert {r.batch: r["count"] for r in batches.collect()} == {0: 500, 1: 500, 2: 1}


def test_plans_scan_each_table_once(spark, sf):
    from lodestone.plans import registry

    known = registry.queries()
    for name in ("path_score", "referential_filter", "graph_stats", "method_extract"):
        plan = known[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan parquet") <= 6, name


@pytest.mark.parametrize("name", ["path_score", "merge_quality"])
def test_values_differ(spark, sf, name):
    from lodestone.plans import registry

    rows = registry.queries()[name](spark, sf).collect()
    if name == "merge_quality":
        assert 0 < rows[0].merge_quality < 1
    else:
        assert len({r.path_score for r in rows}) > 3
