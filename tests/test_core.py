"""Operators without SQL, against brute force and fixtures."""

import datetime
import json

import pandas as pd
import pytest

from lodestone.functions import scores as S
from lodestone.functions import text as T
from lodestone.functions.dialect import SPARK as D
from lodestone.operators.orphans import orphan_counts, orphan_rows

NTZ = datetime.datetime


def value(spark, expression):
    return spark.sql(f"select {expression} as x").first().x


@pytest.mark.parametrize(
    ("expression", "want"),
    [
        (T.tokens(D, "'A.b-c d_ e+ .x'"), ["a.b-c", "d_", "e+", "x"]),
        (T.token_set(D, "'a bb BB c'"), ["bb"]),
        (T.token_set(D, "cast(null as string)"), []),
        (T.slug(D, "'  Hello, World! '"), "hello-world"),
        (T.slug(D, "'!!!'"), "artifact"),
        (T.canonical_url(D, "' HTTPS://www.Example.org/a/ '"), "example.org/a"),
        (T.yearish(D, "'in 12019 or 2024'"), 2019),
        (T.yearish(D, "cast(null as string)"), None),
        (T.source_of(D, "'source:arxiv:abc'"), "arxiv"),
        (T.source_of(D, "'source:arxiv'"), ""),
        (D.sentences("'One. Two!  Three? four'"), ["One.", "Two!", "Three?", "four"]),
        (T.first_sentence(D, "''"), ""),
        (T.compact(D, "'aa  bb cc dd'", 8), "aa bb c..."),
        (S.freshness(D, "'2026-01-01'"), 1.0),
        (S.freshness(D, "''"), 0.45),
        (S.freshness(D, "'2030'", 2026), 1.0),
        (S.path_quality("1", "false", "true"), 0.15),
        (S.path_quality("3", "true", "true"), 1.0),
        (S.tier("0.82e0"), "high"),
        (S.repo_health(D, "5000", "1000", "'MIT'", "'2025-01-01'", "0"), 0.95),
    ],
)
def test_scalar(spark, expression, want):
    got = value(spark, expression)
    assert got == (pytest.approx(want) if isinstance(want, float) else want)


def test_hash_of_canonical_json(spark):
    import hashlib

    for text in ("plain", 'quote " and \\ slash', "tab\tline\n", ""):
        df = spark.createDataFrame([(text,)], "x string")
        got = df.selectExpr(f"{T.stable_hash(D, 'x')} as h").first().h
        assert got == hashlib.sha256(json.dumps(text, separators=(",", ":")).encode()).hexdigest()


CHILD = "row_no long, ref string, loaded_at timestamp_ntz, id string, deleted_at string"
PARENT = "row_no long, id string, fetched_at timestamp_ntz, deleted_at timestamp_ntz, ref string"


def _orphans(spark, kids, parents):
    c, p = spark.createDataFrame(kids, CHILD), spark.createDataFrame(parents, PARENT)
    out = orphan_rows(c, p, ref="ref", row="row_no", loaded="loaded_at", key="id", time="fetched_at", deleted="deleted_at")
    return c, out


def test_orphans(spark):
    t = lambda d: NTZ(2024, 1, d)
    parents = [(1, "a", t(1), None, "x"), (2, "a", t(5), t(5), "x"), (3, "b", t(3), t(3), None), (4, "b", t(9), None, None), (5, "c", t(20), None, None), (6, None, t(1), None, None), (7, "d", None, None, None)]
    kids = [(1, " A ", t(10), "i", "z"), (2, "b", t(10), "i", "z"), (3, "c", t(10), None, None), (4, "c", t(25), None, None), (5, "none", t(1), None, None), (6, None, t(1), None, None), (7, "  ", t(1), None, None), (8, "none", None, None, None), (9, "c", None, None, None), (9, "none", t(1), None, None), (10, "d", t(1), None, None)]
    c, out = _orphans(spark, kids, parents)
    got = sorted((r.row_no, r.reason) for r in out.collect())
    assert got == [(1, "deleted"), (3, "late"), (5, "missing"), (8, "missing"), (9, "missing")]
    counts = {r.period: (r.refs, r.orphans) for r in orphan_counts(out, c, ref="ref", loaded="loaded_at").collect()}
    assert counts == {"2024-01": (7, 4), None: (2, 1)}


def test_orphans_of_empty_tables(spark):
    t = NTZ(2024, 1, 1)
    assert _orphans(spark, [], [(1, "a", t, None, None)])[1].count() == 0
    assert [r.reason for r in _orphans(spark, [(1, "a", t, None, None)], [])[1].collect()] == ["missing"]


def test_orphans_with_a_hot_key(spark):
    t = NTZ(2024, 1, 2)
    kids = [(i, "gone" if i % 3 else "here", t, None, None) for i in range(3000)]
    _, out = _orphans(spark, kids, [(1, "here", NTZ(2024, 1, 1), None, None)])
    assert out.count() == 2000


def _mmr(rows, limit, lam=0.72):
    """Greedy selection as defined, pair by pair."""
    left, got = list(rows), []
    jac = lambda a, b: len(a & b) / len(a | b) if a and b else 0.0
    while left and len(got) < limit:
        def val(r):
            div = 1.0 if not got else round(1 - max(jac(r[2], g[2]) for g in got), 4)
            return round(lam * r[1] + (1 - lam) * div, 6)

        best = max(left, key=lambda r: (val(r), r[1], str(r[0])))
        got.append(best)
        left.remove(best)
    return [g[0] for g in got]


def test_diversity_equals_brute_force():
    import random

    from lodestone.operators.retrieval import diverse

    rnd = random.Random(4)
    for n in (1, 2, 15):
        rows = [(i, round(rnd.random(), 2), set(rnd.sample("abcdefgh", rnd.randint(0, 5)))) for i in range(n)]
        pdf = pd.DataFrame({"q": 1, "doc_id": [r[0] for r in rows], "score": [r[1] for r in rows], "toks": [list(r[2]) for r in rows]})
        assert diverse(6)(pdf)["doc_id"].tolist() == _mmr(rows, 6)


def test_propagation_settles():
    from lodestone.operators.communities import propagate

    pdf = pd.DataFrame([("a", "b", 3.0, "x", "y"), ("b", "c", 1.0, "y", "z")], columns=["a", "b", "w", "la", "lb"])
    got = propagate(pdf)
    assert got["a"] == got["b"]


def test_paths_equal_a_queue(spark):
    import random
    from collections import defaultdict

    from lodestone.operators import paths as P

    rnd = random.Random(2)
    e = sorted({(rnd.choice("XY"), f"n{rnd.randint(0, 9)}", f"n{rnd.randint(0, 9)}") for _ in range(40)})
    e = [x for x in e if x[1] != x[2]]
    spark.createDataFrame([(a, b, c, 0.5) for a, b, c in e], "type string, s string, t string, confidence double").createOrReplaceTempView("given_edges")
    sql = f"with e as (select * from given_edges), {P.expansion(D, 'select distinct s as id from given_edges')} select anchor, place, path from paths"
    got = {(r.anchor, r.place): r.path for r in spark.sql(sql).collect()}
    near = defaultdict(list)
    for ty, s, t in e:
        near[s].append((ty, s, t, t))
        near[t].append((ty, s, t, s))
    want = {}
    for a in {x[1] for x in e}:
        queue, n = [[a]], 0
        while queue and n < P.PATHS:
            p = queue.pop(0)
            n += 1
            want[a, n] = p
            if len(p) <= P.HOPS:
                queue += [p + [x[3]] for x in sorted(near[p[-1]])[: P.FAN] if x[3] not in p]
    assert got == want


def test_possible_duplicates(spark):
    from lodestone.operators.resolution import possible_pairs

    names = spark.createDataFrame([("agent memory dataset",), ("agent memory data",), ("graph walks",), ("x",)], "name string")
    got = [(r.a, r.b) for r in possible_pairs(names).collect()]
    assert got == [("agent memory data", "agent memory dataset")]


def test_possible_duplicates_are_those_of_all_pairs(spark, monkeypatch):
    """Names that share frequent words only, slips in rare words, one word, long and odd names, repeated and null ones."""
    import difflib

    from lodestone.operators import resolution as R

    makes = lambda i: "".join(chr(97 + (i * k) % 26) for k in (1, 3, 7, 11, 17))
    names = [k.format(makes(i)) for i in range(25) for k in ("{} foundation for open knowledge", "fdn of {0} and {0}s", "{}", "{}x lab", "national centre for evidence {} research institute of the walks and paths of northern towns")]
    names += ["stanford", "stanfrod", "x", "y", "a b c d", "a b c e", "b a c d", "é è à o", "é è à u", "w " * 99 + "a", "w " * 99 + "b", "m" * 70 + "no", "m" * 70 + "on"]
    want = {}
    for a in names:
        for b in names:
            if a < b:
                x, y = set(a.split()), set(b.split())
                ratio, over = difflib.SequenceMatcher(None, a, b).ratio(), len(x & y) / max(len(x), len(y))
                if ratio >= R.POSSIBLE_RATIO or over >= R.POSSIBLE_OVERLAP:
                    want[a, b] = round(ratio, 6), round(over, 6)
    for block in (1500, 30):
        monkeypatch.setattr(R, "BLOCK", block)
        rows = R.possible_pairs(spark.createDataFrame([(n,) for n in [*names, None, "stanford"]], "name string")).collect()
        assert {(r.a, r.b): (r.ratio, r.overlap) for r in rows} == want and len(rows) == len(want)


def test_possible_duplicates_in_time(spark, tmp_path):
    """2,000 names of one kind: 1,999,000 pairs."""
    import time

    from lodestone.operators.resolution import er_possible_duplicates

    spark.range(2000).selectExpr("concat('org:', id) as id", "concat('National Centre for Evidence Research n', id) as name").write.parquet(str(tmp_path / "organizations.parquet"))
    began = time.monotonic()
    assert er_possible_duplicates(spark, str(tmp_path)).count() == 2000 * 1999 // 2
    assert time.monotonic() - began < 45


GITHUB = {"items": [{"full_name": "Acme/Tool", "name": "Tool", "owner": {"login": "Acme"}, "html_url": "https://x.example/Acme/Tool", "stargazers_count": 5000, "forks_count": 10, "license": {"spdx_id": "MIT"}, "pushed_at": "2025-02-01", "open_issues_count": 3, "topics": ["a"], "readme": {"path": "README.md", "content": "aGVsbG8="}, "releases": [{"tag_name": f"v{i}"} for i in range(7)], "issues": [{"number": i, "title": "crash bug" if i == 0 else "ask", "labels": [], "pull_request": {"url": "u"} if i == 1 else None} for i in range(12)]}, {"full_name": "", "name": "none"}]}


def test_github_payload(spark, tmp_path):
    from pyspark.sql import functions as F

    from lodestone.sources import payloads as P

    (tmp_path / "g.json").write_text(json.dumps(GITHUB))
    out = P.normalize_github(P.items(spark, str(tmp_path / "g.json"), P.GITHUB), F.lit("source:github:1"))
    repo = out["repos"].first()
    assert repo.id == "repo:acme/tool" and "recent_issue_risk" in repo.risk_signals and repo.health_score == pytest.approx(0.25 + 0.25 + 0.01 + 0.15 + 0.15 - 0.0015, abs=1e-3)
    assert out["releases"].count() == 5 and out["issues"].count() == 9
    assert out["repo_documents"].first().text == "hello"


def test_openalex_and_others(spark, tmp_path):
    from pyspark.sql import functions as F

    from lodestone.sources import payloads as P

    (tmp_path / "o.json").write_text(json.dumps({"results": [{"id": "https://o.example/W1", "display_name": "T", "publication_year": 2020, "abstract_inverted_index": {"b": [1], "a": [0, 2]}, "authorships": [{"author": {"id": "https://o.example/A1", "display_name": "Ann"}, "institutions": [{"id": "https://o.example/I1", "display_name": "Inst", "type": "education"}]}]}]}))
    out = P.normalize_openalex(P.items(spark, str(tmp_path / "o.json"), P.OPENALEX), F.lit("source:openalex:1"))
    assert out["papers"].first().abstract == "a b a" and out["authors"].first().affiliation_text == "Inst" and out["organizations"].count() == 1
    (tmp_path / "s.json").write_text(json.dumps({"data": [{"paperId": "p", "title": "T", "year": 2021, "authors": [{"authorId": "1", "name": "Bo", "affiliations": ["X"]}], "references": [{"paperId": "r", "title": "R"}], "citations": [{"paperId": None, "title": "C"}]}]}))
    s2 = P.normalize_semantic_scholar(P.items(spark, str(tmp_path / "s.json"), P.SEMANTIC), F.lit("source:s2:1"))
    assert sorted((r.id, r.relation) for r in s2["papers"].collect()) == [("paper:semanticscholar:p", "primary"), ("paper:semanticscholar:r", "reference")]
    (tmp_path / "h.json").write_text(json.dumps([{"modelId": "org/m", "tags": ["license:mit"], "likes": 2}]))
    hf = P.normalize_huggingface(P.items(spark, str(tmp_path / "h.json"), P.HUGGINGFACE), F.lit("source:hf:1"), "model")
    assert hf["models"].first().license == "mit" and hf["organizations"].first().name == "org"
    (tmp_path / "a.xml").write_text("<feed xmlns='http://a.example'><entry><id>http://arxiv.example/abs/2101.00001v2</id><title> A  title </title><summary>S</summary><published>2021</published><author><name>Cy</name></author></entry></feed>")
    ax = P.normalize_arxiv(P.read_arxiv(spark, str(tmp_path / "a.xml")), F.lit("source:arxiv:1"))
    assert ax["papers"].first().id == "paper:arxiv:2101.00001" and ax["authors"].first().name == "Cy"
    merged = P.merge({"papers": ax["papers"]}, {"papers": ax["papers"].withColumn("title", F.lit("other"))})
    assert [r.title for r in merged["papers"].collect()] == ["A title"]


def test_archive(spark, tmp_path):
    from lodestone.sources import archive as A

    schema = "source_name string, source_url string, source_id string, terms string, payload string, key string, fetched_at timestamp_ntz"
    t = NTZ(2024, 5, 1)
    raw = spark.createDataFrame([("github", "u", "1", "mit", '{"a":1}', "o/r", t), ("github", "", "1", "mit", "{}", "", t), ("arxiv", None, None, None, None, None, t)], schema)
    first = A.store(raw, str(tmp_path / "arch")).collect()
    assert sorted(r.quality_gate_status for r in first) == ["pass", "quarantine", "quarantine"]
    again = A.store(raw, str(tmp_path / "arch")).collect()
    assert {r.cache_status for r in again} == {"hit"}
    assert A.manifest(spark, str(tmp_path / "arch")).count() == 6
    good = next(r for r in first if r.quality_gate_status == "pass")
    assert A.payload(spark, str(tmp_path / "arch"), "github", good.content_hash).first().payload == '{"a":1}'
    assert A.manifest(spark, str(tmp_path / "none")).count() == 0


def test_sinks(spark, tmp_path):
    from lodestone.sources import sinks as K

    nodes = spark.createDataFrame([('a"b', "Paper"), ("c", "Re po")], "id string, label string")
    edges = spark.createDataFrame([("c", "CITES", "d")], "start_id string, type string, end_id string")
    lines = [r.value for r in K.cypher(nodes, edges).collect()]
    assert lines[0].startswith("MERGE (n:Paper") and '\\"' in lines[0] and lines[-1].endswith("[:CITES]->(b);")
    assert K.load_plan(nodes, edges).count() == 3
    K.write_jsonl(nodes, str(tmp_path / "j"))
    assert K.read_jsonl(spark, str(tmp_path / "j"), "id string, label string").count() == 2
    assert K.read_jsonl(spark, str(tmp_path / "none"), "id string").count() == 0
    K.write_csv(nodes, str(tmp_path / "c"))
    assert "# T" in K.markdown(nodes, "T")


def test_stream_equals_batch(spark, sf, tmp_path):
    from lodestone.streaming import traces as R

    src = spark.read.parquet(f"{sf}/events.parquet")
    (src.repartitionByRange(3, "ts").write.parquet(str(tmp_path / "in")))
    stream = R.windowed(R.read_events(spark, str(tmp_path / "in"), 100))
    q = stream.writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = R.windowed(src.selectExpr("*", "cast(ts as timestamp) as at"))
    key = lambda df: sorted((str(r.start), r.event_type, r.n) for r in df.collect())
    assert key(spark.table("w")) == key(want)
    R.append_traces(R.read_events(spark, str(tmp_path / "in"), 100).select("event_id"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.json(str(tmp_path / "out")).count() == src.count()


def test_reports_and_command_line(spark, sf, tmp_path, capsys):
    from lodestone import cli
    from lodestone.plans import registry
    from lodestone.sources.reports import decision_memo, write_reports

    known = registry.queries()
    paths = write_reports(spark, sf, str(tmp_path), known, ("eval_summary", "system_health"))
    assert len(paths) == 4 and all(open(p).read() for p in paths)
    assert write_reports(spark, sf, str(tmp_path), {}, ("eval_summary",)) == paths[:2]  # kept, not made again
    assert "Decision memo" in open(decision_memo(spark, sf, 1, str(tmp_path / "m" / "memo.md"), known)).read()
    assert cli.main(["list"]) == 0 and "vector_only" in capsys.readouterr().out
    args = cli.parser().parse_args(["--root", sf, "ask", "3", "--mode", "local"])
    assert cli.MODES[args.mode] in known and all(q in known for q in (*cli.MODES.values(), *cli.GRAPH.values()))
    assert cli.main(["--root", sf, "run", "nothing"]) == 2


def test_search_modes(spark, sf):
    from lodestone.plans import registry

    known = registry.queries()
    got = known["local_search"](spark, sf).toPandas()
    assert len(got) and got.groupby("item_id").size().max() <= 8 and got["score"].between(0, 1).all()
    assert known["global_search"](spark, sf).where("score < 0.12").count() == 0


def test_nearest_is_exact(spark):
    """The nodes nearest to a question, repeated ids and ties included, without a row for every token of every text."""
    import re

    from lodestone.operators.search import nearest

    texts = [(f"n{i:04}", " ".join(f"w{(i * 7 + j * j) % 31}" for j in range(i % 9))) for i in range(1500)] + [("n0003", "w1 w2"), ("n0003", "w1 w2"), ("n0009", None)] + [(f"t{i:03}", "alpha beta") for i in range(100)]
    asked = [(1, "w1 w2 w2 w5"), (2, "Alpha"), (3, "nothing here"), (4, ""), (5, "w7 a")]
    got = nearest(spark.createDataFrame(asked, "q long, text string"), spark.createDataFrame(texts, "id string, text string"), 8)
    assert "token" not in got._jdf.queryExecution().toString()
    want = []
    for q, text in asked:
        a, seen = re.findall(r"\w+", text.lower()), {}
        for i, t in texts:
            b = (t or "").split()
            dot = sum(a.count(w) * b.count(w) for w in set(a))
            if dot:
                norm = lambda x: sum(x.count(w) ** 2 for w in set(x)) ** 0.5
                long = {w for w in a if len(w) > 1}
                seen[i] = max(seen.get(i, 0), round(max(dot / (norm(a) * norm(b)), len(long & set(b)) / len(long) if long else 0), 9))
        want += [(q, i) for i, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:8]]
    assert sorted((r.q, r.id) for r in got.collect()) == sorted(want)


def test_answers_of_every_question(spark, sf):
    from lodestone.plans import registry

    got = registry.queries()["answers"](spark, sf).toPandas()
    assert len(got) == 150 and got["answer"].str.len().min() > 0 and (got["citations"].str.len() <= 6).all()
