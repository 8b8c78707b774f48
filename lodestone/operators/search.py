"""Graph search in batch: local, global, DRIFT-style, hybrid and routed modes over the evidence graph, many questions in one plan.

Local: a question's anchor nodes (widened by entity resolution) are expanded along at most eight edges of a node, three
hops, 28 paths; a path is scored by its text's relevance and its edges, the best path per target and length is kept, and
the candidates are made diverse. DRIFT asks its subquestions as further rows of the questions table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions import scores as S
from ..functions import text as T
from ..functions.dialect import SPARK
from ..plans.base import Book, sql
from ..session import written
from .extraction import methods_in, slug_of
from .graph import edges as edge_ctes
from .paths import FAN, HOPS, PATHS, decorated
from .resolution import _papers
from .retrieval import QUERIES as RETRIEVAL
from .retrieval import diverse, route

book = Book()
QUERIES, SQL = book.QUERIES, book.SQL
#: The boost of a match that widened the anchors, its cap, and the mix of a branch into DRIFT's score.
EXACT_BOOST, BOOST_CAP, DRIFT_MIX = 0.12, 0.16, (0.78, 0.22)
ANCHORS = 8


def node_table(spark, root: str) -> DataFrame:
    """``id``, ``label``, ``text``, ``quality``, ``fresh``, ``confidence`` of every node with a text, written once."""
    d = SPARK
    from ..functions import lexicon as L

    methods = " union all ".join(f"select 'method:{slug_of(n)}', 'Method', '{n} {' '.join(a)} {c}', 0.5e0, 0.45e0, 0.84e0" for n, a, c in L.CORPUS_METHODS)
    groups = " union all ".join(f"select 'community:{slug_of(c)}', 'Community', '{c} {' '.join(n for n, _, x in L.CORPUS_METHODS if x == c)}', 0.5e0, 0.45e0, 0.72e0" for c in dict.fromkeys(c for *_, c in L.CORPUS_METHODS))
    return written(
        sql(spark, root, f"""with {edge_ctes(d)}
      select id, 'Paper' as label, concat_ws(' ', title, abstract) as text, 0.88e0 as quality, {S.freshness(d, 'published_at')} as fresh, 0.8e0 as confidence from p1
      union all select id, 'Repo', concat_ws(' ', full_name, description, array_join(topics, ' ')), 0.5e0, 0.45e0, 0.72e0 from r1
      union all select chunk_id, 'DocumentChunk', text, case label when 'Paper' then 0.88e0 else 0.78e0 end, 0.45e0, 0.75e0 from chunks
      union all select claim_id, 'Claim', text, 0.82e0, 0.45e0, confidence from claims
      union all {methods} union all {groups}"""),
        "nodes",
    )


def edge_table(spark, root: str) -> DataFrame:
    """Both directions of every edge with its rank among the first ``FAN`` of its node, written once."""
    both = sql(spark, root, f"with {edge_ctes(SPARK)} select start_id, type, end_id, confidence from edges")
    both.createOrReplaceTempView("edges_")
    return written(spark.sql(f"""
      with t as (select start_id as src, end_id as dst, type as label, type, start_id, end_id, confidence from edges_ union all select end_id, start_id, concat('<-', type), type, start_id, end_id, confidence from edges_)
      select src, dst, label, type, confidence, rk from (select *, row_number() over (partition by src order by type, start_id, end_id) as rk from t) where rk <= {FAN}"""), "edges")  # fmt: skip


def relevance(questions: str, texts: str, key: str) -> str:
    """CTEs that give ``rel(q, key, cosine, overlap)`` of questions and texts paired by ``pairs(q, key)`` or, without it, by common tokens."""
    d = SPARK
    return f"""
qt as (select q, token, count(*) as tf from (select q, explode({T.tokens(d, 'text')}) as token from {questions}) group by q, token),
qn as (select q, sqrt(sum(cast(tf * tf as double))) as norm, count_if(length(token) > 1) as words from qt group by q),
dt as (select {key}, token, count(*) as tf from (select {key}, explode({T.tokens(d, 'text')}) as token from {texts}) group by {key}, token),
dn as (select {key}, sqrt(sum(cast(tf * tf as double))) as norm from dt group by {key})"""


#: Questions that are asked in one pass over the texts; scores nearer than this may be equal when rounded.
BLOCK, ALIKE = 2000, 2e-9


def nearest(questions: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """The ``k`` nodes (``q``, ``id``, ``score``) nearest to each question by the greater of cosine and token overlap, ties by id.

    Every text is compared with every question, but only the best of a task leave it: a batch of texts is a matrix of counts
    over the questions' tokens. Tokens go by their 64-bit hashes. Nodes without a common token are none.
    """
    import numpy as np
    import pyarrow as pa
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    spark, d = questions.sparkSession, SPARK
    asked = questions.selectExpr("q", f"explode({T.tokens(d, 'text')}) as token").groupBy("q", F.xxhash64("token").alias("h"), (F.length("token") > 1).alias("long")).agg(F.count("*").alias("tf")).toPandas()
    qs = np.sort(asked["q"].unique())
    texts = nodes.selectExpr("id", f"transform({T.tokens(d, 'text')}, t -> xxhash64(t)) as hs").where("id is not null and size(hs) > 0")

    def pass_over(part):
        ids_q = np.sort(part["q"].unique())
        vocabulary = np.sort(part["h"].unique())
        counts, long = np.zeros((len(vocabulary), len(ids_q))), np.zeros((len(vocabulary), len(ids_q)))
        at = np.searchsorted(vocabulary, part["h"]), np.searchsorted(ids_q, part["q"])
        counts[at], long[at] = part["tf"], part["long"]
        norms, words = np.sqrt((counts**2).sum(0)), long.sum(0)

        def best(batches):
            kept, least = [{} for _ in ids_q], np.full(len(ids_q), -np.inf)
            for batch in batches:
                hs = batch.column(1)
                ends = np.asarray(hs.offsets) - hs.offsets[0].as_py()
                names, flat = batch.column(0), np.asarray(hs.flatten())
                for lo in range(0, len(names), 1000):
                    hi = min(lo + 1000, len(names))
                    h = flat[ends[lo] : ends[hi]]
                    doc = np.repeat(np.arange(hi - lo), np.diff(ends[lo : hi + 1]))
                    order = np.lexsort((h, doc))
                    h, doc = h[order], doc[order]
                    new = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])
                    tf, h, doc = np.diff(np.r_[new, len(h)]).astype(float), h[new], doc[new]
                    norm = np.sqrt(np.bincount(doc, tf**2, minlength=hi - lo))
                    col = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
                    hit = vocabulary[col] == h
                    if not hit.any():
                        continue
                    used, col = np.unique(col[hit], return_inverse=True)
                    m = np.zeros((hi - lo, len(used)))
                    m[doc[hit], col] = tf[hit]
                    dots, hits = m @ counts[used], (m > 0).astype(float) @ long[used]
                    score = np.maximum(dots / (norms * norm[:, None]), np.where(words > 0, hits / np.maximum(words, 1), 0.0))
                    open_ = (dots > 0) & (score >= least - ALIKE)
                    for j in np.flatnonzero(open_.any(0)):
                        rows = np.flatnonzero(open_[:, j])
                        for i in rows[np.argsort(-score[rows, j], kind="stable")]:
                            if score[i, j] < least[j] - ALIKE:
                                break
                            kept[j][names[int(lo + i)].as_py()] = score[i, j]
                            if len(kept[j]) > 4 * k:
                                least[j] = trim(kept, j)
                        if len(kept[j]) >= k:
                            least[j] = trim(kept, j)
            out = [(int(ids_q[j]), name, float(v)) for j, of in enumerate(kept) for name, v in of.items()]
            yield pa.RecordBatch.from_arrays([pa.array([o[n] for o in out], t) for n, t in enumerate((pa.int64(), pa.string(), pa.float64()))], ["q", "id", "score"])

        def trim(kept, j):
            """Leave what may be among the first ``k`` when rounded: of equal scores the first ``k`` ids; gives the ``k``-th score."""
            ranked = sorted(kept[j].items(), key=lambda x: (-x[1], x[0]))
            floor, same, last, left = ranked[k - 1][1], 0, None, {}
            for name, v in ranked:
                if v < floor - ALIKE:
                    break
                same = same + 1 if v == last else 1
                last = v
                if same <= k:
                    left[name] = v
            kept[j] = left
            return floor

        return texts.mapInArrow(best, "q long, id string, score double")

    if not len(qs):
        return spark.createDataFrame([], "q long, id string, score double")
    found = None
    for lo in range(0, len(qs), BLOCK):
        part = pass_over(asked[asked["q"].isin(qs[lo : lo + BLOCK])])
        found = part if found is None else found.unionByName(part)
    found = found.groupBy("q", "id").agg(F.max("score").alias("score")).withColumn("score", F.round("score", 9))
    return written(found.withColumn("rk", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))).where(F.col("rk") <= k).drop("rk"), "nearest")


def local(spark, root: str, questions: DataFrame, nodes: DataFrame, edges: DataFrame, limit: int = 8) -> DataFrame:
    """Local search for ``questions`` (``q``, ``text``): up to ``limit`` diverse candidates each. Questions without an anchor get none."""
    d = SPARK
    questions.createOrReplaceTempView("questions_")
    nodes.createOrReplaceTempView("nodes_")
    edges.createOrReplaceTempView("fan_")
    sql(spark, root, f"""with p as ({_papers(d)}), v as (select id, doi as value from (select id, {T.identifier(d, 'doi')} as doi from p) where doi <> ''),
        c as (select value, min(id) as canonical_id from v group by value having count(*) > 1) select v.id, c.canonical_id from v join c on c.value = v.value where v.id <> c.canonical_id""").createOrReplaceTempView("resolved_")  # fmt: skip
    nearest(questions, nodes, ANCHORS).createOrReplaceTempView("nearest_")
    anchors = spark.sql(f"""with a as (select q, id from nearest_)
      select q, id, 0e0 as boost from a union select a.q, r.canonical_id, {EXACT_BOOST}e0 from a join resolved_ r on r.id = a.id""")
    written(anchors.groupBy("q", "id").agg({"boost": "max"}).withColumnRenamed("max(boost)", "boost"), "anchors").createOrReplaceTempView("anchors_")
    steps, prev = [], "x0"
    for k in range(HOPS):
        steps.append(f"x{k + 1} as (select x.anchor, array_append(x.path, b.dst) as path, array_append(x.types, b.label) as types, array_append(x.ranks, b.rk) as ranks, array_append(x.hops, {S.hop_score('b.type', 'b.confidence', 'cast(null as double)')}) as hops from {prev} x join fan_ b on b.src = get(x.path, {k}) where not array_contains(x.path, b.dst))")
        prev = f"x{k + 1}"
    every = " union all ".join(f"select *, {k} as depth from x{k}" for k in range(HOPS + 1))
    paths = spark.sql(f"""with x0 as (select id as anchor, array(id) as path, cast(array() as array<string>) as types, cast(array() as array<int>) as ranks, cast(array() as array<double>) as hops from (select distinct id from anchors_)), {', '.join(steps)},
      p as (select * from (select *, row_number() over (partition by anchor order by depth, ranks) as place from ({every})) where place <= {PATHS})
      select a.q, a.boost, p.anchor, p.place, p.depth, p.path, p.types, p.hops, element_at(p.path, -1) as target from anchors_ a join p on p.anchor = a.id""")
    written(paths, "paths").createOrReplaceTempView("paths_")
    # only what lies on a path is looked at from here on
    written(spark.sql("select * from nodes_ where id in (select explode(path) from paths_)"), "path-nodes").createOrReplaceTempView("path_nodes_")
    written(spark.sql(f"select id, token, count(*) as tf from (select id, explode({T.tokens(d, 'text')}) as token from path_nodes_) group by id, token"), "terms").createOrReplaceTempView("terms_")
    quality = S.path_quality("(depth + 1)", "has_claim", "true")
    score = S.combined(semantic="cosine", lexical="overlap", path_quality=quality, source_quality="quality", freshness="fresh", confidence="confidence", evidence=S.evidence_strength(d, "labels"), path_score="path_score")
    # what doesn't depend on the question is settled once per path
    spark.sql(f"""
      with d as (select distinct anchor, place, path from paths_), o as (select anchor, place, explode(path) as id from d),
      t as (select o.anchor, o.place, t.token, sum(t.tf) as tf from o join terms_ t on t.id = o.id group by o.anchor, o.place, t.token)
      select * from t""").createOrReplaceTempView("path_terms_lazy_")
    written(spark.table("path_terms_lazy_"), "path-terms").createOrReplaceTempView("path_terms_")
    found = spark.sql(f"""
      with qt as (select q, token, count(*) as qtf from (select q, explode({T.tokens(d, 'text')}) as token from questions_) group by q, token),
      qn as (select q, sqrt(sum(cast(qtf * qtf as double))) as qnorm, count_if(length(token) > 1) as words from qt group by q),
      norm as (select anchor, place, sqrt(sum(cast(tf * tf as double))) as norm from path_terms_ group by anchor, place),
      asked as (select distinct q, anchor from paths_),
      rel as (select a.q, a.anchor, t.place, sum(cast(t.tf * qt.qtf as double)) as dot, count_if(length(t.token) > 1) as hits
        from asked a join qt on qt.q = a.q join path_terms_ t on t.anchor = a.anchor and t.token = qt.token group by a.q, a.anchor, t.place),
      o as (select anchor, place, explode(path) as id from (select distinct anchor, place, path from paths_)),
      feat as (select o.anchor, o.place, bool_or(n.label = 'Claim') as has_claim, collect_set(n.label) as labels, avg(n.confidence) as confidence from o join path_nodes_ n on n.id = o.id group by o.anchor, o.place),
      f as (select p.*, coalesce(r.dot, 0e0) / (norm.norm * qn.qnorm) as cosine, coalesce(r.hits, 0) / cast(qn.words as double) as overlap, feat.has_claim, feat.labels, feat.confidence, n.label, n.quality, n.fresh,
          case when p.depth = 0 then 0.15e0 else aggregate(p.hops, 0e0, (s, h) -> s + h) / p.depth * {S.length_penalty('(p.depth + 1)')} end as path_score
        from paths_ p join norm on norm.anchor = p.anchor and norm.place = p.place join qn on qn.q = p.q left join rel r on r.q = p.q and r.anchor = p.anchor and r.place = p.place
        join feat on feat.anchor = p.anchor and feat.place = p.place join path_nodes_ n on n.id = p.target),
      c as (select q, anchor, place, target as doc_id, label, depth, {decorated(d)} as path, round(least(1e0, {score} + least({BOOST_CAP}e0, boost)), 4) as score from f),
      g as (select q, doc_id, depth, max_by(struct(label, path, anchor, place), struct(score, path)) as b, max(score) as score from c group by q, doc_id, depth),
      s as (select anchor, place, collect_list(token) as toks from path_terms_ where length(token) > 1 group by anchor, place)
      select g.*, coalesce(s.toks, array()) as toks from g left join s on s.anchor = g.b.anchor and s.place = g.b.place""")  # fmt: skip
    pool = found.selectExpr("q", "doc_id", "depth", "b.label as label", "b.path as path", "toks", "score")

    def pick(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["doc_id", "depth"]).reset_index(drop=True)  # ties go by this order
        chosen = diverse(limit)(pd.DataFrame({"q": 0, "doc_id": range(len(pdf)), "score": pdf["score"], "toks": pdf["toks"]}))
        rows = pdf.iloc[chosen["doc_id"]].reset_index(drop=True)
        return pd.DataFrame({"q": rows["q"], "node_id": rows["doc_id"], "label": rows["label"], "path": rows["path"], "score": chosen["score"], "mmr_score": chosen["mmr_score"]})

    return pool.groupBy("q").applyInPandas(pick, "q long, node_id string, label string, path string, score double, mmr_score double")


def _parts(spark, root):
    return sql(spark, root, "select item_id as q, query as text from eval_items"), node_table(spark, root), edge_table(spark, root)


@book.frame
def local_search(spark, root):
    """Eight candidates per question with their typed paths."""
    return local(spark, root, *_parts(spark, root)).withColumnRenamed("q", "item_id")


@book.frame
def global_search(spark, root):
    """Communities by relevance with their four first members: map, filter (0.12) and the ranking that the reduction takes."""
    return _global(spark, *_parts(spark, root))


def _global(spark, questions: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    questions.createOrReplaceTempView("questions_")
    nodes.where("label = 'Community'").createOrReplaceTempView("communities_")
    edges.where("type = 'BELONGS_TO_COMMUNITY' and label like '<-%' and rk <= 4").createOrReplaceTempView("first_members_")
    score = S.combined(semantic="cosine", lexical="overlap", path_quality="0.72e0", source_quality="0.5e0", freshness="0.45e0", confidence="0.72e0", evidence="0.65e0", path_score="0.65e0")
    return spark.sql(f"""with {relevance('questions_', 'communities_', 'id')},
      s as (select qt.q, dt.id, sum(cast(qt.tf * dt.tf as double)) as dot, count_if(length(qt.token) > 1) as hits from qt join dt on dt.token = qt.token group by qt.q, dt.id),
      r as (select s.q, s.id, s.dot / (qn.norm * dn.norm) as cosine, s.hits / cast(qn.words as double) as overlap from s join qn on qn.q = s.q join dn on dn.id = s.id),
      c as (select q, id, round({score}, 4) as score from r), m as (select src, array_sort(collect_list(dst)) as members from first_members_ group by src)
      select c.q as item_id, c.id as community_id, c.score, coalesce(m.members, array()) as members, row_number() over (partition by c.q order by c.score desc, c.id) as rk from c left join m on m.src = c.id where c.score >= 0.12""")  # fmt: skip


@book.frame
def drift_search(spark, root):
    """Subquestions of every question answered locally and merged: a candidate's score is mixed with its branch's."""
    return _drift(spark, root, *_parts(spark, root))


def _drift(spark, root: str, questions: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    subs = RETRIEVAL["drift_subquestions"](spark, root).join(questions.selectExpr("q as item_id"), "item_id", "left_semi")
    subs = written(subs.selectExpr("item_id * 10 + place as q", "subquestion as text"), "subquestions")
    got = written(local(spark, root, subs.select("q", "text"), nodes, edges, 4), "branches")
    got.createOrReplaceTempView("branches_")
    return spark.sql(f"""with s as (select q, avg(score) as branch from (select *, row_number() over (partition by q order by score desc, node_id) as rk from branches_) where rk <= 3 group by q),
      m as (select cast(floor(b.q / 10) as bigint) as item_id, b.q % 10 as branch_no, b.node_id, b.label, b.path, round({DRIFT_MIX[0]}e0 * b.score + {DRIFT_MIX[1]}e0 * s.branch, 4) as score from branches_ b join s on s.q = b.q)
      select * from (select *, row_number() over (partition by item_id order by score desc, node_id, branch_no) as rk from m) where rk <= 12""")


@book.frame
def routed_search(spark, root):
    """Every question by the mode its route names: the route, its candidates and their scores."""
    d = SPARK
    questions, nodes, edges = _parts(spark, root)
    routes = written(sql(spark, root, f"select item_id as q, {route(d, 'query')} as route from eval_items"), "routes")
    by = lambda *names: written(questions.join(routes.where(routes["route"].isin(*names)), "q", "left_semi"), "asked")
    # each mode is asked only the questions it answers; what it gives is written before the next one takes its views
    loc = written(local(spark, root, by("local", "structured_lookup"), nodes, edges).selectExpr("q as item_id", "node_id", "score"), "local")
    hyb = RETRIEVAL["mmr_rerank"](spark, root).selectExpr("item_id", "cast(doc_id as string) as node_id", "score").join(routes.where("route in ('hybrid', 'comparison')").withColumnRenamed("q", "item_id"), "item_id", "left_semi")
    dri = written(_drift(spark, root, by("drift"), nodes, edges).selectExpr("item_id", "node_id", "score"), "drift")
    glo = _global(spark, by("global"), nodes, edges).selectExpr("item_id", "community_id as node_id", "score")
    return loc.unionByName(hyb).unionByName(dri).unionByName(glo).join(routes.withColumnRenamed("q", "item_id"), "item_id")

