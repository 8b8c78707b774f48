"""Retrieval in batch: every question against every node in one plan, by postings.

Questions are rows; a question's tokens meet the nodes' postings by an equi-join, so a node without a common token is
never touched. Nodes are the documents. Norms are kept per node, not per pair.
"""

from __future__ import annotations

import pandas as pd

from ..functions import lexicon as L
from ..functions import scores as S
from ..functions import text as T
from ..functions.dialect import SPARK, Spark
from ..plans.base import Book, sql

book = Book()
QUERIES, SQL = book.QUERIES, book.SQL

#: The router's words by route, in the order of its tests, and the budgets.
ROUTES = (
    ("comparison", ("compare", "versus", " vs ", "tradeoff"), 10),
    ("drift", ("should", "recommend", "startup", "production", "decision", "evaluate first"), 12),
    ("global", ("main approaches", "themes", "landscape", "what changed", "emerging"), 12),
    ("structured_lookup", ("which repos", "count", "after 20", "before 20", "from stanford"), 8),
)
SHORT, SHORT_BUDGET, MIXED_BUDGET = 5, 8, 10
#: Sentences of answers, gaps and subquestions.
NO_EVIDENCE = "I do not have enough retrieved evidence to answer this query."
BEST_SUPPORTED = "The best-supported answer is grounded in the retrieved claims and source chunks: "
CAUTION = "Retrieved evidence includes cautionary or limitation language; treat recommendation as conditional."
NO_DATA = "No explicit benchmark or dataset node was retrieved for the top evidence chain."
NO_REPOSITORY = "No implementation repository was retrieved in the top evidence."
NO_CONFLICT = "No direct conflicts detected in retrieved evidence."
RECOMMEND = (
    "Evaluate the linked implementation first, but require a small reproduction pass and repo-health review before adoption.",
    "Use the claim evidence for research prioritization, then ingest linked repos before an engineering decision.",
    "Treat the answer as exploratory until stronger claim and implementation evidence is available.",
)
CHECKS = ("Open the saved Cypher evidence-path query in Neo4j Browser.", "Inspect raw source records for the cited spans.")
CHECK_DATA, CHECK_REPOSITORY = "Add benchmark or dataset extraction for the target method.", "Run GitHub ingestion for implementation evidence."
ASK_EVIDENCE, ASK_RISKS = ("What claim and source evidence supports ", " for: "), ("Which implementation or production risks are linked to ", "?")
#: Fusion and diversity.
RRF_K, HYBRID_MIX, LIST_MIX, MMR = 60, (0.74, 0.26), (0.62, 0.38), 0.72


def scored(d: Spark, questions: str = "select item_id as q, query as text from eval_items") -> str:
    """CTE ``scored(q, doc_id, cosine, overlap)`` of questions and documents with a common token."""
    return f"""
qs as ({questions}),
qt as (select q, token, count(*) as tf from (select q, {d.explode(T.tokens(d, 'text'))} as token from qs) group by q, token),
qn as (select q, sqrt(sum(cast(tf * tf as double))) as norm, count(case when length(token) > 1 then 1 end) as words from qt group by q),
dt as (select {'/*+ repartition(doc_id) */ ' if d.name == 'spark' else ''}doc_id, {d.explode(T.tokens(d, 'text'))} as token from documents),
dn as (select doc_id, token, tf, sqrt(sum(cast(tf * tf as double)) over (partition by doc_id)) as norm from (select doc_id, token, count(*) as tf from dt group by doc_id, token)),
dots as (select qt.q, dn.doc_id, max(dn.norm) as norm, sum(cast(qt.tf * dn.tf as double)) as dot, count(case when length(qt.token) > 1 then 1 end) as hits from qt join dn on dn.token = qt.token group by qt.q, dn.doc_id),
scored as (select x.q, x.doc_id, x.dot / (qn.norm * x.norm) as cosine, case when qn.words = 0 then 0e0 else x.hits / cast(qn.words as double) end as overlap
  from dots x join qn on qn.q = x.q)"""


def _meta(d: Spark) -> str:
    """CTE ``meta(doc_id, quality, fresh)``: the features of a document that don't depend on the question."""
    kind = "case doc_kind when 'abstract' then 'paper_full_text' when 'readme' then 'official_repo_readme' when 'issue' then 'repo_issue' when 'release_notes' then 'repo_release' when 'memo' then 'blog_post' else 'unknown' end"
    return f"meta as (select doc_id, text, {S.source_score(d, kind, method="''", span='true', claim="''")} as quality, {S.freshness(d, d.cast_text('created_at'))} as fresh from documents)"


def _vector(d: Spark) -> str:
    return S.combined(semantic="s.cosine", lexical="s.overlap", source_quality="m.quality", freshness="m.fresh", confidence="0.8e0", evidence="0.6e0")


@book.query
def lexical_overlap_topk(d):
    """The five documents that hold most of each question's tokens."""
    return f"""with {scored(d)}, r as (select q, doc_id, overlap, row_number() over (partition by q order by overlap desc, doc_id) as rk from scored where overlap > 0)
        select q as item_id, doc_id, cast(rk as bigint) as rk, round(overlap, 6) as overlap from r where rk <= 5"""


@book.query
def cosine_topk(d):
    """The five documents nearest to each question by bag-of-words cosine."""
    return f"""with {scored(d)}, r as (select q, doc_id, round(cosine, 9) as cosine from scored), w as (select *, row_number() over (partition by q order by cosine desc, doc_id) as rk from r)
        select q as item_id, doc_id, cast(rk as bigint) as rk, round(cosine, 6) as cosine from w where rk <= 5"""


@book.query
def vector_only(d):
    """The vector baseline: five candidates per question by the weighted features."""
    return f"""with {scored(d)}, {_meta(d)}, r as (select s.q, s.doc_id, round({_vector(d)}, 6) as score from scored s join meta m on m.doc_id = s.doc_id),
        w as (select *, row_number() over (partition by q order by score desc, doc_id) as rk from r)
        select q as item_id, doc_id, cast(rk as bigint) as rk, score from w where rk <= 5"""


def ranked(d: Spark) -> str:
    """CTEs ``lists(q, component, doc_id, score, rk)``: the vector and full-text lists, twenty of each per question."""
    feats = S.combined(semantic="s.cosine", lexical="s.overlap", source_quality="m.quality", freshness="m.fresh", confidence="0.75e0", evidence="0.55e0")
    return f"""{scored(d)}, {_meta(d)},
base as (select s.q, s.doc_id, s.cosine, s.overlap, round({feats}, 9) as f from scored s join meta m on m.doc_id = s.doc_id),
each as (select q, 'vector' as component, doc_id, round({LIST_MIX[0]}e0 * f + {LIST_MIX[1]}e0 * cosine, 7) as score from base where cosine > 0
  union all select q, 'fulltext', doc_id, round({LIST_MIX[0]}e0 * f + {LIST_MIX[1]}e0 * overlap, 7) from base where overlap > 0),
lists as (select q, component, doc_id, score, cast(rk as bigint) as rk from (select *, row_number() over (partition by q, component order by score desc, doc_id) as rk from each) where rk <= 20)"""


@book.query
def component_lists(d):
    """The ranked lists of the vector and the full-text component."""
    return f"with {ranked(d)} select q as item_id, component, doc_id, rk, round(score, 5) as score from lists"


def fused(d: Spark) -> str:
    return f"""{ranked(d)},
g as (select q, doc_id, sum(1e0 / ({RRF_K} + rk)) as rrf, max(score) as score, count(*) as components from lists group by q, doc_id),
fused as (select q, doc_id, components, rrf / max(rrf) over (partition by q) as rrf, {HYBRID_MIX[0]}e0 * score + {HYBRID_MIX[1]}e0 * (rrf / max(rrf) over (partition by q)) as score from g)"""


@book.query
def rrf_fusion(d):
    """Reciprocal rank fusion of both lists, relative to the best, and the number of lists."""
    return f"with {fused(d)} select q as item_id, doc_id, components, round(rrf, 6) as rrf from fused"


@book.query
def hybrid_before_diversity(d):
    """The hybrid ranking before diversity: ten per question."""
    return f"""with {fused(d)}, w as (select *, row_number() over (partition by q order by round(score, 7) desc, doc_id) as rk from fused)
        select q as item_id, doc_id, cast(rk as bigint) as rk, round(score, 5) as score from w where rk <= 10"""


@book.query
def anchors(d):
    """Anchor documents of every question: the eight best by the greater of cosine and overlap."""
    return f"""with {scored(d)}, r as (select q, doc_id, round(greatest(cosine, overlap), 9) as score from scored), w as (select *, row_number() over (partition by q order by score desc, doc_id) as rk from r where score > 0)
        select q as item_id, doc_id, cast(rk as bigint) as rk, round(score, 6) as score from w where rk <= 8"""


def route(d: Spark, text: str) -> str:
    low = f"lower({T.txt(text)})"
    tests = " ".join(f"when {T.any_word(d, low, words)} then '{name}'" for name, words, _ in ROUTES)
    return f"case {tests} when {d.size(T.token_set(d, text))} <= {SHORT} then 'local' else 'hybrid' end"


def budget(kind: str) -> str:
    return f"case {kind} " + " ".join(f"when '{n}' then {b}" for n, _, b in ROUTES) + f" when 'local' then {SHORT_BUDGET} else {MIXED_BUDGET} end"


@book.query
def route_queries(d):
    """The route and retrieval budget of every question and document title line."""
    return f"""with r as (select 'question' as kind, item_id as id, {route(d, 'query')} as route from eval_items union all select 'paper', row_no, {route(d, 'title')} from papers)
        select kind, id, route, {budget('route')} as budget from r"""


@book.query
def route_distribution(d):
    return f"select route, count(*) as n from (select {route(d, 'query')} as route from eval_items) group by route"


@book.query
def drift_subquestions(d):
    """Subquestions of a decision question from its three best communities (here the sources of its best documents)."""
    return f"""with {scored(d)}, b as (select s.q, x.source, max(round(s.cosine, 9)) as best from scored s join documents x on x.doc_id = s.doc_id where x.source is not null group by s.q, x.source),
        w as (select *, row_number() over (partition by q order by best desc, source) as rk from b),
        t as (select w.q, w.source, w.rk, i.query from w join eval_items i on i.item_id = w.q where w.rk <= 3),
        u as (select q, 2 * rk - 1 as place, concat('{ASK_EVIDENCE[0]}', source, '{ASK_EVIDENCE[1]}', query) as subquestion from t
          union all select q, 2 * rk, concat('{ASK_RISKS[0]}', source, '{ASK_RISKS[1]}') from t)
        select q as item_id, cast(place as bigint) as place, subquestion from u where place <= 5"""


@book.query
def global_map(d):
    """Global search's map over communities (sources of documents): relevance by the text of their first six members, rescued by top terms."""
    return f"""with {scored(d)}, m as (select doc_id, source, row_number() over (partition by source order by doc_id) as rk from documents where source is not null),
        c as (select s.q, m.source, max(s.cosine) as cosine, max(s.overlap) as overlap, count(*) as members from scored s join m on m.doc_id = s.doc_id where m.rk <= 6 group by s.q, m.source)
        select q as item_id, source, members, round(greatest(cosine, overlap), 6) as relevance,
          round({S.combined(semantic='cosine', lexical='overlap', path_quality='0.72e0', source_quality='0.5e0', freshness='0.45e0', confidence='0.72e0', evidence='(0.45e0 + 0.05e0 * members)', path_score='0.65e0')}, 6) as score from c"""


def diverse(limit: int, pool: int | None = None):
    """A grouped function: greedy maximal marginal relevance over one question's candidates, then diversity along the selection."""

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(["score", "doc_id"], ascending=[False, True])
        left = [(float(s), int(i), set(t)) for s, i, t in zip(rows["score"], rows["doc_id"], rows["toks"], strict=True)]
        near = [0.0] * len(left)  # greatest Jaccard to what is selected
        chosen, open_ = [], list(range(len(left)))
        while open_ and len(chosen) < limit:
            value = lambda k: round(MMR * left[k][0] + (1 - MMR) * (round(1 - near[k], 4) if chosen else 1.0), 6)
            best = max(open_, key=lambda k: (value(k), left[k][0], str(left[k][1])))
            chosen.append((best, value(best), round(1 - near[best], 4) if chosen else 1.0))
            open_.remove(best)
            mine = left[best][2]
            for k in open_:
                union = len(mine | left[k][2])
                near[k] = max(near[k], len(mine & left[k][2]) / union if mine and left[k][2] else 0.0)
        out = [(int(rows["q"].iloc[0]), left[k][1], left[k][0], v, div) for k, v, div in chosen]
        return pd.DataFrame(out, columns=["item_id", "doc_id", "score", "mmr_score", "diversity"])

    return pick


@book.frame
def mmr_rerank(spark, root):
    """The hybrid ranking made diverse: ten of each question's fused candidates (at most forty, the two lists' lengths)."""
    d = SPARK
    pool = sql(spark, root, f"with {fused(d)} select f.q, f.doc_id, round(f.score, 7) as score, {T.token_set(d, 'x.text')} as toks from fused f join documents x on x.doc_id = f.doc_id")
    return pool.groupBy("q").applyInPandas(diverse(10), "item_id long, doc_id long, score double, mmr_score double, diversity double")


@book.frame
def answers(spark, root):
    """An answer per question from its six best diverse candidates: route, confidence, citations and gaps."""
    d = SPARK
    mmr_rerank(spark, root).createOrReplaceTempView("mmr_")
    return sql(spark, root, f"""
      with c as (select m.item_id, m.doc_id, m.score, x.text, x.doc_kind, row_number() over (partition by m.item_id order by m.mmr_score desc, m.doc_id) as rk from mmr_ m join documents x on x.doc_id = m.doc_id),
      g as (select item_id, round(avg(score), 3) as confidence, array_sort(collect_list(struct(rk, doc_id, {T.compact(d, 'text', 180)} as span))) as cs,
              bool_or({T.any_word(d, "lower(coalesce(text, ''))", ('risk', 'limitation', 'challenge', 'stale'))}) as caution, bool_or(doc_kind in ('readme', 'release_notes', 'issue')) as repo,
              bool_or({T.any_word(d, "lower(coalesce(text, ''))", ('benchmark', 'dataset', 'leaderboard'))}) as data, bool_or({T.any_word(d, "lower(coalesce(text, ''))", L.CLAIM_WORDS)}) as claim
            from c where rk <= 6 group by item_id)
      select i.item_id, {route(d, 'i.query')} as route, coalesce(g.confidence, 0e0) as confidence,
        case when g.item_id is null then '{NO_EVIDENCE}' else concat('{BEST_SUPPORTED}', array_join(transform(slice(cs, 1, 3), x -> x.span), '; ')) end as answer,
        coalesce(transform(cs, x -> x.doc_id), array()) as citations,
        coalesce(nullif(concat_ws(' ', case when caution then '{CAUTION}' end, case when not coalesce(data, false) then '{NO_DATA}' end,
                  case when not coalesce(repo, false) then '{NO_REPOSITORY}' end), ''), '{NO_CONFLICT}') as gaps,
        case when repo and claim then '{RECOMMEND[0]}' when claim then '{RECOMMEND[1]}' else '{RECOMMEND[2]}' end as recommendation,
        concat_ws(' ', '{CHECKS[0]}', '{CHECKS[1]}', case when not coalesce(data, false) then '{CHECK_DATA}' end, case when not coalesce(repo, false) then '{CHECK_REPOSITORY}' end) as next_checks,
        round(case when cs is null then 0e0 else 0.6e0 * least(1e0, size(cs) / 4e0) + 0.4e0 * round(1e0 / 7, 3) end, 3) as faithfulness_estimate
      from eval_items i left join g on g.item_id = i.item_id""")  # fmt: skip


@book.frame
def compare_modes(spark, root):
    """Vector-only beside hybrid: shared and different evidence per question."""
    vector_only = QUERIES["vector_only"](spark, root)
    vector_only.createOrReplaceTempView("vector_")
    mmr_rerank(spark, root).createOrReplaceTempView("mmr_")
    return spark.sql("""select coalesce(v.item_id, m.item_id) as item_id, count(v.doc_id) as vector_docs, count(m.doc_id) as graph_docs, count(case when v.doc_id = m.doc_id then 1 end) as shared
        from vector_ v full outer join mmr_ m on v.item_id = m.item_id and v.doc_id = m.doc_id group by 1""")

