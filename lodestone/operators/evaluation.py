"""Evaluation of retrieval over a table of questions: metrics per question, summaries in one pass, weakest and failing cases."""

from __future__ import annotations

from ..functions import text as T
from ..functions.dialect import SPARK, Spark
from ..plans.base import Book, sql
from ..session import written
from .retrieval import _meta, _vector, route, scored

book = Book()
QUERIES, SQL = book.QUERIES, book.SQL

METRICS = ("context_precision", "context_recall", "provenance_coverage", "staleness_detection", "answer_relevance", "conflict_awareness", "faithfulness", "citation_accuracy", "chain_completeness", "faithfulness_estimate")


def rows(d: Spark) -> str:
    """CTE ``rows_(item_id, category, route, ...)``: one row per question with all metrics of its five vector candidates.

    Required nodes of a question are its three best full-text documents; required kinds are abstracts and readmes.
    """
    low = "lower(coalesce(text, ''))"
    outline = d.distinct(d.keep(d.map(d.split("lower(coalesce(answer_outline, ''))", "[ \\t\\n\\r]+"), "w", d.replace("w", "^[.,;:]+|[.,;:]+$", "")), "w", "length(w) > 4"))
    said = d.distinct(d.split("lower(answer)", "[ \\t\\n\\r]+"))
    return f"""{scored(d)}, {_meta(d)},
v as (select s.q, s.doc_id, round({_vector(d)}, 9) as score, m.fresh, m.text from scored s join meta m on m.doc_id = s.doc_id),
c as (select * from (select *, row_number() over (partition by q order by score desc, doc_id) as rk from v) where rk <= 5),
need as (select q, doc_id from (select q, doc_id, row_number() over (partition by q order by round(overlap, 9) desc, doc_id) as rk from scored where overlap > 0) where rk <= 3),
hit as (select n.q, count(*) as needed, count(c.doc_id) as seen from need n left join c on c.q = n.q and c.doc_id = n.doc_id group by n.q),
g as (select c.q, count(*) as n, count(case when x.doc_kind in ('abstract', 'readme') then 1 end) as useful, count(case when coalesce(x.source, '') <> '' and {T.clean(d, 'x.text')} <> '' then 1 end) as covered,
        count(case when {T.clean(d, 'x.text')} <> '' then 1 end) as spanned, count(case when coalesce(x.source, '') <> '' then 1 end) as sourced,
        count(case when c.fresh < 0.55e0 or {T.any_word(d, low.replace('text', 'x.text'), ('stale', 'risk'))} then 1 end) as stale, count(case when {T.any_word(d, low.replace('text', 'x.text'), ('risk', 'limitation', 'challenge', 'stale'))} then 1 end) as cautious, round(avg(c.score), 6) as confidence,
        max(case when c.rk = 1 then {T.compact(d, 'x.text', 180)} end) as answer, sum({d.size(d.split(T.clean(d, 'x.text'), ' '))}) as context_tokens
      from c join documents x on x.doc_id = c.doc_id group by c.q),
w as (select i.item_id, i.category, i.query, {outline} as outline, g.*, {said} as said, hit.needed, hit.seen from eval_items i left join g on g.q = i.item_id left join hit on hit.q = i.item_id),
rows_ as (select item_id, category, {route(d, 'query')} as route, coalesce(confidence, 0e0) as confidence,
   case when n is null then 0e0 else useful / cast(n as double) end as context_precision, case when needed is null then 1e0 else seen / cast(needed as double) end as context_recall,
   case when n is null then 0e0 else covered / cast(n as double) end as provenance_coverage,
   case when category <> 'freshness' then 1e0 when stale > 0 then 0.35e0 else 0.8e0 end as staleness_detection,
   case when {d.size('outline')} = 0 then 0.5e0 else least(1e0, {d.size(d.both('said', 'outline'))} / greatest(1e0, {d.size('outline')} * 0.45e0)) end as answer_relevance,
   case when category in ('contradiction', 'recommend', 'freshness') then case when coalesce(cautious, 0) > 0 or coalesce(useful, 0) = 0 then 1e0 else 0.3e0 end when coalesce(cautious, 0) > 0 then 0.8e0 else 0.5e0 end as conflict_awareness,
   case when n is null then 0e0 else spanned / cast(n as double) end as faithfulness, case when n is null then 0e0 else sourced / cast(n as double) end as citation_accuracy,
   case when n is null then 0e0 else round(1e0 / 7, 3) end as chain_completeness, case when n is null then 0e0 else round(0.6e0 * least(1e0, sourced / 4e0) + 0.4e0 * round(1e0 / 7, 3), 3) end as faithfulness_estimate,
   coalesce(context_tokens, 0) + {d.size(d.split(T.clean(d, 'query'), ' '))} as prompt_tokens from w)"""


@book.query
def eval_rows(d):
    """All metrics of every question, with the estimate of prompt tokens (their cost is nought)."""
    return f"with {rows(d)} select item_id, category, route, {', '.join(f'round({m}, 6) as {m}' for m in METRICS)}, cast(prompt_tokens as bigint) as prompt_tokens, 0e0 as cost from rows_"


@book.query
def eval_summary(d):
    """Averages by category, by route and over all, in one pass of grouping sets."""
    return f"""with {rows(d)} select coalesce(category, 'all') as category, coalesce(route, 'all') as route, count(*) as questions, {', '.join(f'round(avg({m}), 5) as {m}' for m in METRICS)}
        from rows_ group by grouping sets ((category), (route), ())"""


@book.query
def weakest_cases(d):
    """The ten questions of the lowest sum of metrics."""
    total = " + ".join(METRICS)
    return f"with {rows(d)} select item_id, round({total}, 6) as total from rows_ order by round({total}, 6), item_id limit 10"


#: What is said of a failing case, in the order of the tests.
REASONS = (
    ("context_recall < 1e0", "Did not retrieve every required evidence node."),
    ("edge_recall < 1e0", "Retrieved nodes without every required relationship type."),
    ("path_validity < 1e0", "At least one retrieved path was not backed by stored graph edges."),
    ("staleness_detection < 1e0", "Freshness or repo-health caveat was insufficient for a stale-sensitive question."),
)
OTHERWISE = "Lowest aggregate quality case in deterministic ablation comparison."


def reason() -> str:
    return "case " + " ".join(f"when {test} then '{say}'" for test, say in REASONS) + f" else '{OTHERWISE}' end"


@book.query
def failure_reasons(d):
    """How many questions fail for what, by the first reason that holds (vector candidates have no edges and no paths beyond themselves)."""
    return f"with {rows(d)} select {reason()} as reason, count(*) as n from (select *, 1e0 as edge_recall, 1e0 as path_validity from rows_) group by 1"


@book.query
def failure_cases(d):
    """The weakest questions with their reason: a twentieth of all, at least five and at most twenty (the limit is the operator)."""
    total = " + ".join(METRICS)
    return f"""with {rows(d)}, t as (select *, 1e0 as edge_recall, 1e0 as path_validity, round({total}, 6) as total, count(*) over () as n from rows_),
        z as (select item_id, total, {reason()} as reason, row_number() over (order by total, item_id) as rk, n from t)
        select item_id, total, reason, cast(rk as bigint) as rk from z where rk <= greatest(5, least(20, n))"""


@book.query
def unsupported_claims(d):
    """Answers without full support: how many questions have a faithfulness below 1."""
    return f"with {rows(d)} select category, count(*) as questions, count(case when faithfulness < 1e0 then 1 end) as unsupported from rows_ group by category"


@book.query
def merge_quality(d):
    """Share of the pairs that ought to be merged (neighbouring ids of an arXiv number) that a shared DOI or an equal title merges."""
    return f"""with p as (select id, {T.identifier(d, 'min(doi)')} as doi, {T.plain_name(d, 'min(title)')} as title, {d.extract(T.txt('min(arxiv_id)'), '[0-9]{4}[.][0-9]{5}')} as arx from papers where id is not null group by id),
        r as (select arx, doi, title, lag(id) over w as other, lag(doi) over w as other_doi, lag(title) over w as other_title from p where arx <> '' window w as (partition by arx order by id)),
        m as (select case when (doi <> '' and doi = other_doi) or (title <> '' and title = other_title) then 1 else 0 end as merged from r where other is not null)
        select count(*) as pairs, cast(coalesce(sum(merged), 0) as bigint) as merged, case when count(*) = 0 then 1e0 else round(cast(sum(merged) as double) / count(*), 6) end as merge_quality from m"""


@book.query
def decision_quality(d):
    """The ladder's decisions by state, and the share that is accepted: exact and probable ones against all, possible ones being left for review."""
    from .extraction import first_of

    return f"""with o as ({first_of(d, 'organizations', 'id', ('name',))}), n as (select {T.plain_name(d, 'name')} as name, count(*) as n from o where {T.plain_name(d, 'name')} <> '' group by 1),
        p as (select id, {T.identifier(d, 'min(doi)')} as doi from papers where id is not null group by id), e as (select count(*) as c from (select doi from p where doi <> '' group by doi having count(*) > 1)),
        r as (select count(*) as c from n where n > 1), s as (select name, {T.token_set(d, 'name')} as ts from n), x as (select name, {d.explode('ts')} as t from s), f as (select t, count(*) as df from x group by t),
        k as (select x.name, x.t, row_number() over (partition by x.name order by f.df, x.t) as rk from x join f on f.t = x.t),
        h as (select k.name, k.t from k join s on s.name = k.name where k.rk <= {d.size('s.ts')} - cast(ceil(0.72e0 * {d.size('s.ts')}) as bigint) + 1),
        c as (select distinct a.name as l, b.name as g from h a join h b on b.t = a.t and a.name < b.name),
        v as (select count(*) as c from c join s a on a.name = c.l join s b on b.name = c.g where {T.greater_overlap_of_sets(d, 'a.ts', 'b.ts')} >= 0.72e0),
        u as (select c as ec, 0 as rc, 0 as vc from e union all select 0, c, 0 from r union all select 0, 0, c from v),
        g as (select cast(sum(ec) as bigint) as ec, cast(sum(rc) as bigint) as rc, cast(sum(vc) as bigint) as vc from u)
        select ec as exact_decisions, rc as probable_decisions, vc as possible_decisions, case when ec + rc + vc = 0 then 1e0 else round(cast(ec + rc as double) / (ec + rc + vc), 6) end as accepted_share from g"""


#: A token of more names than this is frequent: names that share only frequent tokens are counted by class.
FREQUENT = 40


def _decisions(spark, root: str):
    """``decision_quality`` with the possible decisions counted without listing them.

    Names of equal frequent tokens and equal number of tokens are one class; classes whose frequent tokens alone suffice
    count with the product of their sizes. Beside these, pairs that share a rare token are listed and count if they suffice by that token only.
    """
    from .extraction import first_of

    d = SPARK
    enough = lambda a, b, m, k: f"cast(size(array_intersect({a}, {b})) as double) / greatest({m}, {k}) >= 0.72e0"
    # of tokens from rare to frequent, one of the first so many is shared by any pair that suffices
    first = lambda f, m: f"slice({f}, 1, greatest(0, size({f}) - cast(ceil(0.72e0 * {m}) as int) + 1))"
    written(sql(spark, root, f"select name, count(*) as n, {T.token_set(d, 'first(name)')} as ts from (select {T.plain_name(d, 'name')} as name from ({first_of(d, 'organizations', 'id', ('name',))})) where name <> '' group by name"), "names").createOrReplaceTempView("decided_names_")
    ordered = spark.sql(f"""with x as (select name, explode(ts) as t from decided_names_), f as (select t, count(*) as df from x group by t),
      o as (select x.name, array_sort(collect_list(struct(f.df as df, x.t as t))) as o from x join f on f.t = x.t group by x.name)
      select name, size(o) as m, transform(o, e -> e.t) as ts, transform(filter(o, e -> e.df > {FREQUENT}), e -> e.t) as f, size(filter(o, e -> e.df <= {FREQUENT})) as rare from o""")  # fmt: skip
    written(ordered, "ordered").createOrReplaceTempView("ordered_names_")
    written(spark.sql("select f, m, count(*) as n, xxhash64(f, m) as k from ordered_names_ where size(f) > 0 group by f, m"), "classes").createOrReplaceTempView("name_classes_")
    return sql(spark, root, f"""with h as (select k, f, m, n, explode({first('f', 'm')}) as t from name_classes_),
        classes as (select distinct a.k as l, b.k as g from h a join h b on b.t = a.t and a.k <= b.k),
        common as (select coalesce(sum(case when c.l = c.g then a.n * (a.n - 1) div 2 else a.n * b.n end), 0) as c from classes c join name_classes_ a on a.k = c.l join name_classes_ b on b.k = c.g where {enough('a.f', 'b.f', 'a.m', 'b.m')}),
        r as (select name, explode(slice(ts, 1, least(rare, m - cast(ceil(0.72e0 * m) as int) + 1))) as t from ordered_names_ where rare > 0),
        met as (select distinct a.name as l, b.name as g from r a join r b on b.t = a.t and a.name < b.name),
        more as (select count(*) as c from met join ordered_names_ a on a.name = met.l join ordered_names_ b on b.name = met.g where {enough('a.ts', 'b.ts', 'a.m', 'b.m')} and not ({enough('a.f', 'b.f', 'a.m', 'b.m')})),
        p as (select id, {T.identifier(d, 'min(doi)')} as doi from papers where id is not null group by id),
        u as (select count(*) as ec, 0 as rc, 0 as vc from (select doi from p where doi <> '' group by doi having count(*) > 1) union all select 0, count(*), 0 from decided_names_ where n > 1 union all select 0, 0, c from common union all select 0, 0, c from more),
        g as (select cast(sum(ec) as bigint) as ec, cast(sum(rc) as bigint) as rc, cast(sum(vc) as bigint) as vc from u)
        select ec as exact_decisions, rc as probable_decisions, vc as possible_decisions, case when ec + rc + vc = 0 then 1e0 else round(cast(ec + rc as double) / (ec + rc + vc), 6) end as accepted_share from g""")  # fmt: skip


QUERIES["decision_quality"] = _decisions


@book.query
def system_health(d):
    """Source records by state: stale policies (a policy named stale with a limit in days), short-lived, quarantined and deleted ones, and the mean limit."""
    return """select count(*) as records, count(case when contains(lower(coalesce(freshness_policy, '')), 'stale') and coalesce(stale_after_days, 0) <> 0 then 1 end) as stale_policies,
        count(case when stale_after_days is not null and fetched_at is not null and stale_after_days < 7 then 1 end) as short_lived,
        count(case when lower(quality_gate_status) = 'quarantine' then 1 end) as quarantined, count(case when deleted_at is not null then 1 end) as deleted,
        round(avg(cast(stale_after_days as double)), 6) as mean_stale_after_days from source_records"""


@book.query
def question_years(d):
    """The year that a question names, if any."""
    return f"select item_id, {T.yearish(d, 'query')} as year from eval_items"


@book.query
def question_modes(d):
    """Every question in every ablation, with the mode that runs it (the six ablations are fixed)."""
    modes = (("vector-only", "vector"), ("hybrid", "hybrid"), ("local", "local"), ("global", "global"), ("DRIFT-style", "drift"), ("best-route", "auto"))
    each = d.array(*[d.struct(ablation=f"'{a}'", mode=f"'{m}'") for a, m in modes])
    return f"select item_id, m.ablation as ablation, case when m.mode = 'auto' then {route(d, 'query')} else m.mode end as mode from (select item_id, query, {d.explode(each)} as m from eval_items)"


@book.query
def category_counts(d):
    return "select category, count(*) as n, case when count(*) between 10 and 50 then 'ok' else 'unbalanced' end as balance from eval_items group by category"


@book.query
def trace_averages(d):
    """Averages of a trace log: per event type the number, mean value and share of the busiest hour."""
    return """with h as (select event_type, hour(ts) as h, count(*) as n, sum(value) as v from events group by event_type, hour(ts))
        select event_type, cast(sum(n) as bigint) as n, round(sum(v) / sum(n), 5) as mean_value, round(cast(max(n) as double) / sum(n), 6) as busiest_share from h group by event_type"""

