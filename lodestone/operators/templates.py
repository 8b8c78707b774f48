"""The stored graph templates as plans over nodes and edges."""

from __future__ import annotations

from ..functions import lexicon as L
from ..functions import text as T
from ..functions.dialect import Spark
from ..plans.base import Book
from .extraction import first_of, slug_of
from .graph import on_graph, whole

book = Book()
QUERIES, SQL = book.QUERIES, book.SQL


@on_graph(book)
def template_evidence_paths(d):
    """Source, claim and chunk by confidence, the first 25 (the limit is the template's)."""
    return f"""select c.start_id as source_id, c.end_id as claim_id, s.end_id as chunk_id, c.confidence
        from edges c join edges s on s.start_id = c.end_id and s.type = 'SUPPORTED_BY' where c.type = 'CLAIMS' order by c.confidence desc, claim_id, source_id limit 25"""


@on_graph(book)
def template_method_repo_evidence(d):
    """Papers, methods and repositories that meet in a method, factored per repository and method, with its claims if any."""
    return f"""with p as (select end_id as method_id, count(*) as papers from edges where type = 'INTRODUCES' group by end_id),
        c as (select start_id, count(*) as claims from edges where type = 'CLAIMS' group by start_id)
        select r.start_id as repo_id, r.end_id as method_id, p.papers, coalesce(c.claims, 0) as claims
        from edges r join p on p.method_id = r.end_id left join c on c.start_id = r.start_id where r.type = 'IMPLEMENTS'"""


@on_graph(book)
def template_structured_repo_lookup(d):
    """Repositories with the methods they implement and the organisations of the papers' authors are one row each; fifty by name."""
    return f"""select start_id as repo_id, {d.join(d.collect_set('end_id'), ',')} as targets, count(distinct type) as kinds
        from edges where type in ('IMPLEMENTS', 'USES_METHOD') group by start_id order by start_id limit 50"""


@on_graph(book)
def template_counts(d):
    """Typed counts of labels and relationships."""
    return f"""select 'node' as kind, label as name, count(*) as n from nodes group by label
        union all select 'relationship', type, count(*) from edges group by type"""


@on_graph(book)
def template_community_evidence(d):
    """Communities with their members by label, and the first member of each."""
    return f"""select e.end_id as community_id, n.label, count(*) as members, min(e.start_id) as first_member
        from edges e join nodes n on n.id = e.start_id where e.type = 'BELONGS_TO_COMMUNITY' group by e.end_id, n.label"""


@book.query
def template_conflicts(d):
    """Opposed claims of a method: the most confident of either side (their pairs are factored, see edges_contradicts)."""
    from .extraction import claims, sources
    from .graph import named

    best = lambda p: d.least_by(f"case when polarity = '{p}' then claim_id end", d.order(f"case when polarity = '{p}' then -confidence else 9e0 end", "claim_id"))
    return f"""with {sources(d)}, {claims(d)}, {named(d)} select method_id, {best('positive')} as left_claim, {best('caution')} as right_claim
        from claim_methods group by method_id having count(case when polarity = 'positive' then 1 end) > 0 and count(case when polarity = 'caution' then 1 end) > 0"""


@book.query
def template_list(d):
    """The templates by name, with their parameters."""
    rows = {"evidence_paths": "limit", "method_repo_evidence": "method_name,limit", "structured_repo_lookup": "year,organization,limit", "counts": "", "community_evidence": "community_name,limit", "conflicts": "limit", "duplicate_review": "limit"}
    return " union all ".join(f"select '{n}' as name, '{p}' as parameters" for n, p in rows.items())


#: Labels with a uniqueness constraint, full-text indexes and vector indexes (name, labels, properties).
LABELS = ("Paper", "Author", "Organization", "Repo", "RepoDocument", "DocumentChunk", "Claim", "Method", "Benchmark", "Dataset", "Model", "Community", "SourceRecord")
FULLTEXT = (
    ("paper_text", "Paper", "title, abstract"), ("method_text", "Method", "name, description, category"), ("repo_text", "Repo", "full_name, name, description"),
    ("benchmark_text", "Benchmark", "name, task, metric"), ("claim_chunk_text", "Claim|DocumentChunk", "text, source_span, section"), ("community_text", "Community", "name, summary, report"),
)
VECTORS = (("chunk_embedding", "DocumentChunk", "embedding"), ("claim_embedding", "Claim", "embedding"), ("method_embedding", "Method", "embedding"), ("repo_readme_embedding", "Repo", "readme_embedding"), ("community_embedding", "Community", "embedding"))


@book.query
def schema_statements(d):
    """Statements for constraints, full-text and vector indexes (64 dimensions)."""
    rows = [f"CREATE CONSTRAINT {x.lower()}_id IF NOT EXISTS FOR (n:{x}) REQUIRE n.id IS UNIQUE" for x in LABELS]
    rows += [f"CREATE FULLTEXT INDEX lodestone_{n} IF NOT EXISTS FOR (n:{x}) ON EACH [{', '.join('n.' + c for c in cols.split(', '))}]" for n, x, cols in FULLTEXT]
    rows += [f"CREATE VECTOR INDEX lodestone_{n} IF NOT EXISTS FOR (n:{x}) ON (n.{c}) OPTIONS {{indexConfig: {{`vector.dimensions`: 64, `vector.similarity_function`: ~cosine~}}}}" for n, x, c in VECTORS]
    return " union all ".join(f"select replace('{r}', '~', chr(39)) as statement" for r in rows)


@book.query
def template_duplicate_review(d):
    """Possible duplicates for review: organisation names that share most of their tokens, scored by the greater-set overlap, 50 by score (the limit is the template's).

    Names of ``n`` tokens that overlap by 0.72 share a token among the rarest n - ceil(0.72 n) + 1 of either, so only these meet.
    """
    toks = T.token_set(d, "name")
    return f"""with o as ({first_of(d, 'organizations', 'id', ('name',))}), n as (select {T.plain_name(d, 'name')} as name, min(id) as id from o where {T.plain_name(d, 'name')} <> '' group by 1),
        s as (select id, name, {toks} as ts from n), x as (select id, {d.explode('ts')} as t from s), f as (select t, count(*) as df from x group by t),
        r as (select x.id, x.t, row_number() over (partition by x.id order by f.df, x.t) as rk from x join f on f.t = x.t),
        p as (select r.id, r.t from r join s on s.id = r.id where r.rk <= {d.size('s.ts')} - cast(ceil(0.72e0 * {d.size('s.ts')}) as bigint) + 1),
        c as (select distinct a.id as left_id, b.id as right_id from p a join p b on b.t = a.t and a.id < b.id),
        v as (select c.left_id, c.right_id, round({T.greater_overlap_of_sets(d, 'a.ts', 'b.ts')}, 6) as score from c join s a on a.id = c.left_id join s b on b.id = c.right_id)
        select left_id, right_id, score, true as review_required from v where score >= 0.72e0 order by score desc, left_id, right_id limit 50"""


del L, Spark, slug_of, whole
