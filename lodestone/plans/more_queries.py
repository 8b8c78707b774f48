"""Further operators over whole tables: embedding texts, labels of ids, filters, batches, projections, tallies."""

from __future__ import annotations

from ..functions import scores as S
from ..functions import text as T
from ..operators.extraction import claims, first_of, sources
from ..operators.graph import on_graph
from .base import Book

book = Book()
QUERIES, SQL = book.QUERIES, book.SQL

#: Prefixes of ids and the labels they tell; labels that retrieval may return.
PREFIXES = {"paper": "Paper", "repo": "Repo", "method": "Method", "claim": "Claim", "chunk": "DocumentChunk", "benchmark": "Benchmark", "dataset": "Dataset", "model": "Model", "community": "Community"}
ELIGIBLE = ("Claim", "DocumentChunk", "Repo", "Paper", "Method", "Benchmark", "Dataset", "Model", "Community")


def label_of(x: str) -> str:
    return f"case split_part({x}, ':', 1) " + " ".join(f"when '{p}' then '{n}'" for p, n in PREFIXES.items()) + " end"


@book.query
def labels_of_ids(d):
    """The label that an id's prefix tells, and whether retrieval may return it."""
    return f"""select id, {label_of('id')} as label, coalesce({label_of('id')} in ({', '.join(f"'{x}'" for x in ELIGIBLE)}), false) as eligible
        from (select distinct id from embedding_records where id is not null union select distinct id from authors where id is not null)"""


@on_graph(book)
def relationship_tokens(d):
    """Relationship tokens of decorated paths: upper case without a colon, after an arrow."""
    return f"""with p as (select distinct type as part from edges union select distinct concat('<-', type) from edges union select distinct id from authors where id is not null)
        select part, {d.replace('part', '^<-', '')} = upper({d.replace('part', '^<-', '')}) and not contains(part, ':') as relationship from p"""


@book.query
def embedding_texts(d):
    """The text that is embedded for repositories and claims, by kind."""
    topics = f"coalesce({d.join('topics', ' ')}, '')"
    return f"""with {sources(d)}, {claims(d)}
        select id, 'Repo' as kind, 'readme_embedding' as property_name, concat(coalesce(full_name, ''), ' ', coalesce(description, ''), ' ', coalesce(license, ''), ' ', {topics}) as text from r1
        union all select claim_id, 'Claim', 'embedding', concat(text, ' ', claim_type, ' ', polarity, ' ', text) from claims"""


@book.query
def embedding_norms(d):
    """Stored vectors by size: how many, how many of them zero, mean length."""
    sq = f"{d.sum(d.map('embedding', 'v', 'cast(coalesce(v, 0) as double) * cast(coalesce(v, 0) as double)'))}"
    return f"""select n as dims, count(*) as vectors, count(case when s = 0 then 1 end) as zero, round(avg(sqrt(s)), 4) as mean_length
        from (select {d.size('embedding')} as n, {sq} as s from embedding_records where embedding is not null) group by n"""


@book.query
def label_centroids(d):
    """The centroid of every label's vectors, by dimension."""
    at = d.at("embedding", "i")
    return f"""with e as (select label, embedding, {d.explode(d.range(d.size('embedding')))} as i from embeddings)
        select label, cast(i as bigint) as dim, round(avg(cast({at} as double)), 4) as value, count(*) as n from e group by label, i"""


@book.query
def year_bound(d):
    """Papers of a year or later; a missing year counts as 0 and is dropped."""
    return f"select row_no, {T.yearish(d, 'published_at')} as year from papers where coalesce({T.yearish(d, 'published_at')}, 0) >= 2022"


@book.query
def non_empty_properties(d):
    """Properties of organisations as rows, null and empty ones dropped."""
    cols = ("name", "type", "homepage", "openalex_id", "semantic_scholar_id", "github_login", "huggingface_id")
    every = " union all ".join(f"select row_no, '{c}' as property, {c} as value from organizations where nullif({c}, '') is not null" for c in cols)
    return f"select property, count(*) as n, count(distinct value) as n_values from ({every}) group by property"


@book.query
def document_payloads(d):
    """Titles and paths of repository documents: the given title, else the last part of the path."""
    tail = d.at(d.split(T.txt("path"), "/"), f"cast({d.size(d.split(T.txt('path'), '/'))} - 1 as int)")
    return f"select row_no, coalesce(nullif(trim(title), ''), {tail}) as title, {tail} as file_name, lower(coalesce(doc_type, '')) as doc_type from repo_documents"


@book.query
def citation_sink(d):
    """Citations as flat rows: labels joined, spans cut."""
    return f"with {sources(d)} select chunk_id, concat_ws(',', 'DocumentChunk', label) as labels, url as source_url, {T.compact(d, 'text', 260)} as source_span from chunks"


@book.query
def span_provenance(d):
    """Claims whose text stands in their chunk, with its place."""
    return f"""with {sources(d)}, {claims(d)} select c.claim_id, cast(instr(k.text, c.text) as bigint) as place, {d.chars('c.text')} as chars from claims c join chunks k on k.chunk_id = c.chunk_id"""


@book.query
def paper_quality_and_freshness(d):
    """Evidence features of papers that no question changes, with their combined floor."""
    return f"""select row_no, {S.freshness(d, 'published_at')} as freshness, round({S.combined(source_quality='0.88e0', freshness=S.freshness(d, 'published_at'), confidence='0.8e0', evidence='0.35e0')}, 6) as floor from papers"""


@book.query
def merge_pairs(d):
    """Pairs that ought to be merged (neighbouring ids of an arXiv number) and whether a shared DOI merges them."""
    return f"""with p as ({first_of(d, 'papers', 'id', ('doi', 'arxiv_id'))}), v as (select id, {T.identifier(d, 'doi')} as doi, {d.extract(T.txt('arxiv_id'), '[0-9]{4}[.][0-9]{5}')} as arx from p),
        r as (select arx, id as right_id, doi, lag(id) over (partition by arx order by id) as left_id, lag(doi) over (partition by arx order by id) as left_doi from v where arx <> '')
        select left_id, right_id, doi <> '' and doi = left_doi as merged from r where left_id is not null"""


@book.query
def ordered_distinct(d):
    """Topics of every repository in order, each once, and the set operations against a list of two."""
    ts = "coalesce(topics, " + ("array()" if d.name == "spark" else "[]") + ")"
    want = d.strings("prompt", "verifier")
    return f"""select row_no, {d.size(d.distinct(ts))} as distinct_topics, {d.size(d.both(d.distinct(ts), want))} as shared, {d.size(d.union(ts, want))} as either, {d.size(d.less(want, ts))} as missing from repos"""
