"""Scalar functions over whole tables."""

from __future__ import annotations

from ..functions import scores as S
from ..functions import text as T
from .base import Book

book = Book()
QUERIES, SQL = book.QUERIES, book.SQL


@book.query
def tokenize_counts(d):
    """Tokens and distinct tokens of every document."""
    return f"select doc_id, {d.size(T.tokens(d, 'text'))} as n_tokens, {d.size(T.token_set(d, 'text'))} as n_distinct from documents"


@book.query
def title_abstract_overlap(d):
    """Lexical overlap, Jaccard and greater-set overlap of title and abstract."""
    return f"""select row_no, round({T.overlap_of_sets(d, 'a', 'b')}, 6) as overlap, round({T.jaccard_of_sets(d, 'a', 'b')}, 6) as jaccard,
        round({T.greater_overlap_of_sets(d, 'a', 'b')}, 6) as greater_overlap
        from (select row_no, {T.token_set(d, 'title')} as a, {T.token_set(d, 'abstract')} as b from papers)"""


@book.query
def sentence_split(d):
    """Sentences of every document, and the first."""
    return f"""select doc_id, {d.size(d.sentences(T.txt('text')))} as n_sentences, {T.first_sentence(d, 'text')} as first_sentence from documents"""


@book.query
def sentence_rows(d):
    """One row per sentence with its place and length."""
    return f"""select doc_id, cast(i as bigint) as place, {d.chars(d.at('s', 'i'))} as chars
        from (select doc_id, s, {d.explode(d.range(d.size('s')))} as i from (select doc_id, {d.sentences(T.txt('text'))} as s from documents))"""


@book.query
def compact_text(d):
    """Texts with single spaces, cut to 260 characters and three dots."""
    return f"select row_no, {T.compact(d, 'text', 260)} as compact, {d.chars(T.clean(d, 'text'))} as clean_chars from repo_documents"


@book.query
def slugs(d):
    """Slugs and safe ids of repositories and organisations."""
    return f"""select 'repo' as kind, row_no, {T.slug(d, 'full_name')} as slug, {T.safe_id(d, 'full_name')} as safe_id from repos
        union all select 'organization', row_no, {T.slug(d, 'name', 'uncategorized')}, {T.safe_id(d, "case when name is null then 'none' else name end")} from organizations"""


@book.query
def canonical_urls(d):
    return f"""select 'org' as kind, row_no, {T.canonical_url(d, 'homepage')} as url from organizations
        union all select 'paper', row_no, {T.canonical_url(d, 'source_url')} from papers"""


@book.query
def normal_identifiers(d):
    return f"""select row_no, {T.identifier(d, 'doi')} as doi, {T.identifier(d, 'arxiv_id')} as arxiv_id, {T.plain_name(d, 'title')} as plain_title,
        {T.source_of(d, 'source_record_id')} as source_name from papers"""


@book.query
def year_freshness(d):
    """Years in dates of many forms, and freshness."""
    return f"select row_no, {T.yearish(d, 'published_at')} as year, {S.freshness(d, 'published_at')} as freshness from papers"


@book.query
def stable_hashes(d):
    """Hashes of canonical JSON, of one value and of a list."""
    return f"select row_no, {T.stable_hash(d, 'id')} as hash, {T.hash_list(d, 'id', 'source_record_id')} as pair_hash from papers"


@book.query
def base64_round_trip(d):
    """Content decoded from base64; what is no base64 becomes empty."""
    coded = f"case when row_no % 5 = 0 then substring({d.base64('text')}, 2) else {d.base64('text')} end"
    return f"""select row_no, {d.chars(d.unbase64('coded'))} as chars, {d.unbase64('coded')} = text as same
        from (select row_no, text, {coded} as coded from repo_documents where text is not null)"""


@book.query
def repo_health(d):
    """Health, risk signals and risk of the repositories, issues taken from their documents."""
    health = S.repo_health(d, "r.stars", "r.forks", "r.license", "r.last_commit_at", "r.open_issues_count")
    risky = f"{S.issue_risks(d, 'text')} <> ''"
    signals = """concat_ws(',', case when coalesce(license, '') = '' then 'missing_license' end, case when coalesce(open_issues_count, 0) > 100 then 'high_open_issue_count' end,
        case when releases = 0 then 'no_recent_release_metadata' end, case when changelogs = 0 then 'missing_changelog' end, case when risky > 0 then 'recent_issue_risk' end)"""
    count = "length(signals) - length(replace(signals, ',', '')) + case when signals = '' then 0 else 1 end"
    return f"""
with docs as (
  select repo_id, count(case when lower(doc_type) = 'changelog' then 1 end) as changelogs, count(case when contains(lower(path), 'release') then 1 end) as releases,
         count(case when {risky} then 1 end) as risky from repo_documents where repo_id is not null group by repo_id),
r as (select r.row_no, r.license, r.open_issues_count, {health} as health, coalesce(changelogs, 0) as changelogs, coalesce(releases, 0) as releases, coalesce(risky, 0) as risky
      from repos r left join docs on docs.repo_id = r.id),
s as (select *, {signals} as signals from r)
select row_no, round(health, 6) as health, signals, round(least(1e0, greatest(0e0, 1e0 - health + least(0.25e0, 0.04e0 * ({count})) + least(0.2e0, 0.025e0 * risky))), 6) as risk from s"""


@book.query
def issue_risk_signals(d):
    return f"select row_no, {S.issue_risks(d, 'text')} as signals from repo_documents"


def quality_of_documents(d) -> str:
    """Kind, score and tier of the source of every repository document."""
    span = "(coalesce(text, '') <> '')"
    kind = S.source_type(d, name="'github'", method="'deterministic'", kind="case when lower(doc_type) = 'contributing' then 'Issue' else 'RepoDocument' end", section="doc_type", url="url", span=span)
    return f"""select row_no, kind as source_type, {S.source_score(d, 'kind', method="'deterministic'", span='span', claim="'limitation'")} as score
        from (select row_no, {kind} as kind, {span} as span from repo_documents)"""


@book.query
def source_quality(d):
    """Kind, score and evidence tier of the source of every repository document."""
    return f"select row_no, source_type, score, {S.tier('score')} as tier from ({quality_of_documents(d)})"


@book.query
def source_quality_of_papers(d):
    """The same for paper records: whole-text papers with an abstract, else metadata."""
    span = "(coalesce(abstract, '') <> '')"
    kind = S.source_type(d, name=T.source_of(d, "source_record_id"), method="'api'", kind="'Paper'", section=f"case when {span} then 'abstract' else 'metadata' end", url="source_url", span=span)
    return f"""select row_no, kind as source_type, {S.source_score(d, 'kind', method="'api'", span='span', claim="''")} as score from (select row_no, {kind} as kind, {span} as span from papers)"""


@book.query
def hash_embedding(d):
    """The hash embedding of every record's text: 64 numbers of unit length, per non-zero dimension."""
    digest = d.sha("token")
    return f"""
with t as (select id, {d.explode(f"case when {d.size(T.tokens(d, 'text'))} = 0 then {d.strings('<empty>')} else {T.tokens(d, 'text')} end")} as token from (select id, min(text) as text from embedding_records group by id)),
h as (select id, {d.hexint(f'substring({digest}, 1, 8)')} % 64 as dim,
      case when {d.hexint(f'substring({digest}, 9, 2)')} % 2 = 0 then 1e0 else -1e0 end * (1e0 + {d.hexint(f'substring({digest}, 11, 2)')} / 255e0) as part from t),
v as (select id, dim, sum(part) as x from h group by id, dim),
n as (select id, dim, x, sqrt(sum(x * x) over (partition by id)) as norm from v)
select id, dim, round(x / case when norm = 0 then 1e0 else norm end, 5) + 0e0 as value from n where abs(x) > 1e-9"""


@book.query
def word_positions(d):
    """Abstracts taken apart into word positions, as the inverted index delivers them, and put together again."""
    words = d.split(T.clean(d, "abstract"), " ")
    return f"""
with w as (select row_no, {d.at('ws', 'i')} as word, i from (select row_no, ws, {d.explode(d.range(d.size('ws')))} as i from (select row_no, {words} as ws from papers where abstract is not null))),
inverted as (select row_no, word, {d.collect('i')} as places from w group by row_no, word),
flat as (select row_no, word, {d.explode('places')} as place from inverted)
select row_no, {d.sha(d.join(d.map(d.collect(d.struct(p='place', w='word')), 'x', 'x.w'), ' '))} as text_hash, count(*) as words from flat group by row_no"""
