"""Extraction of methods, benchmarks, datasets and claims from text, and validation with quarantine."""

from __future__ import annotations

from ..functions import lexicon as L
from ..functions import text as T
from ..functions.dialect import Spark
from ..plans.base import Book

book = Book()
QUERIES, SQL = book.QUERIES, book.SQL


def slug_of(name: str) -> str:
    return "".join(c if c.isalnum() else "-" for c in name.lower())


def first_of(d: Spark, table: str, key: str, columns: tuple[str, ...], by: str = "row_no") -> str:
    """The first delivered row of every key (keep-first dedupe), by an aggregate, so a key of any size is combined map-side."""
    packed = d.struct(**{c: c for c in columns})
    return f"select {key}, {', '.join(f'r.{c} as {c}' for c in columns)} from (select {key}, {d.least_by(packed, by)} as r from {table} where {key} is not null group by {key})"


def sources(d: Spark) -> str:
    """CTEs of text sources: ``src(source_id, label, chunk_id, text, url, record_id)``, first deliveries with a text that isn't blank."""
    return f"""
p1 as ({first_of(d, 'papers', 'id', ('title', 'abstract', 'published_at', 'venue', 'source_url', 'source_record_id', 'loaded_at'))}),
r1 as ({first_of(d, 'repos', 'id', ('full_name', 'description', 'url', 'topics', 'source_record_id', 'stars', 'license'))}),
rd1 as ({first_of(d, 'repo_documents', 'id', ('repo_id', 'doc_type', 'text', 'url', 'source_record_id'))}),
src as (
  select id as source_id, 'Paper' as label, {T.clean(d, 'abstract')} as text, source_url as url, source_record_id as record_id from p1 where {T.clean(d, 'abstract')} <> ''
  union all
  select id, 'Repo', {T.clean(d, 'description')}, url, source_record_id from r1 where {T.clean(d, 'description')} <> ''
  union all
  select lower(trim(repo_id)), case when lower(doc_type) = 'issue' then 'Issue' when lower(doc_type) in ('release', 'release_notes', 'changelog') then 'Release' else 'RepoDocument' end, {T.clean(d, 'text')}, url, source_record_id from rd1 where {T.clean(d, 'text')} <> '' and repo_id is not null),
chunks as (select source_id, label, text, min(url) as url, min(record_id) as record_id, concat('chunk:', {T.hash_list(d, 'source_id', 'text')}) as chunk_id from src group by source_id, label, text)"""


def methods_in(d: Spark, text: str, methods=L.CORPUS_METHODS) -> str:
    """Ids of the methods that a text names: an alias as a substring, or all of an alias' tokens."""
    found = []
    for name, aliases, _ in methods:
        tests = []
        for a in dict.fromkeys((name.lower(), *aliases)):
            tests.append(f"contains(x_.low, {d.lit(a)})")
            words = [w for w in a.split() if len(w) > 1]
            if len(words) > 1:
                tests.append("(" + " and ".join(d.has("x_.toks", d.lit(w)) for w in words) + ")")
        found.append(f"case when {' or '.join(tests)} then 'method:{slug_of(name)}' end")
    body = d.keep(d.array(*found), "m_", "m_ is not null")
    # the lower-case text and its tokens are bound once per row
    once = d.array(d.struct(low=f"lower({text})", toks=T.token_set(d, text)))
    return d.at(d.map(once, "x_", body), 0)


@book.query
def method_extract(d):
    """Methods by pattern: the span is the first alias, in the order of aliases, that the text has."""
    found = []
    for name, aliases, category in L.CORPUS_METHODS:
        spans = " ".join(f"when instr(low, {d.lit(a)}) > 0 then substring(text, cast(instr(low, {d.lit(a)}) as int), {len(a)})" for a in aliases)
        found.append(d.struct(name=f"'{name}'", category=f"'{category}'", source_span=f"case {spans} end"))
    return f"""with {sources(d)}, x as (select chunk_id, {d.explode(d.array(*found))} as m from (select chunk_id, text, lower(text) as low from chunks))
        select chunk_id, m.name as name, m.category as category, m.source_span as source_span, 0.84e0 as confidence from x where m.source_span is not null"""


def _keyword(d, rows, columns) -> str:
    found = []
    for word, *values in rows:
        hit = d.at(d.keep("s", "y", f"contains(lower(y), {d.lit(word)})"), 0)
        found.append(d.struct(**{c: f"'{v}'" for c, v in zip(columns, values, strict=True)}, source_span=f"case when contains(low, {d.lit(word)}) then coalesce({hit}, '{word}') end"))
    return f"""with {sources(d)}, x as (select chunk_id, {d.explode(d.array(*found))} as m from (select chunk_id, lower(text) as low, {d.sentences('text')} as s from chunks))
        select chunk_id, {', '.join(f'm.{c} as {c}' for c in columns)}, m.source_span as source_span from x where m.source_span is not null"""


@book.query
def benchmark_extract(d):
    """Benchmarks by keyword, with the first sentence that has it."""
    return _keyword(d, L.BENCHMARKS, ("name", "task", "metric"))


@book.query
def dataset_extract(d):
    """Datasets by keyword, with the first sentence that has it."""
    return _keyword(d, L.DATASETS, ("name", "domain"))


def claims(d: Spark) -> str:
    """CTE ``claims``: up to three sentences with a claim word per chunk, else the first sentence; typed, with polarity and confidence."""
    low = "lower(text)"
    hits = d.keep("s", "x", T.any_word(d, "lower(x)", L.CLAIM_WORDS))
    return f"""
sent as (select source_id, label, chunk_id, url, record_id, {d.sentences('text')} as s, {T.first_sentence(d, 'text')} as head from chunks),
picked as (select *, case when {d.size(hits)} > 0 then {d.slice(hits, 3)} else {d.array('head')} end as c from sent),
flat as (select source_id, label, chunk_id, url, record_id, {d.explode('c')} as text from picked),
claims as (
  select source_id, label, chunk_id, min(url) as url, min(record_id) as record_id, text, concat('claim:', {T.hash_list(d, 'source_id', 'text')}) as claim_id,
    case when label = 'Issue' then 'repo_risk' when label = 'Release' then 'release_signal' when label in ('Model', 'Dataset') then 'asset_metadata' when label = 'RepoDocument' then 'documentation' when {T.any_word(d, low, ('benchmark', 'evaluation', 'faithfulness'))} then 'benchmark'
         when {T.any_word(d, low, ('limitation', 'risk', 'challenge'))} then 'limitation' when label = 'Repo' then 'adoption' else 'architecture' end as claim_type,
    case when {T.any_word(d, low, L.CAUTION_WORDS)} then 'caution' when {T.any_word(d, low, L.POSITIVE_WORDS)} then 'positive' else 'neutral' end as polarity,
    case label {' '.join(f"when '{k}' then {v}e0" for k, v in L.CLAIM_CONFIDENCE.items())} else 0.65e0 end as confidence
  from flat where text <> '' group by source_id, label, chunk_id, text)"""


@book.query
def claim_extract(d):
    return f"with {sources(d)}, {claims(d)} select claim_id, chunk_id, text as claim, claim_type, polarity, confidence from claims"


@book.query
def claim_polarity_counts(d):
    return f"with {sources(d)}, {claims(d)} select label, claim_type, polarity, count(*) as claims, round(avg(confidence), 6) as confidence from claims group by label, claim_type, polarity"


def candidates(d: Spark) -> str:
    """CTE ``offered``: rows as a provider might offer them, with faults by the number of the claim's hash."""
    n = d.hexint("substring(claim_id, 7, 4)") + " % 8"
    return f"""
offered as (select claim_id, chunk_text, case when n = 1 then '' else claim end as text, case when n = 2 then null else claim_type end as claim_type,
   case when n = 3 then '1.2' when n = 4 then 'high' else {d.cast_text('confidence')} end as confidence,
   case when n = 5 then concat(claim, ' as everyone knows') else claim end as source_span,
   case when n = 6 then concat(claim, '!!') else claim end as claimed
 from (select c.claim_id, k.text as chunk_text, c.text as claim, c.claim_type, c.confidence, {n.replace('claim_id', 'c.claim_id')} as n from claims c join chunks k on k.chunk_id = c.chunk_id))"""


def reason(d: Spark) -> str:
    """The first fault of an offered claim; null if it is valid."""
    span = T.clean(d, "source_span")
    value = "try_cast(confidence as double)"
    missing = "concat_ws(',', case when coalesce(text, '') = '' then 'text' end, case when coalesce(claim_type, '') = '' then 'claim_type' end)"
    return f"""case when {missing} <> '' then concat('schema:missing_', {missing}) when {span} = '' or not contains(chunk_text, {span}) then 'untraceable_source_span'
      when {value} is null then 'schema:confidence_not_number' when {value} < 0 or {value} > 1 then 'schema:confidence_out_of_range'
      when not contains(chunk_text, {T.clean(d, 'claimed')}) then 'untraceable_claim_text' end"""


@book.query
def quarantine_reasons(d):
    """Why offered claims are kept out."""
    return f"with {sources(d)}, {claims(d)}, {candidates(d)} select claim_id, {reason(d)} as reason from offered where {reason(d)} is not null"


@book.query
def valid_and_quarantined(d):
    """Both sides of the split, counted."""
    return f"""with {sources(d)}, {claims(d)}, {candidates(d)}, v as (select {reason(d)} as reason from offered)
        select case when reason is null then 'valid' else 'quarantine' end as side, count(*) as claims from v group by 1"""


@book.query
def text_derivatives(d):
    """One chunk per text of a source, with its method mentions and claims counted."""
    return f"""with {sources(d)}, {claims(d)}, n as (select chunk_id, count(*) as claims from claims group by chunk_id)
        select c.chunk_id, c.label, {d.chars('c.text')} as chars, {d.size(methods_in(d, 'c.text'))} as methods, coalesce(n.claims, 0) as claims from chunks c left join n on n.chunk_id = c.chunk_id"""


@book.query
def deduped_names(d):
    """Organisation names, the first delivered of each lower-case form."""
    return f"select lower(name) as folded, {d.least_by('name', 'row_no')} as name, count(*) as rows_merged from organizations where coalesce(name, '') <> '' group by lower(name)"
