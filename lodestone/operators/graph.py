"""The evidence graph: nodes, typed edges and their statistics.

Edge types whose definition pairs every member of one set with every member of another set under a key (authors of a
source record, papers and repositories of a method, opposed claims of a method) are kept factored: the key with both
counts, and memberships. Their pairs are the product and are never listed, as a key may hold a third of all rows.
"""

from __future__ import annotations

from ..functions import lexicon as L
from ..functions import text as T
from ..functions.dialect import SPARK, Spark
from ..plans.base import Book, sql
from ..session import written
from .extraction import claims, first_of, methods_in, slug_of, sources

book = Book()
QUERIES, SQL = book.QUERIES, book.SQL


def _community(d: Spark, method: str) -> str:
    return "case " + method + " " + " ".join(f"when 'method:{slug_of(n)}' then 'community:{slug_of(c)}'" for n, _, c in L.CORPUS_METHODS) + " end"


def named(d: Spark) -> str:
    """CTEs on top of ``sources``: papers and repositories with the methods they name, one row each."""
    return f"""
paper_methods as (select id as source_id, source_record_id, {d.explode(methods_in(d, "concat(coalesce(title, ''), ' ', coalesce(abstract, ''))"))} as method_id from p1),
repo_methods as (select id as source_id, source_record_id, {d.explode(methods_in(d, f"concat(coalesce(full_name, ''), ' ', coalesce(description, ''), ' ', coalesce({d.join('topics', ' ')}, ''))"))} as method_id from r1),
claim_methods as (select claim_id, source_id, polarity, confidence, {d.explode(methods_in(d, 'text'))} as method_id from claims)"""


def edges(d: Spark) -> str:
    """CTE ``edges(start_id, type, end_id, confidence)``: all edge types that grow with the rows, one per (start, type, end)."""
    words = [(w, f"benchmark:{slug_of(n)}") for w, n, *_ in L.BENCHMARKS] + [(w, f"dataset:{slug_of(n)}") for w, n, *_ in L.DATASETS]
    evaluates = d.keep(d.array(*[f"case when contains(lower(text), {d.lit(w)}) then '{i}' end" for w, i in words]), "x", "x is not null")
    return f"""{sources(d)}, {claims(d)}, {named(d)},
source_methods as (select source_id, method_id from paper_methods union select source_id, method_id from repo_methods),
drawn as (
  select source_id as start_id, 'HAS_CHUNK' as type, chunk_id as end_id, 1e0 as confidence from chunks
  union all select source_id, 'CLAIMS', claim_id, confidence from claims
  union all select claim_id, 'SUPPORTED_BY', chunk_id, confidence from claims
  union all select source_id, 'INTRODUCES', method_id, 0.84e0 from paper_methods
  union all select source_id, 'USES_METHOD', method_id, 0.84e0 from repo_methods
  union all select source_id, 'IMPLEMENTS', method_id, 0.72e0 from repo_methods
  union all select c.chunk_id, 'MENTIONS', m.method_id, 0.82e0 from chunks c join source_methods m on m.source_id = c.source_id
  union all select source_id, 'EVALUATES_ON', {d.explode(evaluates)}, 0.76e0 from chunks
  union all select source_id, 'BELONGS_TO_COMMUNITY', {_community(d, 'method_id')}, 0.74e0 from source_methods
  union all select claim_id, 'BELONGS_TO_COMMUNITY', {_community(d, 'method_id')}, 0.74e0 from claim_methods),
edges as (select start_id, type, end_id, max(confidence) as confidence from drawn group by start_id, type, end_id)"""


def nodes(d: Spark) -> str:
    """CTE ``nodes(id, label)`` on top of ``edges``."""
    fixed = " union all ".join(
        [f"select 'method:{slug_of(n)}', 'Method'" for n, *_ in L.CORPUS_METHODS]
        + [f"select 'community:{slug_of(c)}', 'Community'" for c in dict.fromkeys(c for *_, c in L.CORPUS_METHODS)]
        + [f"select 'benchmark:{slug_of(n)}', 'Benchmark'" for _, n, *_ in L.BENCHMARKS]
        + [f"select 'dataset:{slug_of(n)}', 'Dataset'" for _, n, *_ in L.DATASETS]
    )
    return f"""
nodes as (select id, 'Paper' as label from p1 union all select id, 'Repo' from r1 union all select distinct id, 'Author' from authors where id is not null
  union all select distinct id, 'Organization' from organizations where id is not null
  union all select distinct chunk_id, 'DocumentChunk' from chunks union all select distinct claim_id, 'Claim' from claims union all {fixed})"""


def whole(d: Spark) -> str:
    """CTEs ``edges`` and ``nodes``."""
    return f"{edges(d)}, {nodes(d)}"


on_graph = lambda b: b.over(whole, "edges", "nodes")


def _edge_query(kind: str):
    def make(d):
        return f"select start_id, end_id, confidence from edges where type = '{kind}'"

    make.__name__ = f"edges_{kind.lower()}"
    make.__doc__ = f"Edges of type {kind}."
    on_graph(book)(make)


for _kind in ("HAS_CHUNK", "CLAIMS", "SUPPORTED_BY", "INTRODUCES", "USES_METHOD", "IMPLEMENTS", "MENTIONS", "EVALUATES_ON", "BELONGS_TO_COMMUNITY"):
    _edge_query(_kind)


@on_graph(book)
def graph_stats(d):
    """Nodes by label and edges by type, with totals, in one pass each."""
    return """select 'node' as kind, coalesce(label, 'all') as name, count(*) as n from nodes group by grouping sets ((label), ())
        union all select 'relationship', coalesce(type, 'all'), count(*) from edges group by grouping sets ((type), ())"""


@on_graph(book)
def referential_filter(d):
    """Edges whose two ends exist, by type, beside all."""
    return f"""with ids as (select distinct id from nodes),
        kept as (select e.type from edges e left semi join ids a on a.id = e.start_id left semi join ids b on b.id = e.end_id),
        k as (select type, count(*) as kept from kept group by type), a as (select type, count(*) as edges from edges group by type)
        select a.type, a.edges, coalesce(k.kept, 0) as kept from a left join k on k.type = a.type""".replace("left semi join", "semi join" if d.name == "duck" else "left semi join")


@on_graph(book)
def unique_nodes(d):
    """The uniqueness constraint as a query: ids held by several nodes."""
    return f"select id, count(*) as n from nodes group by id having count(*) > 1"


@book.query
def edges_authored_by(d):
    """Papers and authors of a source record, factored: per paper its number of authors and the first of them."""
    return f"""with {sources(d)}, a1 as ({first_of(d, 'authors', 'id', ('source_record_id',))}),
        a as (select source_record_id, count(*) as authors, min(id) as first_author from a1 where coalesce(source_record_id, '') <> '' group by source_record_id)
        select p.id as paper_id, a.authors, a.first_author from p1 p join a on a.source_record_id = p.source_record_id"""


@book.query
def authored_by_groups(d):
    """The factored relation itself: papers, authors and their product per source record."""
    return f"""with {sources(d)}, a1 as ({first_of(d, 'authors', 'id', ('source_record_id',))}),
        p as (select source_record_id, count(*) as papers from p1 where coalesce(source_record_id, '') <> '' group by source_record_id),
        a as (select source_record_id, count(*) as authors from a1 where coalesce(source_record_id, '') <> '' group by source_record_id)
        select p.source_record_id, papers, authors, papers * authors as pairs from p join a on a.source_record_id = p.source_record_id"""


@book.query
def edges_affiliated_with(d):
    """Authors whose affiliation contains the name of an organisation of the same source record (names of any length, at word breaks).

    Candidates meet in the record and the name's rarest word; the whole name is then looked for.
    """
    words = lambda x: d.distinct(d.split(x, " "))
    pad = lambda x: d.cat("' '", x, "' '")
    plain = lambda x: T.clean(d, d.replace(f"lower({T.txt(x)})", "[,;()]+", " "))
    return f"""with a1 as ({first_of(d, 'authors', 'id', ('affiliation_text', 'source_record_id'))}), o1 as ({first_of(d, 'organizations', 'id', ('name', 'source_record_id'))}),
        o as (select id, lower(trim(source_record_id)) as rec, {plain('name')} as name from o1 where {plain('name')} <> '' and coalesce(trim(source_record_id), '') <> ''),
        a as (select lower(trim(source_record_id)) as rec, {plain('affiliation_text')} as aff, id from a1 where {plain('affiliation_text')} <> '' and coalesce(trim(source_record_id), '') <> ''),
        ow as (select id, rec, name, {d.explode(words('name'))} as w from o), n as (select w, count(*) as n from ow group by w),
        key as (select ow.id, ow.rec, ow.name, {d.least_by('ow.w', d.order('n.n', 'ow.w'))} as w from ow join n on n.w = ow.w group by ow.id, ow.rec, ow.name),
        texts as (select distinct rec, aff from a), aw as (select rec, aff, {d.explode(words('aff'))} as w from texts),
        hit as (select distinct aw.rec, aw.aff, key.id as org from aw join key on key.rec = aw.rec and key.w = aw.w where contains({pad('aw.aff')}, {pad('key.name')}))
        select a.id as start_id, hit.org as end_id, 0.7e0 as confidence from a join hit on hit.rec = a.rec and hit.aff = a.aff"""


@book.query
def edges_implements_shared(d):
    """Repositories and papers that share a method, factored by the set of methods: classes of papers per class of repositories."""
    def sets(name, t):
        return f"{name} as (select ms, count(*) as n, min(source_id) as first from (select source_id, {d.join(d.collect_set('method_id'), ',')} as ms from {t} group by source_id) group by ms)"

    return f"""with {sources(d)}, {claims(d)}, {named(d)}, {sets('pc', 'paper_methods')}, {sets('rc', 'repo_methods')},
        px as (select ms, n, {d.explode(d.split('ms', ','))} as m from pc), rx as (select ms, n, {d.explode(d.split('ms', ','))} as m from rc),
        links as (select distinct r.ms as repo_class, r.n as repos, p.ms as paper_class, p.n as papers from rx r join px p on p.m = r.m)
        select repo_class, repos, cast(sum(papers) as bigint) as papers, cast(repos * sum(papers) as bigint) as pairs from links group by repo_class, repos"""


@book.query
def edges_cites(d):
    """Papers with an abstract or date cite those of their record with neither abstract but a Semantic Scholar id: factored per record."""
    return f"""with p1 as ({first_of(d, 'papers', 'id', ('abstract', 'published_at', 'semantic_scholar_id', 'source_record_id'))})
        select source_record_id, count(case when coalesce(abstract, '') <> '' or coalesce(published_at, '') <> '' then 1 end) as citing,
          count(case when coalesce(abstract, '') = '' and coalesce(semantic_scholar_id, '') <> '' then 1 end) as cited
        from p1 where coalesce(source_record_id, '') <> '' group by source_record_id
        having count(case when coalesce(abstract, '') = '' and coalesce(semantic_scholar_id, '') <> '' then 1 end) > 0"""


@book.query
def edges_similar_repos(d):
    """Repositories that share a topic, factored by topic set: per repository the number of others."""
    return f"""with r1 as ({first_of(d, 'repos', 'id', ('topics',))}),
        r as (select id, {d.join(d.sort(d.distinct('topics')), ',')} as ts from r1 where topics is not null and {d.size('topics')} > 0),
        c as (select ts, count(*) as n from r group by ts), x as (select ts, n, {d.explode(d.split('ts', ','))} as t from c),
        l as (select distinct a.ts, b.ts as other, b.n from x a join x b on b.t = a.t), s as (select ts, cast(sum(n) - 1 as bigint) as similar from l group by ts)
        select r.id, s.similar from r join s on s.ts = r.ts where s.similar > 0"""


#: Topic sets of up to so many topics are counted through their subsets (1,023 at most), larger ones pair by pair.
SUBSETS = 10


def _similar_repos(spark, root: str):
    """``edges_similar_repos`` without pairs of topic sets: the repositories that share a topic with a set are counted by inclusion and exclusion over its subsets.

    A subset's count is the number of repositories that have all its topics. Sets of more than ``SUBSETS`` topics meet every set they share a topic with.
    """
    d = SPARK
    pick = "transform(sequence(1, shiftleft(1, size(s)) - 1), i -> filter(s, (y, j) -> (i & shiftleft(1, j)) <> 0))"
    written(sql(spark, root, f"""with r1 as ({first_of(d, 'repos', 'id', ('topics',))})
      select id, ts, array_sort(array_distinct({d.split('ts', ',')})) as s from (select id, {d.join(d.sort(d.distinct('topics')), ',')} as ts from r1 where topics is not null and {d.size('topics')} > 0)"""), "topic-sets").createOrReplaceTempView("topic_sets_")  # fmt: skip
    return spark.sql(f"""with c as (select ts, first(s) as s, count(*) as n from topic_sets_ group by ts),
      u as (select ts, n, explode({pick}) as u from c where size(s) <= {SUBSETS}), h as (select u, sum(n) as n from u group by u),
      x as (select ts, n, size(s) > {SUBSETS} as big, explode(s) as t from c),
      l as (select distinct a.ts, b.ts as other, b.n from x a join x b on b.t = a.t and b.big union select distinct a.ts, b.ts, b.n from x a join x b on b.t = a.t and a.big),
      g as (select u.ts, case when size(u.u) % 2 = 1 then h.n else -h.n end as n from u join h on h.u = u.u union all select ts, n from l),
      s as (select ts, cast(sum(n) - 1 as bigint) as similar from g group by ts)
      select r.id, s.similar from topic_sets_ r join s on s.ts = r.ts where s.similar > 0""")  # fmt: skip


QUERIES["edges_similar_repos"] = _similar_repos


@book.query
def edges_similar_methods(d):
    """Methods of one category or with a common description token (a lexicon is small: ordered pairs)."""
    rows = " union all ".join(f"select {i} as pos, 'method:{slug_of(n)}' as id, '{slug_of(c)}' as category, {d.strings(*sorted({w for a in (n.lower(), *al) for w in a.split() if len(w) > 1}))} as ts" for i, (n, al, c) in enumerate(L.CORPUS_METHODS))
    return f"with m as ({rows}) select a.id as start_id, b.id as end_id from m a join m b on a.pos < b.pos where a.category = b.category or {d.overlap('a.ts', 'b.ts')}"


@book.query
def edges_contradicts(d):
    """Positive and cautionary claims that share a token, factored by token: claims of both sides, and the first of each. Two claims contradict if any token has both."""
    return f"""with {sources(d)}, {claims(d)}, t as (select distinct claim_id, polarity, {d.explode(T.token_set(d, 'text'))} as token from claims where polarity in ('positive', 'caution'))
        select token, count(case when polarity = 'positive' then 1 end) as positive, count(case when polarity = 'caution' then 1 end) as caution,
          min(case when polarity = 'positive' then claim_id end) as first_positive, min(case when polarity = 'caution' then claim_id end) as first_caution
        from t group by token having count(distinct polarity) = 2"""


@book.query
def node_text(d):
    """The text of a record's node: its non-empty fields in fixed order, for papers, repositories, organisations and repository documents."""
    fields = {"papers": ("title", "abstract"), "repos": ("name", "full_name", "description", d.join("topics", " ")), "organizations": ("name",), "repo_documents": ("title", "text")}
    one = lambda t, cols: f"select '{t}' as table_name, row_no, concat_ws(' ', {', '.join(f'nullif({c}, {chr(39) * 2})' for c in cols)}) as text from {t}"
    return f"select table_name, row_no, {d.sha('text')} as text_hash, {d.chars('text')} as chars, {d.size(T.token_set(d, 'text'))} as tokens from ({' union all '.join(one(t, c) for t, c in fields.items())})"


@on_graph(book)
def load_batches(d):
    """The load plan: rows per label or type, in batches of 500."""
    return f"""with k as (select 'node' as kind, label as name, count(*) as n from nodes group by label union all select 'relationship', type, count(*) from edges group by type)
        select kind, name, n, cast(ceil(n / 500e0) as bigint) as batches, n - (cast(ceil(n / 500e0) as bigint) - 1) * 500 as last_batch from k"""


@on_graph(book)
def cypher_export(d):
    """The export: one MERGE line per node, then one per edge."""
    q = "chr(34)"
    text = lambda x: d.cat(q, f"replace(replace({x}, chr(92), {d.cat('chr(92)', 'chr(92)')}), {q}, {d.cat('chr(92)', q)})", q)
    return f"""select 0 as part, {d.cat("'MERGE (n:'", T.cypher_name(d, 'label'), "' {id: '", text('id'), "'});'")} as line from nodes
        union all select 1, {d.cat("'MATCH (a {id: '", text('start_id'), "'}), (b {id: '", text('end_id'), "'}) MERGE (a)-[:'", T.cypher_name(d, 'type'), "']->(b);'")} from edges"""


@on_graph(book)
def corpus_counts(d):
    """Rows and distinct ids of every record table and of what is derived from them."""
    one = [f"select '{t}' as table_name, count(*) as n, count(distinct id) as ids from {t}" for t in ("papers", "authors", "organizations", "repos", "repo_documents", "source_records", "embedding_records")]
    graph = [f"select '{x}', count(*), count(distinct id) from nodes where label = '{x}'" for x in ("DocumentChunk", "Claim", "Method", "Benchmark", "Dataset", "Community")]
    return " union all ".join([*one, *graph, "select 'edges', count(*), count(distinct concat(start_id, type, end_id)) from edges"])


@book.query
def keep_first_merge(d):
    """The merge of two corpora (deliveries before and after June 2025) that keeps the first of every id, and how many rows each side gives."""
    at = "timestamp '2025-06-01 00:00:00'"
    both = f"select id, title, row_no, case when loaded_at < {at} then 0 else 1 end as side from papers where id is not null and loaded_at is not null"
    return f"""with u as ({both}), k as (select id, {d.least_by(d.struct(title='title', side='side'), d.order('side', 'row_no'))} as r, count(*) as n from u group by id)
        select r.side as side, count(*) as ids, cast(sum(n) as bigint) as merged_rows from k group by r.side"""


@book.query
def size_controls(d):
    """The first rows of every table in delivery order, as many as a starter corpus holds (the limit is the operator)."""
    caps = {"papers": 250, "repos": 100, "organizations": 40, "authors": 50, "repo_documents": 800}
    return " union all ".join(f"select * from (select '{t}' as table_name, row_no from {t} order by row_no limit {n})" for t, n in caps.items())


@book.query
def federated_limit(d):
    """The first results of every source, as many as its share of a total of 40 (the limit is the operator)."""
    return """with s as (select lower(source_name) as source_name, row_no, row_number() over (partition by lower(source_name) order by row_no) as rn,
          (select greatest(1, cast(floor(40 / count(distinct lower(source_name))) as int)) from source_records) as k from source_records)
        select source_name, row_no from (select * from s where rn <= 40) where rn <= k"""
