"""Bounded path expansion, path scores and typed lookups over the property graph of the relational tables.

Nodes: customers, orders, parts, suppliers, nations and regions; edges: PLACED (customer, order), CONTAINS (order, part),
SUPPLIED_BY (part, supplier), LOCATED_IN (customer or supplier, nation), PART_OF (nation, region). Expansion is three
unrolled joins; the eight first edges of a node are settled once, as they don't depend on the path.
"""

from __future__ import annotations

from ..functions import scores as S
from ..functions.dialect import Spark
from ..plans.base import Book

book = Book()
QUERIES, SQL = book.QUERIES, book.SQL

FAN, PATHS, HOPS = 8, 28, 3


def graph(d: Spark) -> str:
    """CTE ``e(type, s, t, confidence)``."""
    c = lambda prefix, x: d.cat(f"'{prefix}:'", d.cast_text(x))
    return f"""
e as (
  select 'LOCATED_IN' as type, {c('customer', 'c_custkey')} as s, {c('nation', 'c_nationkey')} as t, 0.9e0 as confidence from customer
  union all select 'LOCATED_IN', {c('supplier', 's_suppkey')}, {c('nation', 's_nationkey')}, 0.9e0 from supplier
  union all select 'PART_OF', {c('nation', 'n_nationkey')}, {c('region', 'n_regionkey')}, 1e0 from nation
  union all select 'PLACED', {c('customer', 'o_custkey')}, {c('order', 'o_orderkey')}, 0.8e0 from orders
  union all select distinct 'CONTAINS', {c('order', 'l_orderkey')}, {c('part', 'l_partkey')}, 0.7e0 from lineitem
  union all select distinct 'SUPPLIED_BY', {c('part', 'l_partkey')}, {c('supplier', 'l_suppkey')}, 0.6e0 from lineitem)"""


def expansion(d: Spark, anchors: str, hops: int = HOPS) -> str:
    """CTE ``paths(anchor, path, types, depth, place)``: simple undirected paths from every anchor in breadth-first order, ``PATHS`` at most.

    A node's edges are taken in the order of (type, start, end), the first ``FAN``, before nodes on the path are left out.
    """
    steps = []
    for k in range(hops):
        steps.append(
            f"x{k + 1} as (select x.anchor, {d.cat('x.path', d.array('b.dst'))} as path, {d.cat('x.types', d.array('b.label'))} as types, {d.cat('x.ranks', d.array('b.rk'))} as ranks"
            f" from x{k} x join b on b.src = {d.at('x.path', k)} where not {d.has('x.path', 'b.dst')})"
        )
    every = " union all ".join(f"select anchor, path, types, ranks, cast({k} as bigint) as depth from x{k}" for k in range(hops + 1))
    empty = "cast(array() as array<string>)" if d.name == "spark" else "cast([] as varchar[])"
    none = "cast(array() as array<bigint>)" if d.name == "spark" else "cast([] as bigint[])"
    if d.name == "duck":
        steps = [s.replace("(x.path || ", "list_concat(x.path, ").replace("(x.types || ", "list_concat(x.types, ").replace("(x.ranks || ", "list_concat(x.ranks, ") for s in steps]
    return f"""
twoway as (select s as src, t as dst, type as label, type, s, t from e union all select t, s, {d.cat("'<-'", 'type')}, type, s, t from e),
b as (select src, dst, label, cast(rk as bigint) as rk from (select src, dst, label, row_number() over (partition by src order by type, s, t) as rk from twoway) where rk <= {FAN}),
x0 as (select id as anchor, {d.array('id')} as path, {empty} as types, {none} as ranks from ({anchors})),
{', '.join(steps)},
paths as (select anchor, path, types, depth, cast(place as bigint) as place from (select *, row_number() over (partition by anchor order by depth, ranks) as place from ({every})) where place <= {PATHS})"""


def _stages(d: Spark, hops: int = HOPS) -> list[tuple[str, str]]:
    """Edges and paths as stages: each is derived once."""
    e = graph(d).strip()
    text = expansion(d, _anchors(d), hops).strip()
    first, rest = text.split("\npaths as (", 1)
    ways, fan = first.index("b as ("), first.index("x0 as (")
    return [
        ("e", e[e.index("(") + 1 : e.rindex(")")]),
        ("b", f"with {first[:ways].rstrip().rstrip(',')} " + first[ways:fan].strip().rstrip(",")[len("b as (") : -1]),
        ("paths", f"with {first[fan:].strip().rstrip(',')} " + rest[: rest.rindex(")")]),
    ]


def _anchors(d: Spark) -> str:
    return f"select distinct {d.cat(chr(39) + 'supplier:' + chr(39), d.cast_text('s_suppkey'))} as id from supplier"


def decorated(d: Spark, path: str = "path", types: str = "types") -> str:
    """A path as text, node and relationship in turn, backward ones with ``<-``."""
    part = f"case when i = 0 then {d.at(path, 0)} else {d.cat(d.at(types, 'i - 1'), chr(39) + '>' + chr(39), d.at(path, 'i'))} end"
    return d.join(d.map(d.range(d.size(path)), "i", part), ">")


@book.staged
def path_expand(d):
    """Every path of every supplier."""
    return _stages(d), f"select anchor, place, depth, {decorated(d)} as path from paths"


def _steps(d: Spark, broken: bool = False) -> str:
    """CTE ``st(anchor, place, kind, s, t)``: the hops of all paths as edges; one in ten broken on purpose if asked for."""
    to = d.at("path", "i + 1")
    to = f"case when (place + i) % 10 = 0 then 'part:0' else {to} end" if broken else to
    kind = d.replace("label", "^<-", "")
    return f"""hops as (select anchor, place, {d.explode(d.range('depth'))} as i, path, types from paths),
        steps as (select anchor, place, {d.at('path', 'i')} as a, {to} as b, {d.at('types', 'i')} as label from hops),
        st as (select anchor, place, {kind} as kind, case when label like '<-%' then b else a end as s, case when label like '<-%' then a else b end as t from steps)"""


@book.staged
def path_score(d):
    """Mean score of a path's hops with the penalty on length, its quality and confidence."""
    return _stages(d), f"""select p.anchor, p.place, round(case when p.depth = 0 then 0.15e0 else m.hop * {S.length_penalty('(p.depth + 1)')} end, 6) as path_score,
          {S.path_quality('(p.depth + 1)', 'false', 'true')} as path_quality, round(coalesce(m.confidence, 0.75e0), 6) as confidence
        from paths p left join (with {_steps(d)}, scored as (select st.anchor, st.place, {S.hop_score('st.kind', 'e.confidence', 'cast(null as double)')} as hop, e.confidence from st join e on e.type = st.kind and e.s = st.s and e.t = st.t)
          select anchor, place, avg(hop) as hop, avg(confidence) as confidence from scored group by anchor, place) m on m.anchor = p.anchor and m.place = p.place"""


@book.staged
def path_validity(d):
    """Share of hops of every anchor's paths that are edges, one hop in ten broken on purpose."""
    return _stages(d), f"""select p.anchor, count(*) as paths, count(*) - count(bad.place) as valid from paths p left join (with {_steps(d, True)}
          select distinct st.anchor, st.place from st left join e on e.type = st.kind and e.s = st.s and e.t = st.t where e.s is null) bad on bad.anchor = p.anchor and bad.place = p.place where p.depth > 0 group by p.anchor"""


@book.query
def structured_lookup(d):
    """Suppliers of parts contained in orders of a year or later: typed edges with the floor on lexical and path scores, best ten per nation."""
    score = S.combined(lexical="0.82e0", path_quality=S.path_quality("2", "false", "true"), source_quality="0.5e0", freshness="f", confidence="0.75e0", evidence="0.47e0", path_score=f"greatest(0.84e0, {S.hop_score(chr(39) + 'IMPLEMENTS' + chr(39), 'cast(null as double)', 'cast(null as double)')})")
    return f"""with y as (select l_suppkey, l_partkey, max(o_orderdate) as last from lineitem join orders on o_orderkey = l_orderkey where year(o_orderdate) >= 1998 group by l_suppkey, l_partkey),
        s as (select s_nationkey, l_suppkey, l_partkey, {S.freshness(d, d.cast_text('last'), 2001)} as f from y join supplier on s_suppkey = l_suppkey),
        r as (select s_nationkey, l_suppkey, l_partkey, round({score}, 6) as score from s),
        w as (select *, row_number() over (partition by s_nationkey order by score desc, l_suppkey, l_partkey) as rk from r)
        select s_nationkey, l_suppkey, l_partkey, score, cast(rk as bigint) as rk from w where rk <= 10"""


@book.query
def organization_reach(d):
    """Orders whose customer's nation lies, within three hops, in a region whose name contains AS."""
    return """select o.o_orderkey from orders o left semi join (select c_custkey from customer join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey
        where contains(lower(r_name), 'as')) k on k.c_custkey = o.o_custkey""".replace("left semi join", "semi join" if d.name == "duck" else "left semi join")


@book.query
def edge_between(d):
    """The edge between two nodes: the first outgoing one, else the first incoming."""
    return f"""with {graph(d)}, pairs as (select s as a, t as b from e where type = 'SUPPLIED_BY' union all select t, s from e where type = 'LOCATED_IN'),
        o as (select p.a, p.b, 0 as dir, e.type from pairs p join e on e.s = p.a and e.t = p.b union all select p.a, p.b, 1, e.type from pairs p join e on e.t = p.a and e.s = p.b)
        select a, b, {d.least_by('type', d.order('dir', 'type'))} as type, min(dir) = 1 as backward from o group by a, b"""


@book.staged
def component_paths(d):
    """Paths carried on to the region (community) of any node on them."""
    return _stages(d, 2), f"""select distinct n.anchor, n.place, e.t as community from (select anchor, place, {d.explode('path')} as node from paths) n join e on e.type = 'PART_OF' and e.s = n.node"""
