"""Entity resolution: the ladder of exact, probable and possible matches.

Exact and probable matches are equalities, so they are given as classes: every record with its canonical id and the size
of its class, never as all pairs. Possible duplicates pair the classes of equal names, not their members.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame

from ..functions import text as T
from ..functions.dialect import SPARK, Spark
from ..plans.base import Book, sql
from ..session import partitions, written
from . import likeness
from .extraction import first_of

if TYPE_CHECKING:
    import pyarrow as pa

book = Book()
QUERIES, SQL = book.QUERIES, book.SQL
#: Thresholds of the ladder.
SAME_NAME, FUZZY, POSSIBLE_RATIO, POSSIBLE_OVERLAP = 0.92, 0.9, 0.76, 0.72


def _papers(d: Spark) -> str:
    return first_of(d, "papers", "id", ("title", "doi", "arxiv_id", "openalex_id", "semantic_scholar_id", "source_url", "published_at", "venue"))


@book.query
def er_exact(d):
    """Papers that share a stable identifier or canonical URL: per signal the canonical id and the class size, classes of two or more."""
    ids = " union all ".join(f"select id, '{k}' as signal, {T.identifier(d, k)} as value, 1e0 as score from p" for k in ("doi", "arxiv_id", "openalex_id", "semantic_scholar_id"))
    return f"""with p as ({_papers(d)}), v as ({ids} union all select id, 'canonical_url', {T.canonical_url(d, 'source_url')}, 0.98e0 from p),
        c as (select signal, value, score, min(id) as canonical_id, count(*) as n from v where value <> '' group by signal, value, score having count(*) > 1)
        select v.id, v.signal, c.canonical_id, c.n as class_size, c.score from v join c on c.signal = v.signal and c.value = v.value"""


@book.query
def er_probable(d):
    """Records of equal normal name: organisations and papers, with canonical id and class size."""
    return f"""with o as ({first_of(d, 'organizations', 'id', ('name',))}), p as ({_papers(d)}),
        v as (select id, 'Organization' as label, {T.plain_name(d, 'name')} as name from o union all select id, 'Paper', {T.plain_name(d, 'title')} from p),
        c as (select label, name, min(id) as canonical_id, count(*) as n from v where name <> '' group by label, name having count(*) > 1)
        select v.id, v.label, c.canonical_id, c.n as class_size, {SAME_NAME}e0 as score from v join c on c.label = v.label and c.name = v.name"""


@book.query
def er_weak_signals(d):
    """Papers of equal name that also share the year or the venue, by class."""
    return f"""with p as ({_papers(d)}), v as (select {T.plain_name(d, 'title')} as name, {d.cast_text(T.yearish(d, 'published_at'))} as year, {T.plain_name(d, 'venue')} as venue from p)
        select name, count(*) as n, count(distinct year) as years, count(distinct nullif(venue, '')) as venues from v where name <> '' group by name having count(*) > 1"""


#: Names of a block, at most and (where cores would be idle otherwise) at least; every block is compared with every other in a group of its own.
BLOCK, SMALL = 1500, 200


def possible_pairs(names: DataFrame) -> DataFrame:
    """Pairs of different names that are possible duplicates: ``a`` < ``b``, ``ratio``, ``overlap``.

    Every name is compared with every other, block by block, by bounds that leave out no pair (``likeness``). The ratio is
    Ratcliff and Obershelp's; the overlap, of white-space separated words, is relative to the name of more words.
    """
    from pyspark.sql import functions as F

    names = written(names.select("name").where("name is not null").distinct(), "names")
    n = names.count()
    blocks = max(1, -(-n // BLOCK), min(n // SMALL, math.ceil(math.sqrt(8 * partitions(names.sparkSession)))))
    own, other = F.col("block"), F.col("other")
    rows = names.withColumn("block", F.pmod(F.xxhash64("name"), F.lit(blocks))).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    # both blocks of a group, and whether a name is of the first
    rows = rows.select((F.least(own, other) * blocks + F.greatest(own, other)).alias("grp"), (own <= other).alias("first"), (own == other).alias("alone"), "name")
    groups = blocks * (blocks + 1) // 2
    return rows.repartition(min(groups, 1000), "grp").sortWithinPartitions("grp").mapInArrow(_compared, "a string, b string, ratio double, overlap double")


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by group -> the group's pairs, some ten thousand at a time."""
    import pyarrow as pa

    group, alone, held = None, False, ([], [])

    def found() -> Iterator[pa.RecordBatch]:
        if held[0] and (alone or held[1]):
            for names, x, y, ratio, overlap in likeness.pairs(held[0], None if alone else held[1], POSSIBLE_RATIO, POSSIBLE_OVERLAP):
                text = pa.array(names, pa.string())
                yield pa.RecordBatch.from_arrays([text.take(pa.array(x)), text.take(pa.array(y)), pa.array(ratio, pa.float64()), pa.array(overlap, pa.float64())], ["a", "b", "ratio", "overlap"])

    for batch in batches:
        for grp, first, lone, name in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if grp != group:
                yield from found()
                group, alone, held = grp, lone, ([], [])
            held[0 if first else 1].append(name)
    yield from found()


@book.frame
def er_possible_duplicates(spark, root):
    """Classes of organisation names that are possible duplicates, with the state of the ladder."""
    from pyspark.sql import functions as F

    d = SPARK
    names = sql(spark, root, f"select distinct {T.plain_name(d, 'name')} as name from organizations where {T.plain_name(d, 'name')} <> ''")
    got = possible_pairs(names)
    return got.withColumn("score", F.greatest("ratio", "overlap")).withColumn("state", F.lit("possible_duplicate"))
