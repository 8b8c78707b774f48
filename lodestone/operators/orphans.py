"""References to records that do not exist: distinct keys against the parents, joined back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of one key are spread over so many tasks when the faults are joined back.
SALT = 16


def normal_key(ref: Column) -> Column:
    """A reference as it is compared: white space trimmed, lower case; null if nothing is left."""
    key = F.lower(F.regexp_replace(ref, r"(?U)^\s+|\s+$", ""))
    return F.when(key != "", key)


def parent_states(parents: DataFrame, key: str, time: str, deleted: str, order: str = "row_no") -> DataFrame:
    """One row per parent key: ``key``, ``gone`` (its latest row is marked deleted), ``first_at``.

    Rows without a time count as the earliest; equal times are settled by ``order``. Parents whose key is null or blank
    are left out.
    """
    latest = F.struct(F.col(time).isNotNull().alias("has"), F.col(time).alias("at"), F.col(order).alias("no"), F.col(deleted).isNotNull().alias("gone"))
    return (
        parents.select(normal_key(F.col(key)).alias("_key"), F.col(time), F.col(order), F.col(deleted))
        .where("_key is not null")
        .groupBy("_key")
        .agg(F.max(latest)["gone"].alias("gone"), F.min(time).alias("first_at"))
    )


def orphan_rows(children: DataFrame, parents: DataFrame, *, ref: str, row: str, loaded: str, key: str, time: str, deleted: str) -> DataFrame:
    """Rows of ``children`` whose reference fails: ``row``, ``period`` (month of ``loaded``), ``reason``.

    Reasons, the first that holds: ``missing`` (no parent row), ``deleted`` (the latest parent row is marked so), ``late``
    (the first parent row is later than the child's own load). Null and blank references are no references. A child
    without a load time can't be late; its period is null. Other columns of either table are not touched, so their names
    may clash. Empty tables give an empty result, an empty parent table makes every reference missing.

    Plan: the child's keys are reduced to distinct ones before they meet the parents (map-side, so a hot key is one row),
    an anti-join gives the missing keys and an inner join the deleted and possibly late ones; only keys at fault are
    joined back, salted, as one key may hold a large share of the rows.
    """
    kids = children.select(F.col(row).alias("_row"), F.col(loaded).alias("_at"), normal_key(F.col(ref)).alias("_key")).where("_key is not null")
    keys = kids.groupBy("_key").agg(F.min("_at").alias("_first_use"))
    states = parent_states(parents, key, time, deleted)
    missing = keys.join(states, "_key", "left_anti").select("_key", F.lit("missing").alias("_why"), F.lit(None).cast("timestamp_ntz").alias("_since"))
    faulty = (
        keys.join(states, "_key")
        .where("gone or first_at > _first_use")
        .select("_key", F.when(F.col("gone"), "deleted").otherwise("late").alias("_why"), F.col("first_at").cast("timestamp_ntz").alias("_since"))
    )
    faults = missing.unionByName(faulty).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    salted = kids.withColumn("_salt", F.pmod(F.xxhash64("_row"), F.lit(SALT)).cast("int"))
    return (
        salted.join(faults, ["_key", "_salt"])
        .where("_why <> 'late' or _since > cast(_at as timestamp_ntz)")
        .select(F.col("_row").alias("row_no"), F.date_format("_at", "yyyy-MM").alias("period"), F.col("_why").alias("reason"))
    )


def orphan_counts(orphans: DataFrame, children: DataFrame, *, ref: str, loaded: str) -> DataFrame:
    """Per period: rows with a reference, orphans, and orphans by reason. Periods without orphans count 0."""
    total = (
        children.where(normal_key(F.col(ref)).isNotNull())
        .groupBy(F.date_format(F.col(loaded), "yyyy-MM").alias("period"))
        .agg(F.count("*").alias("refs"))
    )
    bad = orphans.groupBy("period").agg(
        F.count("*").alias("orphans"), *[F.count_if(F.col("reason") == r).alias(r) for r in ("missing", "deleted", "late")]
    )
    names = ("orphans", "missing", "deleted", "late")
    on = total["period"].eqNullSafe(bad["period"])
    return total.join(bad, on, "left").select(total["period"], "refs", *[F.coalesce(F.col(n), F.lit(0)).cast("long").alias(n) for n in names])


#: table, its reference, the parent table, the parent's time
REFERENCES = (
    ("papers", "source_record_id", "source_records", "fetched_at"),
    ("authors", "source_record_id", "source_records", "fetched_at"),
    ("repo_documents", "repo_id", "repos", "loaded_at"),
)


def _rows(spark, root, name, ref, parent, time):
    from ..session import table

    return orphan_rows(
        table(spark, root, name), table(spark, root, parent), ref=ref, row="row_no", loaded="loaded_at", key="id", time=time, deleted="deleted_at"
    )


def p6_found(spark, root: str) -> DataFrame:
    """Every row whose reference fails, over whole tables."""
    found = [_rows(spark, root, *r).select(F.lit(r[0]).alias("table_name"), "row_no") for r in REFERENCES]
    return found[0].unionByName(found[1]).unionByName(found[2])


def p6_report(spark, root: str) -> DataFrame:
    """Orphans per table and month of load, by reason."""
    from ..session import table

    out = None
    for name, ref, parent, time in REFERENCES:
        one = orphan_counts(_rows(spark, root, name, ref, parent, time), table(spark, root, name), ref=ref, loaded="loaded_at")
        one = one.select(F.lit(name).alias("table_name"), *one.columns)
        out = one if out is None else out.unionByName(one)
    return out


def _sql(name: str, ref: str, parent: str, time: str) -> str:
    return f"""
      select '{name}' as table_name, c.row_no, strftime(c.loaded_at, '%Y-%m') as period,
             case when p.k is null then 'missing' when p.gone then 'deleted' when p.first_at > c.loaded_at then 'late' end as reason
      from (select row_no, loaded_at, lower(regexp_replace({ref}, '^\\s+|\\s+$', '', 'g')) as k from {name}) c
      left join (select lower(trim(id)) as k, min({time}) as first_at,
                        arg_max(deleted_at is not null, row({time}, row_no)) as gone
                 from {parent} group by 1) p on p.k = c.k
      where c.k <> ''"""


_ALL = " union all ".join(_sql(*r) for r in REFERENCES)
SQL = {
    "p6_found": f"select table_name, row_no from ({_ALL}) where reason is not null",
    "p6_report": f"""select table_name, period, count(*) as refs, count(reason) as orphans, count(*) filter (reason = 'missing') as missing,
        count(*) filter (reason = 'deleted') as deleted, count(*) filter (reason = 'late') as late from ({_ALL}) group by 1, 2""",
}
QUERIES = {"p6_found": p6_found, "p6_report": p6_report}
