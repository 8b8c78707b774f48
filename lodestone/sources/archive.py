"""The raw archive: content hashes, append-only partitions, manifest, quality gate and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.base import Book
from ..session import written

book = Book()
QUERIES, SQL = book.QUERIES, book.SQL

#: Days after which a source is stale.
STALE_AFTER = {"arxiv": 7, "openalex": 14, "semantic_scholar": 14, "github": 3, "huggingface": 7, "sample": 3650}
MANIFEST = "source_name string, source_url string, source_id string, day date, content_hash string, cache_status string, quality_gate_status string, quality_gate_reasons array<string>"


def gate(name: Column, url: Column, source_id: Column, terms: Column, payload: Column, key: Column) -> Column:
    """The reasons for which a payload is kept out, in order; empty if it passes. ``key`` is the payload's own id for its source."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    rules = [
        (blank(url), "missing_source_url"), (blank(source_id), "missing_stable_source_id"), (blank(terms), "missing_terms_note"),
        (blank(payload) | F.trim(payload).isin("{}", "[]", "null"), "empty_payload"), ((name == "github") & blank(key), "missing_github_full_name"),
        ((name == "huggingface") & blank(key), "missing_huggingface_asset_id"), ((name == "semantic_scholar") & blank(key), "missing_semantic_scholar_paper_id"),
    ]
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(r)) for c, r in rules]))


def store(raw: DataFrame, root: str) -> DataFrame:
    """Append payloads to ``root``/raw by source and day, and one manifest row per call; gives the manifest rows.

    ``raw``: source_name, source_url, source_id, terms, payload (text), key, fetched_at. A payload that the archive already
    holds is a hit; it is appended to the manifest again but not to the archive. Null payloads are quarantined.
    """
    named = raw.select(
        "source_name", "source_url", "source_id", F.to_date("fetched_at").alias("day"), F.sha2(F.coalesce("payload", F.lit("")), 256).alias("content_hash"), "payload",
        gate(F.col("source_name"), F.col("source_url"), F.col("source_id"), F.col("terms"), F.col("payload"), F.col("key")).alias("quality_gate_reasons"),
    )
    known = read_hashes(raw.sparkSession, root)
    marked = named.join(known.withColumn("held", F.lit(True)), "content_hash", "left").withColumn("cache_status", F.when(F.col("held"), "hit").otherwise("miss"))
    marked = marked.withColumn("quality_gate_status", F.when(F.size("quality_gate_reasons") > 0, "quarantine").otherwise("pass")).drop("held")
    marked = written(marked, "stored")  # settled before the archive grows
    marked.where("cache_status = 'miss'").dropDuplicates(["content_hash"]).select("source_name", "day", "content_hash", "payload").write.mode("append").partitionBy("source_name", "day").parquet(f"{root}/raw")
    rows = marked.select("source_name", "source_url", "source_id", "day", "content_hash", "cache_status", "quality_gate_status", "quality_gate_reasons")
    rows.write.mode("append").parquet(f"{root}/manifest")
    return rows


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_hashes(spark: SparkSession, root: str) -> DataFrame:
    if not _exists(spark, f"{root}/raw"):
        return spark.createDataFrame([], "content_hash string")
    return spark.read.parquet(f"{root}/raw").select("content_hash").distinct()


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """All manifest rows, duplicates kept; empty if nothing was stored."""
    return spark.read.schema(MANIFEST).parquet(f"{root}/manifest") if _exists(spark, f"{root}/manifest") else spark.createDataFrame([], MANIFEST)


def payload(spark: SparkSession, root: str, source: str, content_hash: str) -> DataFrame:
    """A payload by source and hash: only the source's partitions are read."""
    return spark.read.parquet(f"{root}/raw").where((F.col("source_name") == source) & (F.col("content_hash") == content_hash)).select("payload")


@book.query
def quality_gate(d):
    """The gate over source records, with the reasons in order."""
    rules = (
        ("coalesce(trim(source_url), '') = ''", "missing_source_url"), ("coalesce(trim(source_id), '') = ''", "missing_stable_source_id"),
        ("coalesce(trim(license_or_terms_note), '') = ''", "missing_terms_note"), ("coalesce(trim(raw_payload_path), '') = ''", "empty_payload"),
    )
    why = "concat_ws(',', " + ", ".join(f"case when {c} then '{r}' end" for c, r in rules) + ")"
    return f"select row_no, case when {why} = '' then 'pass' else 'quarantine' end as status, {why} as reasons from source_records"


@book.query
def gate_counts(d):
    """What the gate lets through, by source."""
    return """select lower(source_name) as source_name, count(*) as n, count(case when coalesce(trim(source_url), '') <> '' and coalesce(trim(source_id), '') <> '' and coalesce(trim(license_or_terms_note), '') <> '' then 1 end) as passed
        from source_records group by 1"""


@book.query
def archive_hashes(d):
    """Content hashes of repository documents, with hits: a text delivered before."""
    return f"""with h as (select row_no, {T.stable_hash(d, 'text')} as content_hash from repo_documents where text is not null), f as (select content_hash, min(row_no) as first_row, count(*) as n from h group by content_hash)
        select h.row_no, h.content_hash, case when h.row_no = f.first_row then 'miss' else 'hit' end as cache_status, f.n as deliveries from h join f on f.content_hash = h.content_hash"""


@book.query
def manifest_scan(d):
    """Manifest rows per source and month of fetching, with distinct hashes."""
    return f"select lower(source_name) as source_name, {d.month('fetched_at')} as month, count(*) as rows_kept, count(distinct response_hash) as payloads from source_records group by 1, 2"


@book.query
def policy_lookup(d):
    """Every record's policy of staleness, the default for unknown sources."""
    values = " union all ".join(f"select '{k}' as name, {v} as days" for k, v in STALE_AFTER.items())
    return f"with p as ({values}) select s.row_no, coalesce(p.days, 30) as days, coalesce(s.stale_after_days, p.days, 30) as effective_days from source_records s left join p on p.name = lower(s.source_name)"


@book.query
def latest_versions(d):
    """The latest row of every source record and whether it is deleted."""
    return f"select id, {d.most_by('row_no', d.order('fetched_at', 'row_no'))} as row_no, {d.most_by('deleted_at is not null', d.order('fetched_at', 'row_no'))} as deleted, count(*) as versions from source_records where id is not null group by id"


@book.query
def request_parameters(d):
    """The parameters of requests, from maps to rows."""
    if d.name == "duck":
        return "select key, count(*) as n, count(distinct value) as n_values from (select unnest(map_keys(request_params)) as key, unnest(map_values(request_params)) as value from source_records where request_params is not null) group by key"
    return "select key, count(*) as n, count(distinct value) as n_values from (select explode(request_params) as (key, value) from source_records) group by key"


@book.query
def enriched_repos(d):
    """Repositories with their enrichment: readme and the first of several documents present, by order of preference."""
    prefer = "case lower(doc_type) when 'changelog' then 1 when 'docs' then 2 when 'contributing' then 3 else 9 end"
    return f"""with x as (select lower(trim(repo_id)) as repo_id, count(case when lower(doc_type) = 'readme' then 1 end) as readmes, {d.least_by('lower(doc_type)', d.order(prefer, 'row_no'))} as first_kind, count(*) as docs
          from repo_documents where coalesce(trim(repo_id), '') <> '' group by 1), r as (select distinct id from repos where id is not null)
        select r.id, coalesce(x.readmes, 0) as readmes, coalesce(x.first_kind, '') as first_kind, coalesce(x.docs, 0) as docs from r left join x on x.repo_id = r.id"""


@book.query
def release_and_issue_projection(d):
    """The five first releases and, of the ten first issues, those that are no requests: here events by user."""
    return f"""with r as (select user_id, event_id, event_type, row_number() over (partition by user_id order by event_id) as rk from events), k as (select * from r where rk <= 10),
        p as (select user_id, {d.collect("case when rk <= 5 then event_id end")} as five, {d.collect("case when event_type <> 'error' then event_id end")} as kept from k group by user_id)
        select user_id, {d.join(d.map('five', 'x', d.cast_text('x')), ',')} as releases, {d.join(d.map('kept', 'x', d.cast_text('x')), ',')} as issues from p"""


@book.query
def json_values(d):
    """A number out of JSON text, with its mean by type."""
    return f"select event_type, count(*) as n, round(avg(cast({d.json('props', '$.k')} as double)), 5) as mean_k from events group by event_type"


@book.query
def licences(d):
    """A repository's licence: its own, else the one that a topic names."""
    tag = d.at(d.keep("coalesce(topics, " + ("array()" if d.name == "spark" else "[]") + ")", "t", "t like 'license:%'"), 0)
    return f"select row_no, coalesce(nullif(nullif(license, ''), 'NOASSERTION'), split_part({tag}, ':', 2), '') as licence from repos"

