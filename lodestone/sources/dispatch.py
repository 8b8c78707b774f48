"""From raw documents of any source to record tables: fetching, shapes, dispatch by source, samples, stores and the folder layout."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.dialect import SPARK
from . import payloads as P

#: Seconds to wait, characters of an error's text, words that an item of each section must have.
TIMEOUT, ERROR_CHARS = 30, 300
REQUIRED = {"methods": ("name", "source_span"), "benchmarks": ("name", "source_span"), "datasets": ("name", "source_span"), "claims": ("text", "claim_type", "confidence", "polarity", "source_span")}


def fetch(url: str, opener: Callable = urllib.request.urlopen) -> tuple[str, str]:
    """(text, error) of a GET: an absent page (404) is empty without error, other failures give the first characters of their text."""
    try:
        with opener(urllib.request.Request(url, headers={"Accept": "application/json, application/atom+xml"}), timeout=TIMEOUT) as answer:
            return answer.read().decode("utf-8", "replace"), ""
    except urllib.error.HTTPError as e:
        return "", "" if e.code == 404 else f"{e.code} {e.reason}"[:ERROR_CHARS]
    except (urllib.error.URLError, OSError) as e:
        return "", str(e)[:ERROR_CHARS]


def first_existing(urls: list[str], get: Callable[[str], tuple[str, str]] = fetch) -> tuple[str, str]:
    """(url, text) of the first of several candidates that has a text (changelogs go by several names); both empty if none has."""
    return next(((u, t) for u in urls for t, _ in [get(u)] if t), ("", ""))


def halves(limit: int) -> tuple[int, int]:
    """How a limit is shared by models (the greater half) and datasets."""
    return -(-limit // 2), limit // 2


def elapsed_ms(since: float) -> float:
    return round((time.perf_counter() - since) * 1000, 3)


def provider_schema() -> dict:
    """The JSON schema that an extraction provider must answer with."""
    item = lambda names: {"type": "object", "required": list(names), "properties": {n: {"type": "number" if n == "confidence" else "string"} for n in names}}
    return {"type": "object", "required": list(REQUIRED), "properties": {k: {"type": "array", "items": item(v)} for k, v in REQUIRED.items()}}


def provider_prompt(text: str) -> str:
    return f"Extract methods, benchmarks, datasets and claims as JSON of this schema: {json.dumps(provider_schema(), sort_keys=True)}. Every source_span must stand in the text word for word.\n\n{text}"


def shapes(offers: DataFrame) -> DataFrame:
    """Items of provider answers (``id``, ``payload`` JSON text): ``id``, ``section``, ``item``, ``reason``.

    A payload that is no object gives one row of reason payload_not_object; a section that is present and no list,
    section_not_list; an item that is no object, item_not_object. Null payloads are no objects.
    """
    clean = F.ltrim(F.coalesce("payload", F.lit("")))
    good = F.coalesce(F.try_parse_json("payload").isNotNull(), F.lit(False)) & clean.startswith("{")
    sections = F.array(*[F.struct(F.lit(k).alias("section"), F.ltrim(F.get_json_object("payload", f"$.{k}")).alias("body")) for k in REQUIRED])
    each = offers.where(good).select("id", F.explode(sections).alias("s")).select("id", "s.*").where("body is not null")
    listed = F.from_json("body", "array<string>")
    items = each.where("startswith(body, '[')").select("id", "section", F.explode(listed).alias("item")).withColumn("reason", F.when(~F.coalesce(F.ltrim("item"), F.lit("")).startswith("{"), "item_not_object"))
    none = lambda c: F.lit(None).cast("string").alias(c)
    bad = offers.where(~good).select("id", none("section"), none("item"), F.lit("payload_not_object").alias("reason"))
    odd = each.where("not startswith(body, '[')").select("id", "section", none("item"), F.lit("section_not_list").alias("reason"))
    return items.unionByName(bad).unionByName(odd)


def normalize_sample(raw: DataFrame) -> dict[str, DataFrame]:
    """Rows of the sample source (``record``, ``payload``): papers and repositories by their ``kind``."""
    get = lambda k: F.get_json_object("payload", f"$.{k}").alias(k)
    kind = F.get_json_object("payload", "$.kind")
    papers = raw.where(kind == "paper").select(*[get(k) for k in ("id", "title", "abstract", "published_at", "venue", "arxiv_id")], F.get_json_object("payload", "$.citation_count").cast("int").alias("citation_count"), F.col("record").alias("source_record_id"))
    repos = raw.where(kind == "repo").select(*[get(k) for k in ("id", "owner", "name", "full_name", "description", "license", "last_commit_at")], *[F.get_json_object("payload", f"$.{k}").cast("int").alias(k) for k in ("stars", "forks", "open_issues_count")], F.col("record").alias("source_record_id"))
    names = F.from_json(F.get_json_object("payload", "$.authors"), "array<string>")
    authors = raw.where(kind == "paper").select(F.col("record").alias("source_record_id"), F.explode(names).alias("name")).where("trim(name) <> ''")
    return {"papers": papers, "repos": repos, "authors": authors.select(F.concat(F.lit("author:"), F.expr(T.hash_list(SPARK, "source_record_id", "name"))).alias("id"), "*")}


def normalize_generic(raw: DataFrame) -> dict[str, DataFrame]:
    """Any other source as papers: the first present of the usual fields."""
    first = lambda *ks: F.coalesce(*[F.get_json_object("payload", f"$.{k}") for k in ks])
    own = F.coalesce(first("id"), F.expr(T.short_hash(SPARK, "payload")))
    return {"papers": raw.select(F.concat_ws(":", F.lit("paper"), F.lower("source_name"), own).alias("id"), F.coalesce(first("title", "name", "display_name"), own).alias("title"), F.coalesce(first("abstract", "summary", "description"), F.lit("")).alias("abstract"), first("published_at", "published", "date").alias("published_at"), first("url", "source_url").alias("source_url"), F.col("record").alias("source_record_id"))}


_ENTRY = "struct<id:string,title:string,summary:string,published:string,author:array<struct<name:string>>,doi:string>"


def dispatch(raw: DataFrame) -> dict[str, DataFrame]:
    """Raw documents (``source_name``, ``record``, ``payload`` JSON text of one item) to record tables, by source name in lower case.

    Sources nobody knows go through ``normalize_generic``; null payloads give nothing.
    """
    raw = raw.where("payload is not null").withColumn("source", F.lower(F.trim(F.coalesce("source_name", F.lit("")))))
    typed = lambda where, schema: raw.where(where).select("record", F.from_json("payload", schema).alias("x")).where("x is not null").select("record", "x.*")
    model = F.coalesce(F.get_json_object("payload", "$.asset_type"), F.lit("model"))
    hugging = F.col("source") == "huggingface"
    parts = [
        P.normalize_arxiv(typed("source = 'arxiv'", _ENTRY), F.col("record")), P.normalize_openalex(typed("source = 'openalex'", P.OPENALEX), F.col("record")),
        P.normalize_semantic_scholar(typed("source in ('semantic_scholar', 'semanticscholar')", P.SEMANTIC), F.col("record")), P.normalize_github(typed("source = 'github'", P.GITHUB), F.col("record")),
        P.normalize_huggingface(typed(hugging & (model == "model"), P.HUGGINGFACE), F.col("record"), "model"), P.normalize_huggingface(typed(hugging & (model == "dataset"), P.HUGGINGFACE), F.col("record"), "dataset"),
        normalize_sample(raw.where("source = 'sample'")), normalize_generic(raw.where("source not in ('arxiv', 'openalex', 'semantic_scholar', 'semanticscholar', 'github', 'huggingface', 'sample')")),
    ]
    out: dict[str, DataFrame] = {}
    for part in parts:
        for name, df in part.items():
            out[name] = df if name not in out else out[name].unionByName(df, allowMissingColumns=True)
    return out


@dataclass(frozen=True)
class Layout:
    """Where things lie under a root folder."""

    root: str

    #: Names of the derived locations, relative to the root.
    PLACES = {
        "data": "data", "raw": "data/raw", "normalized": "data/normalized", "eval": "data/eval", "artifacts": "artifacts", "graph": "artifacts/graph", "cypher": "artifacts/cypher",
        "traces": "artifacts/traces", "reports": "reports", "memos": "reports/decision_memos", "manifest": "data/raw/source_records.jsonl", "corpus": "data/normalized/corpus",
        "graph_file": "artifacts/graph/graph", "export": "artifacts/cypher/export.cypher", "templates": "artifacts/cypher/evidence_path_queries.cypher",
        "results": "artifacts/eval_results.json", "comparison": "artifacts/retrieval_comparison.csv", "trace_log": "artifacts/traces/query_traces.jsonl",
    }

    def __getitem__(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{self.PLACES[name]}"

    def make(self) -> None:
        for place in self.PLACES.values():
            if "." not in place.rsplit("/", 1)[-1]:
                Path(self.root, place).mkdir(parents=True, exist_ok=True)


def _there(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def load_or_build(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path``; built and written there first if it is missing."""
    if not _there(spark, path):
        build().write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)


def save(corpus: dict[str, DataFrame], path: str) -> None:
    """Write every table of a corpus under ``path``, replacing it."""
    for name, df in corpus.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str, names: tuple[str, ...]) -> dict[str, DataFrame]:
    """The tables of a stored corpus; those that are missing are left out."""
    return {n: spark.read.parquet(f"{path}/{n}") for n in names if _there(spark, f"{path}/{n}")}


def write_json(value, path: str) -> None:
    """A small value as JSON, indented by 2, keys sorted."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(value, indent=2, sort_keys=True, default=str), encoding="utf-8")


def connection(env: dict[str, str]) -> tuple[dict[str, str], dict[str, str]]:
    """A graph database's settings out of the environment, and the same to be shown, with the password masked."""
    got = {"uri": env.get("NEO4J_URI", "bolt://localhost:7687"), "user": env.get("NEO4J_USER", "neo4j"), "password": env.get("NEO4J_PASSWORD", ""), "database": env.get("NEO4J_DATABASE", "neo4j")}
    return got, {**got, "password": "***" if got["password"] else ""}


def numbered_batches(rows: DataFrame, by: str, key: str, size: int = 500) -> DataFrame:
    """``rows`` with ``batch``: numbered per value of ``by`` in the order of ``key``, ``size`` rows each."""
    from pyspark.sql import Window

    return rows.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(by).orderBy(key)) - 1) / size).cast("long"))


#: An invented sample of every shape of source.
SAMPLE = (
    ("sample", {"kind": "paper", "id": "paper:sample:1", "title": "Tracing claims through layered graphs", "abstract": "We trace claims. Evaluation on a benchmark shows improved recall.", "published_at": "2025-02-01", "venue": "Journal of Examples", "citation_count": 4, "authors": ["Marigold Fentworth", "Peregrin Ostwald"]}),
    ("sample", {"kind": "paper", "id": "paper:sample:2", "title": "Limits of graph memory", "abstract": "A limitation of graph memory is its stale evidence.", "published_at": "2024", "venue": "Letters of Examples", "citation_count": 1, "authors": ["Ida Quill"]}),
    ("sample", {"kind": "repo", "id": "repo:quill/tracer", "owner": "quill", "name": "tracer", "full_name": "quill/tracer", "description": "Claim tracing in production", "stars": 120, "forks": 9, "license": "MIT", "last_commit_at": "2025-05-01", "open_issues_count": 3}),
    ("semantic_scholar", {"paperId": "s9", "title": "Routing questions", "abstract": "Routing improves answers.", "year": 2023, "venue": "V", "externalIds": {"DOI": "10.9999/x"}, "url": "https://s.example/s9", "citationCount": 2, "authors": [{"authorId": "7", "name": "Tamsin Orbell", "affiliations": []}], "references": [{"paperId": "s8", "title": "Older routing"}], "citations": []}),
    ("github", {"full_name": "orbell/router", "name": "router", "owner": {"login": "orbell"}, "html_url": "https://g.example/orbell/router", "description": "Router", "stargazers_count": 5, "forks_count": 1, "topics": ["router"], "issues": [], "releases": []}),
    ("huggingface", {"modelId": "orbell/router-small", "asset_type": "model", "downloads": 10, "likes": 2, "tags": ["license:mit"], "description": "A small router"}),
    ("huggingface", {"id": "orbell/questions", "asset_type": "dataset", "downloads": 3, "likes": 1, "tags": [], "description": "Questions"}),
    ("elsewhere", {"name": "A page", "summary": "A page of some other source", "url": "https://e.example/1"}),
)


def sample(spark: SparkSession) -> DataFrame:
    """The sample as raw documents."""
    return spark.createDataFrame([(s, f"source:{s}:{i}", json.dumps(p, sort_keys=True)) for i, (s, p) in enumerate(SAMPLE)], "source_name string, record string, payload string")
