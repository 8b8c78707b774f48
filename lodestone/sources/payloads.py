"""Sources of raw payloads (offline files of the public APIs' shapes) and their normalisation to record tables.

Each reader gives (source_name, source_url, source_id, key, payload) rows; each normaliser gives a dict of DataFrames. All
are projections, explodes and unions; nothing is fetched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import text as T
from ..functions.dialect import SPARK

AUTHOR = "array<struct<name:string>>"
ARXIV_SCHEMA = "id string, title string, summary string, published string, author array<struct<name:string>>, doi string"
OPENALEX = "struct<id:string,display_name:string,publication_year:int,cited_by_count:int,doi:string,abstract_inverted_index:map<string,array<int>>,authorships:array<struct<author:struct<id:string,display_name:string>,institutions:array<struct<id:string,display_name:string,type:string>>>>>"
S2_STUB = "struct<paperId:string,title:string,url:string>"
SEMANTIC = f"struct<paperId:string,title:string,abstract:string,year:int,publicationDate:string,venue:string,externalIds:map<string,string>,url:string,citationCount:int,authors:array<struct<authorId:string,name:string,affiliations:array<string>>>,references:array<{S2_STUB}>,citations:array<{S2_STUB}>>"
GITHUB = (
    "struct<full_name:string,name:string,owner:struct<login:string,html_url:string>,html_url:string,description:string,stargazers_count:int,forks_count:int,license:struct<spdx_id:string>,default_branch:string,"
    "pushed_at:string,open_issues_count:int,topics:array<string>,readme:struct<path:string,encoding:string,content:string,html_url:string>,"
    "releases:array<struct<tag_name:string,name:string,published_at:string,html_url:string,body:string>>,issues:array<struct<number:int,title:string,state:string,labels:array<struct<name:string>>,body:string,html_url:string,pull_request:struct<url:string>>>>"
)
HUGGINGFACE = "struct<modelId:string,id:string,pipeline_tag:string,downloads:long,likes:int,tags:array<string>,lastModified:string,cardData:struct<license:string,task_categories:array<string>>,description:string>"


def read_arxiv(spark: SparkSession, path: str) -> DataFrame:
    """Atom files: one row per entry; titles to 500, summaries to 5,000 characters."""
    raw = spark.read.format("xml").option("rowTag", "entry").option("ignoreNamespace", "true").schema(ARXIV_SCHEMA).load(path)
    return raw.select(
        "id", F.substring(F.expr(T.clean(SPARK, "title")), 1, 500).alias("title"), F.substring(F.expr(T.clean(SPARK, "summary")), 1, 5000).alias("summary"),
        "published", F.coalesce("author", F.array().cast(AUTHOR)).alias("author"), "doi",
    )


def items(spark: SparkSession, path: str, schema: str, keys: tuple[str, ...] = ("results", "data", "items")) -> DataFrame:
    """Tolerant item extraction from JSON files: a list, or the first present of ``keys``; one row per item, none for other shapes."""
    text = spark.read.text(path, wholetext=True).select("value")
    each = [F.from_json(F.get_json_object("value", f"$.{k}"), f"array<{schema}>") for k in keys]
    listed = F.when(F.ltrim("value").startswith("["), F.from_json("value", f"array<{schema}>"))
    return text.select(F.explode(F.coalesce(listed, *each)).alias("x")).where("x is not null").select("x.*")


def decoded(content: Column) -> Column:
    """The text of base64 content; empty if it is none."""
    return F.when(content.isNull(), F.lit("")).otherwise(F.coalesce(F.try_to_binary(F.regexp_replace(content, r"\s", ""), F.lit("base64")).cast("string"), F.lit("")))


def abstract_of(index: Column) -> Column:
    """The text of an inverted index: words in the order of their positions."""
    places = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.coalesce(F.array_join(F.transform(F.array_sort(places), lambda x: x["w"]), " "), F.lit(""))


def normalize_arxiv(raw: DataFrame, record: Column) -> dict[str, DataFrame]:
    base = raw.withColumn("record", record)
    number = F.regexp_extract("id", r"([0-9]{4}\.[0-9]{4,5})", 1)
    papers = base.select(F.concat(F.lit("paper:arxiv:"), number).alias("id"), "title", F.col("summary").alias("abstract"), F.col("published").alias("published_at"), F.coalesce("doi", F.lit("")).alias("doi"), number.alias("arxiv_id"), F.col("id").alias("source_url"), F.col("record").alias("source_record_id"))
    authors = base.select(F.explode("author.name").alias("name"), F.col("id").alias("source_url"), F.col("record").alias("source_record_id")).where("trim(name) <> ''")
    return {"papers": papers, "authors": authors.select(F.concat(F.lit("author:"), F.expr(T.hash_list(SPARK, "source_record_id", "name"))).alias("id"), "*")}


def normalize_openalex(raw: DataFrame, record: Column) -> dict[str, DataFrame]:
    base = raw.withColumn("record", record).withColumn("key", F.element_at(F.split("id", "/"), -1))
    papers = base.select(F.concat(F.lit("paper:openalex:"), F.lower("key")).alias("id"), F.col("display_name").alias("title"), abstract_of(F.col("abstract_inverted_index")).alias("abstract"), F.col("publication_year").cast("string").alias("published_at"), "doi", F.col("key").alias("openalex_id"), F.col("cited_by_count").alias("citation_count"), F.col("id").alias("source_url"), F.col("record").alias("source_record_id"))
    ships = base.select("record", F.explode("authorships").alias("s"))
    authors = ships.select(F.concat(F.lit("author:"), F.element_at(F.split("s.author.id", "/"), -1)).alias("id"), F.col("s.author.display_name").alias("name"), F.array_join("s.institutions.display_name", "; ").alias("affiliation_text"), F.col("record").alias("source_record_id")).where("name is not null")
    orgs = ships.select("record", F.explode("s.institutions").alias("o")).select(F.concat(F.lit("org:"), F.element_at(F.split("o.id", "/"), -1)).alias("id"), F.col("o.display_name").alias("name"), F.col("o.type").alias("type"), F.col("record").alias("source_record_id")).where("name is not null")
    return {"papers": papers, "authors": authors.dropDuplicates(["id"]), "organizations": orgs.dropDuplicates(["id"])}


def normalize_semantic_scholar(raw: DataFrame, record: Column) -> dict[str, DataFrame]:
    """Papers with stubs of references and citations (``relation`` keeps the direction), and authors."""
    base = raw.withColumn("record", record)
    full = base.select(F.concat(F.lit("paper:semanticscholar:"), "paperId").alias("id"), "title", "abstract", F.coalesce("publicationDate", F.col("year").cast("string")).alias("published_at"), "venue", F.col("externalIds")["DOI"].alias("doi"), F.col("externalIds")["ArXiv"].alias("arxiv_id"), F.col("paperId").alias("semantic_scholar_id"), F.col("citationCount").alias("citation_count"), F.col("url").alias("source_url"), F.col("record").alias("source_record_id"), F.lit("primary").alias("relation"))
    stub = lambda c, r: base.select("record", F.explode(c).alias("x")).where("x.paperId is not null and x.title is not null").select(F.concat(F.lit("paper:semanticscholar:"), "x.paperId").alias("id"), F.col("x.title").alias("title"), F.col("x.paperId").alias("semantic_scholar_id"), F.col("x.url").alias("source_url"), F.col("record").alias("source_record_id"), F.lit(r).alias("relation"))
    papers = full.unionByName(stub("references", "reference"), allowMissingColumns=True).unionByName(stub("citations", "citation"), allowMissingColumns=True)
    authors = base.select("record", F.explode("authors").alias("a")).select(F.concat(F.lit("author:"), "a.authorId").alias("id"), F.col("a.name").alias("name"), F.array_join("a.affiliations", "; ").alias("affiliation_text"), F.col("record").alias("source_record_id")).where("name is not null")
    return {"papers": papers, "authors": authors}


def normalize_github(raw: DataFrame, record: Column) -> dict[str, DataFrame]:
    """Repositories with health and risk, their readme, the five first releases, and issues: of the first ten those that are no pull requests."""
    base = raw.withColumn("record", record).where("coalesce(full_name, '') <> ''").withColumn("repo_id", F.concat(F.lit("repo:"), F.lower("full_name")))
    base = base.withColumn("picked", F.filter(F.slice(F.coalesce("issues", F.array().cast(raw.schema["issues"].dataType)), 1, 10), lambda i: i["pull_request"].isNull())).withColumn("latest", F.slice(F.coalesce("releases", F.array().cast(raw.schema["releases"].dataType)), 1, 5))
    health = F.round(F.expr(S.repo_health(SPARK, "stargazers_count", "forks_count", "license.spdx_id", "pushed_at", "open_issues_count")), 3)
    risky = F.expr(f"cast(size(filter(picked, i -> {S.issue_risks(SPARK, SPARK.cat('array_join(transform(coalesce(i.labels, array()), l -> l.name), ' + chr(39) + ' ' + chr(39) + ')', chr(39) + ' ' + chr(39), 'coalesce(i.title, ' + chr(39) * 2 + ')', chr(39) + ' ' + chr(39), 'coalesce(i.body, ' + chr(39) * 2 + ')'))} <> '')) as int)")
    signals = F.array_compact(F.array(F.when(F.coalesce("license.spdx_id", F.lit("")) == "", "missing_license"), F.when(F.coalesce("open_issues_count", F.lit(0)) > 100, "high_open_issue_count"), F.when(F.size("latest") == 0, "no_recent_release_metadata"), F.lit("missing_changelog"), F.when(F.col("risky") > 0, "recent_issue_risk")))
    repos = base.withColumn("risky", risky).withColumn("health_score", health).withColumn("signals", signals)
    repos = repos.withColumn("risk_score", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - F.col("health_score") + F.least(F.lit(0.25), 0.04 * F.size("signals")) + F.least(F.lit(0.2), 0.025 * F.col("risky")))), 3))
    out = repos.select(F.col("repo_id").alias("id"), F.col("owner.login").alias("owner"), "name", "full_name", F.col("html_url").alias("url"), F.col("stargazers_count").alias("stars"), F.col("forks_count").alias("forks"), F.col("license.spdx_id").alias("license"), "default_branch", F.col("pushed_at").alias("last_commit_at"), "open_issues_count", "health_score", "risk_score", F.col("signals").alias("risk_signals"), "description", "topics", F.col("record").alias("source_record_id"))
    docs = base.select("repo_id", "full_name", "record", F.col("readme.path").alias("path"), decoded(F.col("readme.content")).alias("text")).where("text <> ''").select(F.concat(F.lit("repo_doc:"), "repo_id", F.lit(":readme")).alias("id"), "repo_id", F.col("full_name").alias("repo_full_name"), F.lit("readme").alias("doc_type"), F.coalesce("path", F.lit("README.md")).alias("path"), "text", F.col("record").alias("source_record_id"))
    releases = base.select("repo_id", F.explode("latest").alias("r")).select(F.concat(F.lit("release:"), "repo_id", F.lit(":"), "r.tag_name").alias("id"), "repo_id", "r.*")
    issues = base.select("repo_id", F.explode("picked").alias("i")).select(F.concat(F.lit("issue:"), "repo_id", F.lit(":"), F.col("i.number").cast("string")).alias("id"), "repo_id", "i.title", "i.state", "i.body")
    orgs = base.select(F.concat(F.lit("org:github:"), F.lower("owner.login")).alias("id"), F.col("owner.login").alias("name"), F.lit("github_owner").alias("type"), F.col("owner.html_url").alias("homepage"), F.col("record").alias("source_record_id")).where("name is not null").dropDuplicates(["id"])
    return {"repos": out, "repo_documents": docs, "releases": releases, "issues": issues, "organizations": orgs}


def normalize_huggingface(raw: DataFrame, record: Column, kind: str) -> dict[str, DataFrame]:
    """Models or datasets, their licence from the card or a tag, and owners."""
    asset = F.coalesce("modelId", "id")
    tag = F.split_part(F.coalesce(F.filter("tags", lambda t: t.startswith("license:"))[0], F.lit("")), F.lit(":"), F.lit(2))
    text = F.concat_ws(" ", "description", F.concat(F.lit("license: "), "cardData.license"), F.concat(F.lit("tags: "), F.array_join("tags", ", ")))
    rows = raw.where(asset.isNotNull()).select(F.concat(F.lit(f"{kind}:"), F.lower(asset)).alias("id"), asset.alias("name"), F.coalesce(F.nullif(F.col("cardData.license"), F.lit("")), tag).alias("license"), F.coalesce("downloads", F.lit(0)).alias("downloads"), F.coalesce("likes", F.lit(0)).alias("likes"), text.alias("card_text"), record.alias("source_record_id"))
    owners = rows.where("instr(name, '/') > 0").select(F.concat(F.lit("org:hf:"), F.lower(F.split_part("name", F.lit("/"), F.lit(1)))).alias("id"), F.split_part("name", F.lit("/"), F.lit(1)).alias("name"), "source_record_id").dropDuplicates(["id"])
    return {f"{kind}s": rows, "organizations": owners}


def merge(first: dict[str, DataFrame], second: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Union of two corpora, table by table, keeping the first of every id."""
    out = {}
    for name in {**first, **second}:
        parts = [c[name].withColumn("_side", F.lit(i)) for i, c in enumerate((first, second)) if name in c]
        both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
        packed = F.struct(*[c for c in both.columns if c not in ("_side",)])
        out[name] = both.groupBy("id").agg(F.min_by(packed, "_side").alias("r")).select("r.*")
    return out


def federated(results: dict[str, DataFrame], limit: int) -> DataFrame:
    """The first results of every source, as many as its share of ``limit``, cut to ``limit`` (both limits are the operator)."""
    share = max(1, limit // max(1, len(results)))
    parts = [df.limit(share).withColumn("source_name", F.lit(n)).withColumn("_at", F.lit(i)) for i, (n, df) in enumerate(results.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.orderBy("_at").drop("_at").limit(limit)
