"""Sinks: JSON lines, CSV with a joint header, Cypher text, batched load plans and Markdown reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str, append: bool = True) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def read_jsonl(spark, path: str, schema: str) -> DataFrame:
    """JSON lines; blank lines are skipped, a missing folder is empty."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


def write_csv(df: DataFrame, path: str, lists: str = ",") -> None:
    """CSV with a header; arrays are joined, maps and structs become JSON."""
    flat = [F.array_join(c, lists).alias(c) if t == "array<string>" else F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").option("header", True).csv(path)


def joint_header(frames: list[DataFrame]) -> DataFrame:
    """Rows of several frames under the union of their columns, in the order first seen."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def cypher(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """MERGE statements: nodes (``id``, ``label``) first, then edges (``start_id``, ``type``, ``end_id``). Names are stripped to letters, digits and underscores."""
    q = lambda c: F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"\\", r"\\\\"), '"', r'\\"'), F.lit('"'))
    name = lambda c: F.regexp_replace(c, "[^a-zA-Z0-9_]", "")
    n = nodes.select(F.lit(0).alias("part"), F.concat(F.lit("MERGE (n:"), name("label"), F.lit(" {id: "), q(F.col("id")), F.lit("});")).alias("value"))
    e = edges.select(F.lit(1).alias("part"), F.concat(F.lit("MATCH (a {id: "), q(F.col("start_id")), F.lit("}), (b {id: "), q(F.col("end_id")), F.lit("}) MERGE (a)-[:"), name("type"), F.lit("]->(b);")).alias("value"))
    return n.unionByName(e).orderBy("part", "value").select("value")


def load_plan(nodes: DataFrame, edges: DataFrame, batch: int = 500) -> DataFrame:
    """Rows and batches per primary label and edge type."""
    k = nodes.groupBy("label").count().select(F.lit("node").alias("kind"), F.col("label").alias("name"), "count").unionByName(edges.groupBy("type").count().select(F.lit("relationship").alias("kind"), F.col("type").alias("name"), "count"))
    return k.withColumn("batches", F.ceil(F.col("count") / batch))


def markdown(df: DataFrame, title: str, limit: int = 1000) -> str:
    """A small result as a Markdown table (reports are of bounded length)."""
    rows = df.limit(limit).collect()
    head = "| " + " | ".join(df.columns) + " |\n|" + " --- |" * len(df.columns)
    return f"# {title}\n\n{head}\n" + "\n".join("| " + " | ".join(str(v) for v in r) + " |" for r in rows) + "\n"
