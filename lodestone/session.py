"""Sessions, table access and lineage cuts shared by every operator."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def session(cpus: int = 8, app: str = "lodestone") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The Parquet table ``name`` under ``root``."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a folder of our own only where it is unset, which only a local master may do."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = getattr(spark, "_lodestone_dir", None)
    if own is None:
        own = tempfile.mkdtemp(prefix="lodestone-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        spark._lodestone_dir = own
    return own


#: Spark's own switch: a query's shuffle files are deleted as soon as it has ended, instead of when the driver collects its garbage.
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str = "cut", release: bool = False) -> DataFrame:
    """Cut the lineage of ``df``: write it as Parquet to the shared folder and read it back (survives lost executors). ``release``: its shuffle files are deleted then."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(RELEASE, "false")
    try:
        if release:
            spark.conf.set(RELEASE, "true")
        df.write.parquet(path)
    finally:
        spark.conf.set(RELEASE, before)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per context, so that they need no installed copy."""
    sc = spark.sparkContext
    if not getattr(sc, "_lodestone_sent", False):
        here = Path(__file__).parent
        made = shutil.make_archive(f"{tempfile.mkdtemp(prefix='lodestone-code-')}/lodestone_code", "zip", here.parent, here.name)
        sc.addPyFile(made)
        sc._lodestone_sent = True


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
