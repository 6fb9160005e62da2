"""Session helpers shared by every operator."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Operators of a plan that shuffle.
_WIDE = re.compile(r"^[\s+:-]*(Aggregate|Join|Window|Sort|Repartition|RebalancePartitions|Deduplicate|Distinct|GlobalLimit|Except|Intersect|FlatMapGroups|CoGroup)", re.M)
#: Tables of the data directory, each one Parquet file or folder.
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings sources assets content_units "
    "unit_translations unit_embeddings unit_translation_embeddings page_blocks index_log subjects subject_labels lang_samples"
).split()


def local_session(cpus: int | None = None, memory: str = "8g", name: str = "tessera") -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    n = cpus or os.cpu_count() or 4
    spark = (
        SparkSession.builder.master(f"local[{n}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names in spark.checkpoint.dir; set one of our own only where none is set."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tessera-checkpoint-")
    sc.setCheckpointDir(folder)


def shared_folder(spark: SparkSession) -> str:
    """The session's own folder within the one that all executors share."""
    ensure_checkpoint_dir(spark)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and read it from there; survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Bring a frame that came in few partitions onto all cores ahead of Python work; larger ones stay as they are.

    Small single-file tables arrive in one partition; the exchange then moves a few MB only. A frame behind a shuffle stays as it is, too:
    asking for its partitions would run it, and its exchange has parted it already.
    """
    if _WIDE.search(df._jdf.queryExecution().optimizedPlan().toString()):
        return df
    want = partitions or max(df.sparkSession.sparkContext.defaultParallelism, 4)
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df
