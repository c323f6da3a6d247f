"""Session settings, table access and the shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()

BUCKET_ROWS = 250_000
MAX_BUCKETS = 100_000


def build_session(app: str = "brindle", cores: str = "*", **conf: str) -> SparkSession:
    """Local session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="brindle-wh-"))
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


class Tables:
    """Lazy access to the parquet tables of one directory: ``t.lineitem``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(self.path(name))

    def sql(self, text: str, **frames: DataFrame) -> DataFrame:
        """Run SQL in which ``{orders}`` stands for a table or a passed frame."""
        for name in set(re.findall(r"{(\w+)}", text)) - set(frames):
            frames[name] = getattr(self, name)
        return self.spark.sql(text, **frames)


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints and written intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``.  A temporary folder is
    used only where that is unset and all tasks share this machine.
    """
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="brindle-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def store_bucketed(df: DataFrame, keys: list[str], rows: int, label: str) -> DataFrame:
    """Write ``df`` to the shared folder in buckets of ``keys`` and read it back.

    Unlike a checkpoint, the buckets are known to the planner: later joins and
    aggregations on the keys do not shuffle this side again.
    """
    buckets = min(max(-(-rows // BUCKET_ROWS), 1), MAX_BUCKETS)
    name = f"brindle_{label}_{uuid.uuid4().hex}"
    (
        df.repartition(buckets, *keys)
        .write.format("parquet")
        .bucketBy(buckets, *keys)
        .sortBy(*keys)
        .option("path", scratch_path(df.sparkSession, label))
        .saveAsTable(name)
    )
    return df.sparkSession.table(name)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there.

    The result survives lost executors, and values that depend on the
    placement of rows (partition ids, random numbers) stay as written.
    """
    scratch_root(df.sparkSession)
    return df.checkpoint(eager=True)
