"""Session defaults and the shared working folder."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, memory: str = "8g") -> SparkSession:
    """Session for tests and benchmarks on one machine; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("fathom")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(cores) if str(cores).isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_LOCAL: list[str] = []


def _local_dir() -> str:
    """One folder for the life of this process, removed at its end."""
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="fathom-"))
        atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
    return _LOCAL[0]


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the one the cluster names in
    spark.checkpoint.dir. Only a local session without that setting gets a
    machine-local folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return _local_dir()


def run_dir(spark: SparkSession) -> str:
    """Folder of this application's working tables, below the shared one."""
    return f"{shared_dir(spark)}/fathom-{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, label: str) -> str:
    """New, unused path in the application's folder."""
    return f"{run_dir(spark)}/{label}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Remove the application's working tables, once no plan reads them."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(run_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


# Bytes of rows that a Python function is handed at once, or one row.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession | None = None) -> None:
    """From now on rows reach the session's Python functions in batches of BATCH_BYTES
    at most, or of what the session asks for if that is less. A task's memory then does
    not grow with the rows of its partition. Plans are run after their functions
    return, so the setting stays."""
    spark, name = spark or SparkSession.active(), "spark.sql.execution.arrow.maxBytesPerBatch"
    found = re.fullmatch(r"(\d+)([kmg]?)b?", spark.conf.get(name).lower())
    size = int(found[1]) << {"": 0, "k": 10, "m": 20, "g": 30}[found[2]] if found else 0
    if not 0 < size <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def settled(df: DataFrame, label: str) -> DataFrame:
    """The rows written to the shared folder and read back: computed once,
    safe from lost executors, and of a size the planner knows."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
