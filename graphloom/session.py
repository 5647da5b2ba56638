"""Session helpers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


#: What Python workers are started with: memory that a batch needed goes back to the system when the batch is done,
#: since a reused worker lives as long as its executor. Large blocks are mapped, and Arrow asks the same allocator.
WORKER_ENVIRONMENT = {"MALLOC_MMAP_THRESHOLD_": str(8 << 20), "MALLOC_TRIM_THRESHOLD_": str(16 << 20), "MALLOC_ARENA_MAX": "2", "ARROW_DEFAULT_MEMORY_POOL": "system"}


#: Rows of an Arrow batch, where the session keeps Spark's default of 10,000: texts of some kilobytes make such a batch
#: tens of megabytes, which lie in the executor and in the Python worker at once.
BATCH, DEFAULT_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"
BATCH_ROWS = "2000"


def make_importable(spark: SparkSession) -> None:
    """Lets Python workers import this package from the folder it lies in, besides what is installed or shipped, and
    starts them with WORKER_ENVIRONMENT, where nothing else is set; makes Arrow batches BATCH_ROWS long."""
    if spark.conf.get(BATCH, DEFAULT_BATCH) == DEFAULT_BATCH:
        spark.conf.set(BATCH, BATCH_ROWS)
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])
    for name, value in WORKER_ENVIRONMENT.items():
        env.setdefault(name, value)


_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where that is unset a local session gets
    a temporary folder; a cluster session is refused, since its machines would not see one another's files."""
    global _own_dir
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    if _own_dir is None:
        path = tempfile.mkdtemp(prefix="graphloom-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        _own_dir = "file://" + path
    return _own_dir


_run_folders: dict[str, str] = {}  # by application


def run_folder(spark: SparkSession) -> str:
    """This application's folder for intermediate tables in the shared folder; the end of the driver deletes it."""
    app = spark.sparkContext.applicationId
    if app not in _run_folders:
        _run_folders[app] = path = f"{shared_dir(spark)}/graphloom/{app}-{uuid.uuid4().hex[:8]}"
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = p.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(p)
        files.deleteOnExit(p)
    return _run_folders[app]


def delete_path(spark: SparkSession, path: str) -> bool:
    """Deletes a folder in whatever store it lies. Whether there was one."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings the tests and the benchmark use."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("graphloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    make_importable(spark)
    return spark
