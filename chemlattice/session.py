"""Session settings and small helpers that every part of the engine shares."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def session(master: str = "local[*]", **conf: str) -> SparkSession:
    """A session for tests and benchmarks; on a cluster the caller brings its own."""
    b = SparkSession.builder.master(master)
    for k, v in (DEFAULTS | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package to the Python workers, once for each application, so that it need not be installed there."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="chemlattice-")  # on the driver only; Spark carries the file to the executors
    atexit.register(shutil.rmtree, folder, True)
    path = f"{folder}/{root.name}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset (tests on one machine) a temporary one is set."""
    held = spark.sparkContext.getCheckpointDir()
    if held:
        return held
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="chemlattice-")
        atexit.register(shutil.rmtree, path, True)
    spark.sparkContext.setCheckpointDir(path)
    return spark.sparkContext.getCheckpointDir() or path


_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freeing(spark: SparkSession) -> Iterator[None]:
    """Within this, a write deletes its shuffle files when it ends; else they stay until the driver collects its garbage."""
    held = spark.conf.get(_FREE)
    spark.conf.set(_FREE, "true")
    try:
        yield
    finally:
        spark.conf.set(_FREE, held)


def stage(df: DataFrame, name: str = "stage", parts: int | None = None, a_file: int = 0) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: cuts the lineage and survives lost executors.

    ``parts`` files at least let as many tasks read it, where the work on a row outweighs its bytes; files of ``a_file`` rows
    at most do so without a shuffle.
    """
    spark = df.sparkSession
    if parts:
        df = df.repartition(parts)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("maxRecordsPerFile", a_file).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is such a file or folder, through Hadoop's file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


_prepared: dict[tuple, str] = {}


def _stamp(spark: SparkSession, path: str) -> tuple[int, int]:
    """Bytes and last change of a file or of a folder's files."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    held = fs.getFileStatus(p)
    files = [held] if held.isFile() else list(fs.listStatus(p))
    return sum(f.getLen() for f in files), max((f.getModificationTime() for f in files), default=0)


def prepared(spark: SparkSession, directory: str, source: str, name: str, make: Callable[[str], None]) -> str:
    """Folder of what ``make`` works out of a table once, such as parsed molecules or a sorted index.

    It is made again when the table has changed or the folder is gone, and lasts as long as the application.
    """
    key = (spark.sparkContext.applicationId, directory, name, _stamp(spark, f"{directory}/{source}.parquet"))
    path = _prepared.get(key)
    if path is None or not exists(spark, path):
        path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        make(path)
        _prepared[key] = path
    return path


def drop_staged(spark: SparkSession, df: DataFrame) -> None:
    """Deletes the files of a staged table that is no longer needed."""
    for f in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        p = spark._jvm.org.apache.hadoop.fs.Path(f)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def slots(spark: SparkSession) -> int:
    """Tasks that can run at once."""
    return max(1, spark.sparkContext.defaultParallelism)


def tasks_for(spark: SparkSession, rows: int, each: int) -> int:
    """Tasks for steps of which the cost follows the rows rather than their bytes: two a slot, more for many rows."""
    return max(2 * slots(spark), -(-rows // each))


def spread(scan: DataFrame) -> DataFrame:
    """A scan over at least as many partitions as there are slots, for steps that work long on each row.

    Only a table of a few files or row groups is dealt out anew; a large one has more splits than slots and stays as it is.
    """
    want = slots(scan.sparkSession)
    return scan.repartition(want) if scan.rdd.getNumPartitions() < want else scan


def partition_keys(spark: SparkSession, n: int) -> list[int]:
    """A number for each of n partitions that ``repartition(n, key)`` sends to a partition of its own."""
    found: dict[int, int] = {}
    upto = 8 * n + 64
    while len(found) < n:
        for r in spark.range(upto).selectExpr("cast(id as int) AS k", f"pmod(hash(cast(id as int)), {n}) AS p").groupBy("p").agg({"k": "min"}).collect():
            found.setdefault(r[0], r[1])
        upto *= 2
    return [found[i] for i in range(n)]
