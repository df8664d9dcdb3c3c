"""What the engine needs of a session: the shared folder, and tables cut off from their lineage."""

from __future__ import annotations

import io
import tempfile
import time
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: How the names of stored tables and of shipped code begin.
TABLE, CODE = "lexigrove-table-", "lexigrove-code-"


def shared_folder(spark: SparkSession) -> str:
    """Folder that all executors can read, as ``spark.checkpoint.dir`` names it.

    Only a local session, whose executors are the driver, may go without one.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="lexigrove-"))
    return sc.getCheckpointDir()


_tables: dict[str, str] = {}


def materialize(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``df`` written to the shared folder and read again, so that a lost executor costs no recomputation.

    Parquet keeps columns apart, so later plans still prune them; a checkpointed RDD would not. ``by``: columns of few
    values that the table is partitioned by. The table is deleted by :func:`drop_tables`, or else when the driver ends;
    what killed drivers left behind goes by :func:`sweep`.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{TABLE}{uuid.uuid4().hex}"
    fs, target = filesystem(spark, path)
    fs.deleteOnExit(target)
    df.write.partitionBy(*by or ()).parquet(path)
    _tables[path] = spark.sparkContext.applicationId
    columns = [f for f in df.schema.fields if f.name not in (by or ())] + [df.schema[c] for c in by or ()]
    return spark.read.schema(T.StructType(columns)).parquet(path).select(*[F.col(f"`{c}`") for c in df.columns])


def filesystem(spark: SparkSession, path: str) -> tuple:
    """The file system of ``path``, and its path there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def file_state(spark: SparkSession, path: str) -> tuple:
    """Names, lengths and times of a table's files: other ones where it has changed."""
    fs, p = filesystem(spark, path)
    status = fs.getFileStatus(p)
    files = fs.listStatus(p) if status.isDirectory() else [status]
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in files))


def stored_tables(spark: SparkSession) -> set[str]:
    """Paths of the tables that this application has stored and not dropped."""
    return {p for p, a in _tables.items() if a == spark.sparkContext.applicationId}


def drop_tables(spark: SparkSession, kept: set[str] = frozenset()) -> int:
    """Delete this application's stored tables but ``kept`` ones, as :func:`stored_tables` named them earlier; how many. Results that read them must be done."""
    gone = stored_tables(spark) - kept
    for path in gone:
        fs, p = filesystem(spark, path)
        fs.delete(p, True)
        del _tables[path]
    return len(gone)


def sweep(spark: SparkSession, hours: float, now_ms: int | None = None) -> int:
    """Delete tables and code in the shared folder that nobody has changed for so many hours: the leftovers of killed drivers. How many."""
    root = shared_folder(spark).rsplit("/", 1)[0]
    fs, _ = filesystem(spark, root)
    before = (time.time() * 1000 if now_ms is None else now_ms) - hours * 3_600_000
    found = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/*/{{{TABLE},{CODE}}}*")) or []
    old = [f.getPath() for f in found if f.getModificationTime() < before and str(f.getPath()) not in _tables]
    for p in old:
        fs.delete(p, True)
    return len(old)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the package's code to the executors by way of the shared folder, once an application: their Python workers run functions of it."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    archive = io.BytesIO()
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    path = f"{shared_folder(spark)}/{CODE}{uuid.uuid4().hex}.zip"
    fs, target = filesystem(spark, path)
    out = fs.create(target)
    out.write(bytearray(archive.getvalue()))
    out.close()
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        ship(spark)
        return query(spark, folder)

    return run
