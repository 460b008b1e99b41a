"""Cutting lineage in iterative jobs: tables in the folder that the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Bytes, as packed, and rows of a row group in tables of arrays.
ARRAYS_BYTES, ARRAYS_ROWS = 2**24, 16
_written: list[tuple[SparkSession, str]] = []
_shipped: set[str] = set()


def _folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not (context.master or "").startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="timbergrid-")
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet and read back: what follows starts from a scan, and a lost executor costs its tasks.

    A checkpointed RDD would run the plan twice, and keep the plan's own guess of its size. In a loop that joins a state
    with itself that guess squares every round, until planning takes longer than the work; a table has its real size.
    Where no folder is set a local session takes a temporary one; a cluster's must name one.
    """
    spark = df.sparkSession
    path = f"{_folder(spark)}/timbergrid-{uuid.uuid4().hex}"
    _written.append((spark, path))
    told = df.write
    if any(f.dataType.typeName() == "binary" for f in df.schema):
        # Rows that hold arrays: a writer looks at its size first after 100 rows, and a reader holds a whole row group, not
        # as small as it was packed.
        told = told.options(**{"parquet.page.size.row.check.min": 1, "parquet.block.size": ARRAYS_BYTES, "parquet.block.row.count.limit": ARRAYS_ROWS, "parquet.enable.dictionary": "false"})
    told.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._cut_path = path
    return found


def drop(*tables: DataFrame) -> None:
    """Remove tables of ``cut`` that nothing reads any more."""
    for t in tables:
        _written.remove((t.sparkSession, t._cut_path))
        _remove(t.sparkSession, t._cut_path)


def _remove(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _cleanup() -> None:
    while _written:
        spark, path = _written.pop()
        if spark.sparkContext._jsc is not None:  # else the session is gone
            _remove(spark, path)


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once, for Python functions that run there."""
    context, package = spark.sparkContext, Path(__file__).resolve().parents[1]
    if context.applicationId not in _shipped and package.is_dir():  # else it came as a zip itself
        target = Path(tempfile.mkdtemp(prefix="timbergrid-")) / f"{package.name}_package.zip"
        with zipfile.ZipFile(target, "w") as z:
            for f in sorted(package.rglob("*.py")):
                z.write(f, f.relative_to(package.parent))
        context.addPyFile(str(target))
    _shipped.add(context.applicationId)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by its keys into as many partitions as the session shuffles into, however few its bytes are.

    For rows that hold arrays: their work is far above their size, by which Spark would put them into few tasks.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
