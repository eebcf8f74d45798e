"""What a job needs from its session: this package on the executors, and written tables."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


#: Bytes of an Arrow batch to and from Python workers, unless the session says otherwise. Spark's own
#: bound of 64 MB is met by 10,000 documents at once, which a worker and the JVM hold several times.
BATCH_KEY, BATCH_BYTES, SPARK_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m", "67108864b"


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors, once for each context, so that their Python workers can import it, and bounds what they get at once."""
    if spark.conf.get(BATCH_KEY) == SPARK_BYTES:
        spark.conf.set(BATCH_KEY, BATCH_BYTES)
    context = spark.sparkContext
    if not getattr(context, "_wordweave_shipped", False):
        here = Path(__file__).resolve().parent
        path = Path(tempfile.mkdtemp(prefix="wordweave-")) / "wordweave_package.zip"
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(here.rglob("*.py")):
                z.write(p, p.relative_to(here.parent).as_posix())
        context.addPyFile(str(path))
        context._wordweave_shipped = True
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where unset (local runs only)."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = tempfile.mkdtemp(prefix="wordweave-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: lineage ends here, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def _path(spark: SparkSession, path: str):
    """A path and its file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def released(*tables: DataFrame | None) -> None:
    """Deletes tables of written() that nothing reads any more; other frames are left alone."""
    for df in tables:
        if path := getattr(df, "_written", None):
            at, fs = _path(df.sparkSession, path)
            fs.delete(at, True)


def made(spark: SparkSession, path: str) -> None:
    """Makes a folder where there is none."""
    at, fs = _path(spark, path)
    fs.mkdirs(at)


def deleted(spark: SparkSession, path: str) -> None:
    """Deletes a folder, if it is there."""
    at, fs = _path(spark, path)
    fs.delete(at, True)


def stored_path(spark: SparkSession, name: str, sources: Sequence[str], build: Callable[[], DataFrame], by: Sequence[str] = ()) -> str:
    """Where a table lies that is built once for its source paths as they are, in the shared folder; in folders by the columns `by`.

    The names, sizes and times of the sources' files are part of its path, so changed sources
    give another table. It is written aside and then renamed: one whose write didn't end is built
    again, and of two sessions that build at once the first one's table stays.
    """
    seen = []
    for source in sources:
        at, fs = _path(spark, source)
        files = fs.listStatus(at)
        seen += sorted(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}" for f in files)
    path = f"{shared_dir(spark)}/stored/{name}-{hashlib.sha1(chr(10).join(seen).encode()).hexdigest()}"
    there, fs = _path(spark, path)
    if not fs.exists(there):
        aside = f"{path}.{uuid.uuid4().hex}"
        writer = build().write
        (writer.partitionBy(*by) if by else writer).parquet(aside)
        if not fs.rename(_path(spark, aside)[0], there):
            deleted(spark, aside)
    return path


def stored(spark: SparkSession, name: str, sources: Sequence[str], build: Callable[[], DataFrame], by: Sequence[str] = ()) -> DataFrame:
    """The table at stored_path(), which is read from then on."""
    return spark.read.parquet(stored_path(spark, name, sources, build, by))
