"""Reading tables and cutting lineage through the cluster's shared folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def utc_timestamps(df: DataFrame) -> DataFrame:
    """Turn zone-less timestamp columns into instants read as UTC.

    The session time zone must be UTC (``tarn.session`` sets it); the cast is
    then a relabelling and survives predicate pushdown.
    """
    casts = {
        f.name: F.col(f"`{f.name}`").cast(T.TimestampType())
        for f in df.schema.fields
        if isinstance(f.dataType, T.TimestampNTZType)
    }
    return df.withColumns(casts) if casts else df


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` below ``sf_dir`` (one file or a folder of files)."""
    return utc_timestamps(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


#: how files of a suffix are read and written: Spark's format and its options
FORMATS: dict[str, tuple[str, dict[str, str]]] = {
    "parquet": ("parquet", {}),
    "orc": ("orc", {}),
    "json": ("json", {}),
    "jsonl": ("json", {}),
    "csv": ("csv", {"header": "true"}),
    "txt": ("text", {}),
}


def _kind(path: str, kind: str | None) -> tuple[str, dict[str, str]]:
    suffix = kind or path.rstrip("/").rpartition(".")[2].lower()
    if suffix not in FORMATS:
        raise ValueError(f"no format for {path}; known are {', '.join(FORMATS)}")
    return FORMATS[suffix]


def read_files(spark: SparkSession, path: str, kind: str | None = None, schema: T.StructType | str | None = None, **options: str) -> DataFrame:
    """A file or folder in one of ``FORMATS``, by default as its suffix says.

    Without ``schema`` JSON is read once more to infer it, and the columns of CSV are
    texts; over much data a schema should be given.
    """
    name, own = _kind(path, kind)
    reader = spark.read.format(name).options(**own, **options)
    return utc_timestamps((reader.schema(schema) if schema is not None else reader).load(path))


def write_files(df: DataFrame, path: str, kind: str | None = None, mode: str = "errorifexists", **options: str) -> None:
    """Write a folder in one of ``FORMATS``, by default as its suffix says."""
    name, own = _kind(path, kind)
    df.write.format(name).options(**own, **options).mode(mode).save(path)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    The cluster names it in ``spark.checkpoint.dir``.  Only where that is unset
    and the session runs in one process (tests) a temporary folder is made.
    """
    set_by_cluster = spark.conf.get("spark.checkpoint.dir", None)
    if set_by_cluster:
        return set_by_cluster
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="tarn-shared-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut_lineage(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Write ``df`` as a compressed table in the shared folder and read it back.

    Iterative operators read their narrowed rows several times; a written table
    costs less room than a checkpoint (columnar, compressed), prunes columns and
    outlives the loss of any executor.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tarn-{uuid.uuid4().hex}"
    (df if partitions is None else df.coalesce(partitions)).write.parquet(path)
    _WRITTEN.append(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def scratch_folder(spark: SparkSession) -> str:
    """A new folder in the shared one that is removed when the driver ends, or by ``release``."""
    path = f"{shared_dir(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    atexit.register(_remove, spark, path)
    return path


def release(spark: SparkSession) -> int:
    """Remove everything this driver wrote to the shared folder so far; plans made before must be done.

    A driver that lives for days calls it between its jobs.
    """
    n = len(_WRITTEN)
    while _WRITTEN:
        _remove(spark, _WRITTEN.pop())
    return n


#: folders written by this driver and not yet removed
_WRITTEN: list[str] = []


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:
        pass  # the session has gone; the cluster owns its shared folder
