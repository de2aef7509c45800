"""What the operators share: the cluster's shared folder, written intermediate tables and bounded Arrow batches."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch for Python: whole texts travel, so batches stay small.
BATCH_ROWS = 1000
#: Hadoop's checked local files get their modes, and those of their .crc files, from a chmod each, and a process that a JVM starts is at first a second one with all of the JVM's memory: one who adds up processes finds twice an executor. Raw local files take none; instead of .crc files Parquet's own checksums of pages are held against. Other file systems ignore this.
_RAW = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true", "parquet.page.write-checksum.enabled": "true"}
_VERIFIED = {"parquet.page.verify-checksum.enabled": "true"}
#: Rows of a few numbers that are written as few files.
FEW = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset and the master is local (tests, one machine), a temporary one that is then set. A cluster without the setting is refused: its executors would each write to their own disk."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = getattr(shared_dir, "own", None)
        if not found:
            found = shared_dir.own = "file://" + tempfile.mkdtemp(prefix="corestrata-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder; what is written there is deleted when the driver ends, if not before."""
    path = f"{shared_dir(spark)}/corestrata/{tag}-{uuid.uuid4().hex}"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(p.getParent())
    files.mkdirs(p)  # deleteOnExit takes only what exists
    files.deleteOnExit(p)
    files.delete(p, True)
    return path


def written(df: DataFrame, path: str) -> DataFrame:
    """df as written to path, a folder of the shared one, and reread."""
    df.write.options(**_RAW).parquet(path)
    return df.sparkSession.read.schema(df.schema).options(**_VERIFIED).parquet(path)


def spool(df: DataFrame, tag: str) -> DataFrame:
    """Writes df to the shared folder and returns the table: the lineage ends here and a lost executor costs no more than a reread."""
    path = scratch(df.sparkSession, tag)
    out = written(df, path)
    out.spooled_at = path
    return out


def few_files(df: DataFrame, most: int) -> DataFrame:
    """df, of a few numbers a row and of most rows at most: up to FEW are written by at most a task a core, whatever the number of shuffle partitions."""
    return df.coalesce(df.sparkSession.sparkContext.defaultParallelism) if most <= FEW else df


def unspool(df: DataFrame) -> None:
    """Deletes a table of spool() once nothing will read it."""
    path = getattr(df, "spooled_at", None)
    if path:
        sc = df.sparkSession.sparkContext
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def bounded_batches(spark: SparkSession) -> None:
    """Lowers Spark's 10,000 rows a batch, which whole texts would make too large; a lower setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(BATCH_ROWS))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{os.path.join(sf_dir, table)}.parquet")


def dealt(table: DataFrame) -> DataFrame:
    """A table as it is read; one of fewer partitions than the cluster has cores is dealt out row by row, so that a small file, or one of a single row group, keeps all of them busy. At most a partition a core is moved."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table


def pair(df: DataFrame, id_col: str, value_col: str) -> DataFrame:
    """Only the identifier and the value, under names of our own, so that further columns cannot clash."""
    bounded_batches(df.sparkSession)
    return df.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{value_col}`").alias("_value"))


def texts(column: pa.Array) -> list[str]:
    """Python strings; null counts as empty."""
    return [x or "" for x in column.to_pylist()]


def batches(source: Iterable[pa.RecordBatch], make, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """make(batch) gives columns in schema's order."""
    for batch in source:
        if batch.num_rows:
            yield pa.RecordBatch.from_arrays([x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x, f.type) for x, f in zip(make(batch), schema, strict=True)], schema=schema)
