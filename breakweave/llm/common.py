"""Helpers shared by the text operators: table access, shared scratch space, Arrow batch bounds."""

from __future__ import annotations

import os
import tempfile
import uuid

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that one Arrow batch holds at most; with texts of up to some MB a batch stays small.
BATCH_ROWS = 512
#: Rows of two or three numbers up to which a table is broadcast (some 8 MB), and tasks that a hot key is dealt to beyond that.
BROADCAST_ROWS = 200_000
SALTS = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by rows and bytes, so that Python workers hold a few MB at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def shared_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where the setting is missing, one machine's temporary folder takes its place.

    A cluster without the setting is an error: its executors would not see each other's files.
    """
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="breakweave-")
        context.setCheckpointDir(root)
    return "file://" + root if root.startswith("/") else root


def shared_dir(spark: SparkSession, tag: str) -> str:
    """A new folder's URI below spark.checkpoint.dir, which driver and executors share."""
    return f"{shared_root(spark).rstrip('/')}/breakweave/{tag}-{uuid.uuid4().hex}"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """checkpoint() needs a folder; it is only set here where the session names none."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_root(spark))


def hot_join(frame: DataFrame, keyed: DataFrame, key: list[str], how: str = "inner", limit: int = BROADCAST_ROWS, salts: int = SALTS) -> DataFrame:
    """Join with a table of one short row a key, where one key may have a large share of `frame`'s rows.

    Up to `limit` rows the table is broadcast; a larger one is joined with each key dealt over `salts` tasks.
    """
    if keyed.limit(limit + 1).count() <= limit:
        return frame.join(F.broadcast(keyed), key, how)
    left = frame.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    right = keyed.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*key, "_salt"], how).drop("_salt")


def materialise(frame: DataFrame, spark: SparkSession, tag: str, *partition_by: str) -> DataFrame:
    """Write a frame as Parquet in the shared folder and read it back: lineage ends there."""
    path = shared_dir(spark, tag)
    writer = frame.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def release(*frames: DataFrame) -> None:
    """Delete the files of tables that `materialise` wrote and nothing reads any more."""
    for frame in frames:
        for folder in {uri.rsplit("/", 1)[0] for uri in frame.inputFiles()}:
            path = frame.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(frame.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def store(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI and the path in it; works on executors."""
    filesystem, path = pafs.FileSystem.from_uri(uri)
    return filesystem, path


def write_whole(uri: str, name: str, parts: list[bytes]) -> str:
    """Write a file under a temporary name, then move it in place; a retried task replaces it whole."""
    filesystem, folder = store(uri)
    filesystem.create_dir(folder, recursive=True)
    temporary, final = f"{folder}/.{name}.{uuid.uuid4().hex}", f"{folder}/{name}"
    with filesystem.open_output_stream(temporary) as out:
        for part in parts:
            out.write(part)
    filesystem.move(temporary, final)
    return f"{uri}/{name}"


def read_only(uri: str) -> pa.NativeFile:
    """A random-access file: memory-mapped where the store is a local path."""
    filesystem, path = store(uri)
    if isinstance(filesystem, pafs.LocalFileSystem) and os.path.getsize(path):
        return pa.memory_map(path)
    return filesystem.open_input_file(path)
