"""Reading blobs from files, and signatures from and to tables of payloads."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echolith.functions import codec
from echolith.sources.wave_files import file_system


def read_blobs(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, content of the files below a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "content")


def write_blobs(blobs: DataFrame, folder: str) -> DataFrame:
    """Write every blob (id, content) to a file of its own in a folder, named by its id; id, path and length of each. A row that is written again gives the same file. Runs when the result is used."""

    def run(batches):
        system, inner = file_system(folder)
        system.create_dir(inner, recursive=True)
        for batch in batches:
            ids = batch.column("id").to_pylist()
            for key, content in zip(ids, batch.column("content"), strict=True):
                with system.open_output_stream(f"{inner.rstrip('/')}/{key}") as out:
                    out.write(content.as_buffer() if content.is_valid else b"")
            lengths = [len(c.as_buffer()) if c.is_valid else 0 for c in batch.column("content")]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array([f"{folder.rstrip('/')}/{k}" for k in ids], pa.string()), pa.array(lengths, pa.int64())], names=["id", "path", "length"])

    return blobs.select(F.col("id").cast("string").alias("id"), "content").mapInArrow(run, "id string, path string, length long")


def write_signatures(signatures: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write rows with hashes and duration_ms as Parquet, these two packed into a payload column."""
    packed = signatures.withColumn("payload", codec.to_bytes(F.col("hashes"), F.col("duration_ms"))).drop("hashes", "duration_ms")
    packed.write.mode(mode).parquet(path)


def read_signatures(spark: SparkSession, path: str) -> DataFrame:
    """The rows of write_signatures(); a payload that is not whole gives null hashes and duration_ms."""
    read = spark.read.parquet(path).withColumn("_read", codec.from_bytes(F.col("payload")))
    return read.select(*[c for c in read.columns if c not in ("payload", "_read")], "_read.hashes", "_read.duration_ms")
