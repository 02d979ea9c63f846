"""Result writers and manifests."""

from __future__ import annotations

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.session import qualified, spread, stored

from .readers import binary_files, file_digests

NO_KEY = "__HIVE_DEFAULT_PARTITION__"
# So many keys share a folder: a folder takes as much disk as a small file.
FOLDER_KEYS = 1000


def write_table_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """CSV with a fixed column order; other columns are left out."""
    df.select(*columns).write.mode("overwrite").csv(path, header=True, timestampFormat="yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def write_result_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_files(rows: DataFrame, folder: str, key: str, text: str) -> DataFrame:
    """One file per row, ``<key>=<least>-<most>/part-<task>-<number>.<key>=<value>.txt`` below the folder, with the text and a line end; returns ``(path)`` of
    every file, below the folder. Keys are whole numbers; the last ``<key>=`` of a path is the row's.

    Tasks open local files through Arrow, as Hadoop starts a process for each; in other stores Spark writes ``<key>=<value>/part-*.txt``. A file gets its name
    when it is whole, and names follow from the sorted rows of a task, so a task that runs again puts the same files in the same places.
    """
    uri = qualified(rows.sparkSession, folder)
    parts = spread(rows.select(key, F.coalesce(text, F.lit("")).alias("_text"))).sortWithinPartitions(key, "_text")
    if not uri.startswith("file:"):
        parts.write.option("maxRecordsPerFile", 1).option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy(key).text(folder)
        return binary_files(rows.sparkSession, folder).select("path")

    def write(batches):
        store, root = arrow_fs.FileSystem.from_uri(uri)
        task, attempt, number, made = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId(), 0, None
        for batch in batches:
            paths = []
            for value, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                least = None if value is None else value // FOLDER_KEYS * FOLDER_KEYS
                within = f"{key}={NO_KEY}" if value is None else f"{key}={least}-{least + FOLDER_KEYS - 1}"
                if within != made:
                    store.create_dir(f"{root}/{within}")
                    made = within
                path = f"{within}/part-{task:05d}-{number}.{key}={NO_KEY if value is None else value}.txt"
                draft = f"{root}/{within}/.{task}-{number}-{attempt}"
                with store.open_output_stream(draft) as out:
                    out.write(content.as_buffer())
                    out.write(b"\n")
                store.move(draft, f"{root}/{path}")
                paths.append(path)
                number += 1
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string())], ["path"])

    return stored(parts.select(key, F.col("_text").cast("binary")).mapInArrow(write, "path string"), "paths-written")


def build_manifest(files: DataFrame) -> DataFrame:
    """Name, bytes and SHA-256 of every output file; one row per file, so it grows with the files only."""
    return file_digests(files)


def manifest_totals(manifest: DataFrame) -> DataFrame:
    """File count, total bytes and one digest over the sorted per-file digests' sum (order-free)."""
    return manifest.agg(
        F.count("*").alias("files"), F.sum("bytes").alias("bytes"), F.bit_xor(F.xxhash64("name", "sha256")).alias("fingerprint")
    )
