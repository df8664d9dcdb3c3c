"""Corpus of papers as JSON files, in the folders ``pmc_json`` and ``pdf_json`` of a root."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexigrove.functions.scalars import file_key, file_stem, non_empty
from lexigrove.session import filesystem

# Folder and tag of each source, best first.
FOLDERS = (("pmc", "pmc_json"), ("pdf", "pdf_json"))

_BLOCKS = T.ArrayType(T.StructType([T.StructField("text", T.StringType())]))
PAPER = T.StructType([
    T.StructField("paper_id", T.StringType()),
    T.StructField("metadata", T.StructType([T.StructField("title", T.StringType())])),
    T.StructField("abstract", _BLOCKS),
    T.StructField("body_text", _BLOCKS),
    T.StructField("_bad", T.StringType()),
])


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = filesystem(spark, path)
    return fs.exists(p)


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """source, source_rank, folder, path of every file, without its bytes. Absent folders are left out; an absent root raises."""
    if not _exists(spark, root):
        raise FileNotFoundError(root)
    parts = [
        spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(f"{root}/{folder}")
        .select(F.lit(tag).alias("source"), F.lit(rank).alias("source_rank"), F.lit(folder).alias("folder"), "path")
        for rank, (tag, folder) in enumerate(FOLDERS) if _exists(spark, f"{root}/{folder}")
    ]
    if not parts:
        return spark.createDataFrame([], "source string, source_rank int, folder string, path string")
    return reduce(DataFrame.unionByName, parts)


def prefer_source(files: DataFrame) -> DataFrame:
    """One file for each file name up to its first dot: the best source's first path. Only paths are shuffled, as partial minima, however many files share a key."""
    best = F.min(F.struct("source_rank", "path", "source", "folder")).alias("__b")
    return files.groupBy(file_key(F.col("path"), encoded=False).alias("__key")).agg(best).select("__b.source", "__b.source_rank", "__b.folder", "__b.path")


def read_files(files: DataFrame, root: str) -> DataFrame:
    """``files`` with the column value: the text of each, read by the task that needs it. A file that is gone meanwhile raises."""
    schema = T.StructType([*files.schema.fields, T.StructField("value", T.StringType())])
    names = files.columns
    at_folder, at_path = names.index("folder"), names.index("path")
    uri = root if "://" in root else f"file://{root}" if not root.startswith("file:") else root.replace("file:", "file://", 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs as pafs

        fs, base = pafs.FileSystem.from_uri(uri)
        for b in batches:
            for i, (folder, path) in enumerate(zip(b.column(at_folder).to_pylist(), b.column(at_path).to_pylist(), strict=True)):
                with fs.open_input_stream(f"{base}/{folder}/{path.rpartition('/')[2]}", compression=None) as f:
                    text = f.read().decode("utf-8", "replace")
                yield pa.RecordBatch.from_arrays([*(c.slice(i, 1) for c in b.columns), pa.array([text])], [*names, "value"])

    return files.mapInArrow(run, schema)


def _section(blocks) -> F.Column:
    texts = F.filter(F.transform(F.coalesce(blocks, F.array().cast(_BLOCKS)), lambda b: b["text"]), lambda t: t != "")
    return F.array_join(texts, "\n")


def read_papers(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Documents ``source, source_rank, path, paper_id, title, text`` of a corpus, and its bad files ``source, path, reason``.

    A file is bad where it holds no single JSON object. ``paper_id`` falls back to the file's stem,
    missing titles and texts are empty; ``text`` is abstract and body, a line a block, stripped.
    """
    files = read_files(prefer_source(list_files(spark, root)), root)
    parsed = files.withColumn("p", F.from_json("value", PAPER, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    object_ = F.ltrim(F.regexp_replace("value", "^﻿", "")).startswith("{")
    bad = F.col("p").isNull() | F.col("p._bad").isNotNull() | ~object_
    text = F.concat_ws("\n", _section(F.col("p.abstract")), _section(F.col("p.body_text")))
    good = parsed.where(~bad).select(
        "source", "source_rank", "path",
        F.coalesce(non_empty(F.col("p.paper_id")), file_stem(F.col("path"), encoded=False)).alias("paper_id"),
        F.coalesce(F.col("p.metadata.title"), F.lit("")).alias("title"),
        F.regexp_replace(text, r"^\s+|\s+$", "").alias("text"),
    )
    reason = F.when(~object_, "not an object").otherwise("malformed")
    return good, parsed.where(bad).select("source", "path", reason.alias("reason"))
