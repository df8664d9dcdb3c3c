"""Index files in the binary layout (little-endian), read into tables, and barrels written in it.

A file of records is read by one task, in pieces; postings are read by as many tasks as there are ranges of tokens, each of
which seeks its blocks by the offsets. A file that ends within a record, or has another number of records than its
header says, raises ``ValueError``.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes read, and records given on, at once.
PIECE = 16 << 20
BATCH = 50_000
#: Bytes of postings that a task is meant to read.
TASK_BYTES = 64 << 20

# Numbers of 32 bits before the list of a record, and what they are; the last one is the length of the list.
LISTS = {"forward": ("doc_id", "count"), "inverted": ("token_id", "count"), "barrel": ("token_id", "doc_id", "freq", "count")}
OFFSET = np.dtype([("token_id", "<u4"), ("offset", "<u8"), ("length", "<u8")])
MAPPING = np.dtype([("token_id", "<u4"), ("barrel_id", "<u4")])


def _open(path: str):
    import pyarrow.fs as pafs

    fs, p = pafs.FileSystem.from_uri(path if "://" in path else f"file://{path}" if not path.startswith("file:") else path.replace("file:", "file://", 1))
    return fs, p


def list_records(pieces: Iterator[bytes], width: int) -> Iterator[tuple[tuple[int, ...], np.ndarray]]:
    """(head, list) of records of ``width`` numbers, the last of them the length of the list that follows."""
    rest = b""
    for piece in pieces:
        data, at = rest + piece, 0
        while at + 4 * width <= len(data):
            head = struct.unpack_from(f"<{width}I", data, at)
            end = at + 4 * (width + head[-1])
            if end > len(data):
                break
            yield head, np.frombuffer(data, "<u4", head[-1], at + 4 * width)
            at = end
        rest = data[at:]
    if rest:
        raise ValueError("the file ends within a record")


def _pieces(stream) -> Iterator[bytes]:
    while piece := stream.read(PIECE):
        yield piece


def _one_task(spark: SparkSession, path: str, run, schema: str) -> DataFrame:
    return spark.createDataFrame([(path,)], "path string").coalesce(1).mapInArrow(lambda batches: (out for b in batches for p in b.column(0).to_pylist() for out in run(p)), schema)


def read_lists(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """The numbers before the list, and ``list``, of a file of ``kind``: forward, inverted (both begin with the number of records), or barrel."""
    names = LISTS[kind]
    headed = kind != "barrel"

    def run(p: str) -> Iterator[pa.RecordBatch]:
        fs, q = _open(p)
        with fs.open_input_stream(q, compression=None) as f:
            first = f.read(4) if headed else b""
            if headed and len(first) < 4:
                raise ValueError("the file has no header")
            seen, heads, lists = 0, [], []

            def batch() -> pa.RecordBatch:
                cols = [pa.array([h[k] for h in heads], pa.int64()) for k in range(len(names) - 1)]
                return pa.RecordBatch.from_arrays([*cols, pa.array([x.tolist() for x in lists], pa.list_(pa.int64()))], [*names[:-1], "list"])

            for head, values in list_records(_pieces(f), len(names)):
                heads.append(head)
                lists.append(values)
                seen += 1
                if len(heads) == BATCH:
                    yield batch()
                    heads, lists = [], []
            yield batch()
            if headed and seen != struct.unpack("<I", first)[0]:
                raise ValueError(f"{seen} records, not as many as the header says")

    return _one_task(spark, path, run, ", ".join(f"{n} long" for n in names[:-1]) + ", list array<long>")


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """token_id, token of a lexicon file, whose records are length, bytes and number."""

    def run(p: str) -> Iterator[pa.RecordBatch]:
        fs, q = _open(p)
        with fs.open_input_stream(q, compression=None) as f:
            data = f.read()  # one entry a distinct token
        at, ids, tokens = 4, [], []
        n = struct.unpack_from("<I", data)[0] if len(data) >= 4 else -1
        while at < len(data) and at + 4 <= len(data):
            end = at + 4 + struct.unpack_from("<I", data, at)[0]
            if end + 4 > len(data):
                raise ValueError("the file ends within a record")
            tokens.append(data[at + 4 : end].decode())
            ids.append(struct.unpack_from("<I", data, end)[0])
            at = end + 4
        if len(ids) != n:
            raise ValueError(f"{len(ids)} records, not as many as the header says")
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(tokens, pa.string())], ["token_id", "token"])

    return _one_task(spark, path, run, "token_id long, token string")


def _table(spark: SparkSession, path: str, kind: np.dtype, head: int) -> DataFrame:
    """A file of ``head`` numbers, the last of which is the number of records, and records of one size."""
    names = list(kind.names)

    def run(p: str) -> Iterator[pa.RecordBatch]:
        fs, q = _open(p)
        with fs.open_input_stream(q, compression=None) as f:
            data = f.read()
        if len(data) < 4 * head or len(data) != 4 * head + kind.itemsize * struct.unpack_from("<I", data, 4 * (head - 1))[0]:
            raise ValueError("the file has another length than its header says")
        rows = np.frombuffer(data, kind, offset=4 * head)
        yield pa.RecordBatch.from_arrays([pa.array(rows[n].astype(np.int64)) for n in names], names)

    return _one_task(spark, path, run, ", ".join(f"{n} long" for n in names))


def read_offsets(spark: SparkSession, path: str) -> DataFrame:
    """token_id, offset, length."""
    return _table(spark, path, OFFSET, 1)


def read_barrel_map(spark: SparkSession, path: str) -> DataFrame:
    """token_id, barrel_id."""
    return _table(spark, path, MAPPING, 3)


def read_postings(spark: SparkSession, path: str, offsets: DataFrame) -> DataFrame:
    """token_id, doc_id, freq, positions of the blocks that ``offsets`` names in a file of postings."""
    total = offsets.agg(F.sum("length")).head()[0] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, q = _open(path)
        with fs.open_input_file(q) as f:
            for b in batches:
                for token, offset, length in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    f.seek(offset)
                    block = f.read(length)
                    rows = list(list_records(iter([block[4:]]), 3))
                    if len(block) != length or len(rows) != struct.unpack_from("<I", block)[0]:
                        raise ValueError(f"token {token}: its block isn't as its header and offset say")
                    for k in range(0, len(rows), BATCH):
                        part = rows[k : k + BATCH]
                        cols = [pa.array([token] * len(part), pa.int64()), pa.array([h[0] for h, _ in part], pa.int64()), pa.array([h[1] for h, _ in part], pa.int32())]
                        yield pa.RecordBatch.from_arrays([*cols, pa.array([x.tolist() for _, x in part], pa.list_(pa.int32()))], ["token_id", "doc_id", "freq", "positions"])

    ranged = offsets.select("token_id", "offset", "length").repartitionByRange(max(1, -(-total // TASK_BYTES)), "offset").sortWithinPartitions("offset")
    return ranged.mapInArrow(run, "token_id long, doc_id long, freq int, positions array<int>")


def write_barrels(postings: DataFrame, folder: str) -> DataFrame:
    """barrel_id, file, records: postings with a barrel_id as files ``barrel_<id>.bin.<part>`` in ``folder``, one for each barrel and task.

    A barrel file has no header, so a barrel's parts laid end to end are its file. Records are in the order of token, then document, within a part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, root = _open(folder)
        fs.create_dir(root, recursive=True)
        part, files, counts = TaskContext.get().partitionId(), {}, {}
        for b in batches:
            for barrel, token, doc, freq, places in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if barrel not in files:
                    files[barrel] = fs.open_output_stream(f"{root}/barrel_{barrel:02d}.bin.{part:05d}", compression=None)
                files[barrel].write(struct.pack(f"<4I{len(places)}I", token, doc, freq, len(places), *places))
                counts[barrel] = counts.get(barrel, 0) + 1
        for f in files.values():
            f.close()
        names = [f"barrel_{k:02d}.bin.{part:05d}" for k in files]
        yield pa.RecordBatch.from_arrays([pa.array(list(files), pa.int64()), pa.array(names, pa.string()), pa.array(list(counts.values()), pa.int64())], ["barrel_id", "file", "records"])

    ordered = postings.select(F.col("barrel_id").cast("long"), "token_id", "doc_id", "freq", "positions").sortWithinPartitions("barrel_id", "token_id", "doc_id")
    return ordered.mapInArrow(run, "barrel_id long, file string, records long")
