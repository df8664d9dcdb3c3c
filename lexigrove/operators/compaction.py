"""Very many small files of JSON objects joined into few well-sized ones, by their bytes.

Files are cut at object boundaries (quotes, escapes and brackets only), so that arrays, lines, byte order
marks and objects cut off at a file's end are handled alike. Which records stay is decided on their keys
and places alone, without their bytes. Then each file's bytes move once, to the task that lays the
surviving stretches of many files end to end: objects that stand line by line are copied as one stretch,
a compressed file that stays whole as its own complete Zstandard frames. What is written is checked by
length and checksum when it is read.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrove.session import materialize, shared_folder
from lexigrove.sources.tables import spread, table

#: Raw bytes that a consolidated file is meant to have, and how far it may go beyond. A record longer than that has a file to itself.
TARGET_BYTES = 128 << 20
SLACK = 1.25
#: Raw bytes of a Zstandard frame within it.
FRAME_BYTES = 4 << 20
MANIFEST = "bin long, records long, raw_bytes long, raw_crc long, file_bytes long, file_crc long"
#: Most tasks that read consolidated files, each of which reads some of them.
READERS = 50_000

# Fixed value: how a complete Zstandard frame begins.
ZSTD = b"\x28\xb5\x2f\xfd"
BOM = b"\xef\xbb\xbf"

_GAP = re.compile(rb"[\s,\[\]\xef\xbb\xbf]*+")
_FLAT = re.compile(rb'\{(?:[^{}"]++|"(?:[^"\\]++|\\.)*+")*+\}', re.S)
_MARKS = re.compile(rb'"(?:[^"\\]|\\.)*"|[{}]', re.S)


def object_slices(content: bytes) -> Iterator[tuple[int, int]]:
    """Start and end of each whole outermost JSON object in ``content``; one that is cut off gives none.

    A quote that is never closed ends the search: it belongs to a cut-off object.
    """
    at = 0
    while True:
        at = _GAP.match(content, at).end()
        if not (m := _FLAT.match(content, at)):
            break
        yield m.span()
        at = m.end()
    depth, start = 0, 0  # from the first object that holds others
    for m in _MARKS.finditer(content, at):
        if b'"' in content[at : m.start()]:  # an open string was skipped
            return
        at = m.end()
        c = content[m.start() : m.start() + 1]
        if c == b"{":
            if depth == 0:
                start = m.start()
            depth += 1
        elif c == b"}" and depth:
            depth -= 1
            if depth == 0:
                yield start, m.end()


def _decompressed(content: bytes) -> tuple[bytes, bool]:
    """What the Zstandard frames of ``content`` hold, and whether they are all complete; other bytes are given as they are, and not as frames.

    A frame that is cut off gives what can be read of it, a damaged one nothing, and no frame after it is read.
    """
    if not content.startswith(ZSTD):
        return content, False
    import zstandard

    out, rest = [], content
    while rest.startswith(ZSTD):
        frame = zstandard.ZstdDecompressor().decompressobj()
        try:
            out.append(frame.decompress(rest))
        except zstandard.ZstdError:
            break
        if not frame.eof:
            break
        rest = frame.unused_data
    return b"".join(out), not rest


class _Keys:
    """Reads the members that name a record from an object's bytes, as JSON text: 3 and "3" differ, spellings of one string don't."""

    def __init__(self, names: list[str]):
        self.names = names
        self.find = re.compile(rb'(?<!\\)"(' + b"|".join(re.escape(n.encode()) for n in names) + rb')"\s*+:\s*+("(?:[^"\\]++|\\.)*+"|[^\s,{}\[\]"]++)', re.S)
        self.slots = {n.encode(): i for i, n in enumerate(names)}

    def _text(self, value: object) -> str | None:
        return None if value is None else json.dumps(value, ensure_ascii=False, sort_keys=True)

    def __call__(self, raw: bytes) -> list[str] | None:
        """The values, or None where one is missing, null or unreadable."""
        found = self.find.findall(raw)
        if len(found) == len(self.names) and raw.count(b"{") == 1 and len({n for n, _ in found}) == len(found):
            out: list[str | None] = [""] * len(found)
            for name, literal in found:
                plain = literal.isdigit() and literal[:1] != b"0" or literal == b"0" or literal[:1] == b'"' and b"\\" not in literal
                try:
                    out[self.slots[name]] = literal.decode() if plain else self._text(json.loads(literal))
                except ValueError:
                    return None
        else:  # nested, repeated or oddly written members
            try:
                whole = json.loads(raw)
                out = [self._text(whole.get(n)) for n in self.names]
            except ValueError:
                return None
        return None if None in out else out


def _file_id(order: tuple[str, ...], content: str) -> Column:
    """Digest of a file's order columns and bytes."""
    return F.unhex(F.md5(F.concat_ws("|", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in order], F.md5(F.col(f"`{content}`").cast("binary")))))


def record_places(files: DataFrame, names: list[str], order: tuple[str, ...], content: str = "content") -> DataFrame:
    """order columns, file, keys, other, piece, start, end: a row for each whole object of each file, without its bytes.

    ``keys`` is null where a member of ``names`` is missing, null or unreadable; ``other`` then names the record by
    its bytes and by how many objects before it in the file have the same bytes, so that none is lost or
    folded with a different one, while a copy in another file is. Null and empty files give no row.
    """
    kept = files.select(*[F.col(f"`{c}`") for c in order], _file_id(order, content).alias("file"))
    extra = "keys array<string>, other binary, piece int, start long, end long"
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields), extra])
    n = len(order) + 1
    keys = _Keys(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            take, named, other, piece, start, end = [], [], [], [], [], []
            for i, c in enumerate(b.column(n).to_pylist()):
                if not c:
                    continue
                c, _ = _decompressed(c)
                same: Counter[bytes] = Counter()
                for k, (s, e) in enumerate(object_slices(c)):
                    key = keys(c[s:e])
                    if key is None:
                        digest = hashlib.md5(c[s:e]).digest()
                        same[digest] += 1
                        other.append(digest + same[digest].to_bytes(4, "big"))
                    else:
                        other.append(None)
                    take.append(i)
                    named.append(key)
                    piece.append(k)
                    start.append(s)
                    end.append(e)
            cols = [col.take(pa.array(take, pa.int64())) for col in b.columns[:n]]
            new = [pa.array(named, pa.list_(pa.string())), pa.array(other, pa.binary()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(end, pa.int64())]
            yield pa.RecordBatch.from_arrays([*cols, *new], [*order, "file", "keys", "other", "piece", "start", "end"])

    return files.select(*[F.col(f"`{c}`") for c in order], _file_id(order, content).alias("file"), F.col(f"`{content}`").cast("binary")).mapInArrow(run, schema)


def survivors(places: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """order columns, file, size, kept: the stretches that stay of each file, in order. Of records with one key the last in ``order`` stays.

    Keys and places go to the shuffle, not bytes; a group of the second step is the records of one file.
    """
    by = [F.col(f"`{c}`") for c in order]
    last = places.groupBy("keys", "other").agg(F.max(F.struct(*by, "piece", "file", "start", "end")).alias("__r"))
    rows = last.select("__r.*")
    return rows.groupBy(*by, "file").agg(F.sum(F.col("end") - F.col("start") + 1).alias("size"), F.sort_array(F.collect_list(F.struct("start", "end"))).alias("kept"))


def _stretches(content: bytes, kept: list[tuple[int, int]]) -> Iterator[tuple[int, int, int]]:
    """Start, end and number of objects: neighbours that stand on lines of their own are one stretch."""
    at = 0
    while at < len(kept):
        s, e = kept[at]
        n = 1
        if content.find(b"\n", s, e) < 0:
            while at + n < len(kept) and kept[at + n][0] == e + 1 and content[e] == 10 and content.find(b"\n", *kept[at + n]) < 0 and content.find(b"\r", *kept[at + n]) < 0:
                e = kept[at + n][1]
                n += 1
        yield s, e, n
        at += n


class _Container:
    """One consolidated file in the making: frames go to a hidden file, which gets its name when it is complete."""

    def __init__(self, folder: str, number: int):
        import pyarrow.fs as pafs
        import zstandard

        self.fs, self.root = pafs.FileSystem.from_uri(_uri(folder))
        self.fs.create_dir(self.root, recursive=True)
        self.number, self.tmp = number, f"{self.root}/.{uuid.uuid4().hex}.tmp"
        self.out = self.fs.open_output_stream(self.tmp, compression=None)
        self.z = zstandard.ZstdCompressor(write_checksum=True, write_content_size=True)
        self.part: list[bytes] = []
        self.size = self.raw = self.crc = self.records = self.file_bytes = self.file_crc = 0

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.file_bytes += len(data)
        self.file_crc = zlib.crc32(data, self.file_crc)

    def flush(self) -> None:
        if self.part:
            self._write(self.z.compress(b"".join(self.part)))
            self.part, self.size = [], 0

    def add(self, lines: bytes, n: int, frames: bytes | None = None) -> None:
        """``lines``: ``n`` records, each with its line end; ``frames``: complete frames that hold just these."""
        self.raw += len(lines)
        self.crc = zlib.crc32(lines, self.crc)
        self.records += n
        if frames is not None:
            self.flush()
            self._write(frames)
            return
        self.part.append(lines)
        self.size += len(lines)
        if self.size >= FRAME_BYTES:
            self.flush()

    def close(self) -> tuple[int, ...]:
        self.flush()
        self.out.close()
        self.fs.move(self.tmp, f"{self.root}/{_name(self.number)}")
        return self.number, self.records, self.raw, self.crc, self.file_bytes, self.file_crc


def _uri(folder: str) -> str:
    return folder if "://" in folder else f"file://{folder}" if not folder.startswith("file:") else folder.replace("file:", "file://", 1)


def _name(number: int) -> str:
    return f"bin-{number:016d}.jsonl.zst"


def write_containers(files: DataFrame, kept: DataFrame, order: tuple[str, ...], folder: str, content: str = "content", target: int = TARGET_BYTES) -> DataFrame:
    """Write what :func:`survivors` keeps of ``files`` as files ``bin-<number>.jsonl.zst`` of ``folder``; the manifest of what was written.

    Files and their kept stretches are brought together by range-partitioning both in one shuffle, a partition for
    each ``target`` bytes; a task streams through its files and holds one frame. The number of a file
    is its partition's and its place in it, so a repeated task writes the same bytes under the same names.
    """
    spark = files.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    by = [F.col(f"`{c}`") for c in order]
    total = kept.agg(F.sum("size")).head()[0]
    if not total:
        return spark.createDataFrame([], MANIFEST)
    most = int(target * SLACK)
    a = kept.select(*by, "file", F.lit(0).alias("__kind"), "kept", F.lit(None).cast("binary").alias("__content"))
    b = files.where(F.octet_length(F.col(f"`{content}`")) > 0).select(*by, _file_id(order, content).alias("file"), F.lit(1).alias("__kind"), F.lit(None).cast(a.schema["kept"].dataType).alias("kept"), F.col(f"`{content}`").cast("binary").alias("__content"))
    ranged = a.unionByName(b).repartitionByRange(max(1, -(-total // target)), *by, "file").sortWithinPartitions(*by, "file", "__kind")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, made, box = TaskContext.get().partitionId() << 20, [], None
        file, todo = None, None
        for batch in batches:
            for f, k, data in zip(batch.column("file").to_pylist(), batch.column("kept").to_pylist(), batch.column("__content").to_pylist(), strict=True):
                if data is None:
                    file, todo = f, [(x["start"], x["end"]) for x in k]
                    continue
                if f != file or todo is None:  # nothing of it stays, or it is a repeated row
                    continue
                raw, complete = _decompressed(data)
                runs = list(_stretches(raw, todo))
                objects, todo = todo, None
                at = 0
                for s, e, n in runs:
                    whole = complete and s == 0 and len(raw) == e + 1 and raw[e] == 10
                    pieces = [(s, e, n)] if e - s < most or n == 1 else [(x, y, 1) for x, y in objects[at : at + n]]
                    at += n
                    for x, y, m in pieces:
                        if box is not None and box.raw + y - x + 1 > most:
                            made.append(box.close())
                            box = None
                        box = box or _Container(folder, base + len(made))
                        one = raw[x:y]
                        box.add((one.replace(b"\r", b" ").replace(b"\n", b" ") if m == 1 else one) + b"\n", m, data if whole and len(pieces) == 1 else None)
        if box is not None:
            made.append(box.close())
        cols = zip(*made, strict=True) if made else [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], [x.split()[0] for x in MANIFEST.split(", ")])

    return materialize(ranged.select("file", "kept", "__content").mapInArrow(write, MANIFEST))


def read_containers(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """bin, raw: the records of the files that ``manifest`` names. Raises where a file is missing or its length, checksum or number of records differs.

    Each task opens its files itself, so their bytes go through no shuffle.
    """
    m = manifest.select(*[x.split()[0] for x in MANIFEST.split(", ")])
    m = m.repartition(max(1, min(READERS, m.count())), "bin")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs as pafs
        import zstandard

        for b in batches:
            for row in b.to_pylist():
                fs, root = pafs.FileSystem.from_uri(_uri(folder))
                try:
                    with fs.open_input_stream(f"{root}/{_name(row['bin'])}", compression=None) as f:
                        data = f.read()
                except FileNotFoundError:
                    data = None
                if data is None or len(data) != row["file_bytes"] or zlib.crc32(data) != row["file_crc"]:
                    raise ValueError(f"bin {row['bin']}: the file's length or checksum differs from the manifest")
                crc = size = n = 0
                rest = b""
                with zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True) as z:
                    while chunk := z.read(FRAME_BYTES):
                        crc, size = zlib.crc32(chunk, crc), size + len(chunk)
                        *lines, rest = (rest + chunk).split(b"\n")
                        n += len(lines)
                        yield pa.RecordBatch.from_arrays([pa.array([row["bin"]] * len(lines), pa.int64()), pa.array(lines, pa.binary())], ["bin", "raw"])
                if rest or (crc, size, n) != (row["raw_crc"], row["raw_bytes"], row["records"]):
                    raise ValueError(f"bin {row['bin']}: the content's length, checksum or number of records differs from the manifest")

    return m.mapInArrow(run, "bin long, raw binary")


RECORD_KEY = "paper_id string, block_no int"
ORDER = ("written_at", "file_id")


def consolidate(files: DataFrame, folder: str, key: str = RECORD_KEY, order: tuple[str, ...] = ORDER, target: int = TARGET_BYTES) -> DataFrame:
    """Consolidate the objects of ``files`` into ``folder``; the manifest. An empty table gives an empty manifest and no file.

    ``key``: the members that name a record. Objects that lack one, or hold null in it, are records of their own: see
    :func:`record_places`. ``content`` is text, bytes, or bytes of Zstandard frames.
    """
    names = [x.split()[0] for x in key.split(",")]
    kept = materialize(survivors(record_places(files, names, order), order))
    return write_containers(files, kept, order, folder, target=target)


def _consolidated(s: SparkSession, d: str) -> tuple[str, DataFrame]:
    folder = f"{shared_folder(s)}/consolidated-{uuid.uuid4().hex}"
    return folder, consolidate(spread(table(s, d, "paper_files").select("file_id", "content", "written_at")), folder)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def read_back(s: SparkSession, d: str) -> DataFrame:
        folder, manifest = _consolidated(s, d)
        return read_containers(s, folder, manifest)

    def found(s: SparkSession, d: str) -> DataFrame:
        return read_back(s, d).select(F.from_json(F.col("raw").cast("string"), RECORD_KEY).alias("k")).select("k.paper_id", "k.block_no").distinct()

    def texts(s: SparkSession, d: str) -> DataFrame:
        return read_back(s, d).select(F.from_json(F.col("raw").cast("string"), RECORD_KEY + ", section string, text string").alias("k")).select("k.*")

    def totals(s: SparkSession, d: str) -> DataFrame:
        return _consolidated(s, d)[1].agg(F.sum("records").alias("records"))

    return {"p7_found": found, "p7_records": texts, "p7_totals": totals}
