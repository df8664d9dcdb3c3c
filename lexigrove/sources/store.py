"""An index as Parquet tables in a folder, laid out for lookups.

Postings are partitioned by barrel and sorted by token, so that a lookup reads one barrel's row
groups that can hold the token. A build goes to a new folder and becomes the current one by a single
rename: of the numbered pointer files the last one holds, so there is no moment without an index.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrove.operators.barrels import Barrels
from lexigrove.operators import storage
from lexigrove.operators.storage import HEAVY_KB, HEAVY_TOP, heavy, heavy_of, offsets
from lexigrove.operators.validate import block_order, compare_postings, sample_tokens
from lexigrove.session import filesystem

TABLES = ("doc_ids", "lexicon", "forward", "inverted", "barrel_map", "postings", "offsets", "heavy_manifest", "heavy_postings")
POINTER = "current-"
#: Builds that stay when a new one is published: readers of the one before may still be at work.
KEPT = 2

# What a lookup ends with.
FOUND, NO_LEXICON, NO_INDEX, NO_TERM, NO_OFFSET = 0, 2, 3, 4, 5
MANIFEST = "token_id long, bytes long, doc_count long, path string, total_heavy long"


def _write(spark: SparkSession, path: str, data: bytes) -> None:
    fs, p = filesystem(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(data))
    out.close()


def _pointers(spark: SparkSession, folder: str) -> list[str]:
    """Names of the pointer files, the current one last."""
    fs, p = filesystem(spark, folder)
    if not fs.exists(p):
        return []
    return sorted(f.getPath().getName() for f in fs.listStatus(p) if f.getPath().getName().startswith(POINTER))


def _build_of(spark: SparkSession, folder: str, pointer: str) -> str:
    return spark.read.text(f"{folder}/{pointer}").head()[0]


def publish(spark: SparkSession, folder: str, build: str, keep: int = KEPT) -> None:
    """Make ``build`` the current one of ``folder`` by one rename, and delete builds but the last ``keep``. Two at once both get a number."""
    tmp = f"{folder}/.pointer-{uuid.uuid4().hex}"
    _write(spark, tmp, build.rpartition("/")[2].encode())
    fs, source = filesystem(spark, tmp)
    while True:
        last = _pointers(spark, folder)
        number = int(last[-1].removeprefix(POINTER)) + 1 if last else 0
        target = filesystem(spark, f"{folder}/{POINTER}{number:08d}")[1]
        if not fs.exists(target) and fs.rename(source, target):
            break
    for old in _pointers(spark, folder)[:-keep]:
        gone = filesystem(spark, f"{folder}/{_build_of(spark, folder, old)}")[1]
        fs.delete(filesystem(spark, f"{folder}/{old}")[1], False)
        fs.delete(gone, True)


def write_index(barrels: Barrels, folder: str, threshold_kb: float = HEAVY_KB, top: int = HEAVY_TOP, keep: int = KEPT) -> str:
    """Write all tables to a new build in ``folder`` and make it the current one; the build's folder."""
    index = barrels.index
    spark = index.spark
    build = f"{folder}/build-{uuid.uuid4().hex}"
    index.doc_ids().write.csv(f"{build}/doc_ids_tsv", sep="\t")
    index.doc_ids().write.parquet(f"{build}/doc_ids")
    index.lexicon.repartitionByRange("token").sortWithinPartitions("token").write.parquet(f"{build}/lexicon")
    index.forward().write.parquet(f"{build}/forward")
    index.inverted().repartitionByRange("token_id", "block_no").sortWithinPartitions("token_id", "block_no").write.parquet(f"{build}/inverted")
    barrels.barrel_map().repartitionByRange("token_id").sortWithinPartitions("token_id").write.parquet(f"{build}/barrel_map")
    posts = barrels.postings()
    posts.repartitionByRange("barrel_id", "token_id", "doc_id").sortWithinPartitions("barrel_id", "token_id", "doc_id").write.partitionBy("barrel_id").parquet(f"{build}/postings")
    offsets(index.postings).sortWithinPartitions("token_id").write.parquet(f"{build}/offsets")
    _write_heavy(spark, build, threshold_kb, top)
    publish(spark, folder, build, keep)
    return build


def _write_heavy(spark: SparkSession, build: str, threshold_kb: float, top: int) -> None:
    """Heavy lists and their manifest, from the build's own postings."""
    posts = spark.read.parquet(f"{build}/postings")
    heavy(posts, threshold_kb, top).write.mode("overwrite").json(f"{build}/heavy_manifest")
    chosen = spark.read.schema(MANIFEST).json(f"{build}/heavy_manifest")
    heavy_of(posts, chosen.select("token_id"), top).repartitionByRange("token_id", "doc_id").sortWithinPartitions("token_id", "doc_id").write.mode("overwrite").parquet(f"{build}/heavy_postings")


def current_build(spark: SparkSession, folder: str) -> str:
    """Folder of the current build; ``FileNotFoundError`` where there is none."""
    pointers = _pointers(spark, folder)
    if not pointers:
        raise FileNotFoundError(f"{folder} holds no index")
    return f"{folder}/{_build_of(spark, folder, pointers[-1])}"


def read_index_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the current build; ``FileNotFoundError`` where there is no build or it lacks the table."""
    if name not in TABLES:
        raise KeyError(name)
    path = f"{current_build(spark, folder)}/{name}"
    fs, p = filesystem(spark, path)
    if not fs.exists(p):
        raise FileNotFoundError(path)
    return spark.read.schema(MANIFEST).json(path) if name == "heavy_manifest" else spark.read.parquet(path)


@dataclass
class Lookup:
    """What a lookup ends with (``code``, FOUND or one of NO_...), the term's number, how many documents hold it, the first of them
    (doc_id, freq; None without any), whether they came from a heavy list, and the milliseconds of each step."""

    code: int
    token_id: int | None = None
    doc_count: int = 0
    rows: list = field(default_factory=list)
    heavy: bool = False
    ms: dict[str, float] = field(default_factory=dict)


def lookup(spark: SparkSession, folder: str, term: str, top: int = 10, use_heavy: bool = True) -> Lookup:
    """The first ``top`` documents, in their order, that hold ``term``, by equality that is pushed to each scan.

    The term is compared as given. A token with a heavy list is read from it, as it has no positions to skip. A token that
    the barrel map lacks is looked for in all barrels.
    """
    out = Lookup(FOUND)

    def timed(step: str, run):
        t = time.perf_counter()
        x = run()
        out.ms[step] = (time.perf_counter() - t) * 1e3
        return x

    def read(name: str, missing: int) -> DataFrame | None:
        try:
            return read_index_table(spark, folder, name)
        except FileNotFoundError:
            out.code = missing
            return None

    if not _pointers(spark, folder):
        return Lookup(NO_INDEX)
    if (lexicon := read("lexicon", NO_LEXICON)) is None:
        return out
    token = timed("lexicon", lambda: lexicon.where(F.col("token") == term).head())
    if token is None:
        out.code = NO_TERM
        return out
    out.token_id = token.token_id
    if (places := read("offsets", NO_INDEX)) is None or (posts := read("postings", NO_INDEX)) is None:
        return out
    here = F.col("token_id") == token.token_id
    place = timed("offset", lambda: places.where(here).head())
    if place is None:
        out.code = NO_OFFSET
        return out

    def source() -> DataFrame:
        if use_heavy:
            manifest, lists = read("heavy_manifest", FOUND), read("heavy_postings", FOUND)
            if manifest is not None and lists is not None and not manifest.where(here).isEmpty():
                out.heavy = True
                return lists
        barrels = read("barrel_map", FOUND)
        barrel = None if barrels is None else barrels.where(here).head()
        return posts if barrel is None else posts.where(F.col("barrel_id") == barrel.barrel_id)

    found = timed("locate", source)
    out.rows = timed("read", lambda: [(r.doc_id, r.freq) for r in found.where(here).select("doc_id", "freq").orderBy("doc_id").limit(top).collect()])
    out.doc_count = token.doc_freq
    return out


def heavy_tokens(spark: SparkSession, folder: str, threshold_kb: float, top: int) -> DataFrame:
    """The manifest that a threshold and number would give, from the stored postings; 0 for all heavy tokens."""
    return heavy(read_index_table(spark, folder, "postings"), threshold_kb, top)


def rewrite_heavy(spark: SparkSession, folder: str, threshold_kb: float, top: int) -> None:
    """Replace the current build's heavy lists. A lookup meanwhile may find none and read the postings instead."""
    _write_heavy(spark, current_build(spark, folder), threshold_kb, top)


def validate(spark: SparkSession, folder: str, tokens: list[int] | None = None, sample: int | None = None, seed: int = 0) -> DataFrame:
    """Stored postings against those that the stored forward table gives, and the order of their blocks: see
    :func:`compare_postings` and :func:`block_order`. ``tokens``: only these; ``sample``: only so many, drawn by a seeded hash."""
    posts = read_index_table(spark, folder, "postings")
    forward = read_index_table(spark, folder, "forward").select("doc_id", F.posexplode("token_ids").alias("pos", "token_id"))
    if sample is not None:
        tokens = [r.token_id for r in sample_tokens(read_index_table(spark, folder, "offsets"), sample, seed).select("token_id").collect()]
    if tokens is not None:
        posts, forward = (x.where(F.col("token_id").isin(tokens)) for x in (posts, forward))
    again = forward.groupBy("token_id", "doc_id").agg(F.count("*").cast("int").alias("freq"), F.sort_array(F.collect_list("pos")).alias("positions"))
    # Hadoop's committer numbers files by task, and tasks by range.
    placed = posts.select("token_id", "doc_id", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("__file"), F.col("_metadata.row_index").alias("__row"))
    return compare_postings(posts, again).unionByName(block_order(placed, ["__file", "__row"]))


def storage_stats(barrels: Barrels) -> dict:
    """What the storage report holds: files and their sizes, blocks, the largest of them, barrels and memory, each a few rows."""
    index = barrels.index
    rows = lambda df: [r.asDict() for r in df.collect()]
    return {
        "artifacts": {r["artifact"]: r["bytes"] for r in rows(storage.artifact_sizes(index, barrels))},
        "vocabulary": index.lexicon.count(),
        "documents": index.docs.count(),
        "blocks": rows(storage.block_stats(index.postings))[0],
        "largest_blocks": rows(storage.largest_blocks(index.postings)),
        "barrels": rows(barrels.analysis().orderBy(F.desc("size_bytes"), "barrel_id")),
        "memory": rows(storage.memory_estimate(index))[0],
    }


def write_stats(barrels: Barrels, path: str) -> None:
    """Write the storage report as one JSON file."""
    _write(barrels.index.spark, path, json.dumps(storage_stats(barrels), indent=1).encode())


def lookup_timings(spark: SparkSession, folder: str, k: int = 10, seed: int = 0, terms: list[str] | None = None, warm: bool = False) -> DataFrame:
    """term, token_id, lexicon_ms, offset_ms, locate_ms, read_ms, postings of ``terms``, or of ``k`` tokens drawn by a seeded hash, in a stored index.

    ``warm``: each lookup is done once before it is timed. A term that isn't found has null times and no postings.
    """
    if terms is None:
        lexicon = read_index_table(spark, folder, "lexicon")
        terms = [r.token for r in sample_tokens(lexicon, k, seed).select("token").collect()]
    out = []
    for t in terms:
        if warm:
            lookup(spark, folder, t)
        r = lookup(spark, folder, t)
        out.append((t, r.token_id, *(r.ms.get(x) for x in ("lexicon", "offset", "locate", "read")), r.doc_count))
    return spark.createDataFrame(out, "term string, token_id long, lexicon_ms double, offset_ms double, locate_ms double, read_ms double, postings long")
