"""Texts packed into containers of fixed capacity, by Karmarkar-Karp multiway differencing.

Items are spread over shards of bounded size. In a shard, partial partitions into k windows are merged
two by two, those with the greatest imbalance first and with opposing windows on each other, until one
near-equal partition is left; where a window exceeds the capacity, k rises and the shard is done again.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrove.session import materialize

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how byte-level BPE of this family splits text.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Windows that a shard is meant to have, and bounds of its number of items.
WINDOWS = 256
SHARD_ITEMS = (128, 4096)

#: Room left, as a share, where windows over the capacity are divided again.
SLACK = 0.004

PACKED = "container_kind string, container_id string, doc_id {id}, piece_no int, token_start long, token_end long"


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, digest, tokens: a digest of each text and its length in tokens, 0 for null and empty ones. ``tokenizer`` is a path that every executor can read."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoding(tokenizer)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64())], ["doc_id", "digest", "tokens"])

    return rows.withColumn("digest", F.md5("text")).mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, digest string, tokens long")


def _items(counts: DataFrame) -> DataFrame:
    """doc_id, tokens, row: each text with a name that hangs on its id and characters alone; repeated rows, which are counted before the shuffle, are numbered."""
    n = counts.groupBy("doc_id", "digest", "tokens").agg(F.count("*").alias("copies"))
    copy = n.select("doc_id", "digest", "tokens", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    name = F.md5(F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("digest", F.lit("")), F.col("copy").cast("string")))
    return copy.select("doc_id", "tokens", name.alias("row"))


def differencing(sizes: list[int], k: int) -> list[tuple[int, list[int]]]:
    """Windows (sum, places in ``sizes``) of a partition into at most ``k``; windows without an item are left out.

    A partial partition lists its windows from the largest; those it lacks are empty. Equal imbalances go by the first item's place.
    """
    heap = [(-s, i, [(-s, i, [i])]) for i, s in enumerate(sizes)]  # sums are negated, so that plain order is the order
    heapq.heapify(heap)
    while len(heap) > 1:
        _, i, a = heapq.heappop(heap)
        _, j, b = heapq.heappop(heap)
        over = len(a) + len(b) - k
        if over <= 0:
            merged = a + b
        else:  # opposing windows lie on each other: the smallest of one on the largest of the other's smallest
            merged = a[: len(a) - over] + b[: len(b) - over]
            merged += [(s + t, min(p, q), x + y) for (s, p, x), (t, q, y) in zip(a[len(a) - over :], reversed(b[len(b) - over :]), strict=True)]
        merged.sort()
        low = merged[-1][0] if len(merged) == k else 0
        heapq.heappush(heap, (merged[0][0] - low, min(i, j), merged))
    return [(-s, x) for s, _, x in heap[0][2]] if heap else []


def pack(sizes: list[int], capacity: int, slack: float = SLACK) -> list[list[int]]:
    """Windows of places in ``sizes``, none over ``capacity``. Every size must be at most that.

    Windows that fit are kept. The items of those that don't are divided again, together with the emptiest
    windows, as many as bring the room to ``slack`` of the whole; where all of them don't, the count rises.
    """
    done: list[list[int]] = []
    left = list(range(len(sizes)))
    k = max(1, -(-sum(sizes) // capacity))
    while left:
        windows = [(s, [left[p] for p in x]) for s, x in differencing([sizes[p] for p in left], k)]
        again = [w for w in windows if w[0] > capacity]
        fit = sorted((w for w in windows if w[0] <= capacity), key=lambda w: -w[0])
        if again:
            room = sum(capacity - s for s, _ in again)
            while fit and room < slack * capacity * len(again):
                again.append(fit.pop())
                room += capacity - again[-1][0]
        done += [x for _, x in fit]
        left = sorted(p for _, x in again for p in x)
        k = len(again) + (not fit or room < slack * capacity * len(again)) if again else 0
    return done


def pack_documents(
    docs: DataFrame, containers: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER
) -> DataFrame:
    """container_kind, container_id, doc_id, piece_no, token_start, token_end: every text in a container of every kind.

    ``containers``: container_kind, capacity_tokens; a small table of kinds, of which rows with a null or no positive
    capacity are ignored. A text longer than the capacity is divided into full pieces and a rest, no other one
    is; a full piece is a container of its own. Null and empty texts are items of size 0. Rows that
    repeat an id are items of their own. Shards and containers hang on ids and texts, not on how the table is partitioned.
    """
    kinds = {r[0]: r[1] for r in containers.where("capacity_tokens > 0").select("container_kind", "capacity_tokens").distinct().collect()}
    id_type = docs.schema[doc_id].dataType.simpleString()
    schema = PACKED.format(id=id_type)
    sizes = materialize(_items(token_counts(docs, doc_id, text, tokenizer)))
    if not kinds:
        return sizes.limit(0).select(F.lit("").alias("container_kind"), F.lit("").alias("container_id"), "doc_id", F.lit(0).alias("piece_no"), F.lit(0).cast("long").alias("token_start"), F.lit(0).cast("long").alias("token_end"))
    n = F.col("tokens")
    stats = sizes.agg(F.count("*").alias("n"), *[F.sum(F.when(n <= c, n).otherwise(n % c)).alias(f"s{i}") for i, c in enumerate(kinds.values())]).head()
    out = []
    for i, (kind, cap) in enumerate(kinds.items()):
        items = max(SHARD_ITEMS[0], min(SHARD_ITEMS[1], int(WINDOWS * cap * (stats.n or 0) / max(1, stats[f"s{i}"] or 0))))
        shards = max(1, -(-(stats.n or 0) // items))
        out.append(F.struct(F.lit(kind).alias("container_kind"), F.lit(cap).cast("long").alias("capacity"), F.pmod(F.xxhash64("row", F.lit(i)), F.lit(shards)).alias("shard")))
    spread = sizes.select("doc_id", "tokens", "row", F.inline(F.array(*out)))
    cap = F.col("capacity")
    whole = F.when(F.col("tokens") > cap, F.floor(F.col("tokens") / cap)).otherwise(0)
    full = spread.where(whole > 0).select("container_kind", "capacity", "doc_id", "row", F.explode(F.sequence(F.lit(0), (whole - 1).cast("int"))).alias("piece_no")).select(
        "container_kind",
        F.concat_ws("-", "container_kind", F.lit("full"), "row", F.col("piece_no").cast("string")).alias("container_id"),
        "doc_id", "piece_no", (F.col("piece_no") * cap).alias("token_start"), ((F.col("piece_no") + 1) * cap).alias("token_end"),
    )
    rest = spread.select("container_kind", "capacity", "shard", "doc_id", "row", whole.cast("int").alias("piece_no"), "tokens", (F.col("tokens") - whole * cap).alias("size")).where(
        (F.col("size") > 0) | (F.col("tokens") == 0)
    )

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("row")
        size = t.column("size").to_pylist()
        kind, shard = t.column("container_kind")[0].as_py(), t.column("shard")[0].as_py()
        name = [""] * len(size)
        for w, places in enumerate(pack(size, t.column("capacity")[0].as_py())):
            for p in places:
                name[p] = f"{kind}-{shard}-{w}"
        end = t.column("tokens").to_pylist()
        return pa.table([t.column("container_kind"), pa.array(name, pa.string()), t.column("doc_id"), t.column("piece_no"), pa.array([e - s for e, s in zip(end, size, strict=True)], pa.int64()), pa.array(end, pa.int64())], [x.split()[0] for x in schema.split(", ")])

    return full.unionByName(rest.groupBy("container_kind", "shard").applyInArrow(run, schema))


def fill(packed: DataFrame, containers: DataFrame) -> DataFrame:
    """container_kind, containers, tokens, fill: how full the containers of each kind are on the whole."""
    per = packed.groupBy("container_kind").agg(F.countDistinct("container_id").alias("containers"), F.sum(F.col("token_end") - F.col("token_start")).alias("tokens"))
    return per.join(F.broadcast(containers.select("container_kind", "capacity_tokens")), "container_kind").select(
        "container_kind", "containers", "tokens", (F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("fill")
    )


def faults(packed: DataFrame, containers: DataFrame) -> DataFrame:
    """container_kind, texts, over_capacity, divided_in_vain, gaps: how many texts were packed into containers of each kind, and how many
    containers hold more than they can, texts that would have fit are divided, and divided texts have a place in no piece or two: none of each."""
    cap = containers.where("capacity_tokens > 0").select("container_kind", F.col("capacity_tokens").cast("long").alias("cap")).distinct()
    size = F.col("token_end") - F.col("token_start")
    over = packed.groupBy("container_kind", "container_id").agg(F.sum(size).alias("n")).join(F.broadcast(cap), "container_kind").groupBy("container_kind").agg(F.count_if(F.col("n") > F.col("cap")).alias("over_capacity"))
    text = packed.groupBy("container_kind", "doc_id").agg(F.sum(size).alias("n"), F.max("token_end").alias("whole"), F.count_if(F.col("token_start") == 0).alias("copies"), F.count("*").alias("pieces"))
    each = text.join(F.broadcast(cap), "container_kind").groupBy("container_kind").agg(
        F.sum("copies").alias("texts"),
        F.count_if((F.col("pieces") > F.col("copies")) & (F.col("whole") <= F.col("cap"))).alias("divided_in_vain"),
        F.count_if((F.col("copies") == 1) & (F.col("n") != F.col("whole"))).alias("gaps"),
    )
    return each.join(over, "container_kind").select("container_kind", "texts", "over_capacity", "divided_in_vain", "gaps")
