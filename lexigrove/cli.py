"""Command line: build an index of a corpus, look terms up in it, and report on it.

    python -m lexigrove.cli build CORPUS INDEX [--stopwords FILE] [--limit N] [--barrels N] [--share X] [--threshold-kb X] [--top N]
    python -m lexigrove.cli lookup INDEX TERM [--top N]
    python -m lexigrove.cli heavy INDEX [--threshold-kb X] [--top N] [--write]
    python -m lexigrove.cli barrels | frequent INDEX
    python -m lexigrove.cli validate INDEX [--token N | --sample N]
    python -m lexigrove.cli timings INDEX [--terms A,B | --sample N] [--warm]
    python -m lexigrove.cli sweep [--hours X]

CORPUS is a root with the folders pmc_json and pdf_json, or a Parquet table with doc_id and text. A lookup ends with 2 where the
index has no lexicon, 3 where there is no index, 4 for an unknown term and 5 for one without a place; validate with 2 where
postings differ; build with 1 where nothing is left to index.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrove.functions.scalars import human_size
from lexigrove.functions.text import STOPWORDS, read_stopwords
from lexigrove.operators.barrels import FREQUENT_SHARE, NUM_BARRELS, Barrels, record_bytes
from lexigrove.operators.index import EmptyCorpus, build_index
from lexigrove.operators.storage import HEAVY_KB, HEAVY_TOP
from lexigrove.operators.validate import COMPARED
from lexigrove.session import ship, sweep
from lexigrove.sources import store
from lexigrove.sources.papers_json import read_papers

MISMATCH = 2


def _build(spark: SparkSession, a: argparse.Namespace) -> int:
    if a.corpus.endswith(".parquet"):
        docs, order = spark.read.parquet(a.corpus).withColumn("paper_id", F.col("doc_id").cast("string")), ["doc_id"]
    else:
        docs, bad = read_papers(spark, a.corpus)
        order = ["source_rank", "path"]
        for r in bad.groupBy("reason").count().collect():
            print(f"{r['count']} bad files: {r.reason}", file=sys.stderr)
    stop = read_stopwords(spark, a.stopwords) if a.stopwords else STOPWORDS
    index = build_index(docs, order, stopwords=stop, limit=a.limit)
    barrels = Barrels(index, a.barrels, a.share)
    print(store.write_index(barrels, a.index, a.threshold_kb, a.top))
    store.write_stats(barrels, f"{a.index}/storage_stats.json")
    index.forward_stats().show(truncate=False)
    return 0


_SAID = {store.NO_LEXICON: "the index has no lexicon", store.NO_INDEX: "no index", store.NO_TERM: "unknown term", store.NO_OFFSET: "no postings are stored of the term"}


def _lookup(spark: SparkSession, a: argparse.Namespace) -> int:
    found = store.lookup(spark, a.index, a.term, a.top)
    if found.code:
        print(f"{_SAID[found.code]}: {a.term}", file=sys.stderr)
        return found.code
    print(f"token_id {found.token_id}, in {found.doc_count} documents" + ", from its heavy list" * found.heavy)
    print("doc_id", "freq", sep="\t")
    for doc, freq in found.rows:
        print(doc, freq, sep="\t")
    print(", ".join(f"{k} {v:.1f} ms" for k, v in found.ms.items()), file=sys.stderr)
    return store.FOUND


def _print_all(rows: DataFrame) -> None:
    """Every row in its order, tab-separated under a line of the column names; one partition at a time is in the driver."""
    print(*rows.columns, sep="\t")
    for r in rows.toLocalIterator():
        print(*("" if x is None else x for x in r), sep="\t")


def _barrel_report(spark: SparkSession, folder: str) -> DataFrame:
    size = store.read_index_table(spark, folder, "postings").groupBy("barrel_id").agg(F.countDistinct("token_id").alias("tokens"), F.sum(record_bytes(F.col("freq"))).alias("bytes"))
    return size.withColumn("size", human_size(F.col("bytes"))).orderBy(F.desc("bytes"), "barrel_id")


def _validate(spark: SparkSession, a: argparse.Namespace) -> int:
    rows = store.validate(spark, a.index, None if a.token is None else [a.token], a.sample).orderBy("token_id", "problem").cache()
    _print_all(rows)
    return MISMATCH if rows.where(F.col("problem") != COMPARED).count() else 0


def _heavy(spark: SparkSession, a: argparse.Namespace) -> None:
    if a.threshold_kb is None and a.top is None:
        rows = store.read_index_table(spark, a.index, "heavy_manifest")
    else:
        kb, top = HEAVY_KB if a.threshold_kb is None else a.threshold_kb, HEAVY_TOP if a.top is None else a.top
        if a.write:
            store.rewrite_heavy(spark, a.index, kb, top)
        rows = store.heavy_tokens(spark, a.index, kb, top)
    _print_all(rows.orderBy(F.desc("bytes"), "token_id"))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="lexigrove", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="command", required=True)
    b = sub.add_parser("build")
    b.add_argument("corpus")
    b.add_argument("index")
    b.add_argument("--stopwords")
    b.add_argument("--limit", type=int)
    b.add_argument("--barrels", type=int, default=NUM_BARRELS)
    b.add_argument("--share", type=float, default=FREQUENT_SHARE)
    b.add_argument("--threshold-kb", type=float, default=HEAVY_KB)
    b.add_argument("--top", type=int, default=HEAVY_TOP)
    k = sub.add_parser("lookup")
    k.add_argument("index")
    k.add_argument("term")
    k.add_argument("--top", type=int, default=10)
    command = {name: sub.add_parser(name) for name in ("heavy", "barrels", "frequent", "validate", "timings")}
    for c in command.values():
        c.add_argument("index")
    command["heavy"].add_argument("--threshold-kb", type=float)
    command["heavy"].add_argument("--top", type=int)
    command["heavy"].add_argument("--write", action="store_true")
    which = command["validate"].add_mutually_exclusive_group()
    which.add_argument("--token", type=int)
    which.add_argument("--sample", type=int)
    which = command["timings"].add_mutually_exclusive_group()
    which.add_argument("--terms")
    which.add_argument("--sample", type=int, default=10)
    command["timings"].add_argument("--warm", action="store_true")
    sub.add_parser("sweep").add_argument("--hours", type=float, default=48)
    a = p.parse_args(argv)
    spark = spark or SparkSession.builder.appName("lexigrove").getOrCreate()
    ship(spark)
    try:
        if a.command == "build":
            return _build(spark, a)
        if a.command == "lookup":
            return _lookup(spark, a)
        if a.command == "validate":
            return _validate(spark, a)
        if a.command == "sweep":
            print(sweep(spark, a.hours))
        elif a.command == "heavy":
            _heavy(spark, a)
        elif a.command == "barrels":
            _print_all(_barrel_report(spark, a.index))
        elif a.command == "frequent":
            special = store.read_index_table(spark, a.index, "barrel_map").agg(F.max("barrel_id")).head()[0]
            ids = store.read_index_table(spark, a.index, "barrel_map").where(F.col("barrel_id") == special)
            _print_all(ids.join(store.read_index_table(spark, a.index, "lexicon"), "token_id", "left").orderBy("token_id").select("token_id", "token"))
        else:
            _print_all(store.lookup_timings(spark, a.index, a.sample, terms=a.terms.split(",") if a.terms else None, warm=a.warm))
        return 0
    except EmptyCorpus as e:
        print(e, file=sys.stderr)
        return 1
    except FileNotFoundError as e:
        print(e, file=sys.stderr)
        return store.NO_INDEX


if __name__ == "__main__":
    sys.exit(main())
