"""Nested records shredded into an adjacency table, and entity tables made from it.

The adjacency table has one row a node: ``record, node, parent, label, ordinal, kind, scalar``.
A node is named by its path (``/body_text:3/ref_spans:0``), so that ids need no numbering and a
recomputed task makes the same ones. Elements of arrays are children of the object that owns the
array, with the array's label and their place as ordinal; map entries likewise, with their key in
the scalar child ``@key``. An entity table joins object nodes with their scalar children on
(record, node) and pivots these into columns; the pivot keeps the join's partitioning and order. Records are
shredded whole, once, into a table sorted by label, of which an entity reads the pages of its labels.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexigrove.session import drop_tables, file_state, materialize, stored_tables
from lexigrove.sources.tables import spread, table

NODE = "node string, parent string, label string, ordinal int, kind string, scalar string"
KEY = "@key"


def _node(node: Column, parent: Column, label: str, ordinal: Column, kind: Column | str, scalar: Column | None) -> Column:
    return F.struct(
        node.alias("node"),
        parent.alias("parent"),
        F.lit(label).alias("label"),
        ordinal.cast("int").alias("ordinal"),
        (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"),
        (F.lit(None) if scalar is None else scalar).cast("string").alias("scalar"),
    )



def _object(value: Column, kind: T.StructType, node: Column) -> list[Column]:
    """Arrays of the nodes below an object: its scalars, then what is nested in it."""
    scalars, nested = [], []
    for f in kind.fields:
        child = value[f.name]
        if isinstance(f.dataType, T.StructType):
            at = F.concat(node, F.lit(f"/{f.name}"))
            inner = F.concat(
                F.array(_node(at, node, f.name, F.lit(0), F.when(child.isNull(), "null").otherwise("object"), None)),
                *_object(child, f.dataType, at),
            )
            nested.append(inner)
        elif isinstance(f.dataType, T.ArrayType):
            nested.append(_elements(child, f.dataType.elementType, node, f.name))
        elif isinstance(f.dataType, T.MapType):
            entries = F.map_entries(child)
            nested.append(_elements(entries, T.StructType([T.StructField("key", f.dataType.keyType), T.StructField("value", f.dataType.valueType)]), node, f.name, is_map=True))
        else:
            at = F.concat(node, F.lit(f"/{f.name}"))
            scalars.append(_node(at, node, f.name, F.lit(0), "scalar", child))
    return ([F.filter(F.array(*scalars), lambda n: n["scalar"].isNotNull())] if scalars else []) + nested


def _elements(value: Column, kind: T.DataType, node: Column, label: str, is_map: bool = False) -> Column:
    # The element and its path are bound once by a lambda; else each use below would build the path anew.
    bound = F.transform(value, lambda x, i: F.struct(x.alias("x"), F.concat(node, F.lit(f"/{label}:"), i.cast("string")).alias("n"), i.alias("i"), node.alias("p")))

    def one(b: Column) -> Column:
        x, at = b["x"], b["n"]
        if is_map:
            key = _node(F.concat(at, F.lit(f"/{KEY}")), at, KEY, F.lit(0), "scalar", x["key"])
            entry = x["value"]
            below = _object(entry, kind["value"].dataType, at) if isinstance(kind["value"].dataType, T.StructType) else [F.array(_node(F.concat(at, F.lit("/@value")), at, "@value", F.lit(0), "scalar", entry))]
            return F.concat(F.array(_node(at, b["p"], label, b["i"], "object", None), key), *below)
        if isinstance(kind, T.StructType):
            return F.concat(F.array(_node(at, b["p"], label, b["i"], F.when(x.isNull(), "null").otherwise("object"), None)), *_object(x, kind, at))
        return F.array(_node(at, b["p"], label, b["i"], F.when(x.isNull(), "null").otherwise("scalar"), x))

    return F.coalesce(F.flatten(F.transform(bound, one)), F.array().cast(_NODES))


_NODES = T.ArrayType(T.StructType([
    T.StructField("node", T.StringType()), T.StructField("parent", T.StringType()), T.StructField("label", T.StringType()),
    T.StructField("ordinal", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("scalar", T.StringType()),
]))


def shred(df: DataFrame, record: str) -> DataFrame:
    """Adjacency table of ``df``, whose rows are records named by the column ``record``.

    The record itself is the object node with the empty path. Null scalars, null and empty arrays give no
    node; null elements give a node of kind ``null`` that keeps its place. Rows that share an id are
    one record in what follows: identical rows fold into one, others merge. A null id is an id like
    any other. Column names may be anything but need not avoid the node columns' names.
    """
    fields = [f for f in df.schema.fields if f.name != record]
    whole = F.struct(*[F.col(f"`{f.name}`").alias(f.name) for f in fields])
    root = F.lit("")
    nodes = F.concat(
        F.array(_node(root, F.lit(None).cast("string"), "record", F.lit(0), "object", None)),
        *_object(whole, T.StructType(fields), root),
    )
    return df.select(F.col(f"`{record}`").alias("record"), F.inline(nodes))


def entity(nodes: DataFrame, labels: list[str], scalars: list[str], depth: int | None = None) -> DataFrame:
    """record, node, parent, label, ordinal, present and a column for each of ``scalars``: the object (and null, thus not present) nodes with one of ``labels``.

    ``depth``: the number of steps of the node's path, where a label occurs at several depths. A
    missing scalar is null. Objects without any scalar still give their row.
    """
    objects = nodes.where(F.col("kind").isin("object", "null") & F.col("label").isin(labels))
    if depth is not None:
        objects = objects.where(F.length("node") - F.length(F.replace(F.col("node"), F.lit("/"), F.lit(""))) == depth)
    own = ["parent", "label", "ordinal"]
    whole = F.struct("record").alias("__k")  # not null itself where the id is, so that null ids meet and partitions stay
    left = objects.select(whole, "node", "kind", *own)
    values = []
    if scalars:
        children = nodes.where((F.col("kind") == "scalar") & F.col("label").isin(scalars)).select(F.struct("record").alias("__ck"), F.col("parent").alias("__cp"), F.col("label").alias("__cl"), "scalar")
        left = left.join(children, (F.col("__k") == F.col("__ck")) & (F.col("node") == F.col("__cp")), "left")
        values = [F.max(F.when(F.col("__cl") == s, F.col("scalar"))).alias(s) for s in scalars]
    present = F.max(F.col("kind") == "object").alias("present")
    return left.groupBy("__k", "node").agg(*[F.max(c).alias(c) for c in own], present, *values).select("__k.record", "node", *own, "present", *scalars)


def under(child: str, parent: str) -> Column:
    """Join condition of two entity tables, by their aliases; null record ids meet."""
    return F.col(f"{child}.record").eqNullSafe(F.col(f"{parent}.record")) & (F.col(f"{child}.parent") == F.col(f"{parent}.node"))


# Entities of papers

AREAS = ["abstract", "body_text", "back_matter"]
_SPAN = "array<struct<start:int,end:int,text:string,ref_id:string>>"


def paper_nodes(papers: DataFrame) -> DataFrame:
    """Stored adjacency table of papers, each part of it sorted by label."""
    return materialize(shred(papers, "record_id").sortWithinPartitions("label", "kind"))


_stored: dict[tuple[str, str], tuple[tuple, DataFrame, set[str]]] = {}


def nodes_of(spark: SparkSession, folder: str) -> DataFrame:
    """:func:`paper_nodes` of a folder's papers: whole records, shredded once an application and folder, and anew where their files have changed."""
    key, state = (spark.sparkContext.applicationId, folder), file_state(spark, f"{folder}/papers.parquet")
    if key in _stored and _stored[key][0] != state:
        drop_tables(spark, stored_tables(spark) - _stored.pop(key)[2])
    if key not in _stored:
        before = stored_tables(spark)
        nodes = paper_nodes(spread(table(spark, folder, "papers")))
        _stored[key] = (state, nodes, stored_tables(spark) - before)
    return _stored[key][1]


def records(nodes: DataFrame) -> DataFrame:
    return whole_records(nodes).drop("ingested_at")


def blocks(nodes: DataFrame) -> DataFrame:
    b = entity(nodes, AREAS, ["section", "text"], 1)
    return b.select(F.col("record").alias("record_id"), F.col("label").alias("area"), F.col("ordinal").alias("block_no"), "section", "text", "node")


def spans(nodes: DataFrame, kind: str = "ref_spans", scalars: tuple[str, ...] = ("start", "ref_id")) -> DataFrame:
    """Spans with the area, place and section of the block that is their parent."""
    s, b = entity(nodes, [kind], list(scalars), 2).alias("s"), entity(nodes, AREAS, ["section"], 1).alias("b")
    return s.join(b, under("s", "b")).select(
        F.col("s.record").alias("record_id"), F.col("b.label").alias("area"), F.col("b.ordinal").alias("block_no"), F.col("s.ordinal").alias("span_no"), "b.section", *[f"s.{x}" for x in scalars]
    )


def entries(nodes: DataFrame, label: str = "ref_entries", scalars: tuple[str, ...] = ("text", "type")) -> DataFrame:
    e = entity(nodes, [label], [KEY, *scalars], 1)
    return e.select(F.col("record").alias("record_id"), F.col(f"`{KEY}`").alias("entry_key"), *scalars)


def whole_records(nodes: DataFrame) -> DataFrame:
    own = entity(nodes, ["record"], ["source_tag", "paper_id", "ingested_at"], 0).alias("r")
    meta = entity(nodes, ["metadata"], ["title"], 1).alias("m")
    return own.join(meta, under("m", "r"), "left").select(F.col("r.record").alias("record_id"), "r.source_tag", "r.paper_id", "m.title", F.col("r.ingested_at").cast("timestamp_ntz").alias("ingested_at"))


#: Scalars of an author, of its affiliation, and of that one's location.
_AUTHOR = (["first", "last", "suffix", "email"], ["laboratory", "institution"], ["addrLine", "country"])


def _middle(nodes: DataFrame) -> DataFrame:
    """record, parent, middle: the array of middle names of each author that has any, in order."""
    m = nodes.where("label = 'middle'").groupBy("record", "parent").agg(F.sort_array(F.collect_list(F.struct("ordinal", "scalar"))).alias("m"))
    return m.select("record", "parent", F.col("m.scalar").alias("middle"))


def _with_middle(authors: DataFrame, nodes: DataFrame) -> DataFrame:
    m = _middle(nodes).alias("m")
    a = authors.alias("a")
    return a.join(m, F.col("a.record").eqNullSafe(F.col("m.record")) & (F.col("a.node") == F.col("m.parent")), "left").select("a.*", "m.middle")


def authors(nodes: DataFrame) -> DataFrame:
    """Authors of records by record and place, null ones included, with all that is nested in them; ``middle`` is null where it is null or empty."""
    own, affiliation, location = _AUTHOR
    a = _with_middle(entity(nodes, ["authors"], own, 2).where("parent = '/metadata'"), nodes).alias("a")
    f = entity(nodes, ["affiliation"], affiliation).alias("f")
    at = entity(nodes, ["location"], location).alias("l")
    both = a.join(f, under("f", "a"), "left").join(at, under("l", "f"), "left")
    return both.select(F.col("a.record").alias("record_id"), F.col("a.ordinal").alias("author_no"), "first", "middle", "last", "suffix", *affiliation, *location, "email")


def bib_authors(nodes: DataFrame) -> DataFrame:
    """Authors of bibliography entries by record, entry and place, null ones included; ``middle`` is null where it is null or empty."""
    a = _with_middle(entity(nodes, ["authors"], ["first", "last", "suffix"], 2), nodes).alias("a")
    e = entity(nodes, ["bib_entries"], [KEY], 1).alias("e")
    met = a.join(e, F.col("a.record").eqNullSafe(F.col("e.record")) & (F.col("a.parent") == F.col("e.node")))
    return met.select(F.col("a.record").alias("record_id"), F.col(f"e.{KEY}").alias("entry_key"), F.col("a.ordinal").alias("author_no"), "first", "middle", "last", "suffix")


def span_links(nodes: DataFrame) -> DataFrame:
    """record_id, area, block_no, span_no, entry_key: each reference span with the entry of its record that it names, or the empty string."""
    s = spans(nodes, scalars=("ref_id",)).alias("s")
    e = entries(nodes, scalars=()).alias("e")
    met = s.join(e, F.col("s.record_id").eqNullSafe(F.col("e.record_id")) & (F.col("s.ref_id") == F.col("e.entry_key")), "left")
    return met.select("s.record_id", "s.area", "s.block_no", "s.span_no", F.coalesce(F.col("e.entry_key"), F.lit("")).alias("entry_key"))


def affiliations(nodes: DataFrame) -> DataFrame:
    """Affiliations keyed to their author by record and place, with their location; authors without one give no row."""
    _, own, place = _AUTHOR
    f, at, a = entity(nodes, ["affiliation"], own).where("node LIKE '/metadata/authors:%'").alias("f"), entity(nodes, ["location"], place).alias("l"), entity(nodes, ["authors"], [], 2).alias("a")
    both = f.join(a, under("f", "a")).join(at, under("l", "f"), "left").where("f.present")
    return both.select(F.col("f.record").alias("record_id"), F.col("a.ordinal").alias("author_no"), *own, *place)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    whole = ("start", "end", "text", "ref_id")

    def spans_of(kind: str, scalars: tuple[str, ...]) -> Callable[[SparkSession, str], DataFrame]:
        return lambda s, d: spans(nodes_of(s, d), kind, scalars).withColumns({c: F.col(c).cast("int") for c in ("start", "end") if c in scalars})

    def named(df: DataFrame) -> DataFrame:
        """Middle names as one text, which hashes alike in every engine."""
        return df.withColumn("middle", F.array_join("middle", "|", ""))

    return {
        "p2_found": lambda s, d: span_links(nodes_of(s, d)),
        "p2_records": lambda s, d: records(nodes_of(s, d)),
        "p2_blocks": lambda s, d: blocks(nodes_of(s, d)).drop("node"),
        "p2_ref_spans": spans_of("ref_spans", ("start", "ref_id")),
        "p2_cite_spans": spans_of("cite_spans", ("start", "ref_id")),
        "p2_ref_entries": lambda s, d: entries(nodes_of(s, d)),
        "p2_bib_entries": lambda s, d: entries(nodes_of(s, d), "bib_entries", ("title", "year", "venue")).withColumn("year", F.col("year").cast("int")),
        # The tables above keep the columns of their SQL; these have every child.
        "p2_whole_records": lambda s, d: whole_records(nodes_of(s, d)),
        "p2_whole_ref_spans": spans_of("ref_spans", whole),
        "p2_whole_cite_spans": spans_of("cite_spans", whole),
        "p2_whole_ref_entries": lambda s, d: entries(nodes_of(s, d), scalars=("text", "latex", "type")),
        "p2_whole_bib_entries": lambda s, d: entries(nodes_of(s, d), "bib_entries", ("ref_id", "title", "year", "venue", "volume", "issn", "pages")).withColumn("year", F.col("year").cast("int")),
        "p2_authors": lambda s, d: named(authors(nodes_of(s, d))),
        "p2_bib_authors": lambda s, d: named(bib_authors(nodes_of(s, d))),
        "p2_affiliations": lambda s, d: affiliations(nodes_of(s, d)),
    }
