"""Passages of evaluation items in corpus documents, by one Aho-Corasick automaton over words.

The automaton's keys are all runs of so many consecutive words of the items, written as word numbers;
a document's words are numbered alike and go through it once. Words are those of the compatibility
normal form in lower case; positions are mapped back to the characters of the stored text. The automaton
goes to every executor, so its size is checked: a larger set of items is cut into blocks, which a task
takes in turn for a group of texts, read and split into words once.
"""

from __future__ import annotations

import unicodedata
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrove.functions.text import WORD, nfkc

#: Consecutive words that make a leak.
RUN = 12
#: Runs in one automaton: about 100 bytes each a word of them.
BLOCK_RUNS = 400_000
#: Automata that a worker keeps, and characters of text that it holds where there are more blocks than that.
CACHED = 1
GROUP_CHARS = 32 << 20


def normal_words(text: str | None) -> list[str]:
    return WORD.findall(nfkc(text).lower()) if text else []


def blocks_of(items: Iterator[tuple], run: int, most: int) -> Iterator[list[tuple[object, list[str]]]]:
    """Items (id, words) in blocks of at most ``most`` runs, or one item; those shorter than a run can't leak."""
    block, n = [], 0
    for item_id, text in items:
        w = normal_words(text)
        k = len(w) - run + 1
        if k <= 0:
            continue
        if block and n + k > most:
            yield block
            block, n = [], 0
        block.append((item_id, w))
        n += k
    if block:
        yield block


class Automaton:
    def __init__(self, block: list[tuple[object, list[str]]], run: int):
        import ahocorasick

        self.run, self.number = run, {}
        self.items = [i for i, _ in block]
        runs: dict[tuple[int, ...], set[int]] = {}
        for at, (_, words) in enumerate(block):
            ids = [self.number.setdefault(w, len(self.number) + 1) for w in words]
            for s in range(len(ids) - run + 1):
                runs.setdefault(tuple(ids[s : s + run]), set()).add(at)
        self.auto = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, at in runs.items():
            self.auto.add_word(key, tuple(at))
        self.auto.make_automaton()

    def runs(self, words: list[str]) -> Iterator[tuple[object, int, int]]:
        """(item, first, last): items that ``words`` share runs with, and the places of the words of each stretch of runs that overlap."""
        get = self.number.get
        spans: dict[int, list[tuple[int, int]]] = {}
        for end, found in self.auto.iter(tuple([get(w, 0) for w in words])):
            for at in found:
                first, of = end - self.run + 1, spans.setdefault(at, [])
                if of and first <= of[-1][1]:
                    first = of.pop()[0]
                of.append((first, end))
        for at, of in spans.items():
            for a, b in of:
                yield self.items[at], a, b

    def leaks(self, text: str) -> Iterator[tuple[object, int, int]]:
        """(item, start, end) of :meth:`runs` in the characters of ``text``."""
        found = list(self.runs(normal_words(text)))
        places = _places(text) if found else []
        for item, a, b in found:
            yield item, places[a][0], places[b][1]


def _clusters(text: str) -> Iterator[tuple[int, int]]:
    """Start and end of each character of ``text`` with the marks and vowels that may be composed with it."""
    start = 0
    for i, c in enumerate(text):
        if i and not (c > "\u02ff" and (unicodedata.combining(c) or "\u1160" <= c <= "\u11ff")):
            yield start, i
            start = i
    if text:
        yield start, len(text)


def _places(text: str) -> list[tuple[int, int]]:
    """Start and end in ``text`` of each of its normal words, though normal form and lower case may be longer or shorter than the characters they come from."""
    if text.isascii():
        return [m.span() for m in WORD.finditer(text)]
    normal, origin = [], []
    for s, e in _clusters(text):
        n = unicodedata.normalize("NFKC", text[s:e]).lower()
        normal.append(n)
        origin += [(s, e)] * len(n)
    return [(origin[m.start()][0], origin[m.end() - 1][1]) for m in WORD.finditer("".join(normal))]


_kept: dict[tuple[str, int], Automaton] = {}


def _automaton(key: str, number: int, shared, run: int) -> Automaton:
    """The automaton of a block, kept in the worker for its next tasks."""
    if (key, number) not in _kept:
        for old in list(_kept):
            if old[0] != key or len(_kept) >= CACHED:
                del _kept[old]
        _kept[key, number] = Automaton(shared.value, run)
    return _kept[key, number]


def leaks(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", run: int = RUN, block_runs: int = BLOCK_RUNS
) -> DataFrame:
    """doc_id, item_id, start, end, first_word, last_word: documents that share ``run`` consecutive words or more with an item, and
    where in the text, in its characters and by the places of its words from 0.

    One row for each stretch of the item's shared runs that overlap; stretches apart from each other are rows of their
    own. Null, empty and shorter texts share nothing. No document is compared with another, nothing is shuffled, and the
    documents are read once however many blocks the items make.
    """
    src = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    rows = items.select(F.col(f"`{item_id}`"), F.col(f"`{item_text}`").cast("string")).distinct()
    item_type = items.schema[item_id].dataType
    schema = f"doc_id {src.schema['doc_id'].dataType.simpleString()}, item_id {item_type.simpleString()}, start int, end int, first_word int, last_word int"
    item_arrow = src.sparkSession.createDataFrame([], f"x {item_type.simpleString()}").toArrow().schema.field(0).type
    sc = docs.sparkSession.sparkContext
    shared = [sc.broadcast(block) for block in blocks_of(((r[0], r[1]) for r in rows.toLocalIterator()), run, block_runs)]  # each at most block_runs runs
    if not shared:
        return docs.sparkSession.createDataFrame([], schema)
    return src.mapInArrow(_matcher(shared, run, item_arrow), schema)


def _matcher(shared: list, run: int, item_type: pa.DataType):
    key = uuid.uuid4().hex

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple[pa.Array, list[str | None]]] = []
        size = 0

        def found() -> Iterator[pa.RecordBatch]:
            words = [[normal_words(t) for t in texts] for _, texts in group]
            for number, block in enumerate(shared):
                auto = _automaton(key, number, block, run)
                for (ids, texts), of in zip(group, words, strict=True):
                    out = [(i, *x) for i, w in enumerate(of) if len(w) >= run for x in auto.runs(w)]
                    places = {i: _places(texts[i]) for i in {x[0] for x in out}}
                    cols = [pa.array([places[i][a][0] for i, _, a, _ in out], pa.int32()), pa.array([places[i][b][1] for i, _, _, b in out], pa.int32())]
                    cols += [pa.array([x[k] for x in out], pa.int32()) for k in (2, 3)]
                    take = ids.take(pa.array([x[0] for x in out], pa.int64()))
                    yield pa.RecordBatch.from_arrays([take, pa.array([x[1] for x in out], item_type), *cols], ["doc_id", "item_id", "start", "end", "first_word", "last_word"])

        for b in batches:
            texts = b.column(1).to_pylist()
            group.append((b.column(0), texts))
            size += sum(len(t) for t in texts if t)
            if len(shared) <= CACHED or size >= GROUP_CHARS:
                yield from found()
                group, size = [], 0
        if group:
            yield from found()

    return match
