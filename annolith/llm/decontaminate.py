"""Benchmark decontamination by suffix arrays over the training texts.

Each task builds suffix arrays over shards of its documents' words and looks up every test suffix in them by binary
search; a hit is extended to the longest verbatim match. Words that the test set lacks cannot be part of a match, so
only suffixes that open with a long enough run of test words enter an array, sorted as far as a window reaches; this leaves
out no match. The test set is dealt into blocks of about a stated number of words, and each block takes a pass over the
documents of its own: one block at a time is at the driver and in a task. With several blocks the documents are stored once,
with numbers, and a pass gives only the numbers and findings of documents that match.

A document's findings are the stretches of its words that matches cover, merged over all items, and the longest match of each
item with its place; so a row grows with the document and the items in it, not with the pairs of their places.

Results for special cases: a null text has no words and no matches; an item without words matches nothing; repeated
rows are judged each; equal items (id and text) count once; texts are read whole; an empty table of documents gives no
rows, an empty test set no hits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from .shared import arrow_map, positional, quoted, tidied, written

WINDOW = 13
#: Test words in one broadcast, and training words in one suffix array.
BLOCK_WORDS, SHARD_WORDS = 2_000_000, 1_500_000
#: Bytes of the words as they are, A-Z in lower case, all others blank.
WORD_BYTES = bytes(c if c >= 0x80 or chr(c) in "0123456789abcdefghijklmnopqrstuvwxyz" else c + 32 if chr(c) in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split() if text else []


class TestSet:
    """The windows of some test items over numbered words, sorted."""

    __test__ = False

    def __init__(self, items: list[tuple[object, str]], window: int):
        self.window, self.ids, self.names, self.texts = window, {}, [], []
        rows, where = [], []
        for name, text in items:
            own = [self.ids.setdefault(w, len(self.ids) + 1) for w in words_of(text)]
            if not own:
                continue
            n = len(self.names)
            self.names.append(name)
            self.texts.append(np.array(own, np.int32))
            size = min(window, len(own))
            for i in range(len(own) - size + 1):
                rows.append(own[i : i + size] + [0] * (window - size))
                where.append((n, i, size))
        self.flat = np.concatenate([*self.texts, np.zeros(0, np.int32)])
        self.begins = np.cumsum([0, *map(len, self.texts)])
        self.rows = np.array(rows, np.int32).reshape(-1, window)
        self.where = np.array(where, np.int64).reshape(-1, 3)
        self.shortest = int(self.where[:, 2].min(initial=window))

    @cached_property
    def bounds(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each window, packed once a worker: its key, and the least key after all that begin with it."""
        upper = self.rows.copy()
        upper[np.arange(len(upper)), self.where[:, 2] - 1] += 1  # word numbers end far below the type's limit
        return packed(self.rows), packed(upper)


def packed(rows: np.ndarray) -> np.ndarray:
    """Rows of word numbers as byte strings of the same order."""
    return np.ascontiguousarray(rows.astype(">u4")).view(f"S{4 * rows.shape[1]}")[:, 0]


class SuffixArray:
    """Sorted suffixes of a stretch of numbered words (0: no test word, or a document's end), compared over a window."""

    def __init__(self, words: np.ndarray, test: TestSet):
        n, w = len(words), test.window
        stops = np.flatnonzero(words == 0)
        following = np.append(stops, n)[np.searchsorted(stops, np.arange(n))]
        starts = np.flatnonzero(following - np.arange(n) >= test.shortest)
        padded = np.concatenate([words, np.zeros(w, words.dtype)])
        rows = padded[starts[:, None] + np.arange(w)] * (np.arange(w) < (following[starts] - starts)[:, None])
        keys = packed(rows)
        order = np.argsort(keys, kind="stable")
        self.starts, self.keys, self.words, self.following, self.test = starts[order], keys[order], words, following, test

    def matches(self) -> np.ndarray:
        """(position, item, place in the item, length): maximal verbatim matches that hold a window."""
        test = self.test
        if not len(self.keys) or not len(test.rows):
            return np.zeros((0, 4), np.int64)
        low, high = (np.searchsorted(self.keys, x, "left") for x in test.bounds)
        sizes = np.maximum(high - low, 0)
        q = np.repeat(np.arange(len(sizes)), sizes)
        at = self.starts[np.repeat(low - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(q))]
        item, place, length = test.where[q].T
        inner = test.begins[item] + place
        before = (place > 0) & (at > 0) & (self.words[at - 1] == test.flat[inner - 1])
        at, item, place, length, inner = (x[~before] for x in (at, item, place, length, inner))  # others hold such a match
        most = np.minimum(test.begins[item + 1] - inner, self.following[at] - at)
        length = length.copy()
        going = np.flatnonzero(length < most)
        while len(going):
            going = going[self.words[at[going] + length[going]] == test.flat[inner[going] + length[going]]]
            length[going] += 1
            going = going[length[going] < most[going]]
        return np.stack([at, item, place, length], 1)


def test_blocks(items: DataFrame, item: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS) -> tuple[DataFrame, int]:
    """block, item, text of the distinct items, stored, and the number of blocks."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([len(words_of(t)) for t in batch["text"].to_pylist()], pa.int64())], ["item", "text", "n"])

    own = items.select(F.col(quoted(item)).cast("string").alias("item"), F.col(quoted(item_text)).alias("text")).where("text is not null").distinct()
    counted = written(own.mapInArrow(count, "item string, text string, n bigint"), "test-items")
    total = counted.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, -(-total // block_words))
    return counted.where("n > 0").select(F.pmod(F.xxhash64("text", "item"), F.lit(blocks)).alias("block"), "item", "text"), blocks


test_blocks.__test__ = False
SPANS = pa.list_(pa.struct([("at", pa.int64()), ("length", pa.int64())]))
ITEMS = pa.list_(pa.struct([("item_id", pa.string()), ("at", pa.int64()), ("item_at", pa.int64()), ("length", pa.int64())]))
FINDINGS = "n_words bigint, spans array<struct<at bigint, length bigint>>, items array<struct<item_id string, at bigint, item_at bigint, length bigint>>"


def lists(of: np.ndarray, n: int, columns: dict[str, pa.Array], kind: pa.ListType) -> pa.Array:
    """Rows of structs, in the order of the documents that they belong to, as one list for each of n documents."""
    offsets = np.searchsorted(of, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(list(columns.values()), names=list(columns))).cast(kind)


def look_up(shard: list[np.ndarray], test: TestSet) -> list[pa.Array]:
    """n_words, spans and items of each document; documents are numbered words, those that no test word is 0."""
    counts = np.array(list(map(len, shard)), np.int64)
    ends = np.cumsum(counts + 1)  # a zero ends each document
    words = np.zeros(int(ends[-1]) if len(ends) else 0, np.int32)
    for own, end in zip(shard, ends.tolist(), strict=True):
        words[end - 1 - len(own) : end - 1] = own
    made = SuffixArray(words, test).matches()
    made = made[np.argsort(made[:, 0], kind="stable")]
    at, item, place, length = made.T
    reach = np.maximum.accumulate(at + length) if len(made) else at
    fresh = np.append(True, at[1:] > reach[:-1]) if len(made) else np.zeros(0, bool)  # zeros part the documents
    first = np.flatnonzero(fresh)
    begin, stop = at[first], reach[np.append(first[1:], len(made)) - 1] if len(made) else at
    starts = ends - counts - 1
    doc = np.searchsorted(ends, begin, "right")
    spans = lists(doc, len(shard), {"at": pa.array(begin - starts[doc]), "length": pa.array(stop - begin)}, SPANS)
    doc = np.searchsorted(ends, at, "right")
    order = np.lexsort((at, -length, item, doc))
    top = order[np.append(True, (doc[order][1:] != doc[order][:-1]) | (item[order][1:] != item[order][:-1]))] if len(made) else order
    names = pa.array(test.names, pa.string()).take(pa.array(item[top]))
    found = lists(doc[top], len(shard), {"item_id": names, "at": pa.array(at[top] - starts[doc[top]]), "item_at": pa.array(place[top]), "length": pa.array(length[top])}, ITEMS)
    return [pa.array(counts), spans, found]


def looked_up(batches: Iterator[pa.RecordBatch], text: str, test: TestSet, shard_words: int = SHARD_WORDS) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
    """Rows with their findings. A shard goes on over batches until it has so many words."""
    held, words, size = [], [], 0
    get = test.ids.get

    def done() -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
        found, at = look_up(words, test), 0
        for rows in held:
            yield rows, [c.slice(at, len(rows)) for c in found]
            at += len(rows)

    for batch in batches:
        begin = 0
        for i, value in enumerate(batch[text]):
            own = words_of(value.as_py())
            words.append(np.fromiter((get(w, 0) for w in own), np.int32, len(own)))
            size += len(own)
            if size >= shard_words:
                held.append(batch.slice(begin, i + 1 - begin))
                yield from done()
                held, words, size, begin = [], [], 0, i + 1
        if begin < len(batch):
            held.append(batch.slice(begin))
    if held:
        yield from done()


def _tests(blocks: DataFrame, block: int, window: int) -> Broadcast:
    rows = blocks.where(F.col("block") == block).select("item", "text").toLocalIterator()
    return blocks.sparkSession.sparkContext.broadcast(TestSet([(r[0], r[1]) for r in rows], window))


def _stored_findings(docs: DataFrame, text: str, blocks: DataFrame, n: int, window: int) -> tuple[DataFrame, DataFrame]:
    """docs, stored with a number (the last column), and the findings of all blocks for each number that has some."""
    number = f"p{len(docs.columns)}"
    rows = written(docs.withColumn(number, F.monotonically_increasing_id()), "decontaminate-documents")
    kind = StructType([rows.schema[number], *_parse_datatype_string(FINDINGS)])
    parts = []
    for b in range(n):
        shared = _tests(blocks, b, window)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch, found in looked_up(batches, text, shared.value):
                made = pa.RecordBatch.from_arrays([batch[number], *found], kind.names)
                yield made.filter(pc.greater(pc.list_value_length(found[1]), 0))

        parts.append(written(rows.select(number, text).mapInArrow(tidied(run), kind), "decontaminate-pass"))
        shared.destroy()
    every = parts[0]
    for p in parts[1:]:
        every = every.unionAll(p)
    return rows, every.groupBy(number).agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))


def find_matches(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """key, n_words, spans array<struct<at, length>>, items array<struct<item_id, at, item_at, length>>: a row for each row of docs.

    ``at`` and ``length`` count words. A match is verbatim, cannot be made longer, and holds a window: ``window``
    consecutive item words, or a whole shorter item. Spans of one block of items are merged; those of several may overlap. items
    has the longest match of each item, the first of equally long ones.
    """
    own = docs.select(F.col(quoted(key)).alias("p0"), F.col(quoted(text)).alias("p1"))
    blocks, n = test_blocks(items, item, item_text, block_words)
    kind = StructType([own.schema["p0"], *_parse_datatype_string(FINDINGS)])
    if n == 1:
        shared = _tests(blocks, 0, window)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, found in looked_up(batches, "p1", shared.value):
                yield pa.RecordBatch.from_arrays([batch["p0"], *found], kind.names)

        return own.mapInArrow(tidied(run), kind).withColumnRenamed("p0", key)
    rows, every = _stored_findings(own, "p1", blocks, n, window)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = pa.array([len(words_of(t.as_py())) for t in batch["p1"]], pa.int64())
            yield pa.RecordBatch.from_arrays([batch["p0"], batch["p2"], own], ["p0", "p2", "n"])

    numbers = rows.mapInArrow(tidied(counted), StructType([own.schema["p0"], *_parse_datatype_string("p2 bigint, n bigint")]))
    none = [F.array().cast(kind[c].dataType) for c in ("spans", "items")]
    return numbers.join(every, "p2", "left").select(F.col("p0").alias(key), F.col("n").alias("n_words"), F.coalesce("spans", none[0]).alias("spans"), F.coalesce("items", none[1]).alias("items"))


def remove_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", window: int = WINDOW, share: float = 0.05, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs without the rows of whose words matches cover ``share`` or more. With one block of items no row moves; columns may
    have any names."""
    plain, at = positional(docs)
    blocks, n = test_blocks(items, "item_id", "text", block_words)
    if n == 1:
        shared = _tests(blocks, 0, window)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, (counts, spans, _) in looked_up(batches, at[text], shared.value):
                hit, whole = covered(spans), counts.to_numpy()
                yield batch.filter(pa.array(~((hit > 0) & (hit >= share * whole))))

        return plain.mapInArrow(tidied(run), plain.schema).toDF(*docs.columns)
    rows, every = _stored_findings(plain, at[text], blocks, n, window)
    number = rows.columns[-1]
    kind = StructType([rows.schema[number]])

    def bad(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(covered(batch["spans"]) >= share * batch["n_words"].to_numpy())).select([number])

    return rows.join(every.mapInArrow(tidied(bad), kind), number, "left_anti").select(*plain.columns).toDF(*docs.columns)


def covered(spans: pa.Array) -> np.ndarray:
    """The number of words that each row's spans cover together; they may stand in any order and overlap."""
    counts = pc.fill_null(pc.list_value_length(spans), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = spans.flatten()
    at, length = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
    of = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((at, of))
    at, end, of = at[order], (at + length)[order], of[order]
    shift = of * (int(end.max(initial=0)) + 1)  # so that no row's spans reach into the next one's
    before = np.concatenate([[0], np.maximum.accumulate(end + shift)[:-1]]) if len(at) else at
    return np.bincount(of, np.maximum(0, end + shift - np.maximum(at + shift, before)), len(counts)).astype(np.int64)


def judge(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """find_matches' rows with n_hit, n_items, items_sha256 and contaminated (a twentieth of the words or more is hit)."""
    chosen = found.select(F.col(quoted(key)).alias(key), "n_words", "spans", "items.item_id")
    kind = StructType([chosen.schema[0], *_parse_datatype_string("n_words bigint, n_hit bigint, n_items bigint, items_sha256 string")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = [sorted({x for x in own if x is not None}) for own in batch.column(3).to_pylist()]
            shas = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch["n_words"], pa.array(covered(batch["spans"])), pa.array(list(map(len, items)), pa.int64()), pa.array(shas, pa.string())], kind.names)

    return arrow_map(chosen, run, kind).withColumn("contaminated", F.expr("n_hit > 0 and 20 * n_hit >= n_words"))
