"""Ranked lexical search: MaxScore over postings per shard.

Documents become shards: stretches of a bounded size, each sorted by key, with the postings (document, occurrences) of every
term that some item has, and all documents' lengths. Shards are stored once in the shared folder; texts are read once. The
statistics (documents, words, documents of each term) are sums over the shards' own counts.

In a shard, an item's terms are sorted by the most that one posting of theirs can give there. The first of them, whose
bounds together are too little for a place in the list, are non-essential: no document qualifies by these alone. Documents
pass in ranges: postings of the essential terms are added up, and the non-essential ones are probed from the highest bound
down, only for documents that the bounds still left could bring past the last place. The last place's score rises with each
range, so more terms become non-essential. A first pass over one shard in ``FIRST_OF`` gives each item a score that a listed
document must reach; all other shards begin with it.

Special cases: a null text, or one without terms, counts in no statistic and is never listed; equal scores go by ascending
key, null keys last; repeated rows are documents of their own; an item without a known term lists nothing; items with one id
are ranked each, by text; empty tables give no rows. Texts are read whole, of any length. Columns may have any names.

Scores are exact whole numbers: w * ((1000000000 * tf) div (1000 * tf + 8 * m)), m = 10 + (90 * n * N) div L, with a weight
w = floor(1000 * ln((2 N + 2) / (2 df + 1))).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from .shared import arrow_map, quoted, written

K = 10
#: Bytes of text and documents in a shard, documents in a range, distinct terms of the items of one block.
SHARD_BYTES, SHARD_DOCS, RANGE_DOCS, BLOCK_TERMS = 16 << 20, 1 << 16, 1 << 12, 1_000_000
#: One shard in so many is searched first, so that the others can begin with what a listed document must reach.
FIRST_OF = 16
#: Bytes in words (digits, letters, all that is not ASCII), A-Z in lower case; 0 for the others.
WORD_BYTE = np.array([c if c >= 0x80 or chr(c).isdigit() or chr(c).islower() else c + 32 if chr(c).isupper() else 0 for c in range(256)], np.uint8)


def terms_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All texts' terms one after the other (binary), and how many each text has."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    n = len(texts)
    stops = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    begin = int(stops[0]) if n else 0
    buffer = texts.buffers()[2]
    data = WORD_BYTE[np.frombuffer(buffer, np.uint8)[begin : int(stops[-1])]] if n and buffer is not None else np.zeros(0, np.uint8)
    stops = stops - begin
    inside = np.append(data > 0, False)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    border = stops[:-1][stops[:-1] < len(data)]
    first[border] |= inside[border]  # no term crosses from one text to the next
    starts = np.flatnonzero(first)
    at = np.concatenate([[0], np.cumsum(inside[:-1])])  # places among the words' bytes alone
    offsets = np.append(at[starts], at[-1]).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside[:-1]])])
    counts = np.diff(np.searchsorted(starts, stops))
    return words, counts


@dataclass
class Shard:
    """keys, whether a document has one, lengths in words; postings by term: ends of each term's, documents, occurrences."""

    keys: np.ndarray
    keyed: np.ndarray
    lengths: np.ndarray
    terms: np.ndarray
    ends: np.ndarray
    docs: np.ndarray
    tf: np.ndarray


SHARD = "shard bigint, n bigint, words bigint, terms array<int>, df array<int>, keys binary, keyed binary, lengths binary, docs binary, tf binary"


def shards_of(docs: DataFrame, key: str, text: str, vocabulary, shard_bytes: int, shard_docs: int) -> DataFrame:
    """A row for each shard. vocabulary: a broadcast array of the terms that get postings. No row moves."""

    def made(number: int, parts: list[tuple]) -> pa.RecordBatch:
        keys, keyed, lengths, term, doc = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((keys, ~keyed))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        codes, tf = np.unique(term * len(order) + place[doc], return_counts=True)
        own, df = np.unique(codes // max(len(order), 1), return_counts=True)
        lists = [pa.array([x], pa.list_(pa.int32())) for x in (own.tolist(), df.tolist())]
        blobs = [keys[order], keyed[order], lengths[order], (codes % max(len(order), 1)).astype(np.int32), tf.astype(np.int32)]
        numbers = [number, int((lengths > 0).sum()), int(lengths.sum())]
        return pa.RecordBatch.from_arrays([*(pa.array([x], pa.int64()) for x in numbers), *lists, *(pa.array([x.tobytes()], pa.binary()) for x in blobs)], ["shard", "n", "words", "terms", "df", "keys", "keyed", "lengths", "docs", "tf"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, parts, rows, size = TaskContext.get().partitionId() << 32, [], 0, 0
        for batch in batches:
            bytes_ = np.cumsum(pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            a = 0
            while a < len(batch):
                before = int(bytes_[a - 1]) if a else 0
                b = min(max(a + 1, int(np.searchsorted(bytes_, before + shard_bytes - size, "right"))), a + shard_docs - rows, len(batch))
                part = batch.slice(a, b - a)
                words, counts = terms_of(part["text"])
                term = pc.index_in(words, value_set=vocabulary.value)
                doc = np.repeat(np.arange(rows, rows + b - a), counts)[term.is_valid().to_numpy(zero_copy_only=False)]
                column = part["key"]
                parts.append((pc.fill_null(column, 0).to_numpy(zero_copy_only=False), column.is_valid().to_numpy(zero_copy_only=False), counts.astype(np.int64), term.drop_null().to_numpy().astype(np.int64), doc))
                rows, size, a = rows + b - a, size + int(bytes_[b - 1]) - before, b
                if rows >= shard_docs or size >= shard_bytes:
                    yield made(number, parts)
                    number, parts, rows, size = number + 1, [], 0, 0
        if parts:
            yield made(number, parts)

    own = docs.select(F.col(quoted(key)).cast("bigint").alias("key"), F.col(quoted(text)).alias("text"))
    return written(arrow_map(own, run, SHARD), "lexical-shards")


@dataclass
class Statistics:
    """N, L, and the weight of each term of the vocabulary (0 for a term that no document has)."""

    n: int
    words: int
    weights: np.ndarray


def statistics(shards: DataFrame, vocabulary: int) -> Statistics:
    n, words = shards.agg(F.sum("n"), F.sum("words")).first()
    weights = np.zeros(vocabulary, np.int64)
    counted = shards.select(F.explode(F.arrays_zip("terms", "df")).alias("x")).groupBy("x.terms").agg(F.sum("x.df").alias("df"))
    for term, df in counted.collect():
        weights[term] = math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))
    return Statistics(n or 0, words or 0, weights)


class Search:
    """A shard's postings ready for items, with the scores that each posting gives."""

    def __init__(self, shard: Shard, known: Statistics):
        self.shard = shard
        m = 10 + (90 * shard.lengths * known.n) // max(known.words, 1)
        tf = shard.tf.astype(np.int64)
        weight = np.repeat(known.weights[shard.terms], np.diff(np.append(0, shard.ends)))
        self.gain = weight * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[shard.docs]))
        begins = np.append(0, shard.ends)[: len(shard.ends)].astype(np.int64)
        self.most = np.maximum.reduceat(self.gain, begins) if len(begins) else np.zeros(0, np.int64)
        self.begins = begins
        self.ranges = max(1, -(-len(shard.keys) // RANGE_DOCS))

    def top(self, terms: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents (places in the shard) and scores of the k best, by score and then place; those under the floor and those
        that score 0 are left out. ``terms``: distinct numbers."""
        at = np.searchsorted(self.shard.terms, terms)
        at[at == len(self.shard.terms)] = 0
        own = at[self.shard.terms[at] == terms] if len(self.shard.terms) else at[:0]
        own = own[self.most[own] > 0]
        own = own[np.argsort(self.most[own], kind="stable")]
        upto = np.concatenate([[0], np.cumsum(self.most[own])])  # bounds of the first terms together
        docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(own) or upto[-1] < max(floor, 1):
            return docs, scores
        lists = [slice(int(self.begins[t]), int(self.shard.ends[t])) for t in own]
        edges = np.arange(self.ranges + 1) * RANGE_DOCS
        # where each range of documents begins in each list
        cuts = [s.start + np.searchsorted(self.shard.docs[s], edges) for s in lists]
        need = max(floor, 1)  # a document needs so much: more than the k-th, as later ones lose ties
        for r in range(self.ranges):
            split = int(np.searchsorted(upto[1:], need, "left"))  # the terms before it cannot reach it together
            if split == len(own):
                break
            parts = [slice(int(c[r]), int(c[r + 1])) for c in cuts]
            low = r * RANGE_DOCS
            sums = np.zeros(RANGE_DOCS, np.int64)
            for p in parts[split:]:
                sums[self.shard.docs[p] - low] += self.gain[p]  # a list holds a document once
            live = np.flatnonzero((sums > 0) & (sums + upto[split] >= need))
            score = sums[live]
            for j in range(split - 1, -1, -1):
                if not len(live):
                    break
                ids, gains = self.shard.docs[parts[j]], self.gain[parts[j]]
                if len(ids):
                    place = np.searchsorted(ids, live + low)
                    place[place == len(ids)] = 0
                    score = score + np.where(ids[place] == live + low, gains[place], 0)
                fit = score + upto[j] >= need
                live, score = live[fit], score[fit]
            if len(live):
                docs, scores = np.concatenate([docs, live + low]), np.concatenate([scores, score])
                best = np.argsort(-scores, kind="stable")[:k]  # ties stay in the order of places
                docs, scores = docs[best], scores[best]
                if len(docs) == k:
                    need = max(need, int(scores[-1]) + 1)
        return docs, scores


def unpacked(row: dict) -> Shard:
    kinds = {"keys": np.int64, "keyed": np.bool_, "lengths": np.int64, "docs": np.int32, "tf": np.int32}
    blobs = {name: np.frombuffer(row[name], kind) for name, kind in kinds.items()}
    return Shard(terms=np.array(row["terms"], np.int32), ends=np.cumsum(np.array(row["df"], np.int64)), **blobs)


FOUND = "item bigint, key bigint, score bigint"


def _searched(shards: DataFrame, shared, k: int) -> DataFrame:
    """item, key, score: the best of each shard. shared: broadcast (statistics, items' term numbers, floors)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, items, floors = shared.value
        for batch in batches if items else ():
            for i in range(len(batch)):
                shard = unpacked({n: batch[n][i].as_py() for n in ("terms", "df", "keys", "keyed", "lengths", "docs", "tf")})
                search = Search(shard, known)
                found = [search.top(terms, k, floor) for terms, floor in zip(items, floors, strict=True)]
                docs = np.concatenate([d for d, _ in found]).astype(np.int64)
                keys = pa.array(shard.keys[docs], mask=~shard.keyed[docs])
                number = np.repeat(np.arange(len(items)), [len(d) for d, _ in found])
                yield pa.RecordBatch.from_arrays([pa.array(number, pa.int64()), keys.cast(pa.int64()), pa.array(np.concatenate([s for _, s in found]), pa.int64())], ["item", "key", "score"])

    return arrow_map(shards, run, FOUND)


def ranked(found: DataFrame, k: int) -> DataFrame:
    from pyspark.sql import Window

    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("key"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = K, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", shard_bytes: int = SHARD_BYTES, shard_docs: int = SHARD_DOCS, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item, rank (from 1), key, score of the k best documents of each item; key is a whole number.

    Items come in blocks of so many term occurrences that a block's terms fit in memory; each block is a pass over the
    documents. The documents' table may be of any size, a block's items are held by the driver.
    """
    own = items.select(F.col(quoted(item)).alias("item_id"), F.col(quoted(item_text)).alias("text")).where("text is not null").distinct()
    kind = StructType([own.schema["item_id"], *_parse_datatype_string("terms array<binary>")])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, counts = terms_of(batch["text"])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), words.cast(pa.binary()))
            yield pa.RecordBatch.from_arrays([batch["item_id"], pa.array([list(dict.fromkeys(x)) for x in lists.to_pylist()], pa.list_(pa.binary()))], ["item_id", "terms"])

    listed = written(arrow_map(own, split, kind).where("size(terms) > 0"), "lexical-items")
    total = listed.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = max(1, -(-total // block_terms))
    parts = [_one_block(docs, listed.where(F.pmod(F.xxhash64("item_id", "terms"), F.lit(blocks)) == b), k, key, text, shard_bytes, shard_docs) for b in range(blocks)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(F.col("item_id").alias(item), "rank", F.col("key").alias(key), "score")


def _one_block(docs: DataFrame, items: DataFrame, k: int, key: str, text: str, shard_bytes: int, shard_docs: int) -> DataFrame:
    spark = docs.sparkSession
    context = spark.sparkContext
    rows = items.toArrow().combine_chunks()
    names, lists = rows["item_id"].to_pylist(), rows["terms"].to_pylist()
    number: dict[bytes, int] = {}
    numbered = [np.array([number.setdefault(t, len(number)) for t in own], np.int64) for own in lists]
    vocabulary = context.broadcast(pa.array(list(number), pa.large_binary()))
    shards = shards_of(docs, key, text, vocabulary, shard_bytes, shard_docs)
    known = statistics(shards, len(number))
    numbered = [own[known.weights[own] > 0] for own in numbered]
    first = F.pmod(F.xxhash64("shard"), F.lit(FIRST_OF)) == 0
    before = written(_searched(shards.where(first), context.broadcast((known, numbered, [1] * len(names))), k), "lexical-first")
    floors = [1] * len(names)
    for r in ranked(before, k).where(F.col("rank") == k).select("item", "score").collect():
        floors[r["item"]] = r["score"]
    rest = _searched(shards.where(~first), context.broadcast((known, numbered, floors)), k)
    best = ranked(before.unionByName(rest), k)
    schema = StructType([*_parse_datatype_string("item bigint"), items.schema["item_id"]])
    return best.join(F.broadcast(spark.createDataFrame(list(enumerate(names)), schema)), "item").select("item_id", "rank", "key", "score")
