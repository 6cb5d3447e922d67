"""SimHash near-duplicates by pigeonhole blocks.

Equal fingerprints are one class from the start. The 64 bits are cut into blocks: of six, two fingerprints that differ in at
most four bits agree on at least two, so every linked pair shares one of the fifteen keys made of two blocks; a larger
distance takes more blocks, and keys of more of them (six bits: nine blocks, 84 keys of three). The
fingerprints of a key meet in the order of a sorted shuffle and are compared by Hamming distance; a group emits the
edges of a spanning forest instead of its pairs. Groups over ``CHUNK`` fingerprints leave the first pass as chunks, and
each pair of chunks is compared in a task of its own, so no task holds a group whole.

Results for special cases: a null or blank text has fingerprint 0, which links like any other; texts are read whole;
repeated rows each get their class; a null key is a member but never names a component unless all its members are null;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .components import connected_components
from .shared import positional, quoted, tidied, written

SHINGLE, DISTANCE, CHUNK = 4, 4, 4096
#: Fewest bits of a key, so that unlike fingerprints seldom share one.
KEY_BITS = 21
#: Keys of a fingerprint that are dealt out at a time: more of them take more passes, and no more memory.
KEYS_AT_ONCE = 15
#: Rows of a key and a hash that are broadcast at most, some 40 MB; more of them meet the documents in a shuffle.
MOST_BROADCAST = 1_000_000
SEED = 42


def shingle_hashes(text: str | None, size: int = SHINGLE) -> list[int]:
    """XXH64 of each shingle of the text's words, ASCII in lower case; a shorter text is one shingle."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return []
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    n = max(1, len(words) - size + 1)
    starts = np.concatenate([[0], ends[: n - 1]]).tolist()
    stops = (ends[size - 1 :] - 1).tolist() if len(words) >= size else [len(line)]
    digest = xxhash.xxh64_intdigest
    return [digest(line[a:b], SEED) for a, b in zip(starts, stops, strict=True)]


def majority(hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each stretch that ends at ``ends``: the bits set in over half of its hashes."""
    out = np.zeros(len(ends), np.uint64)
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    for i in np.flatnonzero(ends > starts):
        own, votes = hashes[starts[i] : ends[i]], np.zeros(64, np.int64)
        for a in range(0, len(own), 1 << 14):
            votes += np.unpackbits(own[a : a + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[i] = np.packbits(2 * votes > len(own), bitorder="little").view(np.uint64)[0]
    return out


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, carry: tuple[str, ...] = ()) -> DataFrame:
    """key, the columns to carry, fp bigint (the fingerprint's 64 bits). No row moves."""
    columns = [key, *carry]
    chosen = docs.select(*map(quoted, [*columns, text]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for t in batch[text]:
                h = np.array(shingle_hashes(t.as_py(), size), np.uint64)
                made.append(majority(h, np.array([len(h)]))[0])
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in columns), pa.array(np.array(made, np.uint64).view(np.int64), pa.int64())], [*columns, "fp"])

    return chosen.mapInArrow(tidied(run), StructType([*chosen.schema.fields[:-1], StructField("fp", LongType())]))


def blocks_for(distance: int) -> int:
    """The fewest blocks of which those that agree make a key of enough bits."""
    return next(n for n in range(distance + 1, 65) if (n - distance) * 64 / n >= KEY_BITS)


def block_masks(distance: int, blocks: int) -> list[int]:
    """Masks of blocks - distance blocks each: fingerprints within the distance agree under one of them."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    parts = [((1 << cuts[i + 1]) - 1) ^ ((1 << cuts[i]) - 1) for i in range(blocks)]
    return [sum(c) for c in combinations(parts, blocks - distance)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def forest(own: np.ndarray, other: np.ndarray | None, distance: int) -> list[tuple[int, int]]:
    """Edges that join the fingerprints within the distance of each other: within ``own``, or from it to ``other``."""
    both = own if other is None else np.concatenate([own, other])
    left, edges = np.ones(len(both), bool), []
    for first in range(len(own)):
        if not left[first]:
            continue
        left[first] = False
        queue = [first]
        while queue:
            i = queue.pop()
            rest = np.flatnonzero(left)
            near = rest[np.bitwise_count(both[rest] ^ both[i]) <= distance]
            left[near] = False
            edges += [(int(both[i]), int(both[j])) for j in near]
            queue += near.tolist()
    return edges


def links(distinct: DataFrame, distance: int = DISTANCE, chunk: int = CHUNK) -> DataFrame:
    """distinct: fp, each once. a, b: edges whose components are those of all pairs within the distance."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last, number = np.zeros(0, np.int64), None, 0

        def out(a: list, b: list, chunks: list) -> pa.RecordBatch:
            n, m = len(a), len(chunks)
            return pa.RecordBatch.from_arrays([pa.array(a + [None] * m, pa.int64()), pa.array(b + [None] * m, pa.int64()), *(pa.array([None] * n + [c[i] for c in chunks], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.int32(), pa.binary())))], ["a", "b", "combo", "part", "number", "fps"])

        def close(a: list, b: list, chunks: list) -> None:
            if number or len(held) > chunk:
                for k, i in enumerate(range(0, len(held), chunk)):
                    chunks.append((last[0], last[1], number + k, held[i : i + chunk].tobytes()))
            elif len(held) > 1:
                for x, y in forest(held.view(np.uint64), None, distance):
                    a.append(signed(x))
                    b.append(signed(y))

        for batch in batches:
            combo, part, fp = (batch[c].to_numpy(zero_copy_only=False) for c in ("combo", "part", "fp"))
            cuts = np.flatnonzero((combo[1:] != combo[:-1]) | (part[1:] != part[:-1])) + 1
            a, b, chunks = [], [], []
            sizes = np.diff(np.concatenate([[0], cuts, [len(fp)]]))
            firsts = np.concatenate([[0], cuts])
            edge = {0, len(firsts) - 1}
            for g in sorted({*np.flatnonzero(sizes > 1).tolist(), *edge}) if len(fp) else []:
                now = (int(combo[firsts[g]]), int(part[firsts[g]]))
                own = fp[firsts[g] : firsts[g] + sizes[g]]
                if now == last:
                    held = np.concatenate([held, own])
                else:
                    close(a, b, chunks)
                    held, last, number = own, now, 0
                if len(held) >= 8 * chunk:  # give up whole chunks, keep the rest
                    whole = len(held) // chunk
                    for k in range(whole):
                        chunks.append((last[0], last[1], number + k, held[k * chunk : (k + 1) * chunk].tobytes()))
                    held, number = held[whole * chunk :], number + whole
            yield out(a, b, chunks)
        if last is not None:
            a, b, chunks = [], [], []
            close(a, b, chunks)
            yield out(a, b, chunks)

    masks, met = block_masks(distance, blocks_for(distance)), None
    for first in range(0, len(masks), KEYS_AT_ONCE):
        own = F.array(*[F.lit(signed(m)) for m in masks[first : first + KEYS_AT_ONCE]])
        keyed = distinct.select("fp", F.posexplode(F.transform(own, lambda m: F.col("fp").bitwiseAND(m))).alias("combo", "part")).withColumn("combo", F.col("combo") + first)
        part = keyed.repartition("combo", "part").sortWithinPartitions("combo", "part").mapInArrow(tidied(meet), "a bigint, b bigint, combo int, part bigint, number int, fps binary")
        part = written(part, "simhash-met")
        met = part if met is None else met.unionAll(part)
    chunks = met.where("fps is not null").select("combo", "part", "number", "fps")
    pairs = chunks.join(chunks.select("combo", "part", F.col("number").alias("number2"), F.col("fps").alias("fps2")), ["combo", "part"]).where("number <= number2")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for x, y, same in zip(batch["fps"].to_pylist(), batch["fps2"].to_pylist(), batch["same"].to_pylist(), strict=True):
                for p, q in forest(np.frombuffer(x, np.uint64), None if same else np.frombuffer(y, np.uint64), distance):
                    a.append(signed(p))
                    b.append(signed(q))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    far = pairs.select("fps", "fps2", (F.col("number") == F.col("number2")).alias("same")).repartition(F.xxhash64("fps", "fps2")).mapInArrow(tidied(compare), "a bigint, b bigint")
    return met.where("a is not null").select("a", "b").unionAll(far)


def _classes(prints: DataFrame, key: str, distance: int) -> DataFrame:
    """prints (key, fp and more) with root, which names a component, and component_id, the least key in it."""
    classes = written(prints.groupBy("fp").agg(F.min(quoted(key)).alias("least")), "simhash-prints-by-key")
    edges = written(links(classes.select("fp"), distance), "simhash-links")  # steps over components read them several times
    roots = written(connected_components(edges), "simhash-roots")  # only fingerprints with a link
    joined = classes.join(roots, classes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = written(joined, "simhash-classes")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    members = named.join(least, "root").select("fp", "root", "component_id")
    return prints.join(members, "fp", "left")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """key, fp, component_id (the least key that links reach)."""
    prints = written(fingerprints(docs, key, text, size), "simhash-prints")
    return _classes(prints, key, distance).select(quoted(key), "fp", "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """docs with one row of each component, that of the least key (of several texts with this key, the least in hash order).

    A key may stand in several components, with a text in each. Of rows equal in key and text any one stays; rows without a
    key all stay.
    """
    tagged = docs.select(F.col(quoted(key)).alias("key"), F.col(quoted(text)).alias("text"), F.xxhash64(quoted(text)).alias("tag"))
    prints = written(fingerprints(tagged, "key", "text", size, ("tag",)), "simhash-prints")
    members = written(_classes(prints, "key", distance).where("key is not null").groupBy("key", "tag").agg(F.first("root").alias("root"), F.count("*").alias("n")), "simhash-members")
    kept = members.groupBy("root").agg(F.min(F.struct("key", "tag")).alias("least")).select("least.*", F.lit(True).alias("_stays"))
    # what goes, and what stands several times: few of all rows, so that the others need not move
    odd = written(members.join(kept, ["key", "tag"], "left").where("_stays is null or n > 1").select("key", "tag", F.coalesce("_stays", F.lit(False)).alias("_stays")), "simhash-odd")
    plain, at = positional(docs)
    names = odd.select(F.col("key").alias(at[key]), "tag", "_stays")
    names = F.broadcast(names) if odd.count() <= MOST_BROADCAST else names
    own = plain.where(F.col(at[key]).isNotNull()).withColumn("tag", F.xxhash64(at[text])).join(names, [at[key], "tag"], "left")
    once = own.where("_stays").dropDuplicates([at[key], "tag"])
    rows = own.where("_stays is null").unionByName(once).select(*plain.columns)
    return rows.unionByName(plain.where(F.col(at[key]).isNull())).toDF(*docs.columns)
