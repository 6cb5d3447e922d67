"""Draws with replacement by hash, as many in each stratum as it has clusters, where neither fits a task (SMP12-20).

Clusters are numbered in one global order and cut into stretches of ``WIDTH``. A task makes some draws of one replicate,
sorts them, and sends each stretch those that fall on it, at little more than a byte each; a stretch adds them up to the
weights of its clusters, replicate after replicate. Each draw is made once, whatever the number of stretches.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tables
from .streams import group_tables

#: Draws of a task's step; clusters of a stretch; draws that hashlib makes faster.
SEGMENT, WIDTH, FEW = 1 << 24, 1 << 16, 300
CELL = 256
_SHIFTS = [s for row in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in row * 4]
_SINES = [int(abs(np.sin(i + 1)) * 2**32) for i in range(64)]
_WORDS = [*range(16), *[(5 * i + 1) % 16 for i in range(16)], *[(3 * i + 5) % 16 for i in range(16)], *[7 * i % 16 for i in range(16)]]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: The ASCII digits of 0 to 9999
_DIGITS = [(np.arange(10_000, dtype=np.uint32) // 10**k % 10 + 48).astype(np.uint32) for k in (3, 2, 1, 0)]


def _first_words(text: bytes, varying: int, count: int) -> np.ndarray:
    """The first four bytes of the MD5 of a text of at most 55 bytes whose last digits count up, as big-endian numbers."""
    block = bytearray(64)
    block[: len(text)] = text
    block[len(text)] = 0x80
    block[56:64] = (8 * len(text)).to_bytes(8, "little")
    low, moving = int(text[-varying:]), {}
    for k in range(varying):
        at = len(text) - varying + k
        block[at] = 0
        digit = _DIGITS[4 - varying + k][low : low + count] << np.uint32(8 * (at % 4))
        moving[at // 4] = moving[at // 4] | digit if at // 4 in moving else digit
    fixed = np.frombuffer(bytes(block), "<u4").tolist()
    a, b, c, d = (np.full(count, x, np.uint32) for x in _START)
    f, t = np.empty(count, np.uint32), np.empty(count, np.uint32)
    for i in range(61):  # the last three steps don't change the first word
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
        a += f
        a += np.uint32((_SINES[i] + fixed[_WORDS[i]]) & 0xFFFFFFFF)
        if _WORDS[i] in moving:
            a += moving[_WORDS[i]]
        np.right_shift(a, np.uint32(32 - _SHIFTS[i]), out=t)
        a <<= np.uint32(_SHIFTS[i])
        a |= t
        a += b
        a, b, c, d = d, a, b, c
    b += np.uint32(_START[0])
    return b.byteswap()


def picks(head: str, low: int, high: int, n: int) -> np.ndarray:
    """The slots, of n, that the draws from low up to high fall on: the hash of the head and the draw's number, modulo n."""
    out, prefix, at = np.empty(high - low, np.uint32), head.encode(), low
    while at < high:
        digits = len(str(at))
        stop = min(high, at - at % 10_000 + 10_000, 10**digits)
        if stop - at < FEW or len(prefix) + digits > 55:
            out[at - low : stop - low] = [int.from_bytes(md5(prefix + b"%d" % j).digest()[:4], "big") for j in range(at, stop)]
        else:
            out[at - low : stop - low] = _first_words(prefix + b"%d" % at, min(4, digits), stop - at)
        at = stop
    if n < 1 << 32:
        out -= out // np.uint32(n) * np.uint32(n)
    return out


def placed(clusters: DataFrame, stratum: str, cluster: str, kept: Iterable[str] = ()) -> DataFrame:
    """stratum, cluster, kept, _place: strata one after the other, each in the order of its clusters. Rows without a stratum go."""
    return tables.numbered(clusters.select(stratum, cluster, *kept).where(F.col(stratum).isNotNull()), [F.col(stratum), F.col(cluster)], "_place")


def gathered(batches: Iterable[pa.RecordBatch], rows: int = 20_000, size: int = 1 << 24) -> Iterator[pa.RecordBatch]:
    """The same rows in fewer batches."""
    held, n, full = [], 0, 0
    for batch in batches:
        held.append(batch)
        n, full = n + len(batch), full + batch.nbytes
        if n >= rows or full >= size:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n, full = [], 0, 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _falls(head: str, low: int, high: int, n: int, start: int, replicate: int, width: int) -> pa.RecordBatch:
    """A row for each stretch: the draws that fall on it as counts of cells and, in their order, places in the cells."""
    lead, cells = start % width, -(-width // CELL)
    slots = picks(head, low, high, n)
    slots = slots + np.uint32(lead) if n + width < 1 << 32 else slots.astype(np.uint64) + np.uint64(lead)
    slots.sort()
    last = lead + n - 1
    chunks, first = last // width + 1, lead // CELL
    own = np.arange(first, last // width * cells + last % width // CELL + 1)
    ends = np.append(np.searchsorted(slots, (own // cells * width + own % cells * CELL).astype(slots.dtype)), len(slots))
    bounds = np.array([0, *range(cells - first, len(own), cells)[: chunks - 1], len(own)])
    counts = np.diff(ends).astype(np.uint32)
    places = (slots % slots.dtype.type(width) & slots.dtype.type(CELL - 1)).astype(np.uint8)
    blobs = [pa.Array.from_buffers(pa.binary(), chunks, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data)]) for at, data in ((4 * bounds, counts), (ends[bounds], places))]
    numbers = np.full(chunks, replicate, np.int32)
    begins = np.zeros(chunks, np.int32)
    begins[0] = first
    return pa.RecordBatch.from_arrays([pa.array(start // width + np.arange(chunks)), pa.array(numbers), pa.array(begins), *blobs], ["_chunk", "_replicate", "_first", "_high", "_low"])


def dealt(rows: DataFrame, places: DataFrame, stratum: str, by: list[str], replicates: int, stream: str, width: int, segment: int = SEGMENT) -> DataFrame:
    """Partitions of whole stretches, each with its rows (of clusters with _place; sorted by ``by``) and then, replicate after
    replicate, with the draws that fall on it: what ``drawn`` reads."""
    spark = rows.sparkSession
    sizes = places.groupBy(stratum).agg(F.min("_place").alias("_start"), F.count("*").alias("_n"))
    each = sizes.select(F.col(stratum).cast("string").alias("_stratum"), "_start", "_n", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("_replicate"))
    each = each.withColumn("_segment", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_n") - 1) / segment))))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, start, n, replicate, part in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                low = part * segment
                yield _falls(f"{stream}{replicate}|{at}|", low, min(n, low + segment), n, start, replicate, width)

    # a number of partitions, as adaptive execution would put these few small rows into one
    tasks = each.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    falls = tasks.mapInArrow(lambda batches: gathered(draw(batches)), "_chunk bigint, _replicate int, _first int, _high binary, _low binary")
    chunk = F.floor(F.col("_place") / width)
    own = rows.select(chunk.alias("_chunk"), F.lit(-1).alias("_replicate"), (F.col("_place") - chunk * width).cast("int").alias("_at"), *[k for k in rows.columns if k != "_place"])
    both = own.unionByName(falls, allowMissingColumns=True)
    return both.repartition("_chunk").sortWithinPartitions("_chunk", "_replicate", *by)


def drawn(batches: Iterable[pa.RecordBatch], by: list[str], width: int) -> Iterator[tuple[list[tuple[tuple, pa.Table]], int, np.ndarray]]:
    """For each stretch and replicate: the stretch's rows, a table for each group (the same list for each replicate); the
    replicate; the weights of the stretch's clusters."""
    at, groups = None, []
    for (chunk, replicate, *group), table in group_tables(batches, ["_chunk", "_replicate", *by]):
        if chunk != at:
            at, groups = chunk, []
        if replicate < 0:
            groups.append((tuple(group), table))
        elif groups:
            weights = np.zeros(width, np.int64)
            for first, high, low in zip(table["_first"].to_pylist(), table["_high"].to_pylist(), table["_low"].to_pylist(), strict=True):
                counts = np.frombuffer(high, np.uint32)
                cells = np.repeat(np.arange(first, first + len(counts)) * CELL, counts)
                cells += np.frombuffer(low, np.uint8)
                weights += np.bincount(cells, minlength=width)
            yield groups, replicate, weights
