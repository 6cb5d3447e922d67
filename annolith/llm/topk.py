"""Exact top-k inner products with KD-trees per shard.

Each task cuts its vectors into shards as they come, builds a KD-tree of each (median splits along the widest side, a tight
bounding box and the least id at every node) and stores it; no vector is shuffled, so rows that stand very often cost no
more than others. The largest inner product that a box allows bounds what lies below it. The stated queries are cut into
blocks. A task holds the trees of one group of shards and streams blocks past them; in a tree every query goes best box
first, with its k-th score carried from tree to tree. A first pass takes each block to one group; the second takes it to
the others and begins with the k-th score that the first found, so most trees are left at their root or soon after. The
groups' lists, k rows a query, are merged at the end.

Results for special cases: vectors that are null or hold a null or a non-finite component take no part; vectors of
different lengths meet as if the shorter went on with zeros, so an empty one scores 0; a query doesn't meet rows of its own
id; repeated vectors all count; each distinct query (id and vector) has one list, however often it is asked; scores are
exact, whatever the components' size; equal scores go to the smaller id; fewer candidates than k give fewer
rows; rows with a null id take no part; an empty table gives no rows.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import quoted, tidied, written

#: Vectors in a shard, queries in a block, shards in a group whose trees one task holds, vectors in a leaf.
SHARD, BLOCK, GROUP, LEAF = 8192, 512, 16, 512


def quantised(vector: Column, scale: float = 64.0) -> Column:
    """Each component as floor(scale * x), a whole number as a double, or null where the vector is null or holds a null or one
    whose multiple is not finite."""
    wide = F.transform(vector, lambda x: F.lit(scale) * x.cast("double"))
    sound = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    whole = lambda x: F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x)  # noqa: E731 - from there on doubles are whole
    return F.when(sound, F.transform(wide, whole))


def is_narrow(vector: Column) -> Column:
    """Whether a vector's products with others of this kind stay in 62 bits: the sizes of its components come to under 2^31."""
    return F.aggregate(vector, F.lit(0.0), lambda sum_, x: sum_ + F.abs(x.cast("double"))) < 2.0**31


class Tree:
    """Arrays of a KD-tree: the vectors in leaf order and, for each node, its box, stretch, children and least id."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, leaf: int = LEAF):
        order = np.lexsort((ids,))
        self.ids, self.rows = ids[order], rows[order]
        nodes: list[tuple[int, int, int, int]] = []
        low, high, least = [], [], []

        def build(a: int, b: int) -> int:
            own = self.rows[a:b]
            lo, hi = own.min(axis=0), own.max(axis=0)
            me = len(nodes)
            nodes.append((a, b, -1, -1))
            low.append(lo)
            high.append(hi)
            least.append(self.ids[a:b].min())
            side = int((hi.astype(float) - lo).argmax()) if len(hi) else 0
            if b - a > leaf and len(hi) and hi[side] > lo[side]:
                at = np.argsort(own[:, side], kind="stable")
                middle = (b - a) // 2
                self.ids[a:b], self.rows[a:b] = self.ids[a:b][at], own[at]
                nodes[me] = (a, b, build(a, a + middle), build(a + middle, b))
            return me

        if len(ids):
            build(0, len(ids))
        self.nodes = np.array(nodes, np.int64).reshape(-1, 4)
        self.low, self.high = (np.array(x).reshape(len(nodes), rows.shape[1]) for x in (low, high))
        self.least = np.array(least, np.int64)
        self.prepared()

    def packed(self) -> bytes:
        parts = (self.ids, self.rows, self.nodes, self.low, self.high, self.least)
        return struct.pack("<QQQ", *self.rows.shape, len(self.nodes)) + b"".join(x.astype("<i8").tobytes() for x in parts)

    @classmethod
    def unpacked(cls, data: bytes) -> Tree:
        tree, (n, width, m), at = cls.__new__(cls), struct.unpack_from("<QQQ", data), 24
        for name, shape in (("ids", (n,)), ("rows", (n, width)), ("nodes", (m, 4)), ("low", (m, width)), ("high", (m, width)), ("least", (m,))):
            size = int(np.prod(shape))
            setattr(tree, name, np.frombuffer(data, "<i8", size, at).reshape(shape))
            at += 8 * size
        tree.prepared()
        return tree

    def prepared(self) -> None:
        """Doubles for products that they hold exactly; the largest sum of sizes of a row."""
        self.reach = float(np.abs(self.rows.astype(float)).sum(axis=1).max(initial=0))
        self.wide = self.rows, self.low, self.high
        self.narrow = tuple(x.astype(float) for x in self.wide)


class Best:
    """The k best of each query so far: higher scores first, then smaller ids; which of them are new since the start."""

    def __init__(self, n: int, k: int, scores: np.ndarray | None = None, ids: np.ndarray | None = None):
        self.scores = np.full((n, k), np.iinfo(np.int64).min) if scores is None else scores.copy()
        self.ids = np.full((n, k), np.iinfo(np.int64).max) if ids is None else ids.copy()
        self.new = np.zeros((n, k), bool)

    def add(self, which: np.ndarray, scores: np.ndarray, ids: np.ndarray, own: np.ndarray) -> None:
        """scores: of these queries with all of these ids; where ``own`` holds, the row is the query's own."""
        better = ~own & self.open(which[:, None], scores, ids)
        some = np.flatnonzero(better.any(axis=1))
        if not len(some):
            return
        columns = np.flatnonzero(better.any(axis=0))
        which, scores, better = which[some], scores[np.ix_(some, columns)], better[np.ix_(some, columns)]
        k, least, most = self.scores.shape[1], np.iinfo(np.int64).min, np.iinfo(np.int64).max
        all_scores = np.concatenate([self.scores[which], np.where(better, scores, least)], axis=1)
        all_ids = np.concatenate([self.ids[which], np.where(better, ids[columns], most)], axis=1)
        fresh = np.concatenate([self.new[which], better], axis=1)
        top = np.lexsort((all_ids, ~all_scores), axis=1)[:, :k]  # ~x falls as x grows, for all whole numbers
        self.scores[which], self.ids[which], self.new[which] = (np.take_along_axis(x, top, 1) for x in (all_scores, all_ids, fresh))

    def open(self, which: np.ndarray, bounds: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Where a node with this bound and least id may still hold something better than the k-th."""
        kth, last = self.scores[which, -1], self.ids[which, -1]
        return (bounds > kth) | ((bounds == kth) & (least < last))


def fitted(rows: np.ndarray, width: int) -> np.ndarray:
    """Rows of another width, with zeros at the end or without what meets no component."""
    if rows.shape[1] >= width:
        return rows[:, :width]
    return np.pad(rows, ((0, 0), (0, width - rows.shape[1])))


def walk(tree: Tree, queries: np.ndarray, own_ids: np.ndarray, best: Best) -> None:
    """Every query goes best box first: in each round it takes its open node with the highest bound, looks at the vectors
    of a leaf, or opens a node's children; it ends when no open node can hold anything better than its k-th."""
    if not len(tree.nodes):
        return
    queries = fitted(queries, tree.rows.shape[1])
    largest = float(np.abs(queries.astype(float)).max(initial=0)) * tree.reach
    if largest >= 2.0**62:
        raise ValueError("a score might not fit in 64 bits")
    rows, low, high = tree.narrow if largest < 2.0**52 else tree.wide
    queries = queries.astype(rows.dtype)
    bounds = np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T  # of every query and box
    none, children = bounds.dtype.type(-(2.0**63)), tree.nodes[:, 2:]
    frontier = np.full(bounds.shape, none)
    frontier[:, 0] = bounds[:, 0]
    live = np.arange(len(queries))
    while len(live):
        at = frontier[live].argmax(axis=1)
        top = frontier[live, at]
        on = (top > none) & (top >= best.scores[live, -1])  # all other bounds of such a query are lower
        live, at, top = live[on], at[on], top[on]
        frontier[live, at] = none
        useful = best.open(live, top, tree.least[at])
        inner = useful & (children[at, 0] >= 0)
        for side in (0, 1):
            child = children[at[inner], side]
            frontier[live[inner], child] = bounds[live[inner], child]
        who, leaf = live[useful & ~inner], at[useful & ~inner]
        order = np.argsort(leaf, kind="stable")
        cuts = np.flatnonzero(np.diff(leaf[order])) + 1
        for group in np.split(order, cuts) if len(order) else []:
            own, (a, b) = who[group], tree.nodes[leaf[group[0]], :2]
            best.add(own, (queries[own] @ rows[a:b].T).astype(np.int64), tree.ids[a:b], own_ids[own][:, None] == tree.ids[a:b])


def _packed(ids: np.ndarray, numbers: np.ndarray, rows: np.ndarray) -> bytes:
    return struct.pack("<QQ", *rows.shape) + b"".join(x.astype("<i8").tobytes() for x in (ids, numbers, rows))


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, width = struct.unpack_from("<QQ", data)
    ids, numbers = (np.frombuffer(data, "<i8", n, 16 + 8 * n * k) for k in (0, 1))
    return ids, numbers, np.frombuffer(data, "<i8", n * width, 16 + 16 * n).reshape(n, width)


def _matrix(vectors: pa.ListArray) -> np.ndarray:
    """The vectors as rows, shorter ones with zeros at the end."""
    lengths, flat = np.diff(vectors.offsets.to_numpy()), vectors.flatten().to_numpy()
    out = np.zeros((len(lengths), lengths.max(initial=0)), np.int64)
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def _packs(rows: DataFrame, most: int, trees: bool, name: str) -> DataFrame:
    """rows: id, number, v. part, place, pack: each task's rows as they come, ``most`` at a time, as trees or as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, place, held, size = TaskContext.get().partitionId(), 0, [], 0

        def out() -> pa.RecordBatch:
            width = max(m.shape[1] for *_, m in held)
            ids, numbers, all_rows = np.concatenate([i for i, _, _ in held]), np.concatenate([n for _, n, _ in held]), np.concatenate([fitted(m, width) for *_, m in held])
            pack = Tree(ids, all_rows).packed() if trees else _packed(ids, numbers, all_rows)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([place], pa.int32()), pa.array([pack], pa.binary())], ["part", "place", "pack"])

        for batch in batches:
            a = 0
            while a < len(batch):
                own = batch.slice(a, most - size)
                held.append((own["id"].to_numpy(), own["number"].to_numpy(), _matrix(own["v"])))
                a, size = a + len(own), size + len(own)
                if size >= most:
                    yield out()
                    held, size, place = [], 0, place + 1
        if held:
            yield out()

    return written(rows.select("id", "number", F.col("v").cast("array<bigint>").alias("v")).mapInArrow(tidied(run), "part int, place int, pack binary"), name)


def top_inner(vectors: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id", vector: str = "vector", shard: int = SHARD, block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """vectors, queries: key, vector (array of whole numbers, bigint or double). query_id, rank, key, score: the k best vectors of
    each query.

    Vectors whose products might leave 64 bits are searched apart, exactly and slowly; a score that does not fit in a bigint is
    shown as its nearest end, while the rank goes by the score itself.
    """
    spark = vectors.sparkSession
    named = lambda rows: rows.select(F.col(quoted(key)).alias("id"), F.col(quoted(vector)).cast("array<double>" if "double" in dict(rows.dtypes)[vector] else "array<bigint>").alias("v")).where("id is not null and v is not null")
    asked = written(named(queries).distinct().withColumn("number", F.monotonically_increasing_id()), "topk-asked")  # a number for each distinct query
    given = named(vectors).withColumn("number", F.lit(0).cast("bigint"))
    found = _near(given.where(is_narrow(F.col("v"))), asked.where(is_narrow(F.col("v"))), k, shard, block, group)
    wide = [written(rows.where(~is_narrow(F.col("v"))), "topk-wide") for rows in (given, asked)]
    if not any(rows.limit(1).count() for rows in wide):
        order = F.desc("score")
    else:
        found, order = _with_wide(found, given.where(is_narrow(F.col("v"))), asked, *wide, k), F.desc("rank_key")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("number").orderBy(order, "id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(key), "score")


def rank_key(score: int) -> str:
    """A text that sorts, byte by byte, as whole numbers of any size do."""
    digits = str(abs(score))
    if score >= 0:
        return f"1{len(digits):06d}{digits}"
    return f"0{999_999 - len(digits):06d}" + digits.translate(str.maketrans("0123456789", "9876543210"))


FAR = "number bigint, query_id bigint, id bigint, score bigint, rank_key string"


def _far_rows(rows: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    least, most = -(1 << 63), (1 << 63) - 1
    cells = [(n, q, i, max(least, min(most, s)), rank_key(s)) for n, q, i, s in rows]
    return pa.RecordBatch.from_arrays([pa.array([c[j] for c in cells], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["number", "query_id", "id", "score", "rank_key"])


def _whole(vectors: list[list[float]], width: int) -> np.ndarray:
    """Vectors of doubles as whole numbers of any size, of one width."""
    out = np.zeros((len(vectors), width), object)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = [int(x) for x in v[:width]]
    return out


def _blocks(rows: DataFrame, most: int = 256) -> Iterator[list[tuple[int, int, list[float]]]]:
    """A stored table's rows, so many at a time."""
    numbered = rows.withColumn("_at", F.monotonically_increasing_id())
    block = F.floor(F.col("_at") / most)
    for b in sorted(r[0] for r in numbered.select(block).distinct().collect()):
        yield [(r["id"], r["number"], list(r["v"])) for r in numbered.where(block == b).collect()]


def _with_wide(found: DataFrame, narrow: DataFrame, asked: DataFrame, wide: DataFrame, wide_asked: DataFrame, k: int) -> DataFrame:
    """found's rows with their rank keys, and those that wide vectors or wide queries give; blocks of them pass by all others."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _far_rows(list(zip(*(batch[c].to_pylist() for c in ("number", "query_id", "id", "score")), strict=True)))

    parts = [found.select("number", "query_id", "id", "score").mapInArrow(keyed, FAR)]
    context = found.sparkSession.sparkContext
    for block in _blocks(wide):
        shared = context.broadcast(block)

        def queries_by(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            width = max(len(v) for _, _, v in shared.value)
            ids, rows = [i for i, _, _ in shared.value], _whole([v for _, _, v in shared.value], width)
            for batch in batches:
                out = []
                for number, own, v in zip(*(batch[c].to_pylist() for c in ("number", "id", "v")), strict=True):
                    scores = rows @ _whole([v], width)[0]
                    best = sorted((-s, i) for s, i in zip(scores.tolist(), ids, strict=True) if i != own)[:k]
                    out += [(number, own, i, -s) for s, i in best]
                yield _far_rows(out)

        parts.append(written(asked.mapInArrow(tidied(queries_by), FAR), "topk-far"))
        shared.destroy()
    for block in _blocks(wide_asked):
        shared = context.broadcast(block)

        def vectors_by(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            width = max(len(v) for _, _, v in shared.value)
            asks, best = _whole([v for _, _, v in shared.value], width), [[] for _ in shared.value]
            for batch in batches:
                ids, rows = batch["id"].to_pylist(), _whole(batch["v"].to_pylist(), width)
                for at, (own, _, _) in enumerate(shared.value):
                    scores = (rows @ asks[at]).tolist()
                    best[at] = sorted([*best[at], *((-s, i) for s, i in zip(scores, ids, strict=True) if i != own)])[:k]
            yield _far_rows([(number, own, i, -s) for (own, number, _), top in zip(shared.value, best, strict=True) for s, i in top])

        parts.append(written(narrow.mapInArrow(tidied(vectors_by), FAR), "topk-far"))
        shared.destroy()
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def _near(vectors: DataFrame, queries: DataFrame, k: int, shard: int, block: int, group: int) -> DataFrame:
    """number, query_id, id, score: among them each query's k best vectors, by trees."""
    spark = vectors.sparkSession
    trees = _packs(vectors, shard, True, "topk-trees")
    asks = _packs(queries, block, False, "topk-queries")
    n, m = trees.count(), asks.count()
    groups = max(1, -(-n // group))
    # with few groups, blocks are dealt over slices too, and each slice has its own copy of a group's trees
    slices = max(1, min(m, spark.sparkContext.defaultParallelism // groups))
    home = F.pmod(F.xxhash64("part", "place"), F.lit(groups)).cast("int")
    slice_of = F.pmod(F.xxhash64("place", "part"), F.lit(slices)).cast("int")
    shards = trees.select(home.alias("group"), F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), F.lit(0).alias("kind"), "part", "place", "pack", F.lit(None).cast("binary").alias("found"))
    first = asks.select(home.alias("group"), slice_of.alias("slice"), F.lit(1).alias("kind"), "part", "place", "pack", F.lit(None).cast("binary").alias("found"))
    kind = "group int, slice int, kind int, part int, place int, pack binary, found binary"

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Trees come before blocks in each group and slice. Gives each block with its k best and which of them are new."""
        now, held = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if (row["group"], row["slice"]) != now:
                    now, held = (row["group"], row["slice"]), []
                if row["kind"] == 0:
                    held.append(Tree.unpacked(row["pack"]))
                    continue
                own_ids, _, asked = _unpacked(row["pack"])
                before = None if row["found"] is None else np.frombuffer(row["found"], "<i8").reshape(3, len(own_ids), k)
                best = Best(len(own_ids), k, *(() if before is None else before[:2]))
                for tree in held:
                    walk(tree, asked, own_ids, best)
                found = np.stack([best.scores, best.ids, best.new.astype(np.int64)]).astype("<i8").tobytes()
                yield pa.RecordBatch.from_pylist([row | {"found": found}], schema=batch.schema)

    def met(blocks: DataFrame, name: str) -> DataFrame:
        both = shards.unionByName(blocks).repartition("group", "slice").sortWithinPartitions("group", "slice", "kind", "part", "place")
        return written(both.mapInArrow(tidied(meet), kind), name)

    near = met(first, "topk-first")
    parts = [near]
    if groups > 1:
        others = F.filter(F.sequence(F.lit(0), F.lit(groups - 1)), lambda g: g != F.col("group"))
        parts.append(met(near.select(F.explode(others).alias("group"), "slice", "kind", "part", "place", "pack", "found"), "topk-second"))

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pack, found in zip(*batch.columns, strict=True):
                own_ids, numbers, _ = _unpacked(pack.as_py())
                scores, ids, new = np.frombuffer(found.as_py(), "<i8").reshape(3, len(own_ids), k)
                who, place = np.nonzero(new)
                yield pa.RecordBatch.from_arrays([pa.array(numbers[who]), pa.array(own_ids[who]), pa.array(ids[who, place]), pa.array(scores[who, place])], ["number", "query_id", "id", "score"])

    columns = ["pack", "found"]
    found = near.select(*columns) if len(parts) == 1 else near.select(*columns).unionAll(parts[1].select(*columns))
    return found.mapInArrow(tidied(lists), "number bigint, query_id bigint, id bigint, score bigint")
