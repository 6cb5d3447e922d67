"""Spelling variants: each frequent word's neighbours at one edit, and the far more frequent one among them as its form.

Words are counted in tasks and summed. The frequent ones, sorted, become tries: compact arrays of a bounded number of words
and letters each, stored as rows of a table in the shared folder. Tries are broadcast, as many at a time as a stated number
of bytes takes, and all words pass by them once a broadcast. A word's automaton for one edit is run over a trie depth first,
a block of words side by side: as long as a word has no edit yet it has one state at a node; there each edit begins a branch,
which then can only follow the rest of the word and is followed to its end before the next node. An inserted letter differs
from the letter after it, and of a run of equal letters the last is deleted, so each neighbour is accepted once. Of a word's
neighbours in a trie only their number and the best are kept; these are reduced over all tries, so no pair is ever stored.

Special cases: null texts have no words; a null key counts as an empty one where words are damaged; texts and words are taken
whole, of any length; repeated rows count each; of equally frequent neighbours the smallest in code-point order is best; a
table without frequent words gives no rows; columns may have any names.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import arrow_map, quoted, released, within, written

#: A word has so many letters and occurrences at least; its form is so many times as frequent.
LEAST_LETTERS, LEAST_COUNT, RATIO = 6, 5, 5
#: Bytes of text that are worked on at once, distinct words that a task holds before it passes their counts on.
STRETCH, HELD_WORDS = 4 << 20, 400_000
#: Words and letters of a trie, bytes of the tries of one broadcast, words of a block that run side by side.
TRIE_WORDS, TRIE_LETTERS, TRIES_BYTES, BLOCK = 100_000, 2_000_000, 32 << 20, 4096
LETTER = 1 << 21  # above all code points

_BYTE = np.arange(256)
_CAPITAL = (_BYTE >= 65) & (_BYTE <= 90)
_PLAIN = _CAPITAL | ((_BYTE >= 97) & (_BYTE <= 122))
_LOWER = np.where(_CAPITAL, _BYTE + 32, _BYTE).astype(np.uint8)
#: The first byte of U+00C0 to U+00FF in UTF-8; any byte may follow it.
_ACCENT = 0xC3


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = _crc_table()


def crcs(data: np.ndarray, begins: np.ndarray, sizes: np.ndarray, start: np.ndarray) -> np.ndarray:
    """crc32 of stretches of bytes, each continued from a crc; stretches side by side, byte after byte."""
    order = np.argsort(-sizes, kind="stable")
    at, left = begins[order], sizes[order]
    state = start[order] ^ np.uint32(0xFFFFFFFF)
    live = len(order)
    for j in range(int(left[0]) if live else 0):
        live = int(np.searchsorted(-left[:live], -j, "left"))  # stretches of more than j bytes
        s = state[:live]
        state[:live] = _CRC[(s ^ data[at[:live] + j]) & np.uint32(0xFF)] ^ (s >> np.uint32(8))
    out = np.empty_like(state)
    out[order] = state ^ np.uint32(0xFFFFFFFF)
    return out


def runs_of(texts: pa.Array, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts, A-Z in lower case, and of each run of letters of ``least`` letters or more: place, bytes, letters,
    number of its text."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    n = len(texts)
    stops = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[int(stops[0]) : int(stops[-1])]
    stops = stops - stops[0]
    lead = raw == _ACCENT
    inside = np.append(_PLAIN[raw] | lead, False)
    inside[1:-1] |= lead[:-1]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    border = stops[1:-1][stops[1:-1] < len(raw)]
    first[border] |= inside[border]  # no run crosses from one text to the next
    last = np.append(~inside[1:] | first[1:], False)[: len(inside)] & inside
    begins, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    accents = np.concatenate([[0], np.cumsum(lead)])
    letters = ends - begins - (accents[ends] - accents[begins])
    long = letters >= least
    begins, ends, letters = begins[long], ends[long], letters[long]
    return _LOWER[raw], begins, ends - begins, letters, np.searchsorted(stops, begins, "right") - 1


def _binary(data: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(data[within(begins, sizes)])])


def words_in(keys: list[str], texts: pa.Array, least: int, damage: int | None) -> pa.Array:
    """The texts' words (binary), repeats included; with ``damage`` the runs lose a letter whose crc32, after the key and a
    colon, it divides: that at the place crc32 modulo their letters."""
    data, begins, sizes, letters, text = runs_of(texts, least)
    if not damage:
        return _binary(data, begins, sizes)
    start = np.array([zlib.crc32(f"{k}:".encode()) for k in keys], np.uint32)
    h = crcs(data, begins, sizes, start[text])
    hit = h % np.uint32(damage) == 0
    hurt = []
    for at, size, n, code in zip(begins[hit].tolist(), sizes[hit].tolist(), letters[hit].tolist(), h[hit].tolist(), strict=True):
        if n > least:
            word = data[at : at + size].tobytes().decode()
            hurt.append((word[: code % n] + word[code % n + 1 :]).encode())
    return pa.concat_arrays([_binary(data, begins[~hit], sizes[~hit]), pa.array(hurt, pa.large_binary())])


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST_LETTERS, damage: int | None = None) -> DataFrame:
    """word, n: all words of ``least`` letters or more with their occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def summed() -> pa.Table:
            return pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])

        rows = 0
        for batch in batches:
            size = np.cumsum(pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            a = 0
            while a < len(batch):
                b = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + STRETCH, "right")))
                part = batch.slice(a, b - a)
                found = words_in(part["key"].to_pylist(), part["text"], least, damage).value_counts()
                held.append(pa.table({"word": found.field("values"), "n": found.field("counts")}))
                rows, a = rows + len(found), b
                if rows > HELD_WORDS:
                    held = [summed()]
                    rows = len(held[0])
                    if rows > HELD_WORDS // 2:  # hardly any repeats: pass them on, Spark adds them up
                        yield from _as_rows(held.pop())
                        rows = 0
        if held:
            yield from _as_rows(summed())

    own = docs.select(F.coalesce(F.col(quoted(key)).cast("string"), F.lit("")).alias("key"), F.col(quoted(text)).alias("text"))
    return arrow_map(own, run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _as_rows(found: pa.Table) -> Iterator[pa.RecordBatch]:
    words = found["word"].cast(pa.large_string()).cast(pa.string())
    yield from pa.table({"word": words, "n": found["n"].cast(pa.int64())}).to_batches(max_chunksize=50_000)


class Trie:
    """Sorted distinct words as arrays. A node: its parent, letter and the word that ends there (-1: none); node 0 is the root,
    and nodes are numbered in the order of the words' letters."""

    def __init__(self, parent: np.ndarray, letter: np.ndarray, word: np.ndarray, counts: np.ndarray, words: list[str]):
        self.parent, self.letter, self.word, self.counts, self.words = parent, letter, word, counts, words

    @classmethod
    def of(cls, words: list[str], counts: list[int]) -> Trie:
        parent, letter, ends, path, before = [-1], [0], [-1], [0], ""
        for k, word in enumerate(words):
            same = 0
            while same < len(before) and same < len(word) and before[same] == word[same]:
                same += 1
            del path[same + 1 :]
            for c in word[same:]:
                parent.append(path[-1])
                path.append(len(letter))
                letter.append(ord(c))
                ends.append(-1)
            ends[path[-1]] = k
            before = word
        return cls(np.array(parent, np.int32), np.array(letter, np.int32), np.array(ends, np.int32), np.array(counts, np.int64), words)

    @cached_property
    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys (parent * LETTER + letter) in order, and the nodes they lead to."""
        keys = self.parent[1:].astype(np.int64) * LETTER + self.letter[1:]
        order = np.argsort(keys, kind="stable")
        return keys[order], (order + 1).astype(np.int32)

    @cached_property
    def first(self) -> np.ndarray:
        """Where each node's edges begin."""
        return np.searchsorted(self.edges[0], np.arange(len(self.parent) + 1, dtype=np.int64) * LETTER)

    def neighbours(self, flat: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word of the block, word of the trie) at just one edit. flat: the block's letters; a letter stands after the last."""
        keys, child = self.edges
        q, node, i = np.arange(len(sizes)), np.zeros(len(sizes), np.int64), 0
        found: list[tuple[np.ndarray, np.ndarray]] = []
        while len(q):
            some = i < sizes[q]
            now = np.where(some, flat[begins[q] + np.minimum(i, sizes[q])], -1)
            then = np.where(i + 1 < sizes[q], flat[begins[q] + np.minimum(i + 1, sizes[q])], -1)
            gone = some & (now != then)  # of equal letters the last one goes
            count = self.first[node + 1] - self.first[node]
            of = np.repeat(np.arange(len(q)), count)
            edge = within(self.first[node], count)
            next_node, letter = child[edge], keys[edge] % LETTER
            same = letter == now[of]
            swap = ~same & some[of]
            self._follow(
                np.concatenate([q[gone], q[of][swap], q[of][~same]]),
                np.concatenate([node[gone], next_node[swap], next_node[~same]]),
                np.concatenate([np.full(int(gone.sum()) + int(swap.sum()), i + 1), np.full(int((~same).sum()), i)]),
                flat, begins, sizes, found,
            )
            q, node, i = q[of][same], next_node[same].astype(np.int64), i + 1
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.concatenate(x).astype(np.int64) for x in zip(*found, strict=True))

    def _follow(self, q: np.ndarray, node: np.ndarray, i: np.ndarray, flat: np.ndarray, begins: np.ndarray, sizes: np.ndarray, found: list) -> None:
        """States with their edit behind them follow the rest of their words."""
        keys, child = self.edges
        while len(q):
            done = i == sizes[q]
            word = self.word[node[done]]
            if (hit := word >= 0).any():
                found.append((q[done][hit], word[hit]))
            q, node, i = q[~done], node[~done], i[~done]
            key = node.astype(np.int64) * LETTER + flat[begins[q] + i]
            place = np.searchsorted(keys, key)
            place[place == len(keys)] = 0
            live = keys[place] == key if len(keys) else np.zeros(len(key), bool)
            q, node, i = q[live], child[place[live]], i[live] + 1

    def near(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the words that have neighbours here: which they are, how many neighbours, and the best (most frequent, then
        smallest) neighbour."""
        of, count, best = [], [], []
        for a in range(0, len(words), BLOCK):
            part = words[a : a + BLOCK]
            sizes = np.array(list(map(len, part)), np.int64)
            flat = np.frombuffer(("".join(part) + "\0").encode("utf-32-le"), np.uint32).astype(np.int64)
            q, w = self.neighbours(flat, np.cumsum(sizes) - sizes, sizes)
            order = np.lexsort((w, -self.counts[w], q))
            q, w = q[order], w[order]
            first = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else q
            of.append(q[first] + a)
            count.append(np.diff(np.append(first, len(q))))
            best.append(w[first])
        return tuple(np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (of, count, best))


ROW = "shard bigint, size bigint, parent binary, letter binary, word binary, counts binary, words array<string>"


def tries_of(words: DataFrame, total: int, trie_words: int, trie_letters: int) -> DataFrame:
    """A row for each trie over a range of the sorted words, none with more words or letters than stated (a longer word has a
    trie of its own)."""

    def made(number: int, part: list[tuple[str, int]]) -> pa.RecordBatch:
        own = [w for w, _ in part]
        trie = Trie.of(own, [n for _, n in part])
        blobs = [x.tobytes() for x in (trie.parent, trie.letter, trie.word, trie.counts)]
        size = sum(map(len, blobs)) + sum(map(len, own))
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([size], pa.int64()), *(pa.array([b], pa.binary()) for b in blobs), pa.array([own], pa.list_(pa.string()))], ["shard", "size", "parent", "letter", "word", "counts", "words"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, part, letters = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for word, n in zip(batch["word"].to_pylist(), batch["n"].to_pylist(), strict=True):
                if part and (len(part) >= trie_words or letters + len(word) > trie_letters):
                    yield made(number, part)
                    number, part, letters = number + 1, [], 0
                part.append((word, n))
                letters += len(word)
        if part:
            yield made(number, part)

    dealt = words.repartitionByRange(max(1, -(-total // trie_words)), "word").sortWithinPartitions("word")
    return written(arrow_map(dealt, run, ROW), "spelling-tries")


def groups(sizes: list[tuple[int, int]], most: int) -> list[list[int]]:
    """Numbers in groups whose sizes together are at most ``most`` (a larger one is a group of its own)."""
    out: list[list[int]] = []
    held = 0
    for number, size in sizes:
        if not out or held + size > most:
            out.append([])
            held = 0
        out[-1].append(number)
        held += size
    return out


def _near(words: DataFrame, tries: DataFrame, chosen: list[int]) -> DataFrame:
    """word, n_near, best struct<less, word>: what the chosen tries say of each word that has neighbours in them."""
    rows = tries.where(F.col("shard").isin(chosen)).orderBy("shard").collect()
    made = [Trie(*(np.frombuffer(r[k], np.int64 if k == "counts" else np.int32) for k in ("parent", "letter", "word", "counts")), r["words"]) for r in rows]
    shared = words.sparkSession.sparkContext.broadcast(made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch["word"].to_pylist()
            for trie in shared.value:
                of, count, best = trie.near(own)
                if len(of):
                    yield pa.RecordBatch.from_arrays([batch["word"].take(pa.array(of)), pa.array(count), pa.array(trie.counts[best]), pa.array([trie.words[w] for w in best.tolist()], pa.string())], ["word", "n_near", "best_n", "best"])

    out = written(arrow_map(words.select("word"), run, "word string, n_near bigint, best_n bigint, best string"), "spelling-near")
    shared.destroy()
    return out


def roots(links: DataFrame, longest: int) -> DataFrame:
    """links word, form: word, root (the end of its chain); chains have ``longest`` links at most and no circle.

    Each round doubles how far a word sees."""
    now = links.select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(longest)) if longest > 1 else 0):
        on = now.select(F.col("word").alias("root"), F.col("root").alias("after"))
        now = written(now.join(on, "root", "left").select("word", F.coalesce("after", "root").alias("root")), "spelling-roots")
    return now


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text", least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, ratio: int = RATIO, damage: int | None = None, trie_words: int = TRIE_WORDS, trie_letters: int = TRIE_LETTERS, tries_bytes: int = TRIES_BYTES) -> DataFrame:
    """word, form, root, n, n_near, form_n: a row for each word of enough letters and occurrences.

    near: at one inserted, deleted or replaced letter; form: the near word of largest n, if that is ``ratio`` times n or more;
    root: what forms lead to in the end, the word itself without one. n grows by the ratio with each form, which bounds chains.
    """
    if ratio < 2:
        raise ValueError("a form is at least twice as frequent")
    words = written(word_counts(docs, key, text, least_letters, damage).where(F.col("n") >= least_count), "spelling-words")
    total, most = words.agg(F.count("*"), F.max("n")).first()
    tries = tries_of(words, total, trie_words, trie_letters)
    sizes = [(r["shard"], r["size"]) for r in tries.select("shard", "size").orderBy("shard").collect()]
    parts = [_near(words, tries, chosen) for chosen in groups(sizes, tries_bytes)]
    released()
    rows = words.withColumn("n_near", F.lit(0).cast("bigint")).withColumn("best", F.lit(None).cast("struct<less: bigint, word: string>"))
    if parts:
        met = parts[0]
        for p in parts[1:]:
            met = met.unionByName(p)
        met = met.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word"))).alias("best"))
        rows = words.join(met, "word", "left").withColumn("n_near", F.coalesce("n_near", F.lit(0)))
    has = -F.col("best.less") >= F.lit(ratio) * F.col("n")
    formed = written(rows.select("word", "n", "n_near", F.when(has, F.col("best.word")).alias("form"), F.when(has, -F.col("best.less")).alias("form_n")), "spelling-forms")
    longest = math.floor(math.log((most or 1) / max(least_count, 1), ratio) + 1e-9) if most and most >= least_count else 0
    ends = roots(formed.where("form is not null").select("word", "form"), longest)
    return formed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
