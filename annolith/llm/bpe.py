"""Byte-level BPE: words are guessed greedily, the guesses are verified pair by pair, and only failing words are merged.

A text is cut into words as the tokenizer cuts it. Of the words that a worker has not met, all at once:

* speculate: the longest token that fits is taken again and again, for all words side by side, over a trie of the tokens;
* verify: a sequence of tokens is what merging gives just if each token is what its own text gives and each adjacent pair
  is compatible. A pair is not if, at some moment of merging its two texts apart, the symbols on either side of the border
  would have merged. Those symbols are found by undoing the two tokens' last merges, latest first, so all pairs are checked
  together in as many rounds as a token has merges;
* merge: words with a token or pair that failed are merged exactly, lowest rank first and leftmost among equal ranks.

Ids of words are kept in each worker up to a stated number; what is forgotten is only made again.

Special cases: a null text is empty and has no ids; texts are taken whole, of any length; special tokens in a text are
tokens of their own, as the tokenizer has it; ids that the vocabulary lacks give no text; a null list of ids gives an empty
text; bytes that are no UTF-8 become U+FFFD; repeated rows are each encoded; columns may have any names, and a column of the
result's name is replaced.
"""

from __future__ import annotations

import heapq
import json
import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .shared import arrow_map, stretches, within

#: How byte-level BPE of this kind cuts words (fixed by the tokenizer's format).
WORDS = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
#: Bytes of text that are worked on at once (a longer text comes alone), and words whose ids a worker keeps.
STRETCH, KEPT_WORDS = 4 << 20, 600_000
#: Symbols from which a failing word is merged with a heap, not in rounds.
LONG_WORD = 48
NEVER = np.int32(np.iinfo(np.int32).max)

_CODERS: dict[int, Coder] = {}


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary: printable Latin-1 for itself, others from U+0100 upward."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(own)]
    return {**{chr(b): b for b in own}, **{chr(256 + i): b for i, b in enumerate(others)}}


class Coder:
    """A tokenizer file's model as arrays. Symbols are numbered so that bytes come first and then merges by rank."""

    def __init__(self, file: str):
        given = json.loads(file)
        model, before = given["model"], given.get("pre_tokenizer") or {}
        odd = [k for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix") if model.get(k)]
        if model["type"] != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or given.get("normalizer") or odd or model.get("ignore_merges"):
            raise ValueError("not a plain byte-level BPE file")
        letters, vocab = byte_letters(), model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        names = [chr_ for chr_, _ in sorted(letters.items(), key=lambda x: x[1])] + [a + b for a, b in merges]
        number = {name: i for i, name in enumerate(names)}
        if len(number) != len(names):
            raise ValueError("a token that two merges make")
        self.left, self.right = (np.concatenate([np.zeros(256, np.int32), np.array([number[m[k]] for m in merges], np.int32)]) for k in (0, 1))
        made = np.arange(256, len(names))
        if (self.left[256:] >= made).any() or (self.right[256:] >= made).any():
            raise ValueError("a merge that comes before one that it needs")
        self.ids = np.array([vocab[n] for n in names], np.int32)
        self.texts = [bytes(letters[c] for c in n) for n in names]
        keys = self.left[256:].astype(np.int64) << 32 | self.right[256:]
        self.pair_order = np.argsort(keys)
        self.pair_keys = keys[self.pair_order]
        self.special = {t["content"]: t["id"] for t in given.get("added_tokens", [])}
        if any(t.get(k) for t in given.get("added_tokens", []) for k in ("lstrip", "rstrip", "single_word")):
            raise ValueError("special tokens that take white space with them")
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._trie()
        self.names = pa.array([], pa.large_binary())
        self.flat, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)

    # ---- speculate

    def _trie(self) -> None:
        """Edges (node * 256 + byte) and where they lead; the token of each node, or -1."""
        nodes: dict[bytes, int] = {b"": 0}
        edges: dict[int, int] = {}
        for text in self.texts:
            at = 0
            for i in range(len(text)):
                part = text[: i + 1]
                after = nodes.setdefault(part, len(nodes))
                edges[at * 256 + text[i]] = after
                at = after
        self.token = np.full(len(nodes), -1, np.int32)
        self.token[[nodes[t] for t in self.texts]] = np.arange(len(self.texts))
        self.edge_keys = np.array(sorted(edges), np.int64)
        self.edge_to = np.array([edges[k] for k in self.edge_keys.tolist()], np.int32)
        self.first = np.zeros(256, np.int32)
        self.first[self.edge_keys[:256]] = self.edge_to[:256]  # each byte is a token
        self.sizes = np.array([len(t) for t in self.texts], np.int64)

    def greedy(self, data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The longest tokens that fit one after the other: tokens word by word, and how many each word has."""
        word, at = np.flatnonzero(begins < ends), begins[begins < ends]
        took_word, took_token = [], []
        while len(word):
            node = self.first[data[at]]
            best, live, depth = self.token[node].copy(), np.arange(len(word)), 1
            while len(live):
                live = live[at[live] + depth < ends[word[live]]]
                key = node[live].astype(np.int64) * 256 + data[at[live] + depth]
                place = np.searchsorted(self.edge_keys, key)
                place[place == len(self.edge_keys)] = 0
                found = self.edge_keys[place] == key
                live, place = live[found], place[found]
                node[live] = self.edge_to[place]
                token = self.token[node[live]]
                best[live[token >= 0]] = token[token >= 0]
                depth += 1
            took_word.append(word)
            took_token.append(best)
            at = at + self.sizes[best]
            more = at < ends[word]
            word, at = word[more], at[more]
        if not took_word:
            return np.zeros(0, np.int32), np.zeros(len(begins), np.int64)
        words, tokens = np.concatenate(took_word), np.concatenate(took_token)
        return tokens[np.argsort(words, kind="stable")], np.bincount(words, minlength=len(begins))

    # ---- verify

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The symbol that a and b merge to, NEVER if they do not."""
        keys = a.astype(np.int64) << 32 | b
        place = np.searchsorted(self.pair_keys, keys)
        place[place == len(self.pair_keys)] = 0
        return np.where(self.pair_keys[place] == keys, self.pair_order[place].astype(np.int32) + 256, NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """Whether texts that end in token a and begin with token b merge apart from one another.

        before: the merges up to these symbols only (the pair itself makes that symbol); None: all merges.
        """
        n = len(a)
        good, live = np.ones(n, bool), np.arange(n)
        x, y = a.copy(), b.copy()
        limit = np.full(n, NEVER) if before is None else before.copy()
        while len(live):
            # the border symbols x and y stand side by side until one of them goes into the merge ``limit``
            bad = self.rank(x, y) < limit
            good[live[bad]] = False
            going = ~bad & (np.maximum(x, y) >= 256)
            live, x, y = live[going], x[going], y[going]
            undo_left = x > y  # the later merge is undone first; of two equal ones the left was made first
            # a pair at the border is merged before an equal pair to its right, and after one to its left
            limit = np.where(undo_left, x, y + 1)
            x, y = np.where(undo_left, self.right[x], x), np.where(undo_left, y, self.left[y])
        return good

    @cached_property
    def own(self) -> np.ndarray:
        """Whether each token's text gives just that token."""
        n = len(self.texts)
        made = np.arange(256, n, dtype=np.int32)
        good = np.ones(n, bool)
        good[256:] = self.compatible(self.left[256:], self.right[256:], made)
        while True:  # and so do the tokens it is made of
            after = good.copy()
            after[256:] &= good[self.left[256:]] & good[self.right[256:]]
            if (after == good).all():
                return good
            good = after

    def verified(self, tokens: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Of words' guessed tokens: which words are right."""
        word = np.repeat(np.arange(len(counts)), counts)
        good = np.ones(len(counts), bool)
        good[word[~self.own[tokens]]] = False
        inner = np.flatnonzero(word[1:] == word[:-1])
        pairs, of = np.unique(tokens[inner].astype(np.int64) << 32 | tokens[inner + 1], return_inverse=True)
        fine = self.compatible((pairs >> 32).astype(np.int32), (pairs & 0xFFFFFFFF).astype(np.int32))
        good[word[inner[~fine[of]]]] = False
        return good

    # ---- merge

    def merged(self, words: list[bytes]) -> list[np.ndarray]:
        """The exact symbols of words, all short ones together: a round merges one pair in each."""
        out: list[np.ndarray | None] = [self._heap(w) if len(w) > LONG_WORD else None for w in words]
        live = np.array([i for i, x in enumerate(out) if x is None], np.int64)
        sizes = np.array([len(words[i]) for i in live], np.int64)
        symbols = np.frombuffer(b"".join(words[i] for i in live), np.uint8).astype(np.int32)
        while len(live):
            ends = np.cumsum(sizes)
            begins = ends - sizes
            rank = np.append(self.rank(symbols[:-1], symbols[1:]), NEVER)
            rank[ends - 1] = NEVER  # no pair crosses a word's end
            least = np.minimum.reduceat(rank, begins)
            some = least < NEVER
            for i in np.flatnonzero(~some):
                out[live[i]] = symbols[begins[i] : ends[i]]
            at = np.flatnonzero(rank == np.repeat(np.where(some, least, -1), sizes))
            of = np.searchsorted(ends, at, "right")
            at = at[np.append(True, of[1:] != of[:-1])] if len(at) else at  # the leftmost in each word
            symbols[at] = rank[at]
            keep = np.repeat(some, sizes)
            keep[at + 1] = False
            symbols, live, sizes = symbols[keep], live[some], sizes[some] - 1
        return out

    def _heap(self, word: bytes) -> np.ndarray:
        symbols, n = list(word), len(word)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        known = self._ranks
        heap = [(r, i) for i in range(n - 1) if (r := known.get((symbols[i], symbols[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i] if symbols[i] >= 0 else -1
            if j < 0 or known.get((symbols[i], symbols[j])) != r:
                continue
            symbols[i], symbols[j] = r, -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
                if (s := known.get((r, symbols[after[i]]))) is not None:
                    heapq.heappush(heap, (s, i))
            if before[i] >= 0 and (s := known.get((symbols[before[i]], r))) is not None:
                heapq.heappush(heap, (s, before[i]))
        return np.array([s for s in symbols if s >= 0], np.int32)

    @cached_property
    def _ranks(self) -> dict[tuple[int, int], int]:
        return {(int(a), int(b)): i + 256 for i, (a, b) in enumerate(zip(self.left[256:].tolist(), self.right[256:].tolist(), strict=True))}

    # ---- words and texts

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words one after the other, and how many each has."""
        sizes = np.array(list(map(len, words)), np.int64)
        ends = np.cumsum(sizes)
        tokens, counts = self.greedy(np.frombuffer(b"".join(words), np.uint8), ends - sizes, ends)
        wrong = np.flatnonzero(~self.verified(tokens, counts))
        if len(wrong):
            right = self.merged([words[i] for i in wrong.tolist()])
            new = np.array(list(map(len, right)), np.int64)
            keep = np.ones(len(words), bool)
            keep[wrong] = False
            kept = tokens[np.repeat(keep, counts)]
            counts = counts.copy()
            old = np.where(keep, counts, 0)
            counts[wrong] = new
            begins = np.cumsum(counts) - counts
            out = np.empty(int(counts.sum()), np.int32)
            out[within(begins, old)] = kept
            out[within(begins[wrong], new)] = np.concatenate(right)
            tokens = out
        return self.ids[tokens], counts

    def _known(self, names: pa.Array) -> np.ndarray:
        """Numbers of distinct words; new ones are encoded."""
        at = pc.fill_null(pc.index_in(names, value_set=self.names), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        fresh = np.flatnonzero(at < 0)
        if len(fresh):
            new = names.take(pa.array(fresh))
            flat, counts = self.encode_words(new.to_pylist())
            at[fresh] = len(self.names) + np.arange(len(fresh))
            self.names = pa.concat_arrays([self.names, new])
            self.flat = np.concatenate([self.flat, flat])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(counts)])
        return at

    def forget(self) -> None:
        """If a worker keeps too many words, the later half of them goes: frequent words come early."""
        if len(self.names) > KEPT_WORDS:
            half = KEPT_WORDS // 2
            self.names = pa.concat_arrays([self.names[:half]])
            self.ends = self.ends[: half + 1].copy()
            self.flat = self.flat[: self.ends[-1]].copy()

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts one after the other, and how many each has."""
        words, counts, marks = [], [], []
        for text in texts:
            before = len(words)
            if text:
                if self.cut and (parts := self.cut.split(text))[1:]:
                    for i, part in enumerate(parts):  # every second part is a special token
                        if i % 2:
                            marks.append((len(words), self.special[part]))
                            words.append("")
                        else:
                            words += WORDS.findall(part)
                else:
                    words += WORDS.findall(text)
            counts.append(len(words) - before)
        coded = pa.array(words, pa.large_string()).cast(pa.large_binary()).dictionary_encode()
        at = self._known(coded.dictionary)[coded.indices.to_numpy()]
        sizes = np.diff(self.ends)[at]
        begins = self.ends[:-1][at]
        flat = self.flat
        if marks:
            places = np.array([m for m, _ in marks])
            sizes[places], begins[places] = 1, len(flat) + np.arange(len(marks))
            flat = np.concatenate([flat, np.array([i for _, i in marks], np.int32)])
        total = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(np.array(counts, np.int64))])]
        return flat[within(begins, sizes)], np.diff(total)

    @cached_property
    def id_bytes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All tokens' bytes, and by id their places in them and their lengths; the last place is for unknown ids."""
        texts = [b""] * (max([*self.ids.tolist(), *self.special.values()]) + 2)
        for i, t in zip(self.ids.tolist(), self.texts, strict=True):
            texts[i] = t
        for t, i in self.special.items():
            texts[i] = t.encode()
        sizes = np.array(list(map(len, texts)), np.int64)
        return np.frombuffer(b"".join(texts), np.uint8), np.cumsum(sizes) - sizes, sizes

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The texts of lists of ids that stand one after the other."""
        data, begins, sizes = self.id_bytes
        known = np.where((ids >= 0) & (ids < len(sizes) - 1), ids, len(sizes) - 1)
        own = sizes[known]
        whole = data[within(begins[known], own)].tobytes()
        stops = np.concatenate([[0], np.cumsum(own)])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        return [whole[a:b].decode("utf-8", "replace") for a, b in zip(stops, stops[1:], strict=False)]


def coder(file: str) -> Coder:
    """One for each Python worker, kept from task to task."""
    at = zlib.crc32(file.encode())
    if at not in _CODERS:
        _CODERS[at] = Coder(file)
    return _CODERS[at]


def encoded(batches: Iterator[pa.RecordBatch], file: str, text: str, ids: str, most: int = STRETCH) -> Iterator[pa.RecordBatch]:
    """The batches with a column of ids, in smaller batches."""
    own = coder(file)
    for batch in batches:
        for a, b in stretches(batch[text], most):
            rows = batch.slice(a, b - a)
            flat, counts = own.encode(rows[text].to_pylist())
            made = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(flat, pa.int32()))
            own.forget()
            yield with_column(rows, ids, made)


def decoded(batches: Iterator[pa.RecordBatch], file: str, ids: str, text: str) -> Iterator[pa.RecordBatch]:
    """The batches with a column of the texts of their ids."""
    own = coder(file)
    for batch in batches:
        lists = batch[ids]
        counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = pc.fill_null(lists.flatten(), -1).to_numpy(zero_copy_only=False)
        yield with_column(batch, text, pa.array(own.decode(flat, counts), pa.string()))


def with_column(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    kept = [i for i, n in enumerate(batch.schema.names) if n != name]
    return pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), values], [*(batch.schema.names[i] for i in kept), name])


def _extended(df: DataFrame, field: StructField) -> StructType:
    return StructType([*(f for f in df.schema if f.name != field.name), field])


def encode(docs: DataFrame, file: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with the ids of each whole text (array<int>). file: the content of a tokenizer file. No row moves."""
    shared = docs.sparkSession.sparkContext.broadcast(file)
    return arrow_map(docs, lambda batches: encoded(batches, shared.value, text, ids), _extended(docs, StructField(ids, ArrayType(IntegerType()))))


def decode(rows: DataFrame, file: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """rows with the text of each list of ids. No row moves."""
    shared = rows.sparkSession.sparkContext.broadcast(file)
    return arrow_map(rows, lambda batches: decoded(batches, shared.value, ids, text), _extended(rows, StructField(text, StringType())))
