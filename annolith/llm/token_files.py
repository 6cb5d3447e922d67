"""Token files with Re-Pair grammar compression.

Documents are range-partitioned and sorted by key; each partition becomes files of a stated number of blocks, and a block
is a shard with a grammar of its own. In it the distinct pieces (stretches of text that the tokenizer never joins) are
encoded once, and a grammar is grown as in Re-Pair: frequent id pairs become nonterminals again and again, first within
pieces, weighted by how often each piece occurs, then between the symbols of the sequence, until no pair stands at
``LEAST_COUNT`` places. In a round each place goes to the more frequent of the pairs that overlap there. A later round
looks only where a pair was frequent before or a new symbol stands: nowhere else can a pair be frequent. Stored are the
rules, each nonterminal's expansion length, and each document's place in symbols and in tokens, so any document, or any
token range of it, is decoded without the rest.

Results for special cases: a null text is empty, just its end id; repeated rows are stored each, equal keys in the order
of the rows, null keys first; keys are whole numbers, and others are an error; texts are encoded whole; an empty table gives
no file and no rows.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .rawfiles import read_raw, write_raw
from .shared import quoted, released, small_batches, tidied, within, written

MAGIC, HEADER = b"RPTF", struct.Struct("<qqIIIIII")
#: Bytes of text in a block, blocks in a file, and the places at which a pair stands at least to become a rule: a rule
#: takes ten bytes in the file and a symbol three, so rarer pairs don't pay.
BLOCK_BYTES, FILE_BLOCKS, LEAST_COUNT = 4 << 20, 16, 8
#: Distinct pieces whose ids a worker keeps within a task and between tasks; new pieces in a text for the tokenizer, and
#: such texts in a call.
CACHED_PIECES, KEPT_PIECES, TOGETHER, AT_ONCE = 400_000, 300_000, 32, 256
#: Buckets by which pairs are sifted before they are counted exactly, as a power of two.
SIFT_BITS = 20
#: A blank that stands inside white space or ends it: a text with one is cut differently by the tokenizer, and so is one
#: with a null character, which marks pieces here.
SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
INNER_BLANK = rf"{SPACE}\x20(?:{SPACE}|\z)|\x00"
#: A line feed between other signs than white space: an id of its own, as are the stretches around it.
NO_SPACE = rf"[^\x00{SPACE[1:]}"
TWO_LINES = rf"(?s)\A(?P<w>(?:\x00?[^\x00].*)?{NO_SPACE})\n(?P<s>{NO_SPACE}[^\n]*)\z"
#: Signs that the tokenizer never joins with a letter before them.
WORD_AND_SIGNS = r"""(?s)\A(?P<w>(?:\x00?[^\x00].*)?\pL)(?P<s>[-!"#$%&()*+,./:;<=>?@\[\\\]^_`{|}~]+)\z"""
LAST_SIGN = r"""[-!"#$%&()*+,./:;<=>?@\[\\\]^_`{|}~]\z"""

_ENCODERS: dict[int, Encoder] = {}


class Encoder:
    """Ids of pieces. Pieces end before each blank that ends a run of white space; there the tokenizer always cuts.

    A piece is written without its leading blank; one that has none, as at a text's beginning, is marked by a null
    character instead; a text that is encoded as a whole has two.
    """

    def __init__(self, file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(file)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # new pieces are encoded many at a time with a white space between them that is one id of its own
        self.marks = []
        for c in "\n\t":
            own = self.encode(c)
            if len(own) == 1 and self.encode(f"a{c} b{c} .") == [*self.encode("a"), *own, *self.encode(" b"), *own, *self.encode(" .")]:
                self.marks.append((c, own[0]))
        self.names = pa.array([], pa.large_string())
        self.flat, self.ends, self.seen = np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(0, np.int64)

    def encode(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def trim(self, most: int = CACHED_PIECES) -> None:
        """If the pieces are more than ``most``, forgets those that came only once."""
        if len(self.names) <= most:
            return
        kept = np.flatnonzero(self.seen > 1)
        if len(kept) > most // 2:
            kept = np.sort(np.argsort(-self.seen, kind="stable")[: most // 2])
        sizes = np.diff(self.ends)[kept]
        self.flat = self.flat[within(self.ends[kept], sizes)]
        self.ends = np.concatenate([[0], np.cumsum(sizes)])
        self.seen = self.seen[kept]
        self.names = self.names.take(pa.array(kept))

    def number(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All texts' pieces as numbers, and how many pieces each text has.

        The ids of piece k are flat[ends[k]:ends[k + 1]].
        """
        text = lambda x: pa.scalar(x, pa.large_string())
        column = pa.array([t or "" for t in texts], pa.large_string())
        whole = pc.match_substring_regex(column, INNER_BLANK)
        for x in self.special:
            whole = pc.or_(whole, pc.match_substring(column, x))
        cut = pc.split_pattern(pc.binary_join_element_wise(text("\0"), pc.if_else(whole, text(""), column), text("")), " ")
        counts = pc.list_value_length(cut).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = cut.flatten().dictionary_encode()
        names, at = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        apart = np.flatnonzero(whole.to_numpy(zero_copy_only=False))
        if len(apart):  # texts that are encoded as a whole are one piece
            places = (np.cumsum(counts) - counts)[apart]
            at = at.copy()
            at[places] = len(names) + np.arange(len(apart))
            names = pa.concat_arrays([names, pa.array(["\0\0" + texts[i] for i in apart], pa.large_string())])
        of = self._known(names)
        self.seen += np.bincount(of[at], minlength=len(self.seen))
        return of[at], counts

    def _find(self, names: pa.Array) -> np.ndarray:
        return pc.fill_null(pc.index_in(names, value_set=self.names), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def _known(self, names: pa.Array) -> np.ndarray:
        """The numbers of these pieces, new ones encoded."""
        out = self._find(names)
        missing = np.flatnonzero(out < 0)
        if not len(missing):
            return out
        wanted = names.take(pa.array(missing))
        out[missing] = self._split(wanted, r"\n", TWO_LINES, "\n", self._with_signs)
        return out

    def _with_signs(self, wanted: pa.Array) -> np.ndarray:
        """The numbers of pieces: a word and the signs after it are encoded apart."""
        return self._split(wanted, LAST_SIGN, WORD_AND_SIGNS, "", self._single)

    def _single(self, wanted: pa.Array) -> np.ndarray:
        at = self._find(wanted)
        fresh = np.flatnonzero(at < 0)
        if len(fresh):
            at[fresh] = self._encode_new(wanted.take(pa.array(fresh)))
        return at

    def _split(self, wanted: pa.Array, sign: str, pattern: str, between: str, number: Callable[[pa.Array], np.ndarray]) -> np.ndarray:
        """The numbers of distinct pieces; those that fit the pattern are put together from its two groups' ids, with those of
        the text between. sign: what stands in all that fit, quicker to look for."""
        some = np.flatnonzero(pc.match_substring_regex(wanted, sign).to_numpy(zero_copy_only=False))
        parts = pc.extract_regex(wanted.take(pa.array(some)), pattern)
        double = some[parts.is_valid().to_numpy(zero_copy_only=False)]
        if not len(double):
            return number(wanted)
        halves = parts.drop_null()
        second = pc.binary_join_element_wise(pa.scalar("\0", pa.large_string()), pc.struct_field(halves, "s"), pa.scalar("", pa.large_string()))
        rest = [pa.array(["\0" + between], pa.large_string())] if between else []
        split = np.zeros(len(wanted), bool)
        split[double] = True
        words = pc.replace_with_mask(wanted, pa.array(split), pc.struct_field(halves, "w"))
        every = pa.concat_arrays([words, second, *rest]).dictionary_encode()
        at = number(every.dictionary)[every.indices.to_numpy()]
        first = at[: len(wanted)]
        columns = [at[double], *[np.repeat(at[-1:], len(double))] * bool(between), at[len(wanted) : len(wanted) + len(double)]]
        strung = np.stack(columns, 1).ravel()
        sizes = np.diff(self.ends)[strung]
        first[double] = self._add(wanted.take(pa.array(double)), self.flat[within(self.ends[strung], sizes)], sizes.reshape(-1, len(columns)).sum(axis=1))
        return first

    def _add(self, names: pa.Array, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        before = len(self.names)
        self.names = pa.concat_arrays([self.names, names])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
        self.flat = np.concatenate([self.flat, flat.astype(np.int32)])
        self.seen = np.concatenate([self.seen, np.zeros(len(names), np.int64)])
        return before + np.arange(len(names))

    def _encode_new(self, names: pa.Array) -> np.ndarray:
        """Encodes pieces, most of them many at a time, and gives their numbers."""
        plain = pc.and_(pc.utf8_is_printable(names), pc.greater(pc.binary_length(names), 0)).to_numpy(zero_copy_only=False)
        rows = []
        if self.marks:  # printable pieces hold neither white space nor a mark
            self._together(names, np.flatnonzero(plain), *self.marks[0], rows)
        left = np.flatnonzero(~plain) if self.marks else np.arange(len(names))
        rest = list(zip(left.tolist(), names.take(pa.array(left, pa.int64())).to_pylist(), strict=True))
        for c, mark in self.marks:
            of = [k for k, p in rest if p and p[0] != "\0" and not p[0].isspace() and not p[-1].isspace() and c not in p]
            self._together(names, np.array(of, np.int64), c, mark, rows)
            done = set(of)
            rest = [x for x in rest if x[0] not in done]
        for k, p in rest:
            own = self.encode(p[2:] if p[:2] == "\0\0" else p[1:] if p[:1] == "\0" else " " + p)
            rows.append((np.array([k]), np.array(own, np.int32), np.array([len(own)])))
        order = np.concatenate([r for r, _, _ in rows])
        out = np.zeros(len(names), np.int64)
        out[order] = self._add(names.take(pa.array(order)), np.concatenate([f for _, f, _ in rows]), np.concatenate([z for _, _, z in rows]))
        return out

    def _together(self, names: pa.Array, of: np.ndarray, between: str, mark: int, rows: list) -> None:
        """Encodes the pieces at these places, ``TOGETHER`` at a time; adds (places, ids, numbers of ids) to the rows."""
        if not len(of):
            return
        ends = np.append(np.arange(0, len(of), TOGETHER), len(of))
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), names.take(pa.array(of)).cast(pa.string()))
        texts, parts = [f" {t}{between}" for t in pc.binary_join(lists, between + " ").to_pylist()], []
        for i in range(0, len(texts), AT_ONCE):
            parts += [np.array(x.ids, np.int32) for x in self.tokenizer.encode_batch_fast(texts[i : i + AT_ONCE], add_special_tokens=False)]
        got = np.concatenate(parts)
        cut = got == mark  # a mark ends each piece
        rows.append((of, got[~cut], np.diff(np.flatnonzero(cut), prepend=-1) - 1))


def sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of stretches of these lengths, one after the other."""
    running = np.concatenate([[0], np.cumsum(values)])
    return np.diff(running[np.concatenate([[0], np.cumsum(lengths)])])


def encoder(file: str) -> Encoder:
    """One for each Python worker, kept from task to task."""
    at = zlib.crc32(file.encode())
    if at not in _ENCODERS:
        _ENCODERS[at] = Encoder(file)
    return _ENCODERS[at]


class Growing:
    """Symbols of stretches whose frequent pairs become rules, round by round.

    symbols: in stretches that end at ``ends``; no pair crosses an end. weight: how much a place counts (None: 1).
    """

    def __init__(self, symbols: np.ndarray, ends: np.ndarray, weight: np.ndarray | None):
        self.symbols, self.ends, self.weight = symbols, ends, weight
        self.active = np.ones(len(symbols), bool)  # where a frequent pair may begin
        self.active[ends[ends > 0] - 1] = False

    def grow(self, rules: list[np.ndarray], next_id: int, least: int) -> int:
        """Replaces pairs until none stands at ``least`` places; gives the next free symbol."""
        while len(pairs := self._round(next_id, least)):
            rules.append(np.stack([pairs >> 32, pairs & 0xFFFFFFFF], 1))
            next_id += len(pairs)
        return next_id

    def _round(self, next_id: int, least: int) -> np.ndarray:
        """The pairs (left << 32 | right) that this round replaced, the k-th by next_id + k."""
        places = np.flatnonzero(self.active)
        codes = self.symbols[places].astype(np.int64)
        codes <<= 32
        codes |= self.symbols[1:][places]
        weight = None if self.weight is None else self.weight[places]
        if len(places) > 1 << 14:  # pairs of rare buckets are rare
            bucket = codes.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            bucket >>= np.uint64(64 - SIFT_BITS)
            bucket = bucket.view(np.int64)
            some = np.flatnonzero((np.bincount(bucket, weight, 1 << SIFT_BITS) >= least)[bucket])
            del bucket
            places, codes, weight = places[some], codes[some], None if weight is None else weight[some]
        coded = pa.array(codes).dictionary_encode()
        of, pairs = coded.indices.to_numpy(), coded.dictionary.to_numpy()
        counts = np.bincount(of, weight, len(pairs))
        often = counts[of] >= least
        places, of = places[often], of[often]
        if not len(places):
            return pairs[:0]
        at = chosen(places, counts[of])
        uses = np.bincount(of[at], None if weight is None else weight[often][at], len(pairs))
        if (worth := uses[of[at]] >= least / 2).any():  # others wait for what this round leaves of them
            at = at[worth]
        used, number = np.unique(of[at], return_inverse=True)
        taken = places[at]
        self._replace(places, taken, next_id + number)
        return pairs[used]

    def _replace(self, places: np.ndarray, taken: np.ndarray, new: np.ndarray) -> None:
        n = len(self.symbols)
        keep, touched = np.ones(n, bool), np.zeros(n + 1, bool)
        keep[taken + 1] = False
        touched[taken] = touched[taken + 1] = True
        self.symbols[taken] = new
        at = np.concatenate([[0], np.cumsum(keep)])
        self.symbols, self.ends = self.symbols[keep], at[self.ends]
        self.weight = None if self.weight is None else self.weight[keep]
        active = np.zeros(len(self.symbols) + 1, bool)
        whole = places[~(touched[places] | touched[places + 1])]
        active[at[whole]] = active[at[taken]] = True
        active[at[taken] - 1] = True  # of the first symbol that is the spare place at the end
        active = active[:-1]
        active[self.ends[self.ends > 0] - 1] = False
        self.active = active


def chosen(places: np.ndarray, score: np.ndarray) -> np.ndarray:
    """Of ascending places, of which neighbours overlap: indices of the higher scores, every second of an equal run."""
    beside = places[1:] == places[:-1] + 1
    first = np.append(True, ~beside | (score[1:] != score[:-1]))
    start = np.flatnonzero(first)
    stop = np.append(start[1:], len(places)) - 1
    higher = np.append(0, np.where(beside, score[:-1], 0))[start] > score[start]  # the place before goes to its own pair
    lower = np.append(np.where(beside, score[1:], 0), 0)[stop] <= score[stop]
    run = np.cumsum(first) - 1
    offset = np.arange(len(places)) - start[run] - higher[run]
    return np.flatnonzero((offset >= 0) & (offset % 2 == 0) & (lower[run] | (np.arange(len(places)) != stop[run])))


def rule_lengths(rules: np.ndarray, base: int, rounds: np.ndarray) -> np.ndarray:
    """Expansion lengths; rules of a round use symbols of earlier rounds only."""
    out = np.ones(len(rules), np.int64)
    stops = [*rounds, len(rules)]
    for a, b in zip(stops, stops[1:], strict=False):
        own = rules[a:b]
        out[a:b] = np.where(own < base, 1, out[np.where(own < base, 0, own - base)]).sum(axis=1)
    return out


def _three(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values.astype("<u4")).view(np.uint8).reshape(-1, 4)[:, :3].tobytes()


def _from_three(data: memoryview) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(-1, 3)
    out = np.zeros((len(raw), 4), np.uint8)
    out[:, :3] = raw
    return out.view("<u4")[:, 0].astype(np.int32)


def strung(coder: Encoder, numbers: np.ndarray, lengths: np.ndarray, rules: list[np.ndarray], base: int, end_id: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The documents' symbols, each document's followed by the end id, after a grammar has grown on the distinct pieces; where
    each document ends, how many ids it has, and the next free symbol."""
    counts = np.bincount(numbers, minlength=1)
    kinds = np.flatnonzero(counts)
    at, counts = (np.cumsum(counts > 0) - 1)[numbers], counts[kinds]
    sizes = (coder.ends[1:] - coder.ends[:-1])[kinds] if len(kinds) else np.zeros(0, np.int64)
    doc_tokens = sums(sizes[at], lengths) + 1
    symbols = coder.flat[within(coder.ends[kinds], sizes)]  # of four bytes, as symbols stay below 1 << 24
    # the grammar grows on the pieces that occur often enough to give rules; the others stay as they are
    often = np.repeat(counts >= least, sizes)
    grown = Growing(symbols[often], np.cumsum(sizes[counts >= least]), np.repeat(counts, sizes)[often].astype(float))
    next_id = grown.grow(rules, base, least)
    new_sizes = sizes.copy()
    new_sizes[counts >= least] = np.diff(np.concatenate([[0], grown.ends]))
    merged = np.empty(int(new_sizes.sum()), np.int32)
    inside = np.repeat(counts >= least, new_sizes)
    merged[inside] = grown.symbols
    merged[~inside] = symbols[~often]
    starts = np.cumsum(new_sizes) - new_sizes
    doc_ends = np.cumsum(sums(new_sizes[at], lengths) + 1)
    sequence = np.full(doc_ends[-1] if len(doc_ends) else 0, end_id, np.int32)
    text = np.ones(len(sequence), bool)
    text[doc_ends - 1] = False
    sequence[text] = merged[within(starts[at], new_sizes[at])]
    return sequence, doc_ends, doc_tokens, next_id


def pack(keys: list[int | None], texts: list[str | None], coder: Encoder, base: int, end_id: int, shard: int, place: int = 0, least: int = LEAST_COUNT) -> bytes:
    """A block: the documents' ids, each followed by the end id, under a grammar. shard, place: its partition, its place there."""
    rules: list[np.ndarray] = []
    sequence, doc_ends, doc_tokens, next_id = strung(coder, *coder.number(texts), rules, base, end_id, least)
    grown = Growing(sequence, doc_ends, None)
    del sequence
    next_id = grown.grow(rules, next_id, least)
    sequence, doc_ends = grown.symbols, grown.ends
    if next_id >= 1 << 24:
        raise ValueError("a block has too many symbols for its file format")
    rounds = np.cumsum([0, *map(len, rules)])[:-1]
    table = np.concatenate([*rules, np.zeros((0, 2), np.int64)])
    names = np.array([k is not None for k in keys], np.uint8)
    parts = [
        np.array([0 if k is None else k for k in keys], "<i8").tobytes(),
        names.tobytes(),
        doc_ends.astype("<u4").tobytes(),
        doc_tokens.astype("<u4").tobytes(),
        rounds.astype("<u4").tobytes(),
        _three(table.ravel()),
        rule_lengths(table, base, rounds).astype("<u4").tobytes() if len(table) else b"",
        _three(sequence),
    ]
    body = HEADER.pack(shard, place, base, end_id, len(keys), len(rounds), len(table), len(sequence)) + b"".join(parts)
    return MAGIC + struct.pack("<QI", len(body), zlib.crc32(body)) + body


class Block:
    """A packed block, open for random access."""

    def __init__(self, body: memoryview):
        self.shard, self.place, self.base, self.end_id, n, k, m, s = HEADER.unpack_from(body)
        at = HEADER.size

        def take(size: int) -> memoryview:
            nonlocal at
            at += size
            return body[at - size : at]

        keys, named = np.frombuffer(take(8 * n), "<i8"), np.frombuffer(take(n), np.uint8)
        self.keys = [int(x) if y else None for x, y in zip(keys, named, strict=True)]
        self.doc_ends = np.frombuffer(take(4 * n), "<u4").astype(np.int64)
        self.doc_tokens = np.frombuffer(take(4 * n), "<u4").astype(np.int64)
        self.rounds = np.frombuffer(take(4 * k), "<u4").astype(np.int64)
        self.rules = _from_three(take(6 * m)).reshape(m, 2)
        self.lengths = np.frombuffer(take(4 * m), "<u4").astype(np.int64)
        self.packed = take(3 * s)

    @cached_property
    def sequence(self) -> np.ndarray:
        return _from_three(self.packed)

    @cached_property
    def table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids below every symbol one after the other, where each symbol's begin, and how many they are."""
        flat = np.arange(self.base, dtype=np.int32)
        starts, sizes = np.arange(self.base), np.ones(self.base, np.int64)
        stops = [*self.rounds, len(self.rules)]
        for a, b in zip(stops, stops[1:], strict=False):
            own = self.rules[a:b].ravel()
            parts = sizes[own]
            made = flat[within(starts[own], parts)]
            new = parts.reshape(-1, 2).sum(axis=1)
            starts = np.concatenate([starts, len(flat) + np.cumsum(new) - new])
            sizes = np.concatenate([sizes, new])
            flat = np.concatenate([flat, made])
        return flat, starts, sizes

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """The ids that symbols stand for."""
        flat, starts, sizes = self.table
        return flat[within(starts[symbols], sizes[symbols])]

    def document(self, i: int) -> np.ndarray:
        return self.expand(self.sequence[self.doc_ends[i - 1] if i else 0 : self.doc_ends[i]])

    def tokens(self, i: int, start: int, stop: int) -> np.ndarray:
        """Ids start to stop of a document; only the symbols over that range are opened."""
        symbols = self.sequence[self.doc_ends[i - 1] if i else 0 : self.doc_ends[i]]
        sizes = np.where(symbols < self.base, 1, self.lengths[np.where(symbols < self.base, 0, symbols - self.base)]) if len(self.lengths) else np.ones(len(symbols), np.int64)
        ends = np.cumsum(sizes)
        a = int(np.searchsorted(ends, start, "right"))
        b = int(np.searchsorted(ends, stop, "left")) + 1
        skipped = int(ends[a - 1]) if a else 0
        return self.expand(symbols[a:b])[start - skipped : stop - skipped]

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        flat = self.expand(self.sequence)
        stops = np.cumsum(self.doc_tokens)
        for key, a, b in zip(self.keys, stops - self.doc_tokens, stops, strict=True):
            yield key, flat[a:b]


def blocks_of(data: bytes) -> Iterator[Block]:
    view, at = memoryview(data), 0
    while at < len(data):
        size, check = struct.unpack_from("<QI", view, at + 4)
        body = view[at + 16 : at + 16 + size]
        if view[at : at + 4] != MAGIC or len(body) != size or size < HEADER.size or zlib.crc32(body) != check:
            raise ValueError("not a whole block")
        yield Block(body)
        at += 16 + size + 1  # a line feed follows each block


def write_tokens(docs: DataFrame, path: str, tokenizer_file: str, key: str = "doc_id", text: str = "text", end_id: int = 2, block_bytes: int = BLOCK_BYTES, file_blocks: int = FILE_BLOCKS) -> None:
    """Writes the documents' ids in ascending key order; the blocks' order is that of their shards and places."""
    from tokenizers import Tokenizer

    with open(tokenizer_file, encoding="utf-8") as f:
        file = f.read()
    tokenizer = Tokenizer.from_str(file)
    base = max(tokenizer.get_vocab_size(with_added_tokens=True), end_id + 1)
    if not cuts_before_blanks(tokenizer):
        raise ValueError("this tokenizer joins what stands before a blank with what stands after it")
    shared = docs.sparkSession.sparkContext.broadcast(file)
    del tokenizer
    released()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder, shard = encoder(shared.value), TaskContext.get().partitionId()
        keys, texts, held, place = [], [], 0, 0

        def block() -> pa.RecordBatch:
            packed = pack(keys, texts, coder, base, end_id, shard, place)
            coder.trim()
            released(collect=False)
            return pa.RecordBatch.from_arrays([pa.array([packed], pa.binary())], ["block"])

        for batch in batches:
            for k, t in zip(batch["key"], batch["text"], strict=True):
                keys.append(k.as_py())
                texts.append(t.as_py())
                held += len(texts[-1] or "")
                if held >= block_bytes:
                    yield block()
                    keys, texts, held, place = [], [], 0, place + 1
        if keys:
            yield block()
        coder.trim(KEPT_PIECES)

    # the row's number parts rows of one key, should there be very many
    rows = docs.select(F.col(quoted(key)).cast("bigint").alias("key"), F.col(quoted(text)).alias("text"), F.monotonically_increasing_id().alias("row"))
    dealt = rows.repartitionByRange("key", "row").sortWithinPartitions("key", "row")
    with small_batches(docs.sparkSession):
        write_raw(dealt.select("key", "text").mapInArrow(tidied(run), "block binary"), path, "\n", file_blocks)


def cuts_before_blanks(tokenizer: object) -> bool:
    """Whether the tokenizer cuts a text before each blank that ends a run of white space, between a letter and a sign, and on
    both sides of a single line feed."""
    ids = lambda t: tokenizer.encode(t, add_special_tokens=False).ids
    parts = (["the"], [" end"], ["a", ","], [" b", ".)"], ["1"], [" 2", "!"], ["\n"], [" x", "-"], [" é"], ["日"], [" 's"])
    lines = [[*x, "\n", *y] for x in parts for y in parts if x != ["\n"] and y[0][0] not in " \n"]
    return all(ids("".join(z)) == [i for p in z for i in ids(p)] for z in lines + [[*x, *y] for x in parts for y in parts if y[0][0] == " "])


def read_tokens(spark: SparkSession, path: str, key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """key, start (ids of all documents before), n_tokens, ids_crc32, and ids if asked for: a row for each document."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.int32())] * with_ids
    names = ["key", "shard", "place", "before", "n_tokens", "ids_crc32"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch["content"]:
                for block in blocks_of(data.as_py()):
                    cells, before = [[] for _ in kinds], 0
                    for k, ids in block.documents():
                        for cell, value in zip(cells, (k, block.shard, block.place, before, len(ids), zlib.crc32(ids.astype("<i4", copy=False)), ids), strict=False):
                            cell.append(value)
                        before += len(ids)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, kinds, strict=True)], names)

    schema = "key bigint, shard bigint, place bigint, before bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids
    rows = written(read_raw(spark, path).select("content").mapInArrow(tidied(run), schema), "tokens-read")  # files are read once
    blocks = rows.groupBy("shard", "place").agg(F.sum("n_tokens").alias("tokens"))
    # two levels: a row for each shard, and the blocks of each shard
    shards = blocks.groupBy("shard").agg(F.sum("tokens").alias("all")).selectExpr("shard", "coalesce(sum(all) over (order by shard rows between unbounded preceding and 1 preceding), 0) as base")
    starts = blocks.selectExpr("shard", "place", "coalesce(sum(tokens) over (partition by shard order by place rows between unbounded preceding and 1 preceding), 0) as inside").join(shards, "shard")
    out = rows.join(starts.select("shard", "place", (F.col("base") + F.col("inside")).alias("first")), ["shard", "place"])
    return out.select(F.col("key").alias(key), (F.col("first") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)
