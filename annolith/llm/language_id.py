"""Language identification by segmentation-marginalised unigrams.

Each language has a unigram distribution over the lower-case pieces of a fixed public vocabulary. A word's probability
is the sum over all its segmentations into pieces, which a forward pass yields; training runs forward and backward
passes (EM) over word counts of a bounded sample of labelled rows, each pass a Spark job that sums expected piece counts.
A text's score is the sum of its words' log probabilities, normalised over the languages. The forward pass runs in numpy
over all new words of a batch at once, and a task keeps the scores of the words it has seen.

Results for special cases: a null text, or one without a letter (Unicode's category L), is ``und`` with score 0; words of any length
are one word each, of which no piece is cut; letters outside the vocabulary, and pieces that no language's sample holds, count the same for every language; ties go to the
language that sorts first; texts are read whole; repeated rows are scored each, and learned from once for each key; with
no labelled rows every text is ``und``; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .shared import arrow_map, hash_bound, quoted, released, stretches, tidied, written

#: The sample that the model is fitted on: so many labelled rows of each language, those whose hash is least. EM steps.
SAMPLE_PER_LANG, EM_STEPS = 400, 3
SMOOTHING, UNKNOWN, CACHED_WORDS, START = 0.05, 1e-7, 150_000, "▁"
#: Bytes of text that are scored at once; a longer text comes alone.
STRETCH = 1 << 20
#: Expected counts are summed as whole numbers of this fraction, so that their sums don't depend on the order.
GRAIN = 1e6
LETTERS = regex.compile(r"[\p{L}\p{M}]+")
ANY_LETTER = regex.compile(r"\p{L}")


def public_pieces(path: str) -> list[str]:
    """The pieces of a sentencepiece vocabulary file that can occur in lower-case words."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
    return sorted(p for p in pieces if p != START and (bare := p.removeprefix(START)) == bare.lower() and LETTERS.fullmatch(bare))


LETTER = 1 << 21  # above all code points
Edges = dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]


class Lattice:
    """Finds, for many words at once, which pieces begin and end where: a trie of the pieces, walked from every letter."""

    def __init__(self, pieces: list[str]):
        nodes: dict[str, int] = {"": 0}
        edges: dict[int, int] = {}
        for p in pieces:
            at = 0
            for i, c in enumerate(p):
                after = nodes.setdefault(p[: i + 1], len(nodes))
                edges[at * LETTER + ord(c)] = after
                at = after
        self.pieces = pieces
        self.keys = np.array(sorted(edges), np.int64)
        self.to = np.array([edges[k] for k in self.keys.tolist()], np.int32)
        self.piece = np.full(len(nodes), len(pieces), np.int32)
        self.piece[[nodes[p] for p in pieces if p]] = [i for i, p in enumerate(pieces) if p]

    def edges(self, codes: np.ndarray) -> Edges:
        """codes: words of one length in rows. By (start, end): the words with a piece there, and which; a single letter that is
        no piece has the number of pieces."""
        n, width = codes.shape
        flat, found = codes.ravel().astype(np.int64), {}
        none = len(self.pieces)
        at, node, depth = np.arange(n * width), np.zeros(n * width, np.int64), 0
        while len(at):
            place, ok = self._step(node, flat[at + depth])
            if depth == 0:  # all places are live, in order
                single = np.full(len(at), none, np.int32)
                single[ok] = self.piece[self.to[place[ok]]]
                for i in range(width):
                    found[i, i + 1] = np.arange(n), single[i::width]
            at, node = at[ok], self.to[place[ok]].astype(np.int64)
            depth += 1
            if depth > 1:
                hit = np.flatnonzero(self.piece[node] < none)
                start = at[hit] % width
                order = np.argsort(start, kind="stable")
                hit, start = hit[order], start[order]
                stops = np.flatnonzero(np.diff(start, append=-1)) + 1
                for low, high in zip([0, *stops[:-1].tolist()], stops.tolist(), strict=True) if len(hit) else ():
                    found[int(start[low]), int(start[low]) + depth] = at[hit[low:high]] // width, self.piece[node[hit[low:high]]]
            more = at % width + depth < width
            at, node = at[more], node[more]
        return found

    def _step(self, node: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys):
            return np.zeros(len(node), np.int64), np.zeros(len(node), bool)
        key = node * LETTER + letter
        place = np.searchsorted(self.keys, key)
        place[place == len(self.keys)] = 0
        return place, self.keys[place] == key


@dataclass
class Model:
    langs: list[str]
    lattice: Lattice
    chance: np.ndarray  # (pieces + 1) x langs; the last row is for single letters that are no piece

    def log_words(self, words: list[str]) -> np.ndarray:
        """log P(word | language), summed over all segmentations."""
        out = np.zeros((len(words), len(self.langs)))
        for rows, codes in blocks(words):
            edges = self.lattice.edges(codes)
            alpha, scale = forward(edges, codes.shape, self.chance)
            with np.errstate(divide="ignore"):  # beside others, a language may be too far off to be told from impossible
                out[rows] = np.log(alpha[-1]) + scale[-1][:, None]
        return out


def blocks(words: list[str], most: int = 5_000, letters: int = 100_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words of one length together, as rows of code points."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for n in np.unique(lengths[lengths > 0]):
        of = np.flatnonzero(lengths == n)
        step = max(1, min(most, letters // int(n)))
        for a in range(0, len(of), step):
            rows = of[a : a + step]
            flat = "".join([words[i] for i in rows]).encode("utf-32-le", "surrogatepass")
            yield rows, np.frombuffer(flat, np.uint32).reshape(len(rows), n).astype(np.uint64)


#: Sums of words of more letters are scaled as they grow: those of fewer cannot leave the range of doubles.
UNSCALED = 40


def forward(edges: Edges, shape: tuple[int, int], chance: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Sums over all segmentations up to each place, a row for each word, and the logarithms of what they were divided by."""
    n, width = shape
    alpha = [np.ones((n, chance.shape[1]))] + [np.zeros((n, chance.shape[1])) for _ in range(width)]
    scale = [np.zeros(n) for _ in range(width + 1)] if width > UNSCALED else [np.zeros(n)] * (width + 1)
    by_start: list[list[int]] = [[] for _ in range(width)]
    for i, j in edges:
        by_start[i].append(j)
    for i in range(width):
        if width > UNSCALED:
            top = alpha[i].max(axis=1)
            top[top == 0] = 1.0
            alpha[i] = alpha[i] / top[:, None]
            scale[i] = scale[i] + np.log(top)
        for j in sorted(by_start[i]):
            hit, k = edges[i, j]
            part = alpha[i][hit] * chance[k]
            if width > UNSCALED:  # what comes from here is carried on the scale that the place has
                fresh = ~alpha[j][hit].any(axis=1)
                scale[j][hit[fresh]] = scale[i][hit[fresh]]
                part *= np.exp(np.minimum(scale[i][hit] - scale[j][hit], 700.0))[:, None]
            alpha[j][hit] += part
    return alpha, scale


def expected(edges: Edges, shape: tuple[int, int], chance: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Expected piece counts of words under one language's chances, by forward and backward passes."""
    n, width = shape
    alpha, up = forward(edges, shape, chance[:, None])
    flipped = {(width - j, width - i): x for (i, j), x in edges.items()}
    beta, down = forward(flipped, shape, chance[:, None])
    total, counts = alpha[-1][:, 0], np.zeros(len(chance))
    whole = up[-1]
    for (i, j), (hit, k) in edges.items():
        share = alpha[i][hit, 0] * chance[k] * beta[width - j][hit, 0] / total[hit]
        if width > UNSCALED:
            share = share * np.exp(up[i][hit] + down[width - j][hit] - whole[hit])
        counts += np.bincount(k, weight[hit] * share, len(chance))
    return counts


def segments(word: str) -> list[str]:
    """Runs of letters, each with the mark that begins a word."""
    return [START + run for run in LETTERS.findall(word)]


def fit(docs: DataFrame, pieces: list[str], key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE_PER_LANG) -> Model:
    """docs: labelled rows. The driver holds chances of pieces by language, and no words."""
    labelled = docs.select(F.col(quoted(key)).alias("_key"), F.col(quoted(text)).alias("_text"), F.col(quoted(lang)).alias("_lang"), F.xxhash64(quoted(key)).alias("_hash")).where("_lang is not null and _key is not null")
    counts = labelled.groupBy("_lang").agg(F.approx_count_distinct("_key")).collect()
    langs, lattice = sorted(r[0] for r in counts), Lattice(pieces)
    if not langs:
        return Model([], lattice, np.zeros((len(pieces) + 1, 0)))
    # the least hashes of each language; a bound by its number of keys leaves few rows to rank, however many there are
    bounds = F.broadcast(docs.sparkSession.createDataFrame([(name, hash_bound(sample, n)) for name, n in counts], "_lang string, _bound bigint"))  # a row for each language
    near = labelled.select("_key", "_lang", "_hash").join(bounds, "_lang").where("_hash <= _bound").select("_key", "_lang", "_hash").distinct()
    picked = near.withColumn("_place", F.row_number().over(Window.partitionBy("_lang").orderBy("_hash", "_key"))).where(F.col("_place") <= sample)
    ids = F.broadcast(picked.select("_key", "_lang"))  # at most sample rows for each language
    texts = labelled.join(ids, ["_key", "_lang"]).groupBy("_key", "_lang").agg(F.min("_text").alias("_text"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(x, s) for x, t in zip(batch["_lang"].to_pylist(), batch["_text"].to_pylist(), strict=True) for w in (t or "").lower().split() for s in segments(w)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)], ["lang", "segment"])

    words = texts.select("_lang", "_text").mapInArrow(split, "lang string, segment string").groupBy("lang", "segment").agg(F.count("*").alias("n"))
    words = written(words.repartition("lang", "segment"), "language-words")
    n, at = len(pieces), {x: i for i, x in enumerate(langs)}
    chance = np.full((n + 1, len(langs)), 1.0 / max(n, 1))
    chance[n], met = UNKNOWN, np.zeros(n, bool)
    for _ in range(EM_STEPS):
        found = np.full((n, len(langs)), SMOOTHING)
        for part in _expected_counts(words, Model(langs, lattice, chance)).toArrow().to_batches():
            piece, which = part["piece"].to_numpy(), [at[x] for x in part["lang"].to_pylist()]
            found[piece, which] += part["count"].to_numpy() / GRAIN
            met[piece] = True
        chance[:n] = found / found.sum(axis=0)
    chance[:n][~met] = chance[:n][~met].mean(axis=1, keepdims=True)
    released()
    return Model(langs, lattice, chance)


def _expected_counts(words: DataFrame, model: Model) -> DataFrame:
    """lang, piece, count (in grains): how often a piece is expected in a language's words; pieces times languages rows."""
    shared = words.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, made = shared.value, {}
        none = len(model.lattice.pieces)
        for batch in batches:
            langs, segment, weight = np.array(batch["lang"].to_pylist(), object), batch["segment"].to_pylist(), batch["n"].to_numpy()
            for x in set(langs.tolist()):
                of, total = np.flatnonzero(langs == x), made.setdefault(x, np.zeros(none, np.int64))
                for rows, codes in blocks([segment[i] for i in of]):
                    counts = expected(model.lattice.edges(codes), codes.shape, model.chance[:, model.langs.index(x)], weight[of[rows]].astype(float))
                    total += np.rint(counts[:none] * GRAIN).astype(np.int64)
        for x, total in made.items():
            piece = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([x] * len(piece), pa.string()), pa.array(piece, pa.int64()), pa.array(total[piece])], ["lang", "piece", "count"])

    return words.mapInArrow(tidied(run), "lang string, piece bigint, count bigint").groupBy("lang", "piece").agg(F.sum("count").alias("count"))


def _scored(batches: Iterator[pa.RecordBatch], model: Model, text: str) -> Iterator[tuple[pa.RecordBatch, list[int], list[float]]]:
    """Each batch with its rows' languages (the number of languages: none) and their posteriors."""
    seen: dict[str, int] = {}
    scores = np.zeros((0, max(len(model.langs), 1)))
    for batch in batches:
        which, best = [], []
        for a, b in stretches(batch[text], STRETCH):
            texts = batch[text].slice(a, b - a).to_pylist()
            if len(seen) > CACHED_WORDS:
                seen, scores = {}, scores[:0]
            documents = [LETTERS.findall(t.lower()) if t else [] for t in texts]
            if model.langs:
                new = [w for w in dict.fromkeys(chain.from_iterable(documents)) if w not in seen]
                own = model.log_words([START + w for w in new])
                seen.update(zip(new, range(len(scores), len(scores) + len(new)), strict=True))
                scores = np.concatenate([scores, own])
            for t, words in zip(texts, documents, strict=True):
                if not model.langs or not t or not ANY_LETTER.search(t):
                    which.append(len(model.langs))
                    best.append(0.0)
                    continue
                total = scores[list(map(seen.__getitem__, words))].sum(axis=0)
                chance = np.exp(total - total.max())
                chance /= chance.sum()
                which.append(int(chance.argmax()))
                best.append(float(chance.max()))
        yield batch, which, best


def identify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang_pred, score: the language with the highest posterior and that posterior. No row moves."""
    chosen = docs.select(quoted(key), quoted(text))
    kind = StructType([chosen.schema[0], StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs = pa.array([*shared.value.langs, "und"])
        for batch, which, best in _scored(batches, shared.value, text):
            yield pa.RecordBatch.from_arrays([batch[key], langs.take(pa.array(which, pa.int64())), pa.array(best, pa.float64())], [key, "lang_pred", "score"])

    return arrow_map(chosen, run, kind)


def keep_identified(docs: DataFrame, model: Model, least: float | None = None, text: str = "text") -> DataFrame:
    """docs without the rows that have no language, or none with a posterior of ``least`` or more.

    By default a posterior a twentieth above chance will do: only texts whose letters no language knows stay below it.
    """
    if least is None:
        least = 1.05 / len(model.langs) if len(model.langs) > 1 else 0.0
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, which, best in _scored(batches, shared.value, text):
            none = len(shared.value.langs)
            yield batch.filter(pa.array([w < none and b >= least for w, b in zip(which, best, strict=True)], pa.bool_()))

    return arrow_map(docs, run, docs.schema)
