"""Mixing to target weights with soft domain membership.

A classifier fitted on a labelled table gives each document a posterior over the domains; weighted by the document's
tokens these are its expected domain tokens. Nonnegative document rates are found by accelerated projected-gradient
least squares, so that the rates' expected domain totals meet the targets. The gradient that a document sees depends on
its posterior alone (in the metric that weighs documents by tokens), so a step needs one small vector: all documents'
rates follow from the list of these vectors, and no rate is stored or shuffled between steps. The steps run over groups of like
posteriors, as fine as the driver holds for so many domains; then passes over all posteriors correct the aim by what the
shares in truth lack. A document's step is scaled by the shares of its domains, so that rare
domains move as fast as others. The steps end when the shares are near to the best that nonnegative rates can give, which is
found beforehand; if they don't get there, a warning names the distance.

Results for special cases: a null or blank text has no tokens and rate 1; repeated rows are rated each; labels with a
null key or domain, and keys that the documents lack, are left out, and of several labels or texts of a key the last or
the first in order counts; rows round to whole copies by the hash of their key and text, so equal rows round alike; a domain without labelled rows has posterior 0; with fewer than two labelled domains every posterior is uniform
over the targets' domains; texts are read whole; an empty table gives no rows.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .shared import arrow_map, hash_bound, positional, quoted, released, tidied, written

#: The classifier is fitted on so many labelled rows at most, those whose hash is least, in so many partitions.
SAMPLE_ROWS, SAMPLE_PARTS = 20_000, 4
FEATURES, REGULARISATION, SPARSITY, FIT_STEPS = 1 << 15, 4e-3, 1.0, 60
#: Projected-gradient steps at most; they end when the domain shares are this near to the least-squares ones; groups of
#: posteriors that the driver holds at most; passes over all posteriors at most.
STEPS, CLOSE_ENOUGH, HELD_CELLS, PASSES = 5000, 1e-3, 50_000, 12
TEXT, TOKENS, TERMS, LABEL, CHANCE = "_mix_text", "_mix_tokens", "_mix_terms", "_mix_label", "_mix_chance"


@dataclass
class Domains:
    names: list[str]
    model: PipelineModel | None


def fit_domains(docs: DataFrame, labels: DataFrame, names: list[str], key: str = "doc_id", text: str = "text", domain: str = "domain", sample: int = SAMPLE_ROWS) -> Domains:
    """labels: key, domain. A multinomial logistic regression on the presence of hashed words and signs."""
    known = labels.select(F.col(key).alias("_key"), F.col(domain).alias("_domain")).where(F.col("_key").isNotNull() & F.col("_domain").isin(names))
    # the least hashes; a bound by the number of keys leaves few rows to rank, however many there are
    keys = known.agg(F.approx_count_distinct("_key")).first()[0]
    near = known.where(F.xxhash64("_key") <= F.lit(hash_bound(sample, keys)))
    known = near.groupBy("_key").agg(F.max("_domain").alias("_domain")).orderBy(F.xxhash64("_key"), "_key").limit(sample)
    number = F.array_position(F.array(*map(F.lit, names)), F.col("_domain")) - 1
    met = docs.select(F.col(quoted(key)).alias("_key"), F.coalesce(F.col(quoted(text)), F.lit("")).alias(TEXT)).join(F.broadcast(known), "_key")  # sample rows at most
    rows = met.groupBy("_key", "_domain").agg(F.min(TEXT).alias(TEXT)).select(TEXT, number.cast("double").alias(LABEL))
    stages = Pipeline(stages=[*_terms(), LogisticRegression(featuresCol=TERMS, labelCol=LABEL, probabilityCol=CHANCE, rawPredictionCol="_mix_raw", predictionCol="_mix_prediction", family="multinomial", regParam=REGULARISATION, elasticNetParam=SPARSITY, maxIter=FIT_STEPS)])
    # few partitions: a step of the fit is then one stage of short tasks, without a shuffle of gradients
    rows = written(rows, "mixing-sample").coalesce(SAMPLE_PARTS)
    if rows.select(LABEL).distinct().count() < 2:
        return Domains(names, None)
    return Domains(names, stages.fit(rows))


def _terms() -> list:
    return [RegexTokenizer(inputCol=TEXT, outputCol=TOKENS, pattern=r"[\p{L}\p{M}]+|[^\s\p{L}\p{M}]+", gaps=False), HashingTF(inputCol=TOKENS, outputCol=TERMS, numFeatures=FEATURES, binary=True)]


def posteriors(docs: DataFrame, domains: Domains, text: str = "text") -> DataFrame:
    """docs with ``_mix_tokens`` (their number) and ``_mix_chance`` (array<double> in the order of the names)."""
    n, columns = len(domains.names), map(quoted, docs.columns)
    plain = docs.withColumn(TEXT, F.coalesce(F.col(quoted(text)), F.lit("")))
    if domains.model is None:
        out = _terms()[0].transform(plain).withColumn(CHANCE, F.array(*[F.lit(1.0 / n)] * n))
    else:
        out = domains.model.transform(plain).withColumn(CHANCE, vector_to_array(CHANCE))
        missing = n - domains.model.stages[-1].numClasses
        if missing:
            out = out.withColumn(CHANCE, F.concat(CHANCE, F.array(*[F.lit(0.0)] * missing)))
    return out.select(*columns, F.size(TOKENS).cast("bigint").alias(TOKENS), CHANCE)


@dataclass
class Path:
    """The steps that give every rate: vectors over the domains, each with its momentum, and the domains' shares."""

    shares: np.ndarray
    steps: list[tuple[np.ndarray, float]] = field(default_factory=list)


def moved(chance: np.ndarray, scale: np.ndarray, rate: np.ndarray, ahead: np.ndarray, step: tuple[np.ndarray, float]) -> tuple[np.ndarray, np.ndarray]:
    after = np.maximum(0.0, ahead - chance @ step[0] / scale)
    return after, after + step[1] * (after - rate)


def rates_after(chance: np.ndarray, path: Path | None) -> np.ndarray:
    """Rates of documents with these posteriors after the path's steps, from 1."""
    rate = ahead = np.ones(len(chance))
    if path:
        scale = np.maximum(chance @ path.shares, 1e-12)
        for step in path.steps:
            rate, ahead = moved(chance, scale, rate, ahead, step)
    return np.stack([rate, ahead])


def nearest(rows: np.ndarray, goal: np.ndarray) -> np.ndarray:
    """The nonnegative combination of a few rows that is nearest to the goal (Lawson and Hanson's active sets)."""
    x, on = np.zeros(len(rows)), np.zeros(len(rows), bool)
    for _ in range(100 * len(rows)):
        gain = np.where(on, -np.inf, rows @ (goal - x @ rows))
        if gain.max() <= 1e-10:
            break
        on[gain.argmax()] = True
        while True:
            z = np.zeros(len(rows))
            z[on] = np.linalg.lstsq(rows[on].T, goal, rcond=None)[0]
            bad = on & (z <= 1e-12)
            if not bad.any():
                break
            x = x + (x[bad] / np.maximum(x[bad] - z[bad], 1e-300)).min() * (z - x)
            on &= x > 1e-12
            x[~on] = 0.0
        x = z
    return x @ rows


def reachable(cells: DataFrame, n: int, goal: np.ndarray) -> np.ndarray:
    """The shares nearest to the goal that nonnegative rates can give. A pass finds the posterior that improves most."""
    own = np.array([r[0] for i in range(n) for r in cells.select(CHANCE).orderBy(F.col(CHANCE)[i].desc(), CHANCE).limit(1).collect()])
    for _ in range(1000):
        best = nearest(own, goal)
        slope = sum((F.col(CHANCE)[i] * float(best[i] - goal[i]) for i in range(n)), F.lit(0.0))
        least, row = cells.agg(F.min(F.struct(slope.alias("slope"), F.col(CHANCE).alias("row"))).alias("x")).select("x.*").first()
        if least >= -1e-7 or (own == np.array(row)).all(axis=1).any():
            return best
        own = np.vstack([own, row])
    raise RuntimeError("the shares that rates can give have not been found")


def lattice(n: int, held: int) -> int:
    """The finest steps of a unit of which ``held`` groups can hold all posteriors over n domains; 0: not even one."""
    k = 0
    while n > 1 and comb(k + n, n - 1) <= held:
        k += 1
    return k


def held_cells(cells: DataFrame, n: int, held: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """Mean posteriors and tokens of at most ``held`` groups of like cells, and whether each group is one cell.

    Groups have like running sums of their posteriors, in steps that follow from the number of domains alone, so a cell's group
    doesn't depend on the other cells; where not even one step fits, the likeliest domain and its rounded posterior.
    """
    chance, tokens, k = F.col(CHANCE), F.col("tokens"), lattice(n, held)
    top = F.array_max(CHANCE)
    key = F.struct(F.array_position(CHANCE, top), F.round(top, 1))
    if k:
        key = F.array(*[F.floor(sum((chance[j] for j in range(1, i + 1)), chance[0]) * k) for i in range(n - 1)])
    sums = cells.groupBy(key.alias("_key")).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("cells"), *[F.sum(tokens * chance[i]).alias(f"s{i}") for i in range(n)])
    few = sums.orderBy("_key").select(F.array(*[F.col(f"s{i}") / F.col("tokens") for i in range(n)]).alias(CHANCE), "tokens", "cells")
    whole = few.toArrow().combine_chunks()
    return np.array(whole[CHANCE].to_pylist(), float).reshape(len(whole), n), whole["tokens"].to_numpy(), bool((whole["cells"].to_numpy() == 1).all())


def descend(chance: np.ndarray, weight: np.ndarray, shares: np.ndarray, aim: np.ndarray, steps: int, close: float) -> tuple[Path, np.ndarray]:
    """Accelerated projected-gradient steps over cells with these shares of the tokens, until their domains' shares are close to
    the aim: the path and the shares."""
    path, scale = Path(shares), np.maximum(chance @ shares, 1e-12)
    rate = ahead = np.ones(len(chance))
    pace, last, back = 1.0, None, None
    while True:
        now, front = (rate * weight) @ chance, (ahead * weight) @ chance
        if float(np.abs(now - aim).max()) <= close or len(path.steps) >= steps:
            return path, now
        if last is not None and back @ (now - last) > 0:
            pace = 1.0  # the last step went uphill: momentum starts anew
        then = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        last, back = now, front - aim
        path.steps.append((back, (pace - 1) / then))
        pace = then
        rate, ahead = moved(chance, scale, rate, ahead, path.steps[-1])


def shares_after(cells: DataFrame, path: Path, n: int) -> np.ndarray:
    """The domains' token sums under the path's rates: a pass over all cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = np.zeros(n)
        for batch in batches:
            if len(batch):
                chance = batch[CHANCE].flatten().to_numpy().reshape(len(batch), n)
                made += (rates_after(chance, path)[0] * batch["tokens"].to_numpy()) @ chance
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in made], [f"s{i}" for i in range(n)])

    parts = cells.mapInArrow(tidied(run), ", ".join(f"s{i} double" for i in range(n)))
    return np.array(parts.agg(*[F.sum(f"s{i}") for i in range(n)]).first(), float)


def fit_rates(rated: DataFrame, targets: dict[str, float], names: list[str], steps: int = STEPS, close: float = CLOSE_ENOUGH, held: int = HELD_CELLS) -> Path | None:
    """rated: posteriors' rows. targets: shares of all tokens by domain. The path that gives every rate.

    Steps run over groups of like cells, at any size of the input, and a pass over all cells says which shares the path gives in
    truth; the aim is moved by what is missing, for ``PASSES`` passes at most, whatever the number of
    steps and domains.
    """
    cells = written(rated.groupBy(CHANCE).agg(F.sum(TOKENS).cast("double").alias("tokens")).where("tokens > 0"), "mixing-cells")
    n, goal = len(names), np.array([targets.get(x, 0.0) for x in names])
    total, *sums = cells.agg(F.sum("tokens"), *[F.sum(F.col("tokens") * F.col(CHANCE)[i]) for i in range(n)]).first()
    if not total:
        return None
    shares, best = np.array(sums, float) / total, reachable(cells, n, goal)
    chance, tokens, _ = held_cells(cells, n, held)
    aim, found, least = best, None, np.inf
    for _ in range(PASSES):
        # what groups can give is a little less than what their members can
        path, _ = descend(chance, tokens / total, shares, nearest(chance, aim), steps, close / 4)
        now = shares_after(cells, path, n) / total
        off = float(np.abs(now - best).max())
        if off < least:
            found, least, reached = path, off, now
        if off <= close:
            break
        aim = aim + best - now
    if least > close:
        warnings.warn(f"mixing: after {len(found.steps)} steps the domain shares {reached.round(4).tolist()} are {least:.4f} from the nearest to the targets, {best.round(4).tolist()}", stacklevel=2)
    released()
    return found


def rated(rows: DataFrame, path: Path | None, columns: list[str]) -> DataFrame:
    """posteriors' rows with rate: the given columns, tokens, posterior, rate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(batch)
            chance = batch[CHANCE].flatten().to_numpy().reshape(n, -1) if n else np.zeros((0, 1))
            rate = rates_after(chance, path)[0] if n else np.zeros(0)
            rate = np.where(batch[TOKENS].to_numpy() > 0, rate, 1.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rate)], [*batch.schema.names, "_mix_rate"])

    chosen = rows.select(*map(quoted, columns), TOKENS, CHANCE)
    return arrow_map(chosen, run, StructType([*chosen.schema.fields, StructField("_mix_rate", DoubleType())]))


def copies(rate: Column, *row: Column) -> Column:
    """Whole copies whose expectation is the rate: the fraction is decided by the row's hash."""
    chance = F.pmod(F.xxhash64(*row, F.lit("mix")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return (F.floor(rate) + F.when(chance < rate - F.floor(rate), 1).otherwise(0)).cast("int")


def mixing_rates(docs: DataFrame, domains: Domains, targets: dict[str, float], key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, posterior, rate, copies: a row for each document."""
    own = docs.select(F.col(quoted(key)).alias(key), F.col(quoted(text)).alias("_mix_own"))
    found = posteriors(own, domains, "_mix_own").withColumn("_mix_hash", F.xxhash64("_mix_own"))
    narrow = written(found.select(quoted(key), "_mix_hash", TOKENS, CHANCE), "mixing-posteriors")
    path = fit_rates(narrow, targets, domains.names)
    out, k = rated(narrow, path, [key, "_mix_hash"]), F.col(quoted(key))
    return out.select(k, F.col(TOKENS).alias("n_tokens"), F.col(CHANCE).alias("posterior"), F.col("_mix_rate").alias("rate"), copies(F.col("_mix_rate"), k, F.col("_mix_hash")).alias("copies"))


def mixed(docs: DataFrame, domains: Domains, targets: dict[str, float], key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs, each row as often as its rate says. Texts meet the classifier once: rows are stored with their posteriors.

    Columns may have any names, those of this module included; a null text has no words, is rated 1 and stays once.
    """
    plain, at = positional(docs)
    found = written(posteriors(plain, domains, at[text]), "mixing-posteriors")
    path = fit_rates(found.select(TOKENS, CHANCE), targets, domains.names)
    row = [F.col(at[key]), F.xxhash64(at[text])]
    out = rated(found, path, plain.columns).withColumn("_mix_copies", copies(F.col("_mix_rate"), *row))
    once = F.when(F.col("_mix_copies") > 0, F.sequence(F.lit(1), F.col("_mix_copies"))).otherwise(F.array().cast("array<int>"))
    return out.withColumn("_mix_copy", F.explode(once)).select(*plain.columns).toDF(*docs.columns)
