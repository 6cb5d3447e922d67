"""Small sequential algorithms over each page's rows, page after page in one pass over a sorted partition."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

MOST_ROWS = 20_000


def _values(column: pa.Array) -> list:
    """The values as Python objects; numpy makes numbers and texts many times faster than Arrow."""
    kind = column.type
    if pa.types.is_string(kind):
        return column.to_numpy(zero_copy_only=False).tolist()
    if not (pa.types.is_integer(kind) or pa.types.is_floating(kind)):
        return column.to_pylist()
    out = column.fill_null(0).to_numpy().tolist()
    if column.null_count:
        for i in np.flatnonzero(column.is_null().to_numpy(zero_copy_only=False)).tolist():
            out[i] = None
    return out


def per_group(rows: DataFrame, keys: list[str], columns: list[str], order: list, solve: Callable[[tuple, list[tuple]], Iterable[tuple]], schema: str) -> DataFrame:
    """solve(key, rows in order) gives the group's output rows, without the keys; ``schema`` is that of all output.

    Groups are those of a bounded thing, such as a page. The rows are shuffled by key once and streamed, so that many
    small groups cost no call each.
    """
    kind: StructType = _parse_datatype_string(schema)
    target = to_arrow_schema(kind)
    n = len(keys)

    def made(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(target)], schema=target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, out = None, [], []
        for batch in batches:
            lists = [*map(_values, batch.columns)]
            for own, row in zip(zip(*lists[:n], strict=True), zip(*lists[n:], strict=True), strict=True):
                if own != key:
                    if held:
                        out += [(*key, *r) for r in solve(key, held)]
                    key, held = own, []
                held.append(row)
            if len(out) >= MOST_ROWS:
                yield made(out)
                out = []
        if held:
            out += [(*key, *r) for r in solve(key, held)]
        yield made(out)

    return rows.select(*keys, *columns).repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, kind)


def group_pieces(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """The runs of equal keys in each sorted batch; a run that goes on in the next batch comes in pieces."""
    for batch in batches:
        n = len(batch)
        if not n:
            continue
        fresh = np.zeros(n - 1, bool)
        for name in keys:
            column = batch[name]
            fresh |= pc.fill_null(pc.not_equal(column[1:], column[:-1]), False).to_numpy(zero_copy_only=False)
            fresh |= pc.not_equal(column[1:].is_null(), column[:-1].is_null()).to_numpy(zero_copy_only=False)
        stops = [0, *(np.flatnonzero(fresh) + 1).tolist(), n]
        for a, b in zip(stops, stops[1:], strict=False):
            yield tuple(batch[name][a].as_py() for name in keys), batch.slice(a, b - a)


def group_tables(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """The runs of equal keys in sorted batches, each as a table."""
    held, key = [], None
    for own, piece in group_pieces(batches, keys):
        if own != key and held:
            yield key, pa.Table.from_batches(held)
            held = []
        key = own
        held.append(piece)
    if held:
        yield key, pa.Table.from_batches(held)


def sequence_hash(rows: DataFrame, keys: list[str], line: str, separator: str = "\n") -> DataFrame:
    """SRC17: keys and ``sha256`` of each group's lines in order, joined by a separator.

    Such a hash is sequential by definition: a group is one task's stream, of which a batch is held at a time.
    """
    schema = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    kind: StructType = _parse_datatype_string(f"{schema}, sha256 string" if keys else "sha256 string")
    target = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, now, done = None, None, []
        for own, table in group_pieces(batches, keys):
            if now is None or own != key:
                done += [(*key, now.hexdigest())] if now is not None else []
                key, now = own, hashlib.sha256()
                text = ""
            else:
                text = separator
            now.update((text + separator.join(table[line].to_pylist())).encode())
        if now is not None:
            done.append((*key, now.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], f.type) for i, f in enumerate(target)], schema=target)

    dealt = rows.select(*keys, line).where(F.col(line).isNotNull())
    dealt = dealt.repartition(*keys) if keys else dealt.coalesce(1)
    return dealt.sortWithinPartitions(*keys, line).mapInArrow(run, kind)
