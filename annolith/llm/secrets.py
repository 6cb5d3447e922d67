"""Secret scans: fixed patterns and an assignment-aware lexer.

The lexer (``lexing``) reads source and configuration syntax into name-literal pairs and follows constants, so a literal that
reaches a target through other names counts as the target's. Each literal is scored by the sensitivity of the target's name
and by the literal's own form.

Results for special cases: a null text is as an empty one, with no spans; repeated rows are scanned each; texts are
scanned whole, whatever their length; an empty table gives no rows; columns may have any names.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from .lexing import pairs
from .shared import arrow_map, quoted

KINDS = ("assign", "access", "hex", "named")
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")  # the run is maximal, so those under 18 characters can be left out at once
HEX = re.compile(r"[0-9a-f]{16,}")

#: Stems of sensitive names with their weights.
SENSITIVE = {"password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.8, "secret": 1.0, "token": 0.8, "apikey": 1.0, "accesskey": 1.0, "privatekey": 1.0, "credential": 0.9, "authorization": 0.8, "bearer": 0.8}
DUMMY = re.compile(r"(?ai)(?:x+|\*+|\.+|none|null|true|false|changeme|example|placeholder|<.*>|\$\{.*\}|todo)\Z")
#: A literal counts as a secret from this score on; literals are of so many characters at least.
MIN_SCORE, MIN_LENGTH = 0.6, 8


def name_weight(name: str) -> float:
    """The weight of the strongest sensitive stem that the name holds."""
    plain = re.sub(r"[^a-z0-9]", "", name.lower())
    return max((w for stem, w in SENSITIVE.items() if stem in plain), default=0.0)


def literal_score(text: str) -> float:
    """0 to 1: mixed character classes and entropy speak for a secret, blanks and dummy values against it."""
    if len(text) < MIN_LENGTH or DUMMY.match(text) or re.search(r"\s", text):
        return 0.0
    counts = Counter(text)
    entropy = -sum(n / len(text) * math.log2(n / len(text)) for n in counts.values())
    classes = sum(bool(re.search(p, text)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return min(1.0, 0.2 * classes + entropy / 5)


def may_name(text: str) -> bool:
    """Whether a sensitive name can stand in the text: what ``name_weight`` leaves out of a name is left out here."""
    plain = text.lower()
    for sign in "_$.-":
        plain = plain.replace(sign, "")
    return any(stem in plain for stem in SENSITIVE)


def named_spans(text: str) -> list[tuple[int, int]]:
    """Spans of the literals that reach a sensitive target, directly or through constants."""
    if not may_name(text):
        return []
    found: set[tuple[int, int]] = set()
    for name, own in pairs(text):
        weight = name_weight(name)
        todo = [own] if weight else []
        while todo:  # what a target of this weight or more has reached is not visited again
            held = todo.pop()
            if held.reached < weight:
                held.reached = weight
                found.update(s for s in held.spans if weight * literal_score(text[slice(*s)]) >= MIN_SCORE)
                todo += held.parts
    return sorted(found)


def scan(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, by start and then by kind."""
    if not text:
        return []
    spans = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        spans += [(*m.span(), 1) for m in ACCESS.finditer(text)]
    spans += [(*m.span(), 2) for m in HEX.finditer(text)]
    spans += [(*s, 3) for s in named_spans(text)]
    return [(a, b, KINDS[k]) for a, b, k in sorted(spans, key=lambda s: (s[0], s[2], s[1]))]


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, spans array<struct<start, end, kind>>: all spans of each whole text. No row moves."""
    own = docs.select(F.col(quoted(key)).alias(key), F.col(quoted(text)).alias("_secret_text"))
    kind = StructType([own.schema[0], *_parse_datatype_string("spans array<struct<start bigint, end bigint, kind string>>")])
    item = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[{"start": a, "end": b, "kind": k} for a, b, k in scan(t)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(item))], kind.names)

    return arrow_map(own, run, kind)


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def digest(spans: list[tuple[int, int, str]]) -> str:
    return hashlib.sha256(joined([s for s in spans if s[2] != "named"]).encode()).hexdigest()
