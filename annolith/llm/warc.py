"""WARC archives in Zstandard: one frame a record, the dictionary in a leading skippable frame.

Each task trains a dictionary on the first records of its partition and writes archives of a bounded size, each of which
opens with the dictionary. Records follow each other as frames; between them stands an empty skippable frame, which every Zstandard reader passes over. Equal payloads are
stored once: the record with the least key is a ``response``, the others ``revisit`` it.

The reader loads the dictionary, cuts the file into frames by their block headers, decodes one frame for each record and
checks version, headers, lengths and, if it has one, the SHA-1 digest; what fails is named in ``error``, frames with a wrong
checksum or damaged content too, and where no further frame can be found, the last row says so. Frames may be written as
streams, without their size. Names of headers
are read in any case, with or without a blank before the value, over several lines and repeated (the first counts). An
archive is read as one value, so those written elsewhere must be under 2 GB.

Results for special cases: a null payload is empty; a null url gives a record without a target; repeated rows give a
record each, both of them responses if they are the first of their payload; among rows without a key none is first unless
all of a payload's are, and then each is a response; payloads are whole; an empty table gives no archive and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .rawfiles import read_raw, write_raw
from .shared import quoted, tidied

#: Fixed values of the formats: the dictionary's frame, other skippable frames, data frames.
DICTIONARY_MAGIC, SKIPPABLE_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0x184D2A50, 0xFD2FB528
SEPARATOR = struct.pack("<II", SKIPPABLE_MAGIC, 0).decode()
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"
#: Bytes of the dictionary, of the records that it is trained on, and of an archive (and the record that fills it).
DICTIONARY_BYTES, SAMPLE_BYTES, ARCHIVE_BYTES, LEVEL = 16 << 10, 1 << 20, 32 << 20, 3
#: A record of more bytes is an error of its own, so that no frame can fill a task's memory.
MOST_BYTES = 1 << 30
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(key: object) -> str:
    return f"<urn:row:{quote(str(key), safe='')}>" if key is not None else "<urn:row>"


def record(key: object, url: str | None, payload: bytes, refers_to: object, revisit: bool) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(key)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + quote(url, safe="!#$&'()*+,/:;=?@[]~"))
    lines.append(f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}")
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def compressor(samples: list[bytes]) -> tuple[bytes, zstandard.ZstdCompressor]:
    """The leading frame (empty without a dictionary) and a compressor for the records."""
    try:
        trained = zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8)
    except zstandard.ZstdError:  # too few or too uniform samples
        return b"", zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)
    raw = trained.as_bytes()
    return struct.pack("<II", DICTIONARY_MAGIC, len(raw)) + raw, zstandard.ZstdCompressor(level=LEVEL, dict_data=trained, write_checksum=True)


def write_warc(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Writes each partition's archives. Payloads under ``least_bytes`` are never revisited."""
    own = [F.col(quoted(x)) for x in (key, url, payload)]
    whole = pages.select(own[0].alias("key"), own[1].alias("url"), F.encode(F.coalesce(own[2], F.lit("")), "UTF-8").alias("payload")).withColumn("sha", F.sha1("payload"))
    first = whole.where(F.length("payload") >= least_bytes).select("key", "sha").groupBy("sha").agg(F.min("key").alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size, lead, made, held, between = [], 0, b"", None, [], SEPARATOR.encode()

        def add(records: list[bytes]) -> Iterator[pa.RecordBatch]:
            """Puts records into the archive that is open, and gives those that are full."""
            nonlocal held, size
            for r in records:
                held.append(made.compress(r))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield closed()

        def closed() -> pa.RecordBatch:
            nonlocal held, size
            archive = between.join([lead, *held] if lead else held)
            held, size = [], 0
            return pa.RecordBatch.from_arrays([pa.array([archive], pa.binary())], ["archive"])

        def opened() -> Iterator[pa.RecordBatch]:
            nonlocal lead, made, waiting, size
            lead, made = compressor(waiting)
            size = 0
            yield from add(waiting)
            waiting = []

        for batch in batches:
            for a in range(0, len(batch), 256):
                rows = batch.slice(a, 256).to_pylist()
                records = [record(r["key"], r["url"], r["payload"], r["first"], r["first"] is not None and r["key"] != r["first"]) for r in rows]
                if made:
                    yield from add(records)
                else:
                    waiting += records
                    size += sum(map(len, records))
                    if size >= SAMPLE_BYTES:
                        yield from opened()
        if waiting:
            yield from opened()
        if held:
            yield closed()

    write_raw(whole.join(first, "sha", "left").select("key", "url", "payload", "first").mapInArrow(tidied(run), "archive binary"), path, SEPARATOR, 1)


def frames_of(data: bytes) -> Iterator[tuple[int, int, int]]:
    """(magic, begin, end) of each frame; ``begin`` is that of the content for skippable frames."""
    at = 0
    while at < len(data):
        if at + 8 > len(data):
            raise ValueError("a frame is cut off")
        magic, size = struct.unpack_from("<II", data, at)
        if magic & 0xFFFFFFF0 == SKIPPABLE_MAGIC:
            begin, end = at + 8, at + 8 + size
        elif magic == FRAME_MAGIC:
            begin, flags = at, data[at + 4]
            at += zstandard.frame_header_size(data[at : at + 18])
            last = 0
            while not last:
                head = int.from_bytes(data[at : at + 3], "little")
                last, kind, size = head & 1, head >> 1 & 3, head >> 3
                at += 3 + (1 if kind == 1 else size)
                if at > len(data) or kind == 3:
                    raise ValueError("a block is cut off")
            end = at + (4 if flags & 4 else 0)
        else:
            raise ValueError(f"no frame begins with {magic:08x}")
        if end > len(data):
            raise ValueError("a frame is cut off")
        yield magic, begin, end
        at = end


def record_in(reader: zstandard.ZstdDecompressor, frame: bytes) -> bytes | str:
    """A frame's content, or what is wrong with it. Frames of writers that did not state its size are read as streams."""
    try:
        size = zstandard.frame_content_size(frame)
        if 0 <= size <= MOST_BYTES:
            return reader.decompress(frame)
        parts, held = [], 0
        with reader.stream_reader(frame) as stream:
            while part := stream.read(1 << 20):
                held += len(part)
                if held > MOST_BYTES:
                    return f"a record of over {MOST_BYTES} bytes"
                parts.append(part)
        return b"".join(parts)
    except zstandard.ZstdError as e:
        return f"frame: {e}"


def records_of(data: bytes) -> Iterator[bytes | str]:
    """The archive's records, one for each data frame; what is wrong instead of one that cannot be read. Where no frame can be
    found any more, that is the last."""
    reader, frames = zstandard.ZstdDecompressor(), frames_of(data)
    while True:
        try:
            magic, begin, end = next(frames)
        except StopIteration:
            return
        except (ValueError, struct.error, zstandard.ZstdError) as e:
            yield f"archive: {e}"
            return
        if magic == DICTIONARY_MAGIC:
            raw = data[begin:end]
            if raw[:4] == struct.pack("<I", FRAME_MAGIC):  # the format lets the dictionary itself be compressed
                raw = record_in(zstandard.ZstdDecompressor(), raw)
            if isinstance(raw, str):
                yield f"dictionary: {raw}"
                return
            reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
        elif magic == FRAME_MAGIC:
            yield record_in(reader, data[begin:end])


def headers_in(head: str) -> dict[str, str] | None:
    """Headers by their names in lower case, the first of each; None if a line is none."""
    fields: dict[str, str] = {}
    last = None
    for line in head.split("\r\n"):
        if line[:1] in (" ", "\t") and last is not None:  # the value goes on
            fields[last] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            return None
        last = name.lower()
        if last in fields:
            last = None
        else:
            fields[last] = value.strip()
    return fields


def parsed(raw: bytes | str) -> dict:
    """A record's fields; ``error`` says what is wrong with it."""
    if isinstance(raw, str):
        return {"headers": {}, "payload": b"", "error": raw, "digest": None, "length": None}
    head, mark, rest = raw.partition(b"\r\n\r\n")
    version, _, lines = head.decode("utf-8", "replace").partition("\r\n")
    fields = headers_in(lines)
    digest = (fields or {}).get("warc-payload-digest", "")
    out = {"headers": fields or {}, "payload": b"", "error": None, "digest": digest.removeprefix("sha1:"), "length": None}
    if not mark or not version.startswith("WARC/1."):
        return out | {"error": "no WARC record"}
    missing = [x for x in REQUIRED if x not in (fields or {})]
    if missing:
        return out | {"error": "headers: " + (", ".join(missing) if fields else "malformed")}
    kind = fields["warc-type"]
    if not fields["content-length"].isdigit() or len(rest) != int(fields["content-length"]) + 4 or not rest.endswith(b"\r\n\r\n"):
        return out | {"error": "content-length"}
    if kind not in ("response", "revisit"):  # warcinfo and others: the block as it is
        return out | {"payload": rest[:-4], "length": len(rest) - 4}
    http, mark, payload = rest[:-4].partition(b"\r\n\r\n")
    inner = headers_in(http.decode("latin-1").partition("\r\n")[2])
    length = (inner or {}).get("content-length", "")
    if not mark or inner is None or (length and not length.isdigit()):
        return out | {"error": "HTTP headers"}
    out |= {"payload": payload, "length": int(length) if length else len(payload)}
    if kind == "response" and len(payload) != out["length"]:
        return out | {"error": "payload length"}
    if kind == "response" and digest.startswith("sha1:") and base32_sha1(payload) != out["digest"].upper():
        return out | {"error": "payload digest"}
    if kind == "response" and not digest:
        out["digest"] = base32_sha1(payload)
    if kind == "revisit" and (payload or "warc-refers-to" not in fields):
        return out | {"error": "revisit"}
    return out


def _key(urn: str | None) -> str | None:
    return unquote(urn[9:-1]) if urn and urn.startswith("<urn:row:") else None


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """key, url, record_type, refers_to, payload_bytes, payload_digest, payload, error: a row for each record.

    For a revisit ``payload_bytes`` and ``payload_digest`` are those of the payload it revisits, and ``payload`` is null.
    """
    names = ["key", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload", "error"]
    kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string())

    def rows(records: list[dict]) -> pa.RecordBatch:
        cells = []
        for r in records:
            h = r["headers"]
            keep = with_payload and h.get("warc-type") == "response"
            url = h.get("warc-target-uri")
            cells.append((_key(h.get("warc-record-id")), url if url is None else unquote(url) if "%" in url else url, h.get("warc-type"), _key(h.get("warc-refers-to")), r["length"], r["digest"], r["payload"] if keep else None, r["error"]))
        return pa.RecordBatch.from_arrays([pa.array([c[i] for c in cells], kind) for i, kind in enumerate(kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch["content"]:
                held = []
                for raw in records_of(data.as_py()):
                    held.append(parsed(raw))
                    if len(held) == 200:
                        yield rows(held)
                        held = []
                yield rows(held)

    return read_raw(spark, path).select("content").mapInArrow(tidied(run), "key string, url string, record_type string, refers_to string, payload_bytes bigint, payload_digest string, payload binary, error string")
