"""URL filters by a sort-merge range join.

A host with its labels reversed and each label closed by a dot (``m.example.org`` is ``org.example.m.``) makes "this
host and its subdomains" a key prefix, so each rule host is an interval of the key order and intervals either nest or
are disjoint. Both sides are sorted by that key; one sweep keeps the stack of the rule intervals that hold the current
url, and of their rules the longest whose path begins the url's path wins.

Results for special cases: a null url, or one without ``://``, has host and path '' and fits no rule; repeated rows are
judged each; an empty table of urls or of rules gives no rows, or the default verdict for all; rules with a null host or
verdict are left out, a null rule path is ''; of equal rules ``block`` wins; columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import quoted, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: So many rules go to every task at a time.
BLOCK_RULES = 200_000
PARTS = r"(?s)\A.*?://([^/?#]*)([^?#]*)"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; '' without ``://``."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 1), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 2)


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def filter_urls(urls: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow", block_rules: int = BLOCK_RULES) -> DataFrame:
    """urls(key, url, ...) judged by rules(host, path, verdict): key, host, path, rule, verdict.

    A rule fits its host and all subdomains where the url's path begins with the rule's; the longest (host and path
    together, then the longer host) wins, and ``default`` holds where none fits. Rules come in blocks of about ``block_rules``,
    each of which takes a sweep over the urls; only key, host, path and the best rule so far go from one to the next.
    """
    pages = urls.select(F.col(quoted(key)).alias("key"), url_host(F.col(quoted(url))).alias("host"), url_path(F.col(quoted(url))).alias("path"))
    rules = rules.select(F.translate("host", UPPER, LOWER).alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"), F.col("verdict").alias("rule_verdict")).where("rule_host is not null and rule_verdict is not null")
    rules = rules.groupBy("rule_host", "rule_path").agg(F.max("rule_verdict").alias("rule_verdict"))  # block > allow
    few = rules.limit(block_rules + 1).collect()
    none = F.lit(None).cast("string")
    found = pages.withColumns({"size": F.lit(-1), "host_size": F.lit(-1), "rule": none, "rule_verdict": none})
    if len(few) <= block_rules:
        found = _swept(found, few)
    else:
        rules = written(rules, "url-rules")
        blocks = -(-rules.count() // block_rules)
        of = F.pmod(F.xxhash64("rule_host", "rule_path"), F.lit(blocks))
        for b in range(blocks):
            found = written(_swept(found, rules.where(of == b).collect()), "url-verdicts")
    return found.select(F.col("key").alias(key), "host", "path", "rule", F.coalesce("rule_verdict", F.lit(default)).alias("verdict"))


def _swept(pages: DataFrame, rules: list) -> DataFrame:
    """pages: key, host, path and the best rule so far; the same with the best of these rules, too."""
    by_host: dict[str, dict[str, tuple[str, str]]] = {}
    for host, path, verdict in rules:
        by_host.setdefault(host, {})[path] = (host + path, verdict)
    intervals = sorted((".".join(reversed(host.split("."))) + ".", len(host), sorted({len(p) for p in own}, reverse=True), own) for host, own in by_host.items())
    shared = pages.sparkSession.sparkContext.broadcast(intervals)
    kind = pages.schema

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, at, stack, last = shared.value, 0, [], None
        for batch in batches:
            best = [list(batch[c].to_pylist()) for c in ("size", "host_size", "rule", "rule_verdict")]
            for row, (k, path) in enumerate(zip(batch["host_key"].to_pylist(), batch["path"].to_pylist(), strict=True)):
                if k != last:
                    last = k
                    while stack and not k.startswith(stack[-1][0]):
                        stack.pop()
                    while at < len(starts) and starts[at][0] <= k:
                        if k.startswith(starts[at][0]):
                            stack.append(starts[at])
                        at += 1
                for _, wide, lengths, own in stack:
                    fit = next((n for n in lengths if path[:n] in own and n <= len(path)), None)
                    if fit is not None and (wide + fit, wide) > (best[0][row], best[1][row]):
                        best[0][row], best[1][row] = wide + fit, wide
                        best[2][row], best[3][row] = own[path[:fit]]
            numbers, texts = ([pa.array(c, t) for c in part] for part, t in ((best[:2], pa.int32()), (best[2:], pa.string())))
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("key", "host", "path")), *numbers, *texts], kind.names)

    # each partition is merged with the whole rule list, so a sort within it is enough and no row moves
    return pages.withColumn("host_key", host_key(F.col("host"))).sortWithinPartitions("host_key").mapInArrow(sweep, kind)
