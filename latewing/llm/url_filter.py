"""URL rules in a trie over reversed host labels and path segments.

Rows are pages (``page_id``, ``url``); other columns are ignored. The host is what
stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z in lower case; the
path goes on to ``?``, ``#`` or the end. A URL that is NULL or has no ``://`` has an empty host
and path, which no rule fits. Without a fitting rule the verdict is ``default``. Rows are judged on
their own, repeated rows alike. No rows give no rows.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import batch, ddl

#: Largest size of the rules' texts that is sent to every task.
MOST_BYTES = 64 << 20

ALLOW, BLOCK = "allow", "block"


class RuleTrie:
    """Longest host first, then longest path; of a rule given twice the last verdict holds."""

    def __init__(self, rules: list[tuple[str, str, str]]):
        #: host label -> node; under None a path trie of segment -> node, whose rules are {unfinished segment: rule}.
        self.root: dict = {}
        for verdict, host, path in rules:
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault(label, {})
            node = node.setdefault(None, {})
            *segments, last = path.split("/")
            for segment in segments:
                node = node.setdefault(segment, {})
            node.setdefault(None, {})[last] = (host + path, verdict)

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        node, hosts = self.root, []
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            if None in node:
                hosts.append(node[None])
        segments = path.split("/")
        for paths in reversed(hosts):
            best = None
            for segment in segments:
                ends = paths.get(None, {})
                for size in range(min(len(segment), max(map(len, ends), default=-1)), -1, -1):
                    if segment[:size] in ends:
                        best = ends[segment[:size]]
                        break
                paths = paths.get(segment)
                if paths is None:
                    break
            if best:
                return best
        return None


def host_of(url: Column) -> Column:
    capitals, small = string.ascii_uppercase, string.ascii_lowercase
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), capitals, small), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], default: str = ALLOW) -> DataFrame:
    """``page_id``, ``host``, ``path``, the ``rule`` that fits (NULL if none) and the ``verdict``.

    ``rules`` are (verdict, host, path), at most ``MOST_BYTES`` of text.
    """
    if sum(len(h.encode()) + len(p.encode()) for _, h, p in rules) > MOST_BYTES:
        raise ValueError(f"the rules have more than {MOST_BYTES} bytes")
    if any(v not in (ALLOW, BLOCK) for v, _, _ in rules):
        raise ValueError("a rule's verdict is allow or block")
    fields = {"page_id": pa.int64(), "host": pa.string(), "path": pa.string(), "rule": pa.string(), "verdict": pa.string()}
    shared = pages.sparkSession.sparkContext.broadcast(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = RuleTrie(shared.value)
        for part in batches:
            found = [trie.find(h, p) for h, p in zip(part.column(1).to_pylist(), part.column(2).to_pylist())]
            yield batch(fields, {
                "page_id": part.column(0), "host": part.column(1), "path": part.column(2),
                "rule": [f and f[0] for f in found], "verdict": [f[1] if f else default for f in found],
            })

    url = F.col("url")
    rows = pages.select(F.col("page_id").cast("bigint"), host_of(url).alias("host"), path_of(url).alias("path"))
    return rows.mapInArrow(run, ddl(fields))
