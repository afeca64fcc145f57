"""Operator 2. URL filter: a trie over reversed host labels and path segments, broadcast.

A rule is (host, path, verdict). It fits its host and every subdomain of it if the url's path starts with the rule's
path. Among the rules that fit, the longest wins: most host labels, then the longest path. The trie's first levels are
host labels from the right; below each host stand path segments, each ended by a slash; a rule's unfinished last
segment is kept at its node as a prefix. A url walks down once and meets every rule that fits.

Defined results: a null url, or one without "://", has an empty host and path and gets the default verdict. An empty
table gives an empty table; repeated rows give repeated rows. Columns other than the id and the url are not read.
Equal rules of both verdicts: block wins. Rules are driver-side data: their size is checked against `max_bytes` before
they are sent to executors; a larger list is split into several tries of at most that size, each in a pass of its own
over the urls, and the longest of the winners wins.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules of the registered query.
RULES = (Rule("net", "/", "block"), Rule("example.net", "/en/", "allow"), Rule("example.com", "/de/", "block"), Rule("org", "/fr/", "allow"))


class Trie:
    """Nodes are dicts; the key None holds [(unfinished segment, rule)] of a node, longest first."""

    def __init__(self, rules: Iterable[Rule]):
        self.root: dict = {}
        for rule in rules:
            if rule.verdict not in ("allow", "block"):
                raise ValueError(f"{rule.text}: verdict {rule.verdict}")
            node = self.root
            for label in reversed(rule.host.lower().split(".")):
                node = node.setdefault(label, {})
            node = node.setdefault("/", {})  # no host label holds a slash: the path's part of the trie
            *segments, rest = rule.path.split("/")
            for segment in segments:
                node = node.setdefault(segment, {})
            node.setdefault(None, []).append((rest, rule))
            node[None].sort(key=lambda x: (-len(x[0]), x[1].verdict != "block"))

    def find(self, host: str, path: str) -> Rule | None:
        """The rule of the deepest host that has one for this path; there, the longest path's."""
        node, found = self.root, None
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            if "/" in node:
                found = self.below(node["/"], path) or found
        return found

    @staticmethod
    def below(node: dict, path: str) -> Rule | None:
        found, segments = None, path.split("/")
        for k, segment in enumerate(segments):
            for rest, rule in node.get(None, ()):
                if (segment if k == len(segments) - 1 else segment + "/").startswith(rest):
                    found = rule
                    break
            node = node.get(segment) if k < len(segments) - 1 else None
            if node is None:
                break
        return found


def tries_of(rules: Iterable[Rule], max_bytes: int) -> list[Trie]:
    """Tries of at most `max_bytes` of rule text each."""
    parts, size = [[]], 0
    for rule in sorted(set(rules)):
        size += len(rule.text.encode())
        if size > max_bytes and parts[-1]:
            parts, size = [*parts, []], len(rule.text.encode())
        parts[-1].append(rule)
    return [Trie(p) for p in parts]


def address(url):
    """(host, path) columns: what is between the first :// and a slash, question mark, hash or the end; then up to ? or #."""
    part = lambda k: F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)([^?#]*)", k)
    return F.translate(part(1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), part(2)


def judge(urls: DataFrame, rules: Iterable[Rule] = RULES, default: str = "allow", id_col: str = "page_id", url_col: str = "url", max_bytes: int = 8 << 20) -> DataFrame:
    """(id, host, path, rule, verdict) of every row."""
    host, path = address(F.col(url_col))
    df = urls.select(F.col(id_col), host.alias("host"), path.alias("path"))
    kind = df.schema[id_col].dataType.simpleString()
    tries = tries_of(rules, max_bytes)
    many = len(tries) > 1

    def passing(df: DataFrame, trie: Trie) -> DataFrame:
        sent = urls.sparkSession.sparkContext.broadcast(trie)

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, hosts, paths = batch.columns[:3]
            found = [sent.value.find(h, p) for h, p in zip(hosts.to_pylist(), paths.to_pylist(), strict=True)]
            if many:
                key = lambda r: (r.host.count(".") + 1, len(r.path), r.verdict == "block") if r else (0, 0, False)
                before = [x and Rule(**x) for x in batch.column(3).to_pylist()]
                found = [max(a, b, key=key) for a, b in zip(before, found, strict=True)]
                held = pa.array([x and x._asdict() for x in found], pa.struct([("host", pa.string()), ("path", pa.string()), ("verdict", pa.string())]))
                return pa.RecordBatch.from_arrays([ids, hosts, paths, held], [id_col, "host", "path", "held"])
            return pa.RecordBatch.from_arrays([ids, hosts, paths, pa.array([x and x.text for x in found], pa.string()), pa.array([x.verdict if x else default for x in found], pa.string())], [id_col, "host", "path", "rule", "verdict"])

        return map_batches(df, run, f"`{id_col}` {kind}, host string, path string, " + ("held struct<host string, path string, verdict string>" if many else "rule string, verdict string"))

    if not many:
        return passing(df, tries[0])
    df = df.withColumn("held", F.lit(None).cast("struct<host string, path string, verdict string>"))
    for trie in tries:
        df = passing(df, trie)
    return df.select(id_col, "host", "path", F.concat("held.host", "held.path").alias("rule"), F.coalesce("held.verdict", F.lit(default)).alias("verdict"))


SQL = r"""
WITH a AS (
  SELECT page_id, url, CASE WHEN url IS NULL OR position('://' IN url) = 0 THEN '' ELSE substr(url, position('://' IN url) + 3) END AS rest
  FROM pages),
b AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
c AS (SELECT *, CASE
  WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
  WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM b)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM c
"""
