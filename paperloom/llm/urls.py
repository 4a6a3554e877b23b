"""URL filter: a trie over reversed host labels, under each host one over path segments, and one over the characters of a last segment."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Above this many rules the trie is not broadcast; the rules are then joined by host.
MAX_BROADCAST_RULES = 200_000
ALLOW, BLOCK = "allow", "block"
Rule = tuple[str, str, str]


class UrlTrie:
    """Rules are (verdict, host, path). A rule fits its host and all subdomains if the url's path starts with its path.

    The rule with the longest host wins, then the longest path; of equal rules, block wins over allow.
    """

    def __init__(self, rules: Iterable[Rule]):
        self.root: dict = {}
        self.size = 0
        for verdict, host, path in rules:
            if verdict not in (ALLOW, BLOCK):
                raise ValueError(f"verdict {verdict!r}")
            self.size += 1
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault("labels", {}).setdefault(label, {})
            node = node.setdefault("paths", {})
            *whole, tail = path.split("/")
            for segment in whole:
                node = node.setdefault("segments", {}).setdefault(segment, {})
            node = node.setdefault("tails", {})
            for char in tail:
                node = node.setdefault(char, {})
            # A character's key is one long, so the rule's is none of them.
            if node.get("rule", ("", ALLOW))[1] == ALLOW:
                node["rule"] = (host + path, verdict)

    @staticmethod
    def _longest(node: dict, segments: list[str]) -> tuple[str, str] | None:
        best = None
        for segment in segments:
            tail = node.get("tails", {})
            best = tail.get("rule", best)
            for char in segment:
                tail = tail.get(char)
                if tail is None:
                    break
                best = tail.get("rule", best)
            node = node.get("segments", {}).get(segment)
            if node is None:
                break
        return best

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest rule that fits."""
        best, node, segments = None, self.root, path.split("/")
        for label in reversed(host.split(".")):
            node = node.get("labels", {}).get(label)
            if node is None:
                break
            if "paths" in node:
                best = self._longest(node["paths"], segments) or best
        return best


def host_of(url: Column) -> Column:
    """What stands between the first :// and the next /, ?, # or the end, with A-Z lower-cased; else empty."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), upper, lower)


def path_of(url: Column) -> Column:
    """What stands between the host and the next ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge_urls(df: DataFrame, rules: list[Rule], url: str = "url", default: str = ALLOW) -> DataFrame:
    """df with the columns host, path, rule and verdict in place of columns of those names.

    A null url, or one without ://, has an empty host and path and so no rule: its verdict is ``default``. Repeated and extra
    rows and columns pass through. Up to MAX_BROADCAST_RULES rules go to every executor as one trie; more are joined by host.
    """
    kept = [c for c in df.columns if c not in ("host", "path", "rule", "verdict")]
    parts = df.select(*kept, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    if len(rules) > MAX_BROADCAST_RULES:
        return _judge_by_join(parts, rules, kept, default)
    trie = df.sparkSession.sparkContext.broadcast(UrlTrie(rules))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [trie.value.match(h, p) or (None, default) for h, p in zip(b["host"].to_pylist(), b["path"].to_pylist(), strict=True)]
            columns = [*b.columns, pa.array([r for r, _ in found], pa.string()), pa.array([v for _, v in found], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*b.schema.names, "rule", "verdict"])

    schema = parts.select("*", F.lit("").alias("rule"), F.lit("").alias("verdict")).schema
    for f in schema.fields:
        f.nullable = True
    return parts.mapInArrow(judge, schema)


def _judge_by_join(parts: DataFrame, rules: list[Rule], kept: list[str], default: str) -> DataFrame:
    """The same verdicts by a join on each suffix of the host; hosts are judged once however many urls they have."""
    spark = parts.sparkSession
    table = spark.createDataFrame(rules, "rule_verdict string, suffix string, prefix string")
    pairs = parts.select("host", "path").distinct()
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fits = pairs.select("host", "path", F.explode(suffixes).alias("suffix")).join(table, "suffix").where(F.startswith("path", "prefix"))
    order = F.struct(F.size(F.split("suffix", r"\.", -1)), F.length("prefix"), F.col("rule_verdict") == BLOCK)
    best = fits.groupBy("host", "path").agg(F.max_by(F.struct(F.concat("suffix", "prefix").alias("rule"), F.col("rule_verdict").alias("verdict")), order).alias("b"))
    joined = parts.join(best, ["host", "path"], "left")
    return joined.select(*kept, "host", "path", F.col("b.rule").alias("rule"), F.coalesce("b.verdict", F.lit(default)).alias("verdict"))
