"""URL filters: a trie over reversed host labels, then path segments, with longest-match precedence.

A rule is a host and a path prefix with a verdict, ``allow`` or ``block``. It fits its host
and every subdomain where the URL's path starts with the rule's path. Of the rules that fit,
the one with the longest text (host and path) decides; of two as long, the one that blocks.

The rules are broadcast as a trie, at most ``max_rules`` at a time: more of them are dealt into
blocks, and the URLs pass once for each block with the best rule so far. Rules may be a list or
a frame with columns host, path and verdict; only a block of a frame is on the driver at a
time. URLs are judged row by row, with no shuffle.

Where no rule fits, a URL with a host has ``default`` and one without a host is blocked.
A null URL, or one without ``://``, has an empty host and an empty path. Rows that repeat are
judged each on its own.
"""

from __future__ import annotations

import string
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliograph.llm.shared import written

_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


@dataclass
class _PathNode:
    below: dict[str, _PathNode] = field(default_factory=dict)
    #: What the rest of a path must start with, and the verdict and text of the rule that asks for it.
    ends: list[tuple[str, str, str]] = field(default_factory=list)


@dataclass
class _HostNode:
    below: dict[str, _HostNode] = field(default_factory=dict)
    paths: _PathNode = field(default_factory=_PathNode)


class UrlTrie:
    """Built from (host, path, verdict) rules."""

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.root = _HostNode()
        for host, path, verdict in rules:
            if verdict not in ("allow", "block"):
                raise ValueError(f"verdict {verdict!r} of {host}{path} is neither allow nor block")
            node = self.root
            for label in reversed(host.translate(_LOWER).split(".")):
                node = node.below.setdefault(label, _HostNode())
            at = node.paths
            *segments, rest = path.split("/")
            for segment in segments:
                at = at.below.setdefault(segment, _PathNode())
            at.ends.append((rest, verdict, f"{host}{path}"))

    def match(self, host: str, path: str, earlier: tuple[str, str] | None = None) -> tuple[str, str] | None:
        """(rule, verdict) of the rule that decides, if any fits; ``earlier`` is one that fits already."""
        found: list[tuple[int, bool, str, str]] = [(len(earlier[0]), earlier[1] == "block", *earlier)] if earlier else []
        node, segments = self.root, path.split("/")
        for label in reversed(host.split(".")):
            node = node.below.get(label)
            if node is None:
                break
            at, start = node.paths, 0
            for segment in segments:
                found += [(len(rule), verdict == "block", rule, verdict) for rest, verdict, rule in at.ends if path.startswith(rest, start)]
                at = at.below.get(segment)
                if at is None:
                    break
                start += len(segment) + 1
        return max(found)[2:] if found else None


def host_and_path(url: str | None) -> tuple[str, str]:
    """The host, A-Z lower-cased, and the path up to the query or fragment."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    rest = rest.split("#", 1)[0].split("?", 1)[0]
    host, slash, path = rest.partition("/")
    return host.translate(_LOWER), slash + path


def with_verdict(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame, *, url: str = "url", default: str = "allow", max_rules: int = 50_000) -> DataFrame:
    """The rows with columns host, path, rule and verdict; these replace columns of such names."""
    names = ("host", "path", "rule", "verdict")
    n = rules.count() if isinstance(rules, DataFrame) else len(rules)
    blocks = max(1, -(-n // max_rules))

    def block(k: int) -> list[tuple[str, str, str]]:
        if not isinstance(rules, DataFrame):
            return rules[k::blocks]
        some = rules.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("host", "path")], "verdict")
        return [tuple(r) for r in some.filter(F.pmod(F.xxhash64("host", "path"), F.lit(blocks)) == k).collect()]

    judged = pages.withColumn("_url", F.col(url)).select(*[F.col(f"`{c}`") for c in pages.columns if c not in (*names, "_url", "_judged")], "_url")
    judged = judged.withColumn("_judged", F.lit(None).cast("struct<host: string, path: string, rule: string, verdict: string>"))
    for k in range(blocks):
        trie = pages.sparkSession.sparkContext.broadcast(UrlTrie(block(k)))
        judged = judged.withColumn("_judged", _judged(trie)(F.col("_url"), F.col("_judged")))
        if k + 1 < blocks:
            judged = written(judged, "url-rules")
    verdict = F.coalesce("_judged.verdict", F.when(F.col("_judged.host") != "", default).otherwise("block")).alias("verdict")
    return judged.select(*[F.col(f"`{c}`") for c in judged.columns if c not in ("_url", "_judged")], "_judged.host", "_judged.path", "_judged.rule", verdict)


def _judged(trie):
    @F.pandas_udf("host string, path string, rule string, verdict string")
    def judged(batches: Iterator[tuple[pd.Series, pd.DataFrame]]) -> Iterator[pd.DataFrame]:
        match = trie.value.match
        for urls, earlier in batches:
            rows = []
            for x, rule, verdict in zip(urls, earlier["rule"], earlier["verdict"]):
                host, path = host_and_path(x)
                rows.append((host, path, *(match(host, path, (rule, verdict) if rule is not None else None) or (None, None))))
            yield pd.DataFrame(rows, columns=["host", "path", "rule", "verdict"], dtype=object)

    return judged
