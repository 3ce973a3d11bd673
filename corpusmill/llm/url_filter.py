"""URL filters: a trie over reversed host labels and path segments, broadcast to the executors.

A rule is (verdict, host, path). It fits a url if the url's host is the rule's or a subdomain of it and
the url's path starts with the rule's path. The longest fitting rule (characters of host and path together)
decides; of equally long ones, `block` does. A url that no rule fits gets `default`.

Null urls and urls without `://` have an empty host and path, so no rule fits them. Repeated rows are judged
alike, very long urls are read whole, an empty table gives an empty result, and any other columns of the input pass through unless they
bear the name of an output column, which then replaces them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_LOWER = {i: i + 32 for i in range(ord("A"), ord("Z") + 1)}
#: The trie is broadcast only up to so many characters of rules; rules are configuration, not data.
MAX_RULE_CHARS = 64 << 20
_ENDS = frozenset("/?#")


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path) of a url; both empty without `://`."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    end = next((i for i, c in enumerate(rest) if c in _ENDS), len(rest))
    path = rest[end:]
    stop = min((i for i in (path.find("?"), path.find("#")) if i >= 0), default=len(path))
    return rest[:end].translate(_LOWER), path[:stop]


class HostTrie:
    """Rules by reversed host labels; below each host, by path segments."""

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.root: dict = {}
        for verdict, host, path in rules:
            if verdict not in ("allow", "block"):
                raise ValueError(f"no such verdict: {verdict}")
            node = self.root
            for label in reversed(host.translate(_LOWER).split(".")):
                node = node.setdefault(label, {})
            node = node.setdefault(None, {})  # None: where the paths of this host begin
            *whole, rest = path.split("/")
            for segment in whole:
                node = node.setdefault(segment, {})
            ends = node.setdefault(None, {})  # rest of a segment: what a url's segment must start with
            if ends.get(rest, ("",))[0] != "block":
                ends[rest] = (verdict, host.translate(_LOWER) + path)

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """(verdict, rule) of the longest rule that fits."""
        best: tuple[str, str] | None = None
        segments = path.split("/")
        node = self.root
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            at = node.get(None)
            for segment in segments if at else ():
                for rest, found in at.get(None, {}).items():
                    if segment.startswith(rest) and (best is None or (len(found[1]), found[0]) > (len(best[1]), best[0])):
                        best = found
                at = at.get(segment)
                if at is None:
                    break
        return best


def filter_urls(df: DataFrame, rules: Iterable[tuple[str, str, str]], url_col: str = "url", default: str = "allow") -> DataFrame:
    """df with host, path, rule (null if none fits) and verdict."""
    rules = list(rules)
    if sum(len(h) + len(p) for _, h, p in rules) > MAX_RULE_CHARS:
        raise ValueError("the rules are too large to broadcast")
    trie = df.sparkSession.sparkContext.broadcast(HostTrie(rules))
    out = pa.struct([(n, pa.string()) for n in ("host", "path", "rule", "verdict")])

    @F.arrow_udf("struct<host:string,path:string,rule:string,verdict:string>")
    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for urls in batches:
            rows = []
            for url in urls.to_pylist():
                host, path = split_url(url)
                verdict, rule = trie.value.match(host, path) or (default, None)
                rows.append({"host": host, "path": path, "rule": rule, "verdict": verdict})
            yield pa.array(rows, out)

    names = {"host", "path", "rule", "verdict"}
    kept = [c for c in df.columns if c.lower() not in names]
    # the input's columns travel in one, so that their names do not matter
    done = df.select(F.struct(*([F.col(f"`{c}`") for c in kept] or [F.lit(0)])).alias("row"), judge(F.col(url_col)).alias("judged"))
    return done.select(*[F.col("row")[c].alias(c) for c in kept], "judged.*")
