"""Scraped pages, settings and databases."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.html_text import links_column


def read_json_array(spark: SparkSession, path: str, schema: str = "name STRING, url STRING, main_text STRING") -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def listing(pages: DataFrame, html_col: str, within_class: str = "recent-answers") -> DataFrame:
    """(name, url) of the anchors in the listing part of pages."""
    return pages.select(F.explode(links_column(F.col(html_col), within_class)).alias("a")).select("a.name", "a.url")


def fetched(url: Column, fetch: Callable[[str], str | None]) -> Column:
    """Bodies of pages by a provider; null where it gives none."""

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield pa.array([None if u is None else fetch(u) for u in b.to_pylist()], pa.string())

    return run(url)


def settings(path: str) -> dict:
    """Nested settings of a YAML file of mappings with scalar values; comments and quotes are understood, lists are not."""
    root: dict = {}
    stack: list[tuple[int, dict]] = [(-1, root)]
    for line in open(path, encoding="utf-8"):
        body = re.sub(r"\s+#.*$", "", line.rstrip("\n"))
        if not body.strip() or body.lstrip().startswith("#"):
            continue
        indent = len(body) - len(body.lstrip())
        key, _, value = body.strip().partition(":")
        while stack[-1][0] >= indent:
            stack.pop()
        if value.strip():
            stack[-1][1][key] = _scalar(value.strip())
        else:
            stack[-1][1][key] = {}
            stack.append((indent, stack[-1][1][key]))
    return root


def _scalar(value: str):
    if value[0] in "'\"":
        return value[1:-1]
    if value in ("true", "false"):
        return value == "true"
    for kind in (int, float):
        try:
            return kind(value)
        except ValueError:
            pass
    return value


def key_ranges(spark: SparkSession, url: str, table: str, key: str, parts: int, **options: str) -> list[str]:
    """At most `parts` conditions on a whole-number key, which hold of about as many rows each; every row, also one without a key, meets exactly one.

    The database counts the rows of 16 * parts equal ranges, and again within each range that holds more than half a part, down to single keys;
    neighbouring ranges are put together by these counts. Only a single key that very many rows have makes a larger part. An empty table has the one
    condition that always holds.
    """

    def ask(sql: str) -> list:
        return spark.read.format("jdbc").options(url=url, query=sql, **options).load().collect()

    def counted(low: int, high: int, pieces: int) -> list[tuple[int, int, int]]:
        """(least key, largest key, rows) of each of the ranges that holds any, ascending."""
        inside = f"SELECT {key} AS k, FLOOR({key} / {(high + 1 - low) // pieces + 1}) AS place FROM {table} WHERE {key} >= {low} AND {key} <= {high}"
        found = ask(f"SELECT place, MIN(k) AS low, MAX(k) AS high, COUNT(*) AS n FROM ({inside}) placed GROUP BY place")
        return sorted((int(x), int(y), int(n)) for _, x, y, n in found)

    low, high = ask(f"SELECT MIN({key}) AS low, MAX({key}) AS high FROM {table}")[0]
    if low is None or parts < 2:
        return ["1 = 1"]
    counts = counted(int(low), int(high), 16 * parts)
    total = sum(n for *_, n in counts)
    while any(crowded := [2 * parts * n > total and x < y for x, y, n in counts]):
        counts = [r for r, cut in zip(counts, crowded, strict=True) for r in (counted(r[0], r[1], 16) if cut else [r])]
    held, bounds = 0, []
    for (*_, n), (after, *_) in zip(counts, counts[1:], strict=False):
        held += n
        if held * parts >= total * (len(bounds) + 1) and len(bounds) < parts - 1:
            bounds.append(after)
    if not bounds:
        return ["1 = 1"]
    inner = [f"{key} >= {x} AND {key} < {y}" for x, y in zip(bounds, bounds[1:], strict=False)]
    return [f"{key} < {bounds[0]} OR {key} IS NULL", *inner, f"{key} >= {bounds[-1]}"]


def read_table(spark: SparkSession, url: str, table: str, limit: int | None = None, key: str | None = None, parts: int = 1, **options: str) -> DataFrame:
    """A database table over JDBC; with a whole-number `key` (as the database's SQL names it) in up to `parts` partitions of about as many rows.

    Each partition is a query of its own with a condition of `key_ranges`; filters, chosen columns and aggregates are handed to the database as well.
    """
    if key is None:
        df = spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
    else:
        df = spark.read.jdbc(url, table, predicates=key_ranges(spark, url, table, key, parts, **options), properties=options)
    return df if limit is None else df.limit(limit)


def retried(run: Callable[[], object], attempts: int = 30, wait_s: float = 5.0):
    """Try until it works; the last failure is raised."""
    import time

    for i in range(attempts):
        try:
            return run()
        except Exception:
            if i == attempts - 1:
                raise
            time.sleep(wait_s)
