"""Exact quantiles of groups of any size: ranks are found in a histogram that is refined, so no task sees a group's values.

A wanted rank lies in a range of values, at first the whole of its group. Each pass counts the range's rows in `bins` equal parts, with the
least and the most value of each (a row for each part and task is shuffled, whatever the group's size), and keeps the part that holds the rank. Two
passes make a range a millionth of the first, if values are spread; where they crowd, parts narrow to their own least and most, and
passes go on until a range holds `few` rows at most or one value only. The values of those ranges are sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sinks import written
from ..sources.store import scratch

#: Ranges of so many bytes are sent to all tasks; more meet their rows in a join that Spark splits where a group is large.
RANGES_BYTES = 32 << 20


def _same(a: DataFrame, b: DataFrame, by: list[str]) -> Column:
    found = F.lit(True)
    for c in by:
        found = found & a[c].eqNullSafe(b[c])
    return found


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _within(rows: DataFrame, wanted: DataFrame, by: list[str]) -> DataFrame:
    """Rows that lie in a wanted range of their group, each in one."""
    ranges = wanted.where("lo < hi").select(*[F.col(c).alias(f"g_{c}") for c in by], "lo", "hi").distinct()
    if ranges.count() * (40 + 40 * len(by)) <= RANGES_BYTES:
        ranges = F.broadcast(ranges)
    test = F.col("v").between(F.col("lo"), F.col("hi"))
    for c in by:
        test = test & F.col(c).eqNullSafe(F.col(f"g_{c}"))
    return rows.join(ranges, test).select(*by, "v", "lo", "hi")


def _narrowed(parts: DataFrame, wanted: DataFrame, by: list[str], order: str) -> DataFrame:
    """Each wanted rank with the part (least, most, rows) of its range that holds it; ranks of one value stay."""
    before = Window.partitionBy(*by, "lo", "hi").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("rows").over(before), F.lit(0)))
    p = parts.select(*[F.col(c).alias(f"g_{c}") for c in by], F.col("lo").alias("p_lo"), F.col("hi").alias("p_hi"), "least", "most", F.col("rows").alias("p_rows"), "before")
    test = (F.col("lo") == F.col("p_lo")) & (F.col("hi") == F.col("p_hi")) & (F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("p_rows"))
    for c in by:
        test = test & F.col(c).eqNullSafe(F.col(f"g_{c}"))
    moved = wanted.where("lo < hi").join(p, test).select(*by, "k", F.col("least").alias("lo"), F.col("most").alias("hi"), (F.col("rank") - F.col("before")).alias("rank"), F.col("p_rows").alias("rows"))
    return moved.unionByName(wanted.where("lo = hi"))


def exact_quantiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float], bins: int = 1024, few: int = 100_000) -> DataFrame:
    """by..., and a column for each share: the value at share * (rows - 1), between two values in proportion.

    Null and NaN values do not count; groups without others give no row; a null group is a group. Without `by` there is one row, if there is a value. Values are finite.
    """
    names, by = by, [f"_by{i}" for i in range(len(by))]  # a key may have the name of a column here
    known = df.select(*[F.col(c).alias(own) for c, own in zip(names, by, strict=True)], F.col(value).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    with written(known, "values") as rows:
        groups = _stored(rows.groupBy(*by).agg(F.count("*").alias("rows"), F.min("v").alias("lo"), F.max("v").alias("hi")).where("rows > 0"), "groups")
        at = [F.lit(float(p)) * (F.col("rows") - 1) for p in shares.values()]
        ranks = F.array_distinct(F.array(*[f(x).cast("long") for x in at for f in (F.floor, F.ceil)]))
        wanted = _stored(groups.select(*by, F.explode(ranks).alias("k"), "lo", "hi", "rows").withColumn("rank", F.col("k")), "ranks")
        done = 0
        while (left := wanted.where("lo < hi").agg(F.max("rows")).first()[0]) is not None and (done < 2 or left > few):
            place = F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))
            parts = _within(rows, wanted, by).groupBy(*by, "lo", "hi", place.alias("part")).agg(F.count("*").alias("rows"), F.min("v").alias("least"), F.max("v").alias("most"))
            wanted = _stored(_narrowed(parts, wanted, by, "part"), "ranks")
            done += 1
        if left is not None:
            values = _within(rows, wanted, by).groupBy(*by, "lo", "hi", F.col("v").alias("least")).agg(F.count("*").alias("rows")).withColumn("most", F.col("least"))
            wanted = _stored(_narrowed(values, wanted, by, "least"), "ranks")
    found = wanted.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("k", "lo"))).alias("found"))  # two ranks a share at most
    out = groups.alias("g").join(found.alias("f"), _same(groups, found, by)).select(*[groups[c] for c in by], "rows", "found")
    value_at = lambda x: F.element_at("found", x.cast("long"))
    between = lambda x: value_at(F.floor(x)) + (value_at(F.ceil(x)) - value_at(F.floor(x))) * (x - F.floor(x))
    return out.select(*[F.col(own).alias(c) for c, own in zip(names, by, strict=True)], *[between(x).alias(name) for name, x in zip(shares, at, strict=True)])
