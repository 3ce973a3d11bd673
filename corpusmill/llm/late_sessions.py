"""Sessions whose events come late: each version of each session, and which version retracts it.

Events come in batches. After each batch a user's events so far form sessions: neighbours in time at most `gap` seconds apart share
one. A session that holds an event of the batch is a new version; it retracts the standing sessions that it contains.

Versions come from Spark's session_window over (user, snapshot batch), its gap half a second longer so that a distance of just
`gap` joins whichever way ends are read. A snapshot is not given all earlier events but what can matter to it, merged before:

1. Events are summed by cells of `gap` seconds and batch; events of one cell always share a session, so a cell is one interval.
2. Islands are the sessions of all events; what is apart at the end was never together. Cells are linked to their neighbours, and runs are found
   by windows over blocks of CELLS cells and then over blocks, so no task holds a user's whole time line.
3. For batches [i * 2^k, (i + 1) * 2^k) of an island, its cells are merged by session_window: fragments. The batches before b are
   a few such ranges, one for each bit of b, so a snapshot reads few fragments: the sessions of those ranges, and not all events. A range's
   fragments number as many as its own sessions within the island; they merge early where late events come within a few batches.
4. The snapshot's fragments and its own cells are merged by session_window over (user, snapshot, island).

A version is retracted at the first later batch with an event at most `gap` seconds before its start, or after its end, or inside it. The
first two come from the cells beside its ends, the third is the next version with the same start; the version of that batch in the island
that contains it is its retractor.

Rows without user, time or batch are no events. Repeated rows are events of their own. Ties in time share a cell. An empty table gives no version.
Other columns are not read. Times, batches and batch numbers are whole and batches are not negative.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Cells of one block of a user's time line.
CELLS = 64
#: Batches of one block in which a version looks for the next one with its start.
BATCHES = 1024


def _session(gap: int) -> Column:
    """The session window of an interval first .. last."""
    length = F.make_interval(secs=(F.col("last") - F.col("first") + F.lit(gap)).cast("decimal(18,6)") + F.lit(0.5).cast("decimal(18,6)"))
    return F.session_window(F.timestamp_seconds("first"), length)


def _islands(cells: DataFrame, gap: int) -> DataFrame:
    """Each (user, cell) with its island: the first second of the run of cells that it belongs to."""
    block = cells.groupBy("user", "cell").agg(F.min("first").alias("first"), F.max("last").alias("last")).withColumn("block", F.floor(F.col("cell") / CELLS))
    order = Window.partitionBy("user", "block").orderBy("cell")
    block = block.withColumn("new", F.col("first") - F.lag("last").over(order) > gap)  # null: depends on the block before
    # the last beginning in the block up to here; null: still the island of the block before
    own = block.withColumn("island", F.last(F.when(F.col("new"), F.col("first")), ignorenulls=True).over(order))
    own = materialize(own, "islands")
    sums = own.groupBy("user", "block").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.max("island").alias("newest"))
    along = Window.partitionBy("user").orderBy("block")
    opens = F.coalesce(F.col("first") - F.lag("last").over(along) > gap, F.lit(True))
    sums = sums.withColumns({"opens": opens, "before": F.lag("newest").over(along)})
    # what the block's first cells belong to: their own start, or what was newest in the nearest block before with a beginning
    begun = F.when(F.col("opens"), F.col("first")).otherwise(F.col("before"))
    sums = sums.select("user", "block", F.last(begun, ignorenulls=True).over(along).alias("entered"))
    return own.join(sums, ["user", "block"]).select("user", "cell", F.coalesce("island", "entered").alias("island"))


def _merged(pieces: DataFrame, keys: list[str], gap: int) -> DataFrame:
    """Pieces (first, last, n_events, n_new, h_sum) merged to sessions within the keys."""
    sums = (F.min("first").alias("first"), F.max("last").alias("last"), *(F.sum(c).alias(c) for c in ("n_events", "n_new", "h_sum")))
    return pieces.groupBy(*keys, _session(gap).alias("window")).agg(*sums).drop("window")


def session_versions(events: DataFrame, gap: int = 600, user: str = "user", seconds: str = "seconds", batch: str = "batch", value: str = "h") -> DataFrame:
    """Every version: user, batch, start_s, end_s, n_events, n_new, n_retracted, h_sum (sum of `value`), retracted_batch, retracted_start_s."""
    rows = events.select(F.col(user).alias("user"), F.col(seconds).cast("long").alias("s"), F.col(batch).cast("long").alias("batch"), F.coalesce(F.col(value).cast("long"), F.lit(0)).alias("h"))
    rows = rows.dropna(subset=["user", "s", "batch"]).withColumn("cell", F.floor(F.col("s") / gap))
    cells = rows.groupBy("user", "cell", "batch").agg(F.min("s").alias("first"), F.max("s").alias("last"), F.count("*").alias("n_events"), F.sum("h").alias("h_sum"))
    cells = materialize(cells, "cells")
    pieces = materialize(cells.join(_islands(cells, gap), ["user", "cell"]).withColumn("n_new", F.col("n_events")), "pieces")

    levels = max(1, int(pieces.agg(F.max("batch")).first()[0] or 0).bit_length())
    bits = lambda wanted: F.explode(F.expr(f"filter(sequence(0, {levels - 1}), k -> shiftright(batch, k) & 1 = {wanted})")).alias("k")
    at = F.expr("shiftright(batch, k)")
    # ranges with even numbers; those before b are numbered one less than b's bits above them
    ranges = pieces.select("user", "island", "first", "last", "n_events", "n_new", "h_sum", "batch", bits(0)).withColumn("i", at).drop("batch")
    fragments = _merged(ranges, ["user", "island", "k", "i"], gap)
    snapshots = pieces.select("user", "island", "batch").distinct().select("user", "island", "batch", bits(1)).withColumn("i", at - 1)
    old = snapshots.join(fragments, ["user", "island", "k", "i"]).withColumn("n_new", F.lit(0).cast("long"))
    columns = ["user", "batch", "island", "first", "last", "n_events", "n_new", "h_sum"]
    versions = _merged(old.select(*columns).unionByName(pieces.select(*columns)), ["user", "batch", "island"], gap).where("n_new > 0")
    versions = materialize(versions, "versions")

    # the first batch with an event before a start, or behind an end
    near = cells.select("user", "cell", F.col("batch").alias("at"), F.col("first").alias("low"), F.col("last").alias("high"))
    by = lambda c, step: F.explode(F.array(F.floor(F.col(c) / gap), F.floor(F.col(c) / gap) + step)).alias("cell")
    starts = versions.select("user", "first").distinct().select("user", "first", by("first", -1)).join(near, ["user", "cell"])
    starts = starts.where("low < first").where(F.col("high") >= F.col("first") - gap).groupBy("user", "first").agg(F.min("at").alias("at_start"))
    ends = versions.select("user", "last").distinct().select("user", "last", by("last", 1)).join(near, ["user", "cell"])
    ends = ends.where("high > last").where(F.col("low") <= F.col("last") + gap).groupBy("user", "last").agg(F.min("at").alias("at_end"))
    # the next version with the same start, within a block of batches or in the next block that has one
    blocked = versions.select("user", "first", "last", "batch", "island", F.floor(F.col("batch") / BATCHES).alias("block"))
    following = blocked.withColumn("next", F.lead("batch").over(Window.partitionBy("user", "first", "block").orderBy("batch")))
    beyond = blocked.groupBy("user", "first", "block").agg(F.min("batch").alias("least"))
    beyond = beyond.select("user", "first", "block", F.lead("least").over(Window.partitionBy("user", "first").orderBy("block")).alias("beyond"))
    following = following.join(beyond, ["user", "first", "block"]).join(starts, ["user", "first"], "left").join(ends, ["user", "last"], "left")
    retracted = following.select("user", "island", "batch", "first", "last", F.least(F.coalesce("next", "beyond"), "at_start", "at_end").alias("by_batch"))

    # the containment join: of that batch's versions in the island, the one around it
    later = versions.select("user", "island", F.col("batch").alias("by_batch"), F.col("first").alias("by_first"), F.col("last").alias("by_last"))
    links = retracted.where("by_batch is not null").join(later, ["user", "island", "by_batch"]).where("by_first <= first and last <= by_last")
    links = materialize(links.select("user", "batch", "first", "by_batch", "by_first"), "links")
    taken = links.groupBy("user", F.col("by_batch").alias("batch"), F.col("by_first").alias("first")).agg(F.count("*").alias("n_retracted"))
    done = versions.join(links, ["user", "batch", "first"], "left").join(taken, ["user", "batch", "first"], "left")
    return done.select(
        "user", "batch", F.col("first").alias("start_s"), F.col("last").alias("end_s"), "n_events", "n_new", F.coalesce("n_retracted", F.lit(0)).alias("n_retracted"), "h_sum",
        F.col("by_batch").alias("retracted_batch"), F.col("by_first").alias("retracted_start_s"),
    )
