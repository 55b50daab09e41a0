"""The page pipeline: packing of patches in batches, completion by key, and the same as a stream with state."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quire.catalog import register
from quire.plans.shared import new_folder, spill
from quire.plans.tables import load

PATCHES = "page long, patch long, total long"


def running_sums(rows: DataFrame, order: list[Column], value: str, name: str) -> DataFrame:
    """rows with the sum of value over all rows before, in order, as name: ranges of the order are summed apart, and then shifted by the sums of the ranges before."""
    placed = spill(rows.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranges")
    inside = F.coalesce(F.sum(value).over(W.partitionBy("__range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranges = placed.groupBy("__range").agg(F.sum(value).alias("all"))  # a row a partition
    shift = ranges.select("__range", F.coalesce(F.sum("all").over(W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__shift"))
    return placed.withColumn(name, inside).join(F.broadcast(shift), "__range").withColumn(name, F.col(name) + F.col("__shift")).drop("__range", "__shift")


@register(
    "pack_batches",
    """WITH p AS (SELECT conv_id AS page, turn AS patch, count(*) OVER (PARTITION BY conv_id) AS pending, min(conv_id * 1000) OVER (PARTITION BY conv_id) AS arrived FROM conversations),
r AS (SELECT *, row_number() OVER (ORDER BY pending DESC, arrived, patch) - 1 AS k FROM p)
SELECT page, patch, CAST(k // 64 AS BIGINT) AS batch, CAST(k % 64 AS BIGINT) AS place FROM r""",
)
def pack_batches(spark: SparkSession, sf_dir: str, size: int = 64):
    """Patches of pages in order of how many each has pending, then of arrival, dealt into batches of size.

    The running number is made in two steps: pages are numbered by their counts (a row a page), patches in their page.
    """
    c = load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("page"), F.col("turn").alias("patch"))
    pages = c.groupBy("page").agg(F.count("*").alias("pending"))
    pages = running_sums(pages, [F.desc("pending"), F.col("page")], "pending", "before")
    inside = F.row_number().over(W.partitionBy("page").orderBy("patch")) - 1
    r = c.withColumn("inside", inside).join(pages, "page").withColumn("k", F.col("before") + F.col("inside"))
    return r.select("page", "patch", F.expr(f"k DIV {size}").alias("batch"), (F.col("k") % size).cast("long").alias("place"))


@register("accumulator_complete", "SELECT conv_id AS page, count(DISTINCT turn) AS patches FROM conversations WHERE role != 'system' OR turn >= 0 GROUP BY 1 HAVING count(DISTINCT turn) >= max(turn) + 1")
def accumulator_complete(spark, sf_dir):
    """Pages of which every patch has come."""
    c = load(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("page")).agg(F.countDistinct("turn").alias("patches"), F.max("turn").alias("last"))
    return c.where("patches >= last + 1").drop("last")


def complete_pages(patches: DataFrame, wait: str | None = None) -> DataFrame:
    """A stream of (page, patch, total) -> (page, patches) once, as soon as a page has all its patches. A repeated patch counts once.

    What stays of a complete page is its total, so that later repeats aren't taken for a new page. With wait (as in
    "1 hour") the state of a page that nothing came for is dropped after that time, complete or not.
    """
    timeout = GroupStateTimeout.ProcessingTimeTimeout if wait else GroupStateTimeout.NoTimeout

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen, total, done = (set(state.get[0]), state.get[1], state.get[2]) if state.exists else (set(), None, False)
        for b in batches:
            seen |= set(b.patch.tolist())
            total = int(b.total.iloc[-1])
        if not done and total is not None and len(seen) >= total:
            yield pd.DataFrame({"page": [key[0]], "patches": [len(seen)]})
            done = True
        state.update(([] if done else sorted(seen), total, done))
        if wait:
            state.setTimeoutDuration(wait)

    return patches.groupBy("page").applyInPandasWithState(step, "page long, patches long", "seen array<long>, total long, done boolean", "append", timeout)


def run_to_end(stream: DataFrame, folder: str) -> DataFrame:
    """Run a stream over what there is now, into a table below folder, and return that table; a repeated run goes on where the last one ended."""
    q = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/progress").option("path", f"{folder}/rows").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")


@register(
    "page_stream",
    """WITH p AS (SELECT conv_id AS page, turn AS patch, max(turn) OVER (PARTITION BY conv_id) + 1 AS total FROM conversations)
SELECT page, count(DISTINCT patch) AS patches FROM p WHERE NOT (page % 5 = 0 AND patch = 0) GROUP BY page HAVING count(DISTINCT patch) >= max(total)""",
)
def page_stream(spark: SparkSession, sf_dir: str, files: int = 8):
    """Patches as files that arrive a few at a time, pages out as they become complete. Pages of which a patch never comes don't.

    The source's rate is the backpressure; the end of the input ends the query, and what is incomplete then stays in its state.
    """
    c = load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("page"), F.col("turn").alias("patch"))
    total = c.groupBy("page").agg((F.max("patch") + 1).alias("total"))
    folder = new_folder(spark, "page-stream")
    late = c.where("NOT (page % 5 = 0 AND patch = 0)").join(total, "page").select("page", "patch", "total")
    late.repartition(files).write.parquet(f"{folder}/patches")
    stream = spark.readStream.schema(late.schema).option("maxFilesPerTrigger", files // 2).parquet(f"{folder}/patches")
    return run_to_end(complete_pages(stream), folder)


class Progress(StreamingQueryListener):
    """Rows done by query, refreshed at most every interval seconds; the end is always shown."""

    def __init__(self, show: Callable[[str, int], None], interval: float = 0.2, clock: Callable[[], float] = time.monotonic):
        self.show, self.interval, self.clock = show, interval, clock
        self.rows: dict[str, int] = {}
        self.shown: dict[str, float] = {}

    def add(self, query: str, rows: int, end: bool = False) -> None:
        self.rows[query] = self.rows.get(query, 0) + rows
        now = self.clock()
        if end or now - self.shown.get(query, -self.interval) >= self.interval:
            self.shown[query] = now
            self.show(query, self.rows[query])

    def onQueryStarted(self, event) -> None:
        self.add(str(event.id), 0)

    def onQueryProgress(self, event) -> None:
        self.add(str(event.progress.id), event.progress.numInputRows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.add(str(event.id), 0, end=True)


@register(
    "fallback_queue",
    """SELECT event_id, 'main' AS taken_by, value FROM events WHERE event_type != 'error' UNION ALL SELECT event_id, 'fallback' AS taken_by, value / 2 FROM events WHERE event_type = 'error' AND event_id % 4 != 0
UNION ALL SELECT event_id, 'input' AS taken_by, value FROM events WHERE event_type = 'error' AND event_id % 4 = 0""",
)
def fallback_queue(spark, sf_dir):
    """Rows that the first worker refuses go to a second one, and what that refuses passes as it came: side outputs, joined again. One scan."""
    refused, again = F.col("event_type") == "error", F.col("event_id") % 4 == 0
    taken = F.when(~refused, "main").when(~again, "fallback").otherwise("input")
    return load(spark, sf_dir, "events").select("event_id", taken.alias("taken_by"), F.when(taken == "fallback", F.col("value") / 2).otherwise(F.col("value")).alias("value"))


@register("skip_path", "SELECT event_id, CASE WHEN event_type = 'view' AND event_id % 2 = 0 THEN 'input' ELSE 'restored' END AS taken_from FROM events")
def skip_path(spark, sf_dir, skip: bool = True):
    """Without detected boxes the input passes as it is, if skipping is on."""
    none = (F.col("event_type") == "view") & (F.col("event_id") % 2 == 0) & F.lit(skip)
    return load(spark, sf_dir, "events").select("event_id", F.when(none, "input").otherwise("restored").alias("taken_from"))
