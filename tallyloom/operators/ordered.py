"""Cuts of lineage, sized broadcasts, and numbers and sums over a whole order without a task that holds it."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder below spark.checkpoint.dir, which driver and executors share, that this application writes to."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))  # one machine: tests
    return context.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Cuts the lineage into the shared folder, so that a lost executor costs one read and no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Tables up to this many rows are broadcast; larger ones join by shuffle.
BROADCAST_ROWS = 200_000


def sized(few: DataFrame) -> DataFrame:
    """A table, to be broadcast if a count shows that it is small enough."""
    return F.broadcast(few) if few.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else few


def running_totals(df: DataFrame, groups: list[str], order: list[str | Column], values: dict[str, str]) -> DataFrame:
    """Adds, for each value column, the sum over the rows that come before in the group, under the name given.

    No group is ever in one task: rows are dealt by range, each range is summed, and a row gets the sums of the earlier ranges plus those
    of its own range. A group has as many sums of ranges as there are shuffle partitions."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = durable(df.repartitionByRange(n, *groups, *order).withColumn("_range", F.spark_partition_id()))
    sums = dealt.groupBy(*groups, "_range").agg(*[F.sum(v).alias(f"_{to}") for to, v in values.items()])
    before = Window.partitionBy(*(groups or [F.lit(1)])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*groups, "_range", *[F.coalesce(F.sum(f"_{to}").over(before), F.lit(0)).alias(f"_{to}") for to in values])
    own = Window.partitionBy(*groups, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = dealt.select("*", *[F.coalesce(F.sum(v).over(own), F.lit(0)).alias(f"_own_{to}") for to, v in values.items()])
    rows = rows.join(starts, [*groups, "_range"])
    kept = [c for c in df.columns if c not in groups]
    return rows.select(*groups, *kept, *[(F.col(f"_own_{to}") + F.col(f"_{to}")).cast("long").alias(to) for to in values])


def row_numbers(df: DataFrame, order: list[str | Column], name: str) -> DataFrame:
    """df with the number of each row, from 1, in the order of all rows; its columns must tell rows apart."""
    return running_totals(df.withColumn("_one", F.lit(1)), [], order, {name: "_one"}).withColumn(name, F.col(name) + 1).drop("_one")


def walked(df: DataFrame, keys: list[str], order: list[str], value: str, walk: Callable[[], Callable[[list[tuple]], list[int]]], kept: list[str], name: str) -> DataFrame:
    """The columns kept and a number, a long under the name given, of each row: walk() makes for each task a function that is called with each group's rows (order and value, in the order) and gives their numbers.

    All groups of a partition go through one call, so that many small groups cost no more than few large ones; a task holds one group and one batch."""
    rows = df.select(*dict.fromkeys([*keys, *kept, *order, value])).repartition(*keys).sortWithinPartitions(*keys, *[F.asc_nulls_last(c) for c in order])
    schema = df.select(*kept, F.lit(None).cast("long").alias(name)).schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold, here, waiting, members = walk(), None, [], []
        for b in batches:
            heads = list(zip(*(b.column(k).to_pylist() for k in keys), strict=True))
            numbers: list[int] = []
            for head, member in zip(heads, zip(*(b.column(c).to_pylist() for c in [*order, value]), strict=True), strict=True):
                if head != here and members:
                    numbers += fold(members)
                    members = []
                here = head
                members.append(member)
            # the rows of complete groups leave; the last group may go on in the next batch
            rows = pa.Table.from_batches([*waiting, b.select(kept)])
            if numbers:
                yield from rows.slice(0, len(numbers)).append_column(name, pa.array(numbers, pa.int64())).combine_chunks().to_batches()
            waiting = rows.slice(len(numbers)).to_batches()
        if members:
            yield from pa.Table.from_batches(waiting).append_column(name, pa.array(fold(members), pa.int64())).combine_chunks().to_batches()

    return rows.mapInArrow(work, schema)
