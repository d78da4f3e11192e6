"""What several operators of this subpackage share: durable cuts of lineage, running totals, bounded samples and Arrow plumbing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import durable, row_numbers, running_totals, shared_folder

__all__ = ["beside", "durable", "first_by_hash", "fresh", "held_out", "in_arrow", "labelled_sample", "labelled_texts", "row_numbers", "running_totals", "shared_folder", "sized", "spans", "table", "text_bytes", "texts_of"]

#: Rows of a batch that goes to Python: long texts must not add up to gigabytes in one Arrow batch.
BATCH_ROWS = "256"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(columns: list[str], name: str) -> str:
    """The name, with as many underscores in front as it takes to be none of the columns'."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def beside(columns: list[str], name: str) -> list[str]:
    """The columns that stay beside a new one of this name: a column of the same name is replaced."""
    return [c for c in columns if c.lower() != name.lower()]


def in_arrow(df: DataFrame, schema: str, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return df.mapInArrow(work, schema)


def spans(start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after another."""
    size = stop - start
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + size, size)


#: Frames up to this many rows, and bytes of their values as text, are broadcast; others join by shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 50_000_000


def sized(few: DataFrame) -> DataFrame:
    """A frame, to be broadcast if a count of its rows and bytes shows that it is small enough."""
    first = few.limit(BROADCAST_ROWS + 1).agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0))).first()
    return F.broadcast(few) if first[0] <= BROADCAST_ROWS and first[1] <= BROADCAST_BYTES else few


def text_bytes(column: str = "text") -> Column:
    """Bytes of the UTF-8 form, none for null."""
    return F.coalesce(F.octet_length(column), F.lit(0)).cast("long")


def held_out(modulus: int, remainder: int) -> Column:
    """Whether crc32 of the doc_id as text leaves this remainder; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def first_by_hash(rows: DataFrame, n: int, total: int) -> list:
    """The n rows of the least hashes of doc_id, of `total` rows. A bound on the hash, twice as wide as needed, leaves the tasks few others to send."""
    ranked = rows.withColumn("rank", F.xxhash64("doc_id"))
    if total > 4 * n:
        ranked = ranked.where(F.col("rank") <= F.lit(int(2**64 * (2 * n / total)) - 2**63))
    return ranked.orderBy("rank", "doc_id").limit(n).collect()


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id and text of the ids, once each; ids is a bounded sample, so it is broadcast and only its texts move."""
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id", "left_semi")
    return found.groupBy("doc_id").agg(F.min("text").alias("text"))


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, learn_from: Column, per_class: int, max_bytes: int) -> DataFrame:
    """label, text and their order (rank, doc_id) of at most per_class texts of each label, of at most max_bytes each, the first by a hash of the doc_id: the bounded sample that a classifier
    is fitted on. A doc_id with both labels has label 1; of texts with one doc_id, the least counts. It is chosen by ids and sizes alone; then its texts are fetched."""
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1)).groupBy("doc_id").agg(F.max("label").alias("label"))
    rows = docs.where(learn_from).select("doc_id", text_bytes().alias("size")).groupBy("doc_id").agg(F.max("size").alias("size")).where(F.col("size") <= max_bytes).join(known, "doc_id")
    rows = durable(rows.select("doc_id", "label"))
    totals = dict(rows.groupBy("label").count().collect())
    chosen = [(r["doc_id"], r["label"]) for k in (0, 1) for r in first_by_hash(rows.where(F.col("label") == k), per_class, totals.get(k, 0))]
    ids = docs.sparkSession.createDataFrame(chosen, rows.select("doc_id", "label").schema)
    return texts_of(docs, ids.select("doc_id")).join(F.broadcast(ids), "doc_id").select("label", F.xxhash64("doc_id").alias("rank"), "doc_id", "text")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn_from: Column, per_class: int, max_bytes: int) -> list:
    """The rows of labelled_texts, label by label."""
    return labelled_texts(docs, labels, label, learn_from, per_class, max_bytes).orderBy("label", "rank", "doc_id").collect()
