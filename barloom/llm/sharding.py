"""Sharding by bytes: contiguous shards of nearly equal size, cut from a global prefix sum.

Documents are put in order of id (null last, equal ids by a hash of the text) by range partitions. Each partition's bytes and
rows are summed up, the totals of earlier partitions are added to running sums inside each one, and so every document
knows the bytes before it in the whole corpus. Shard k takes the documents whose middle byte lies in the k-th of equal
parts of all bytes. A shard therefore differs from its equal share by at most half of the document at each end.

Only narrow rows are shuffled, never texts. Of every range partition one row is broadcast, and one of every shard. Equal rows of
any number are spread over partitions, as each row's place in the input settles ties.

Cases: a null text has no bytes and the crc32 of none (0); every document weighs EXTRA bytes beside its text, so that
empty ones count; a null id comes last; repeated rows get places of their own; a document larger than a shard's share
leaves shards empty beside it; an empty table gives an empty result; other columns play no part. Totals of up to
2 ** 57 bytes are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, partitions

SHARDS = 24
#: Bytes that a document weighs beside those of its text.
EXTRA = 8

_at_mask = (1 << 33) - 1


def size_of(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + EXTRA


def _key(text: Column) -> Column:
    """What settles the order of documents with one id."""
    return F.xxhash64(F.coalesce(text, F.lit("")), text.isNull())


def placed(rows: DataFrame, order: list[Column], size: str = "size") -> DataFrame:
    """Rows with __rank (from 0), __before (sum of size of all earlier rows) and __total in the order given."""
    spark = rows.sparkSession
    own = rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    own = materialize(own.withColumn("__at", F.monotonically_increasing_id()), "ordered")
    own = own.withColumn("__part", F.shiftright("__at", 33))
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    every = Window.partitionBy()
    totals = own.groupBy("__part").agg(F.sum(size).alias("bytes"), F.count(F.lit(1)).alias("rows"))
    totals = totals.select(
        F.col("__part").alias("__p"), F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("__bytes"), F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("__rows"), F.sum("bytes").over(every).alias("__total")
    )
    running = Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    own = own.withColumn("__sum", F.sum(size).over(running))
    own = own.join(F.broadcast(totals), F.col("__part") == F.col("__p"))
    before, rank = F.col("__bytes") + F.col("__sum") - F.col(size), F.col("__rows") + F.col("__at").bitwiseAND(F.lit(_at_mask))
    return own.select(*rows.columns, rank.alias("__rank"), before.alias("__before"), "__total")


def assign(docs: DataFrame, n: int = SHARDS, *, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, key, shard, slot) of every row; slot: place in the shard, from 0."""
    body = F.col(text)
    rows = docs.select(F.col(id_col).alias("doc_id"), size_of(body).alias("size"), F.crc32(F.coalesce(body, F.lit("")).cast("binary")).alias("text_crc32"), _key(body).alias("key"))
    rows = materialize(rows.withColumn("__row", F.monotonically_increasing_id()), "sizes")
    own = placed(rows, [F.col("doc_id").asc_nulls_last(), F.col("key"), F.col("__row")])
    middle = 2 * F.col("__before") + F.col("size")
    own = own.withColumn("shard", F.least(F.lit(n - 1), F.floor(F.call_function("div", middle * n, 2 * F.col("__total")))).cast("int"))
    first = own.groupBy(F.col("shard").alias("__s")).agg(F.min("__rank").alias("__first"))  # a row for each shard
    own = own.join(F.broadcast(first), F.col("shard") == F.col("__s"))
    return own.select("doc_id", "size", "text_crc32", "key", "shard", (F.col("__rank") - F.col("__first")).alias("slot"))


def shard_table(docs: DataFrame, n: int = SHARDS, **columns: str) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard); grown_shard, for the law `key` only, is null."""
    own = assign(docs, n, **columns)
    return own.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write(docs: DataFrame, path: str, n: int = SHARDS, *, id_col: str = "doc_id", text: str = "text", files: int = 4) -> None:
    """Write docs as Parquet, a folder for each shard with `files` files in order of id. Rows that agree in id and text go
    to the first shard of theirs."""
    key = _key(F.col(text))
    own = assign(docs, n, id_col=id_col, text=text).groupBy("doc_id", "key").agg(F.min("shard").alias("shard"))
    own = own.select(F.col("doc_id").alias("__d"), F.col("key").alias("__k"), "shard")
    out = docs.join(own, F.col(id_col).eqNullSafe(F.col("__d")) & (key == F.col("__k"))).drop("__d", "__k")
    out = out.repartitionByRange(n * files, "shard", id_col).sortWithinPartitions("shard", id_col)
    out.write.partitionBy("shard").parquet(path)
