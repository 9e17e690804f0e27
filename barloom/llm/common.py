"""What several operators share: words, shared storage, order-preserving buckets, global ranks and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The characters that separate words, and a word.
SPACE_CHARS = " \t\n\x0b\f\r"
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: Rows that a worker makes results of at once.
AT_ONCE = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A folder of our own is set only where the session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: computed once, lineage cut, any executor may be lost."""
    path = f"{shared_dir(df.sparkSession)}/barloom-{uuid.uuid4().hex}/{name}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the folder of a materialized table, once all that is made of it has been written too."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 2)[0] for f in df.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The batches in parts of AT_ONCE rows, so that a worker holds few results beside a batch of texts."""
    for b in batches:
        yield from (b.iloc[i : i + AT_ONCE] for i in range(0, len(b), AT_ONCE))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words(text: Column) -> Column:
    """Array of the words of a text; null and blank texts give an empty array."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACES))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def global_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Add the 1-based position of each row in a total order, without one task that sees all rows.

    Rows are range-partitioned and sorted, numbered inside their partition and written; then the partitions' row counts
    (one number for each) are summed up and added. Range partitioning on the whole order splits hot leading keys.
    """
    n = partitions(df.sparkSession)
    placed = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    placed = materialize(placed, "ranked")
    part = F.shiftright(F.col("__at"), 33)
    counts = placed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    sizes = sorted((r["__part"], r["__n"]) for r in counts.collect())  # one row for each shuffle partition
    base, rows = 0, []
    for p, size in sizes:
        rows.append((p, base))
        base += size
    offsets = df.sparkSession.createDataFrame(rows, "__part long, __base long")
    out = placed.withColumn("__part", part).join(F.broadcast(offsets), "__part")
    return out.withColumn(name, F.col("__base") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("__at", "__part", "__base")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of an undirected graph given as (a, b) long pairs: component is the smallest node reachable.

    Every round, each node takes the smallest label among its own and its neighbours' and then its label's label, so
    that chains shorten by more than half. Labels and links stay distributed and each round is written to the shared
    folder. Nodes without links are not returned.
    """
    links = materialize(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "links")
    labels = materialize(links.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    for _ in range(rounds):
        near = links.join(labels, links.b == labels.node).groupBy("a").agg(F.min("label").alias("m"))
        moved = labels.join(near, labels.node == near.a).select("node", F.least("label", "m").alias("label"), F.col("label").alias("was"))
        # Hooking: a node's old label follows the node to its new one, then every label takes its own label's label.
        hooks = moved.filter("label < was").groupBy(F.col("was").alias("h")).agg(F.min("label").alias("to"))
        hooked = moved.join(hooks, moved.node == hooks.h, "left").select("node", "was", F.least("label", F.coalesce("to", "label")).alias("label"))
        hooked = materialize(hooked, "hooked")
        up = hooked.select(F.col("node").alias("u"), F.col("label").alias("top"))
        new = materialize(hooked.join(up, hooked.label == up.u, "left").select("node", F.least("label", F.coalesce("top", "label")).alias("label"), "was"), "labels")
        changed = not new.filter("label <> was").isEmpty()
        labels = new.select("node", "label")
        if not changed:
            break
    else:
        raise RuntimeError(f"labels still change after {rounds} rounds")
    return labels.select("node", F.col("label").alias("component"))
