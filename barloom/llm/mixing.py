"""Mixing sources to target weights by systematic sampling.

Every source gets a target number of words. Each of its documents then has the same expected number of copies, target /
size of the source. Within the source, documents are put in order of size; the prefix sums of their expected copies plus
one random offset cross an integer boundary now and then, and each crossing emits the document once. As the order is by
size, the words taken differ from the target by no more than about one document's size.

The prefix sum of equal shares is share * position, so one distributed rank over (source, size, id) serves all sources,
and a source with a third of all rows is spread over many tasks. Only narrow rows are shuffled, never texts.

Cases: null text has size 0 and is never taken in words; the null source is a source of its own, last in order; a source
of size 0 has target 0; repeated rows are ranked one by one; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import global_rank, materialize, n_words

WEIGHTS = (5, 2, 1)
SHARE_PERCENT, MOST_TIMES = 150, 2
SEED = "mix-1"


def sizes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, source, size) of every row."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"))


def targets(by_source: DataFrame) -> DataFrame:
    """Add target to rows that have source and source_size, one for each source.

    Sources in code point order weigh 5, 2, 1, 5, ... The level is found in rounds: the sources that would exceed
    MOST_TIMES their size are held there and the rest of the words is shared anew by weight, until none is above. Each
    round is one aggregation to a single row.
    """
    ranked = global_rank(by_source, [F.col("source").asc_nulls_last()], "__r")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), F.pmod(F.col("__r") - 1, F.lit(len(WEIGHTS))).cast("int") + 1)
    ranked = ranked.withColumn("__w", weight.cast("double")).withColumn("__cap", F.col("source_size") * float(MOST_TIMES))
    ranked = materialize(ranked, "sources")
    total = (ranked.agg(F.sum("source_size")).first()[0] or 0) * SHARE_PERCENT / 100
    level = 0.0
    while True:
        held = F.col("__cap") <= F.lit(level) * F.col("__w")
        full, weights = ranked.agg(F.coalesce(F.sum(F.when(held, F.col("__cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~held, F.col("__w"))), F.lit(0.0))).first()
        now = (total - full) / weights if weights else level
        if now <= level:
            break
        level = now
    target = F.least(F.col("__cap"), F.lit(level) * F.col("__w"))
    return ranked.withColumn("target", target).drop("__r", "__w", "__cap")


def offset(source: Column) -> Column:
    """A number in [0, 1), a multiple of 2**-16, that depends on the seed and the source's name only."""
    name = F.concat(F.lit(SEED + "/"), F.coalesce(F.concat(F.lit("s:"), source), F.lit("null")))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 4), 16, 10).cast("double") / 65536.0


def copies(rows: DataFrame, ties: tuple[str, ...] = ()) -> DataFrame:
    """Add source_size, target and copies to rows that have doc_id, source and size; ties: columns that settle equal ids."""
    ranked = materialize(global_rank(rows, [F.col("source").asc_nulls_last(), F.col("size"), F.col("doc_id"), *map(F.col, ties)], "__r"), "documents")
    by_source = ranked.groupBy("source").agg(F.sum("size").alias("source_size"), (F.min("__r") - 1).alias("__before"))
    per = targets(by_source).withColumnRenamed("source", "__source")
    joined = ranked.join(per, F.col("source").eqNullSafe(F.col("__source")))
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    at, start = F.col("__r") - F.col("__before"), offset(F.col("source"))
    crossed = F.floor(share * at + start) - F.floor(share * (at - 1) + start)
    return joined.select(*rows.columns, "source_size", "target", F.least(crossed, F.lit(MOST_TIMES)).cast("long").alias("copies"))


def mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) for every row of docs."""
    return copies(sizes(docs, id_col, text, source)).withColumn("taken", F.col("copies") * F.col("size"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs, each as many times as the mix takes it, with the columns that they had (id, text and source
    under the names doc_id, text and source). Rows that agree in all three count as one row that is taken that often."""
    key = F.xxhash64(F.coalesce(F.col("text"), F.lit("")), F.col("text").isNull())
    rows = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), key.alias("key"))
    taken = copies(rows, ("key",)).filter("copies > 0").groupBy("doc_id", "source", "key").agg(F.sum("copies").alias("__n"))
    taken = taken.select(F.col("doc_id").alias("__d"), F.col("source").alias("__s"), F.col("key").alias("__k"), "__n")
    same = F.col("doc_id").eqNullSafe(F.col("__d")) & F.col("source").eqNullSafe(F.col("__s")) & (F.col("__key") == F.col("__k"))
    own = docs.withColumn("__key", key).dropDuplicates(["doc_id", "source", "__key"]).join(taken, same)
    return own.withColumn("__i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n")))).select(*docs.columns)
