"""Chat formatting: logged snapshots that prefix a longer conversation collapse into it, the rest is rendered.

A conversation is its turns in order of turn number (null numbers last, then role and a hash of the text). Each prefix has a
rolling hash: the XOR of 128 bits of (position, role, text) of its turns, so that the hash of every prefix is a running
aggregate. A conversation whose whole hash and length equal a proper prefix of another one goes, and of equal
conversations the one with the smallest id stays. Hashes are made distinct before the anti-join, so that an opening that a
third of all conversations share is one row on either side.

Cases: null role or text counts as empty; rows with null conversation id form one conversation; repeated rows are
repeated turns; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Turns of a chunk; the positions and hashes of very long conversations are summed up over chunks.
CHUNK = 512


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|im_start|>"), role, F.lit("\n"), text, F.lit("<|im_end|>\n"))


def _turns(conversations: DataFrame) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    number = F.coalesce(F.col("turn").cast("long"), F.lit((1 << 62)))
    return conversations.select(F.col("conv_id").alias("conv"), number.alias("turn"), text("role").alias("role"), text("text").alias("text"))


def prefixes(conversations: DataFrame) -> DataFrame:
    """(conv, n, h1, h2, total) for every turn: length and hash of the prefix that ends there, and the turns in all."""
    turns = _turns(conversations).withColumn("chunk", F.floor(F.col("turn") / CHUNK))
    turns = turns.select("conv", "chunk", "turn", "role", F.sha2("text", 256).alias("body"))
    in_chunk = Window.partitionBy("conv", "chunk").orderBy("turn", "role", "body")
    per_chunk = turns.groupBy("conv", "chunk").agg(F.count(F.lit(1)).alias("size"))
    of_conv = Window.partitionBy("conv").orderBy("chunk")
    before = per_chunk.select(F.col("conv").alias("c"), F.col("chunk").alias("k"), (F.sum("size").over(of_conv) - F.col("size")).alias("before"), F.sum("size").over(Window.partitionBy("conv")).alias("total"))
    placed = turns.withColumn("at", F.row_number().over(in_chunk)).join(before, F.col("conv").eqNullSafe(F.col("c")) & (F.col("chunk") == F.col("k")))
    placed = placed.select("conv", "chunk", (F.col("at") + F.col("before")).alias("n"), "total", "role", "body")
    h = [F.xxhash64(F.col("n"), F.col("role"), F.col("body"), F.lit(salt)) for salt in ("a", "b")]
    hashed = placed.select("conv", "chunk", "n", "total", h[0].alias("h1"), h[1].alias("h2"))
    sums = hashed.groupBy("conv", "chunk").agg(F.bit_xor("h1").alias("x1"), F.bit_xor("h2").alias("x2"))
    earlier = of_conv.rowsBetween(Window.unboundedPreceding, -1)
    carry = sums.select(F.col("conv").alias("c"), F.col("chunk").alias("k"), *(F.coalesce(F.bit_xor(f"x{i}").over(earlier), F.lit(0)).alias(f"c{i}") for i in (1, 2)))
    running = Window.partitionBy("conv", "chunk").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    own = hashed.select("conv", "chunk", "n", "total", *(F.bit_xor(f"h{i}").over(running).alias(f"h{i}") for i in (1, 2)))
    own = own.join(carry, F.col("conv").eqNullSafe(F.col("c")) & (F.col("chunk") == F.col("k")))
    return own.select("conv", "n", *(F.col(f"h{i}").bitwiseXOR(F.col(f"c{i}")).alias(f"h{i}") for i in (1, 2)), "total")


def maximal(conversations: DataFrame) -> DataFrame:
    """(conv, n_same): the conversations that stay, and how many logged ones are equal to each, itself included."""
    every = prefixes(conversations)
    whole = every.filter("n = total").groupBy("n", "h1", "h2").agg(F.min(F.struct(F.col("conv").isNull(), F.col("conv").alias("conv"))).alias("m"), F.count(F.lit(1)).alias("n_same"))
    proper = every.filter("n < total").select("n", "h1", "h2").distinct()
    return whole.join(proper, ["n", "h1", "h2"], "left_anti").select(F.col("m.conv").alias("conv"), "n_same")


def collapse(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_same, rendered) of the maximal conversations."""
    stay = maximal(conversations).select(F.col("conv").alias("__c"), "n_same")
    own = _turns(conversations).join(stay, F.col("conv").eqNullSafe(F.col("__c")))
    parts = F.sort_array(F.collect_list(F.struct("turn", "role", F.sha2("text", 256).alias("body"), "text")))
    joined = F.array_join(F.transform(parts, lambda t: render(t["role"], t["text"])), "")
    return own.groupBy("conv").agg(F.count(F.lit(1)).alias("n_turns"), F.min("n_same").alias("n_same"), joined.alias("rendered")).withColumnRenamed("conv", "conv_id")
