"""Near-duplicates by bottom-k sketches of one hash function.

A document's set is its distinct 5-word shingles. Documents are linked if 100 * intersection >= 75 * union; those that
links connect form a component.

1. One pass over the texts gives each document the size and a digest of its set, and the head of its sketch, which is the K
   smallest shingle hashes. Equal sets form a class, of which the smallest id goes on.
2. Linked sets share at least need(n) retained values: for sets that their sketches hold whole, three quarters of n; else
   three quarters of K less six standard deviations. So they share at least some(n) of the smallest kept - need + some, the head.
   Heads are range-partitioned and sorted by (value, document), which splits a value of any frequency over tasks, and a class
   with fewer values beside another document's goes. For the rest, the full sets are written.
   Inverted lists: a class with fewer than need values that another one has, too, has no partner, and any other one needs
   lists only of its shared - need + 1 rarest values to meet every partner on one of them: text that many documents hold has
   no lists.
3. In each list all members are compared with one, its pivot: the member with the largest share of shared values, which in a
   group of copies is their original. What is linked becomes one component. A list is never expanded into all its pairs.
4. Members of one pivot that lie in different components are paired where their intersections with the pivot, their sizes
   and what they share outside of it allow a link; partners that share a list share its pivot, so none is left out.
5. A pair is dropped if the sketch of the union puts it six standard deviations below 75 %, and otherwise confirmed on the
   full sets.

Cases: null, empty and blank texts have empty sets, are linked with nothing and keep themselves; fewer than 5 words make
one shingle; ids are taken to be unique, repeated rows with one id and text are one node and rejected or kept alike; rows with null ids have their
set's size, null components and are kept; very long texts are worked on by themselves; other columns play no part; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, materialize, partitions, parts
from .hashing import hashed, mixed, sums_of

K, SHINGLE, PERCENT = 256, 5, 75
#: Shared retained values of linked sets, at least, where sketches don't hold the sets whole.
LEAST_SHARED = math.floor(K * PERCENT / 100 - 6 * math.sqrt(K * PERCENT / 100 * (1 - PERCENT / 100)))
#: One in so many of the values that linked sets share is looked for in their heads.
SOME = 8
#: Standard deviations that bounds from samples leave.
DEVIATIONS = 4.5


def shingles(h: np.ndarray) -> np.ndarray:
    """The set of a text's word hashes as sorted 64-bit hashes."""
    if not h.size:
        return np.zeros(0, np.int64)
    n = min(SHINGLE, h.size)
    return np.unique(mixed(sums_of(h, n), n).view(np.int64))


def head(n: int) -> int:
    """How many of a sketch's smallest values linked sets share some(n) of."""
    least = min(-(-n * PERCENT // 100), LEAST_SHARED)
    return min(n, K) - least + max(1, least // SOME)


def _heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in parts(batches):
        sets = list(map(shingles, hashed(list(b["text"]))))
        digests = [hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest() if s.size else None for s in sets]
        yield pd.DataFrame({"doc_id": b["doc_id"], "n": [s.size for s in sets], "digest": digests, "head": [s[: head(s.size)] if s.size else s for s in sets]})


def _sizes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in parts(batches):
        yield pd.DataFrame({"n_shingles": [shingles(h).size for h in hashed(list(b["text"]))]})


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in parts(batches):
        yield pd.DataFrame({"doc_id": b["doc_id"], "members": list(map(shingles, hashed(list(b["text"]))))})


def _beside(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(doc, hits): rows of sorted (value, doc) whose value another document has, too. A partition's first and last rows count,
    whatever their neighbours in the next one are, which keeps a document too many at most."""
    last, flag = np.zeros((0, 2), np.int64), True  # the row that waits for its next one, and whether it counts already
    for b in batches:
        if not len(b):
            continue
        x = np.concatenate([last, np.stack([b["value"].to_numpy(np.int64), b["doc"].to_numpy(np.int64)], 1)])
        same = (x[1:, 0] == x[:-1, 0]) & (x[1:, 1] != x[:-1, 1])
        flags = np.append(flag, same)
        docs, hits = np.unique(x[:-1, 1][flags[:-1] | same], return_counts=True)
        yield pd.DataFrame({"doc": docs, "hits": hits})
        last, flag = x[-1:], bool(flags[-1])
    if len(last):
        yield pd.DataFrame({"doc": last[:, 1], "hits": np.ones(1, np.int64)})


def need() -> Column:
    return F.least(F.ceil(F.col("n") * PERCENT / 100), F.lit(LEAST_SHARED)).cast("int")


def some() -> Column:
    return F.greatest(F.floor(need() / SOME), F.lit(1))


def candidates(heads: DataFrame) -> DataFrame:
    """(w): the classes (doc_id, n, head) of which enough values in the head are another one's, too."""
    order = ("value", "doc")
    values = heads.select(F.explode("head").alias("value"), F.col("doc_id").alias("doc"))  # half of K for each class, about
    placed = values.repartitionByRange(partitions(heads.sparkSession), *order).sortWithinPartitions(*order)
    hits = placed.mapInPandas(_beside, "doc long, hits long").groupBy("doc").agg(F.sum("hits").alias("hits"))
    met = heads.select("doc_id", "n").join(hits, F.col("doc_id") == F.col("doc")).filter(F.col("hits") >= some())
    return met.select(F.col("doc_id").alias("w")).distinct()


def lists(sets: DataFrame) -> DataFrame:
    """(value, doc, n, shared): the inverted lists that pairs must meet on, of values that two classes have at least."""
    values = sets.select(F.col("doc_id").alias("doc"), F.size("members").alias("n"), F.explode(F.slice("members", 1, K)).alias("value"))
    known = values.groupBy("value").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    common = values.join(known.withColumnRenamed("value", "v"), F.col("value") == F.col("v"))
    each = common.groupBy("doc", "n").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("c"))  # K values at most
    each = each.withColumn("shared", F.size("c")).filter(F.col("shared") >= need())
    return each.select("doc", "n", "shared", F.explode(F.slice("c", F.lit(1), F.col("shared") - need() + 1)).alias("x")).select("x.value", "doc", "n", "shared")


def pivots(posted: DataFrame) -> DataFrame:
    """(a, n, shared, b): every member of a list with the list's pivot, which is a member of itself."""
    rank = F.struct((F.col("shared") / F.least("n", F.lit(K))).alias("share"), (-F.col("doc")).alias("first"))
    central = posted.groupBy("value").agg(F.max_by("doc", rank).alias("b"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    met = posted.join(central.withColumnRenamed("value", "v"), F.col("value") == F.col("v"))
    return met.select(F.col("doc").alias("a"), "n", "shared", "b").distinct()


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Add what pairs (a, b) have in common: first the union's sketch, then, where it allows a link, the full sets.

    seen: members of both sketches; common: of both sets; linked: 75 % or more, tried only if the sketches allow it.
    """
    left = sets.select(F.col("doc_id").alias("x"), F.col("members").alias("p"))
    right = sets.select(F.col("doc_id").alias("y"), F.col("members").alias("q"))
    both = pairs.join(left, F.col("a") == F.col("x")).join(right, F.col("b") == F.col("y"))
    pk, qk = F.slice("p", 1, K), F.slice("q", 1, K)
    union = F.slice(F.sort_array(F.array_union(pk, qk)), 1, K)
    near = F.size(F.array_intersect(union, F.array_intersect(pk, qk)))
    floor = F.when(F.size(union) < K, F.ceil(F.size(union) * PERCENT / 100)).otherwise(F.lit(LEAST_SHARED))
    common = F.size(F.array_intersect("p", "q"))
    linked = F.when(near >= floor, common * 100 >= (F.size("p") + F.size("q") - common) * PERCENT).otherwise(F.lit(False))
    return both.select(*pairs.columns, F.size(F.array_intersect(pk, qk)).alias("seen"), common.alias("common"), linked.alias("linked"))


def across(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(a, b): members of one pivot that lie in different components and may be linked.

    For sets a and b and a pivot p, |a & b| is at most min(|a & p|, |b & p|) plus what they share outside of p. For that, a
    set that its sketch holds whole has its shared values outside of p; of others the larger one's sketch has a sample, and
    its count is taken DEVIATIONS above what was seen. A link needs 7 |a & b| >= 3 (|a| + |b|).
    """
    named = members.join(labels, F.col("a") == F.col("node"), "left").withColumn("c", F.coalesce("component", "a")).drop("node", "component")
    mixed = named.groupBy("b").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi").select(F.col("b").alias("v"))
    # Written, so that a hot pivot's members lie in many partitions again and the join may split them.
    named = materialize(named.join(mixed, F.col("b") == F.col("v"), "left_semi"), "named")
    step = lambda x: F.floor(F.log(x.cast("double")) / math.log(1.05)).cast("int")
    n, seen = F.col("n"), F.greatest(F.col("shared") - F.col("seen"), F.lit(0))
    sampled = F.ceil((seen + DEVIATIONS * F.sqrt(seen + 1.0) + DEVIATIONS**2 / 2) * n / K)
    outside = n - F.col("common")
    other = F.least(F.when(n <= K, seen).otherwise(sampled), outside).cast("int")
    a = named.filter("n > 0").select(F.col("b").alias("pivot"), "a", n.alias("na"), F.col("c").alias("ca"), F.col("common").alias("pa"), other.alias("oa"), F.explode(F.sequence(step(F.ceil(n * PERCENT / 100)), step(n))).alias("bucket"))
    b = named.filter("n > 0").select(F.col("b").alias("v"), F.col("a").alias("b"), n.alias("nb"), F.col("c").alias("cb"), F.col("common").alias("pb"), F.least(seen, outside).alias("ob"), outside.alias("xb"), step(n).alias("s"))
    fits = (F.col("pivot") == F.col("v")) & (F.col("bucket") == F.col("s")) & (F.col("ca") != F.col("cb"))
    fits &= (F.col("nb") < F.col("na")) | ((F.col("nb") == F.col("na")) & (F.col("b") < F.col("a")))
    # The smaller set's count holds only if the larger one's sketch is whole, too.
    apart = F.least(F.col("oa"), F.when(F.col("na") <= K, F.col("ob")).otherwise(F.col("xb")))
    fits &= 7 * (F.least("pa", "pb") + apart) >= 3 * (F.col("na") + F.col("nb"))
    return a.join(b, fits).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    given = own.filter("doc_id is not null")
    sketched = materialize(given.mapInPandas(_heads, "doc_id long, n int, digest string, head array<long>"), "heads")
    first = materialize(sketched.filter("n > 0").groupBy("digest").agg(F.min("doc_id").alias("rep")), "classes")
    # Heads aren't shuffled for this while the copies' ids are few: a small file of ids is broadcast by its size, a
    # large one sorted and merged.
    named = sketched.select("doc_id", "digest").join(first.withColumnRenamed("digest", "d"), F.col("digest") == F.col("d"))
    copies = materialize(named.filter("doc_id <> rep").select(F.col("doc_id").alias("copy")).distinct(), "copies")
    classes = sketched.filter("n > 0").join(copies, F.col("doc_id") == F.col("copy"), "left_anti").select("doc_id", "n", "head")
    wanted = materialize(candidates(classes), "wanted")
    texts = given.join(wanted, F.col("doc_id") == F.col("w"), "left_semi")
    sets = materialize(texts.mapInPandas(_sets, "doc_id long, members array<long>").dropDuplicates(["doc_id"]), "sets")
    posted = materialize(lists(sets), "lists")
    members = materialize(compared(pivots(posted), sets), "members")
    star = members.filter("linked and a <> b").select("a", "b")
    rest = materialize(compared(across(members, components(star)), sets).filter("linked").select("a", "b"), "rest")
    labels = components(star.unionByName(rest))
    to = first.join(labels, F.col("rep") == F.col("node"), "left").select(F.col("digest").alias("d"), F.coalesce("component", "rep").alias("component_id"))
    done = sketched.join(to, F.col("digest") == F.col("d"), "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    done = done.withColumn("kept", F.col("doc_id") == F.col("component_id"))
    nulls = own.filter("doc_id is null").select("text").mapInPandas(_sizes, "n_shingles long")
    return done.unionByName(nulls.select(F.lit(None).cast("long").alias("doc_id"), "n_shingles", F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept")))
