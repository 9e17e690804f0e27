"""Trades that don't overlap, chosen over pieces of a series at once.

The choice is greedy: in order of entry, a trade is taken if the one taken before is out. Where a trader is free after a trade, the
next entry is a successor that a binary search finds, so that inside a piece of bars every entry has a chain of successors; pointers
that double in length find where each chain leaves the piece. Of a piece only the entries that a chain from an earlier piece can reach
first (no further than the longest trade from its start) and where they lead go on. These are followed from piece to piece, a row for
each piece, and then every piece marks the chain that it is entered by. No task sees the entries of a whole key.

Entries without entry or exit are never taken, and an exit before the entry counts as the entry itself. Of equal entries the one with the
earliest exit comes first, then a hash of the row settles it. Keys may be null.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

c = F.col
#: Bars of a piece.
SIZE = 4096
_never = -(1 << 62)


def _prepared(own: pd.DataFrame, most: bool) -> pd.DataFrame:
    """Rows in order; most: without trades that contain another one, so that the chain takes as many trades as possible."""
    # Rows come with at, exit_at and a number that settles ties.
    own = own.sort_values(["__at", "__exit", "__tie"], kind="stable").reset_index(drop=True)
    if most and len(own):
        own = own.drop_duplicates("__at")
        out = own["__exit"].to_numpy(np.int64)
        later = np.append(np.minimum.accumulate(out[::-1])[::-1][1:], 1 << 62)
        own = own[out < later].reset_index(drop=True)
    return own


def _chains(own: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(entries, exits, each one's successor or the number of entries, the last of each one's chain)."""
    at, out = own["__at"].to_numpy(np.int64), own["__exit"].to_numpy(np.int64)
    after = np.searchsorted(at, out, "right")
    last = np.where(after < at.size, after, np.arange(at.size))
    while True:
        further = last[last]
        if (further == last).all():
            return at, out, after, last
        last = further


def non_overlapping(entries: DataFrame, by: tuple[str, ...] = ("key", "config"), *, size: int = SIZE, most: bool = False) -> DataFrame:
    """Of rows (by..., at, exit_at, ...), those that a trader takes who is in one trade at a time.

    most: takes as many as possible by leaving out trades that contain another one.
    """
    by, names = list(by), entries.columns
    rows = entries.filter(c("at").isNotNull() & c("exit_at").isNotNull())
    rows = rows.withColumns({"__at": c("at").cast("long"), "__exit": F.greatest(c("exit_at"), c("at")).cast("long")})
    rows = rows.withColumn("__tie", F.xxhash64(F.to_json(F.struct(*names))))
    longest = rows.agg(F.coalesce(F.max(c("__exit") - c("__at")), F.lit(0)).alias("__h"))  # one row
    rows = rows.join(longest).withColumn("__piece", F.floor(c("__at") / size))
    first = F.floor((c("__at") - c("__h")) / size) if most else c("__piece")  # what comes right after a piece can rule out its last trades
    rows = rows.withColumn("__in", F.explode(F.sequence(first, c("__piece"))))
    group = [*by, "__in"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in entries.select(*by).schema)

    def ends(own: pd.DataFrame) -> pd.DataFrame:
        piece, reach = int(own["__in"].iloc[0]), int(own["__h"].iloc[0])
        part = _prepared(own, most)
        part = part[part["__piece"] == piece]
        at, out, _, last = _chains(part)
        new = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if at.size else np.zeros(0, np.int64)
        new = new[: int(np.searchsorted(at[new], piece * size + reach, "right")) + 1]
        one = own.iloc[[0]][by].reset_index(drop=True)
        return one.assign(__in=piece, starts=[at[new].tolist()], ends=[out[last[new]].tolist()])

    def followed(pieces: pd.DataFrame) -> pd.DataFrame:
        free, entered = _never, []
        pieces = pieces.sort_values("__in")
        for starts, out in zip(pieces["starts"], pieces["ends"]):
            entered.append(free)
            i = int(np.searchsorted(np.asarray(starts), free, "right")) if len(starts) else 0
            free = int(out[i]) if i < len(starts) else free
        return pieces[[*by, "__in"]].assign(__free=entered)

    def marked(own: pd.DataFrame) -> pd.DataFrame:
        piece, free = int(own["__in"].iloc[0]), int(own["__free"].iloc[0])
        part = _prepared(own, most)
        part = part[part["__piece"] == piece].reset_index(drop=True)
        at, _, after, _ = _chains(part)
        taken, i = [], int(np.searchsorted(at, free, "right"))
        while i < at.size:
            taken.append(i)
            i = int(after[i])
        return part.iloc[taken][names]

    summaries = rows.groupBy(*group).applyInPandas(ends, f"{kinds}, __in long, starts array<long>, ends array<long>")
    state = summaries.groupBy(*by).applyInPandas(followed, f"{kinds}, __in long, __free long")  # a row for each piece
    state = state.select(*(c(b).alias(f"__{b}") for b in by), c("__in").alias("__i2"), "__free")
    same = reduce(lambda a, b: a & b, [c(b).eqNullSafe(c(f"__{b}")) for b in by], c("__in") == c("__i2"))
    whole = rows.join(state, same).drop(*(f"__{b}" for b in by), "__i2")
    return whole.groupBy(*group).applyInPandas(marked, entries.schema)


def random_trades(entries: DataFrame, counts: DataFrame, seed: int = 1, size: int = SIZE) -> DataFrame:
    """Random trades that don't overlap, as many for each key as `counts` (key, n) asks, of entries (key, at, exit_at, ...).

    Entries are drawn at shares of 1, 1/2, 1/4, ... by one hash, each draw holding the smaller ones, and of each draw as many trades are
    chosen as don't overlap. A key takes the smallest draw that gives n, and of its trades the n with the smallest second
    hash; only a key in which n trades without overlap don't exist gives fewer. All draws together have two rows for each entry.
    """
    names = entries.columns
    own = entries.join(counts.select(c("key").alias("__k"), c("n").alias("__n")), c("key").eqNullSafe(c("__k"))).drop("__k")
    draw = lambda salt: F.xxhash64(F.lit(seed), F.lit(salt), "key", "at")
    share = (F.pmod(draw(0), F.lit(1 << 40)) + 1) / float(1 << 40)
    own = own.withColumn("__draw", F.explode(F.sequence(F.lit(0), F.floor(-F.log2(share)).cast("int"))))
    apart = non_overlapping(own, ("key", "__draw"), size=size, most=True)
    found = apart.groupBy("key", "__draw").agg((F.count(F.lit(1)) >= F.max("__n")).alias("enough"))
    best = found.groupBy("key").agg(F.coalesce(F.max(F.when(c("enough"), c("__draw"))), F.lit(0)).alias("__best"))
    best = best.select(c("key").alias("__k"), "__best")
    kept = apart.join(best, c("key").eqNullSafe(c("__k")) & (c("__draw") == c("__best")))
    place = F.row_number().over(Window.partitionBy("key").orderBy(draw(1), "at"))  # over about n rows
    return kept.withColumn("__r", place).filter(c("__r") <= c("__n")).select(*names)
