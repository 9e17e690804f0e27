"""Long series in pieces of rows: exact row numbers without a window over a whole key, windows with a halo, and running aggregates.

A series of any length is cut into pieces of `size` rows in order of time. Row numbers come from the counts of time buckets (days, say):
a window over a key sees one row for each bucket, and rows are numbered inside their bucket. Then

- `by_pieces` applies functions with windows of a bounded reach: a piece also gets the rows that its windows reach into, which are
  dropped afterwards. Windows count rows, and so does the reach: gaps in time don't matter;
- `scan` makes running aggregates from a key's first row: each piece is summed up to one row, these are combined over the pieces before
  (a window with a row for each piece), and rows combine what came before their piece with what came before them in it.

Keys may be null. Rows of equal key and order are numbered in any order.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .windows import KEY, TS, col

#: Rows of a piece.
SIZE = 4096
RANK, PIECE = "__rank", "__piece"
_earlier = (Window.unboundedPreceding, -1)
_upto = (Window.unboundedPreceding, 0)


def bucket_of(df: DataFrame, x: str) -> Column:
    """Days of a time, SIZE-th parts of a number; other values are one bucket."""
    kind = df.select(x).schema[0].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.date_trunc("day", col(x))
    return F.floor(col(x) / SIZE) if isinstance(kind, T.NumericType) else F.lit(0)


def in_pieces(df: DataFrame, by: list[str] | None = None, order: list[str] | None = None, *, size: int = SIZE, bucket: Column | None = None) -> DataFrame:
    """Add __rank, the number of a row in its key's order (from 0), and __piece = __rank / size.

    bucket: a value that doesn't fall as rows go on, with no more rows in one of its values than a task takes; by default that of the
    first column of the order by bucket_of(). Rows that have __rank keep it.
    """
    if RANK in df.columns:
        return df.withColumn(PIECE, F.floor(F.col(RANK) / size))
    by, order = by or [KEY], order or [TS]
    own = df.withColumn("__by", F.struct(*by)).withColumn("__bucket", bucket_of(df, order[0]) if bucket is None else bucket)
    counts = own.groupBy("__by", "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("__by").orderBy("__bucket").rowsBetween(*_earlier)), F.lit(0))
    counts = counts.select(F.col("__by").alias("__b2"), F.col("__bucket").alias("__u2"), before.alias("__before"))
    here = F.row_number().over(Window.partitionBy("__by", "__bucket").orderBy(*order))
    out = own.withColumn("__here", here).join(counts, (F.col("__by") == F.col("__b2")) & F.col("__bucket").eqNullSafe(F.col("__u2")))
    rank = F.col("__before") + F.col("__here") - 1
    return out.select(*df.columns, rank.alias(RANK)).withColumn(PIECE, F.floor(F.col(RANK) / size))


def by_pieces(df: DataFrame, apply: Callable[[DataFrame], DataFrame], *, back: int = 0, ahead: int = 0, size: int = SIZE, bucket: Column | None = None) -> DataFrame:
    """apply(df), for functions whose windows over the key reach no further than `back` rows before a row and `ahead` after it.

    In what apply is given, the key is a struct of the key and the number of the piece.
    """
    if max(back, ahead) > size:
        raise ValueError("a piece has fewer rows than the windows reach")
    own = in_pieces(df, size=size, bucket=bucket)
    at = F.col(RANK) % size
    more = [F.when(at >= size - back, F.col(PIECE) + 1), F.when((at < ahead) & (F.col(PIECE) > 0), F.col(PIECE) - 1)]
    own = own.withColumn("whole_key", F.col(KEY)).withColumn("own_piece", F.col(PIECE)).withColumn("in_piece", F.explode(F.array_compact(F.array(PIECE, *more))))
    own = own.withColumn(KEY, F.struct(F.col("whole_key").alias("k"), F.col("in_piece").alias("p"))).drop(PIECE, *({RANK} - set(df.columns)))
    done = apply(own).filter("own_piece = in_piece")
    return done.withColumn(KEY, F.col("whole_key")).drop("whole_key", "own_piece", "in_piece")


class Running(NamedTuple):
    """A running aggregate: over a window in a piece, of a piece's rows as a whole, over a window of the pieces before (given the column
    of their wholes), and of both (what came before the piece, what is in it)."""

    inner: Callable[[WindowSpec], Column]
    whole: Column
    over: Callable[[Column, WindowSpec], Column]
    both: Callable[[Column, Column], Column]


def total(x: str | Column) -> Running:
    zero = lambda v: F.coalesce(v, F.lit(0))
    return Running(lambda w: F.sum(col(x)).over(w.rowsBetween(*_upto)), F.sum(col(x)), lambda v, w: F.sum(v).over(w), lambda a, b: zero(a) + zero(b))


def highest(x: str | Column) -> Running:
    return Running(lambda w: F.max(col(x)).over(w.rowsBetween(*_upto)), F.max(col(x)), lambda v, w: F.max(v).over(w), lambda a, b: F.greatest(a, b))


def latest(x: str | Column) -> Running:
    """The last value that isn't null, the row's own included."""
    known = F.when(col(x).isNotNull(), F.col(RANK))
    return Running(lambda w: F.last(col(x), True).over(w.rowsBetween(*_upto)), F.max_by(col(x), known), lambda v, w: F.last(v, True).over(w), lambda a, b: F.coalesce(b, a))


def previous(x: str | Column) -> Running:
    """The row before, null or not."""
    held = lambda w: F.struct(F.row_number().over(w).alias("i"), F.lag(col(x)).over(w).alias("v"))
    return Running(held, F.max_by(F.struct(col(x).alias("v")), RANK), lambda v, w: F.last(v).over(w), lambda a, b: F.when(b["i"] == 1, a["v"]).otherwise(b["v"]))


def scan(pieces: DataFrame, by: list[str] | None = None, **running: Running) -> DataFrame:
    """Add running aggregates to rows of in_pieces(), name -> Running."""
    by = by or [KEY]
    own = pieces.withColumn("__by", F.struct(*by))
    wholes = own.groupBy("__by", PIECE).agg(*(r.whole.alias(f"__w_{n}") for n, r in running.items()))
    earlier = Window.partitionBy("__by").orderBy(PIECE).rowsBetween(*_earlier)
    carried = wholes.select(F.col("__by").alias("__b2"), F.col(PIECE).alias("__p2"), *(r.over(F.col(f"__w_{n}"), earlier).alias(f"__c_{n}") for n, r in running.items()))
    inside = Window.partitionBy("__by", PIECE).orderBy(RANK)
    own = own.withColumns({f"__i_{n}": r.inner(inside) for n, r in running.items()})
    out = own.join(carried, (F.col("__by") == F.col("__b2")) & (F.col(PIECE) == F.col("__p2")))
    return out.select(*pieces.columns, *(r.both(F.col(f"__c_{n}"), F.col(f"__i_{n}")).alias(n) for n, r in running.items()))


def whole(df: DataFrame) -> DataFrame:
    return df.drop(RANK, PIECE)


def streaks(df: DataFrame, *, size: int = SIZE, **conditions: Column) -> DataFrame:
    """For each name=condition the length of the run of true that ends at the row, else 0; null counts as false."""
    flags = {f"__f_{n}": F.coalesce(x, F.lit(False)) for n, x in conditions.items()}
    own = scan(in_pieces(df.withColumns(flags), size=size), **{f"__s_{n}": latest(F.when(~F.col(f"__f_{n}"), F.col(RANK))) for n in conditions})
    run = lambda n: F.when(F.col(f"__f_{n}"), F.col(RANK) - F.coalesce(f"__s_{n}", F.lit(-1))).otherwise(0).cast("int")
    return own.withColumns({n: run(n) for n in conditions}).select(*df.columns, *conditions)


def since(df: DataFrame, *, size: int = SIZE, **conditions: Column) -> DataFrame:
    """For each name=condition the rows since it last held; null before it first does."""
    own = in_pieces(df.withColumns({f"__f_{n}": x for n, x in conditions.items()}), size=size)
    own = scan(own, **{f"__s_{n}": latest(F.when(F.col(f"__f_{n}"), F.col(RANK))) for n in conditions})
    return own.withColumns({n: (F.col(RANK) - F.col(f"__s_{n}")).cast("int") for n in conditions}).select(*df.columns, *conditions)


def paths(df: DataFrame, x: str | Column, by: list[str], order: list[str], *, size: int = SIZE, bucket: Column | None = None) -> DataFrame:
    """Add path, the running sum of x, and top, its highest value so far."""
    own = scan(in_pieces(df, by, order, size=size, bucket=bucket), by, path=total(x))
    return scan(own, by, top=highest("path")).select(*df.columns, "path", "top")

