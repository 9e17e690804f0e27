"""Forward-looking labels: barrier outcomes and excursions. For trades that don't overlap see chains.

For barriers, the running extremes of the bars ahead of each row are laid out once, for the longest horizon; they are sorted, so
that the first bar that reaches a level is the level's place among them, for each distinct level of a grid of take-profit,
stop and horizon."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions import windows as w

c = F.col


def _ahead(df: DataFrame, hold: int) -> DataFrame:
    window = w.forward(hold)
    return df.withColumns({f"__{x}s": F.collect_list(x).over(window) for x in ("high", "low", "close")})


def first_at(levels: Column, level: Column, above: bool) -> Column:
    """Position (from 1) of the first value at or beyond the level; 0 if there is none."""
    return F.array_position(F.transform(levels, (lambda v: v >= level) if above else (lambda v: v <= level)), F.lit(True))


#: Rows for which running extremes are laid out at once.
ROWS = 4096


def _reached(highs: np.ndarray, lows: np.ndarray, closes: np.ndarray, ahead: np.ndarray, rows: int, up: list[float], down: list[float], hold: int) -> tuple[np.ndarray, np.ndarray]:
    """For the first rows: the bar (from 1) at which the running maximum of the highs ahead has come to close + up, and the running
    minimum of the lows to close - down; 0 where it doesn't within the bars ahead (at most hold)."""
    above, below = np.zeros((rows, len(up)), np.int32), np.zeros((rows, len(down)), np.int32)
    step = np.arange(1, hold + 1)
    for lo in range(0, rows, ROWS):
        hi = min(rows, lo + ROWS)
        at, known = np.arange(lo, hi)[:, None] + step, step <= ahead[lo:hi, None]
        at = np.minimum(at, highs.size - 1)
        for out, values, worst, extreme, levels, sign in ((above, highs, -np.inf, np.maximum, up, 1), (below, lows, np.inf, np.minimum, down, -1)):
            run = extreme.accumulate(np.where(known & ~np.isnan(values[at]), values[at], worst), axis=1) if hold else np.zeros((hi - lo, 0))
            for k, x in enumerate(levels):
                # A sorted row: the level's place in it is the number of values that don't come to it.
                level = (closes[lo:hi] + sign * x)[:, None]
                place = (run < level).sum(axis=1) if sign > 0 else (run > level).sum(axis=1)
                out[lo:hi, k] = np.where((place < hold) & np.isfinite(level[:, 0]), place + 1, 0)
    return above, below


REASONS = ("insufficient_data", "tp_hit", "sl_hit", "timeout")


def _outcomes(tp_at: np.ndarray, sl_at: np.ndarray, ahead: np.ndarray, hold: int, tie: str) -> np.ndarray:
    """The place of the reason in REASONS, and four times the bar of the exit (from 1)."""
    tp, sl = (tp_at > 0) & (tp_at <= hold), (sl_at > 0) & (sl_at <= hold)
    first = tp & (~sl | ((tp_at <= sl_at) if tie == "tp" else (tp_at < sl_at)))
    found = np.where(first, 1 + 4 * tp_at, np.where(sl, 2 + 4 * sl_at, 3 + 4 * hold))
    return np.where(ahead >= hold, found, 0).astype(np.int32)


def outcomes(df: DataFrame, configs: list[tuple[float, float, int]], short: bool, tie: str) -> DataFrame:
    """Add __found, of each configuration what _outcomes() gives, and __final, the close each of the horizons (sorted) ahead.

    Rows are dealt by key, sorted by time and streamed: what waits for bars ahead is no more than the longest horizon's rows. A configuration is
    a few comparisons of the bars at which its two levels are reached. Missing prices reach nothing.
    """
    tps, sls, holds = (sorted({x[i] for x in configs}) for i in range(3))
    up, down, hold = (sls, tps, holds[-1]) if short else (tps, sls, holds[-1])
    more = T.StructType().add("__found", T.ArrayType(T.IntegerType())).add("__final", T.ArrayType(T.DoubleType()))
    lists = lambda m, kind: pa.FixedSizeListArray.from_arrays(pa.array(m.ravel(), kind), m.shape[1]).cast(pa.list_(kind))

    def made(table: pa.Table, keys: np.ndarray, rows: int) -> Iterator[pa.RecordBatch]:
        """Results of the first rows; the table goes on to the end of their keys or `hold` rows further."""
        highs, lows, closes = (np.asarray(table.column(x).cast(pa.float64()).fill_null(float("nan"))) for x in ("high", "low", "close"))
        ends = np.append(np.flatnonzero(keys[1:] != keys[:-1]) + 1, keys.size)
        at = np.arange(rows)
        ahead = np.minimum(hold, ends[np.searchsorted(ends, at, "right")] - at - 1)
        above, below = _reached(highs, lows, closes, ahead, rows, up, down, hold)
        tp_at, sl_at = (below, above) if short else (above, below)
        found = np.column_stack([_outcomes(tp_at[:, tps.index(t)], sl_at[:, sls.index(s)], ahead, h, tie) for t, s, h in configs])
        final = np.column_stack([np.where(h <= ahead, closes[np.minimum(at + h, closes.size - 1)], np.nan) for h in holds])
        out = table.slice(0, rows).drop_columns(["__key"])
        for f, x in zip(more, (lists(found, pa.int32()), lists(final, pa.float64()))):
            out = out.append_column(f.name, x)
        yield from out.combine_chunks().to_batches(ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None
        for batch in batches:
            new = pa.Table.from_batches([batch])
            waiting = pa.concat_tables([waiting, new]).combine_chunks() if waiting is not None else new
            keys = waiting.column("__key").combine_chunks().to_numpy(zero_copy_only=False)
            last = keys.size - int(np.argmax(np.append(keys[::-1] != keys[-1], True)))
            rows = max(last, keys.size - hold)  # whole keys, and what has all bars ahead
            if rows > 0:
                yield from made(waiting, keys, rows)
                waiting = waiting.slice(rows)
        if waiting is not None and waiting.num_rows:
            yield from made(waiting, waiting.column("__key").combine_chunks().to_numpy(zero_copy_only=False), waiting.num_rows)

    own = df.withColumn("__key", F.to_json(F.struct(w.KEY))).repartition("__key").sortWithinPartitions("__key", w.TS)
    return own.mapInArrow(run, T.StructType([*df.schema.fields, *more.fields]))


def _named(found: Column, tp: Column, sl: Column, final: Column, entry: Column, sign: int, timeout: str) -> list[Column]:
    """label, reason, exit_bar and pips of a configuration."""
    code, marked = found.bitwiseAND(F.lit(3)), (final - entry) * sign
    won = code == 1
    if timeout == "mark":
        won = won | ((code == 3) & (marked > 0))
    pips = F.when(code == 1, tp).when(code == 2, -sl).when(code == 3, marked)
    reason = F.element_at(F.array(*map(F.lit, REASONS)), code + 1)
    return [F.coalesce(won, F.lit(False)).cast("int").alias("label"), reason.alias("reason"), F.when(code > 0, F.shiftright(found, 2)).alias("exit_bar"), pips.alias("pips")]


def barrier(df: DataFrame, tp: float, sl: float, hold: int, *, direction: str = "short", tie: str = "sl", timeout: str = "loss") -> DataFrame:
    """Add label, reason, exit_bar and pips. tie: which barrier wins on one bar; timeout: loss, or mark to the last close.
    A row with fewer than `hold` bars ahead is insufficient_data, even if a barrier is hit."""
    short = direction == "short"
    out = outcomes(df, [(tp, sl, hold)], short, tie)
    return out.select(*df.columns, *_named(F.element_at("__found", 1), F.lit(float(tp)), F.lit(float(sl)), F.element_at("__final", 1), c("close"), -1 if short else 1, timeout))


def grid(tps: list[float], sls: list[float], holds: list[int]) -> list[tuple[float, float, int]]:
    return [(t, s, h) for t in tps for s in sls for h in holds]


def barrier_grid(df: DataFrame, configs: list[tuple[float, float, int]], *, direction: str = "short", tie: str = "sl", timeout: str = "loss", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, ts, keep..., tp, sl, hold, label, reason, exit_bar, pips) for every row and configuration."""
    short, holds = direction == "short", sorted({h for *_, h in configs})
    out = outcomes(df.select("key", "ts", *keep, "high", "low", "close"), configs, short, tie)
    out = out.select("key", "ts", *keep, "close", "__final", F.posexplode("__found").alias("i", "found"))
    of = lambda values: F.element_at(F.array(*map(F.lit, values)), c("i") + 1)
    tp, sl, hold = (of([float(t) for t, _, _ in configs]), of([float(s) for _, s, _ in configs]), of([h for *_, h in configs]))
    out = out.select("key", "ts", *keep, tp.alias("tp"), sl.alias("sl"), hold.alias("hold"), "close", "found", F.element_at("__final", of([holds.index(h) + 1 for *_, h in configs])).alias("final"))
    return out.select("key", "ts", *keep, "tp", "sl", "hold", *_named(c("found"), c("tp"), c("sl"), c("final"), c("close"), -1 if short else 1, timeout))


def config_id() -> Column:
    whole = lambda x: F.col(x).cast("int").cast("string")
    return F.concat(F.lit("TP"), whole("tp"), F.lit("_SL"), whole("sl"), F.lit("_H"), whole("hold"))


def label_statistics(labels: DataFrame) -> DataFrame:
    """(tp, sl, hold, n, wins, win_rate, counts of reasons, imbalance)."""
    valid = F.col("reason") != "insufficient_data"
    out = labels.groupBy("tp", "sl", "hold").agg(F.count_if(valid).alias("n"), F.sum("label").alias("wins"), *(F.count_if(F.col("reason") == r).alias(f"n_{r}") for r in ("tp_hit", "sl_hit", "timeout", "insufficient_data")))
    return out.withColumns({"win_rate": F.try_divide("wins", "n"), "imbalance": F.try_divide(F.greatest(F.col("wins"), F.col("n") - F.col("wins")).cast("double"), F.least(F.col("wins"), F.col("n") - F.col("wins")))})


def excursions(df: DataFrame, horizons: list[int]) -> DataFrame:
    """Add mfe_h, mae_h and final_h in price units for a short entry at the close; null without h bars ahead."""
    out = {}
    for h in horizons:
        whole = F.count("close").over(w.forward(h)) == h
        out[f"mfe_{h}"] = F.when(whole, c("close") - F.min("low").over(w.forward(h)))
        out[f"mae_{h}"] = F.when(whole, F.max("high").over(w.forward(h)) - c("close"))
        out[f"final_{h}"] = F.when(whole, c("close") - F.lead("close", h).over(w.order()))
    return df.withColumns(out)


def excursion_in_atr(df: DataFrame, horizon: int = 48) -> DataFrame:
    """Add mfe_short_atr and mfe_long_atr."""
    whole = F.count("close").over(w.forward(horizon)) == horizon
    short, long = c("close") - F.min("low").over(w.forward(horizon)), F.max("high").over(w.forward(horizon)) - c("close")
    return df.withColumns({"mfe_short_atr": F.when(whole, F.try_divide(short, c("atr"))), "mfe_long_atr": F.when(whole, F.try_divide(long, c("atr")))})


def multi_target(df: DataFrame, targets: list[float], hold: int, safe: float, fast: int = 12, clean: float = 1.5) -> DataFrame:
    """Bars to each target (short), reached flags, safe ones (stop `safe` not hit before), excursions and their ratio; for the
    first target also whether it is reached within `fast` bars, and clean_winner: with a ratio of more than `clean`."""
    out = _ahead(df, hold)
    stop = first_at(c("__highs"), c("close") + safe, True)
    out = out.withColumns({"__stop": stop} | {f"bars_to_{t:g}": F.nullif(first_at(c("__lows"), c("close") - t, False), F.lit(0)).cast("int") for t in targets})
    whole = F.size("__closes") == hold
    flags = {f"reached_{t:g}": F.when(whole, w.flag(c(f"bars_to_{t:g}").isNotNull())) for t in targets}
    flags |= {f"safe_{t:g}": F.when(whole, w.flag(c(f"bars_to_{t:g}").isNotNull() & ((c("__stop") == 0) | (c(f"bars_to_{t:g}") < c("__stop"))))) for t in targets}
    mfe, mae = c("close") - F.array_min("__lows"), F.array_max("__highs") - c("close")
    ratio = F.try_divide(mfe, mae)
    flags |= {"mfe": F.when(whole, mfe), "mae": F.when(whole, mae), "mfe_mae_ratio": F.when(whole, ratio)}
    flags |= {f"fast_{targets[0]:g}": F.when(whole, w.flag(c(f"bars_to_{targets[0]:g}") <= fast)), "clean_winner": F.when(whole, w.flag((mfe >= targets[0]) & (ratio > clean)))}
    return out.withColumns(flags).drop("__highs", "__lows", "__closes", "__stop")


def random_entries(df: DataFrame, share: float, seed: int = 1) -> DataFrame:
    """A repeatable random choice of rows, as a baseline for signals."""
    return df.filter(F.pmod(F.xxhash64(F.lit(seed), "key", "ts"), F.lit(1_000_000)) < int(share * 1_000_000))


def label_summary(df: DataFrame, targets: list[float], signal: Column | None = None) -> DataFrame:
    """One row over rows of multi_target(): counts, shares that reach each target, mean excursions, share of clean ones.
    signal: the rows that count as signals, by default those near the upper band. Rows without enough bars ahead count as rows only."""
    first = f"{targets[0]:g}"
    share = lambda x: F.avg(c(x).cast("double"))
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(c("bb_position") >= 0.95 if signal is None else signal).alias("n_signals"),
        *(share(f"reached_{t:g}").alias(f"prob_{t:g}") for t in targets), F.avg("mfe").alias("avg_mfe"), F.avg("mae").alias("avg_mae"),
        F.avg("mfe_mae_ratio").alias("avg_mfe_mae_ratio"), share(f"bars_to_{first}").alias(f"avg_bars_to_{first}"),
        share(f"safe_{first}").alias(f"share_safe_{first}"), share(f"fast_{first}").alias(f"share_fast_{first}"), share("clean_winner").alias("share_clean_winner"),
    )
