"""Strategy columns over a table of predictions, equity curves and resampling."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions import pieces

c = F.col


def dynamic_stop(atr_pips: Column, mae: Column, volatility: Column, low: float = 15, high: float = 100) -> Column:
    """Stop by volatility band: the wider of ATR and excursion when it is high, the tighter when low, else their mean."""
    a, m = atr_pips * 1.5, mae * 1.2
    base = F.when(volatility > 0.75, F.greatest(a, m)).when(volatility < 0.25, F.least(a, m) * 1.1).otherwise((a + m) / 2)
    return F.round(F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), base)), 1)


def probability_at(level: float, known: dict[float, Column]) -> Column:
    """Probability of reaching a level, interpolated between the known ones and held beyond them."""
    xs = sorted(known)
    if level <= xs[0]:
        return known[xs[0]]
    for a, b in zip(xs, xs[1:]):
        if level <= b:
            return known[a] + (known[b] - known[a]) * ((level - a) / (b - a))
    return known[xs[-1]]


def best_take_profit(df: DataFrame, known: dict[float, Column], levels: list[float], stop: str = "sl", ratio: float = 1.0, least: float = 0.0) -> DataFrame:
    """Add action, optimal_tp, tp_probability and tp_ev: the level with the best value among those with enough ratio."""
    each = []
    for t in levels:
        p = probability_at(t, known)
        ev = F.round(p * t - (1 - p) * c(stop), 9)
        each.append(F.when((F.lit(t) / c(stop) >= ratio) & (ev >= least), F.struct(ev.alias("ev"), F.lit(-t).alias("minus"), p.alias("p"))))
    best = F.array_max(F.array(*each))
    return df.withColumn("__b", best).withColumns({"action": F.when(c("__b").isNull(), "NO_TRADE").otherwise("TRADE"), "optimal_tp": -c("__b.minus"), "tp_probability": c("__b.p"), "tp_ev": c("__b.ev")}).drop("__b")


def kelly(p: Column, tp: Column, sl: Column, balance: float, part: float = 0.5, most: float = 0.10, pip_value: float = 10.0) -> dict[str, Column]:
    b = F.try_divide(tp, sl)
    full = F.try_divide(p * b - (1 - p), b)
    risk = F.greatest(F.lit(0.0), F.least(F.lit(most), full * part))
    return {"full_kelly": full, "risk_percent": risk, "lots": F.try_divide(risk * balance, sl * pip_value), "confidence": F.when(full > 0.2, "high").when(full > 0.1, "medium").when(full > 0, "low").otherwise("none")}


def decide(df: DataFrame, known: dict[float, Column], levels: list[float], balance: float = 10_000) -> DataFrame:
    """Stop, take profit and size of each row of predictions (atr_pips, predicted_mae, volatility)."""
    out = best_take_profit(df.withColumn("sl", dynamic_stop(c("atr_pips"), c("predicted_mae"), c("volatility"))), known, levels)
    return out.withColumns(kelly(c("tp_probability"), c("optimal_tp"), c("sl"), balance))


def equity(trades: DataFrame, by: list[str], order: list[str], risk: float = 0.01, sl: float = 50, pips: str = "pips_result", size: int = pieces.SIZE) -> DataFrame:
    """Add equity (from 1, compounding a fixed risk), its peak and drawdown_percent. The first column of the order is a time."""
    out = pieces.paths(trades.withColumn("ret", c(pips) / sl * risk), F.log1p("ret"), by, order, size=size)
    out = out.withColumn("equity", F.exp("path")).withColumn("peak", F.greatest(F.exp("top"), F.lit(1.0))).drop("path", "top")
    return out.withColumn("drawdown_percent", (1 - c("equity") / c("peak")) * 100)


def equity_summary(curve: DataFrame, by: list[str], year: int = 1512) -> DataFrame:
    out = curve.groupBy(*by).agg(F.count(F.lit(1)).alias("n_trades"), F.exp(F.sum(F.log1p("ret"))).alias("__e"), F.max("drawdown_percent").alias("max_drawdown_percent"), F.avg("ret").alias("__m"), F.stddev_samp("ret").alias("__s"))
    return out.select(*by, "n_trades", ((c("__e") - 1) * 100).alias("total_return_percent"), "max_drawdown_percent", (F.try_divide("__m", "__s") * math.sqrt(year)).alias("sharpe"))


#: Trades of a block, about; the prime below which numbers are scrambled; the simulations that deal trades into blocks and order blocks.
BLOCK, PRIME = 2048, 2_147_483_647
DEAL, PLACE = 1_000_003, 2_000_003


def scrambled(x, sim):
    """A number below PRIME that looks random for each x (0 <= x < PRIME) and simulation; of Columns, or of arrays of 64-bit integers."""
    y = (x * 48_271 + sim * 69_621 + 11) % PRIME
    y = (y * y + x) % PRIME
    return (y * y + sim) % PRIME


def trade_key(*identity: str | Column, seed: int = 1) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), *identity), F.lit(PRIME))


class _Simulator:
    """Numbers and orders of a block's trades, `step` simulations at a time, in buffers that are used again.

    PRIME is 2 ** 31 - 1, so that a remainder by it is the sum of the lower 31 bits and those above them. An order is a sort of words of 32 bits,
    the upper bits of a number and the trade's place; the few that agree in these upper bits are put in order by whole numbers.
    """

    def __init__(self, key: np.ndarray, step: int) -> None:
        self.bits = max(1, (key.size - 1).bit_length())
        # The second sum is of what is PRIME less than needed, so that its square fits in 64 bits.
        self.first, self.second = key * 48_271 + 11, key - (PRIME << 31)
        self.held, self.carry = np.empty((2, step, key.size), np.int64)
        self.words, self.place = np.empty((step, key.size), np.uint32), np.arange(key.size, dtype=np.uint32)

    def numbers(self, lo: int, hi: int) -> np.ndarray:
        """scrambled(key, sim) + 1 for the simulations from lo to hi, a row each; good until the next call."""
        sims, y, t = np.arange(lo, hi, dtype=np.int64)[:, None], self.held[: hi - lo], self.carry[: hi - lo]
        np.add(self.first, sims * 69_621, out=y)
        for more in (self.second, sims + (1 << 31), None):
            np.right_shift(y, 31, out=t)
            np.bitwise_and(y, PRIME, out=y)
            np.add(y, t, out=y)
            if more is not None:
                np.multiply(y, y, out=y)
                np.add(y, more, out=y)
        np.right_shift(y, 31, out=t)  # one more than the sum is here, by 1 << 31 above, and two where the sum isn't below PRIME
        np.add(y, t, out=y)
        return np.bitwise_and(y, PRIME, out=y)

    def places(self, lo: int, hi: int) -> np.ndarray:
        """The places of the trades in order of (number, place)."""
        y, bits = self.numbers(lo, hi), self.bits
        if bits > 16:
            return np.argsort(y, axis=1, kind="stable")
        w = self.words[: hi - lo]
        np.right_shift(y, bits - 1, out=self.carry[: hi - lo])
        np.copyto(w, self.carry[: hi - lo], casting="unsafe")
        np.left_shift(w, bits, out=w)
        np.bitwise_or(w, self.place, out=w)
        w.sort(axis=1)
        flat = w.ravel()
        at = np.flatnonzero((flat[1:] ^ flat[:-1]) < 1 << bits)
        if at.size:
            both = np.unique(np.concatenate([at, at + 1]))
            row, held = both // w.shape[1], flat[both]
            place = held & ((1 << bits) - 1)
            flat[both] = held[np.lexsort((place, y[row, place], row))]
        return np.bitwise_and(w, (1 << bits) - 1, out=w)


#: Trades of a stretch of a path.
STRETCH = 8


def _summaries(path: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sum, highest, lowest point, deepest fall) of each row of steps, of which there are a multiple of STRETCH: those of the stretches, combined."""
    parts = path.reshape(len(path), -1, STRETCH)
    total = parts[:, :, 0].copy()
    top, low, fall, here = total.copy(), total.copy(), np.zeros_like(total), np.empty_like(total)
    for k in range(1, STRETCH):
        np.add(total, parts[:, :, k], out=total)
        np.maximum(top, total, out=top)
        np.minimum(low, total, out=low)
        np.maximum(fall, np.subtract(top, total, out=here), out=fall)
    start = np.cumsum(total, axis=1) - total
    peak = np.maximum.accumulate(start + top, axis=1)
    low += start
    deep = np.maximum(fall[:, 1:], peak[:, :-1] - low[:, 1:]).max(axis=1, initial=0)  # from the peak of earlier stretches
    return start[:, -1] + total[:, -1], peak[:, -1], low.min(axis=1), np.maximum(deep, fall[:, 0])


def _path_summaries(by: list[str], n: int, replace: bool):
    """Of a block's trades: for each simulation the sum of its path, its highest and lowest point and its deepest fall."""

    def run(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["trade", "x"])
        key, x = own["trade"].to_numpy(np.int64), own["x"].to_numpy(float)
        out = np.empty((4, n))
        step = min(n, max(1, (1 << 17) // x.size))
        draws, paths = _Simulator(key, step), np.zeros((step, -(-x.size // STRETCH) * STRETCH))
        for lo in range(0, n, step):
            hi = min(n, lo + step)
            at = (draws.numbers(lo, hi) - 1) % x.size if replace else draws.places(lo, hi)
            path = paths[: hi - lo]  # steps of 0 at the end change nothing
            path[:, : x.size] = x.take(at, mode="clip")
            out[:, lo:hi] = _summaries(path)
        first = {b: [own[b].iloc[0]] * n for b in by}
        return pd.DataFrame(first | {"block": own["block"].iloc[0], "sim": np.arange(n), "total": out[0], "top": out[1], "low": out[2], "fall": out[3]})

    return run


def resample(trades: DataFrame, by: list[str], n: int = 1000, *, seed: int = 1, replace: bool = False, pips: str = "pips_result", identity: list[str] | None = None, key: Column | None = None, block: int = BLOCK) -> DataFrame:
    """(by, sim, total, max_drawdown) of n reorderings of each group's trades, or of draws with replacement.

    A group's trades are dealt at random, by their key, into blocks of about `block`, which is the only time that trades are shuffled. A
    simulation puts the blocks in an order of its own and the trades inside each one too, or draws a block's number of trades from the
    block. Of each block and simulation only a summary goes on: (sum, highest, lowest point, deepest fall), which combines over blocks in
    order, as a path's deepest fall lies inside a block or between the highest point of earlier ones and a later low. A group that fits
    in one block is reordered, or drawn from, as a whole; in larger ones draws in blocks make the variance of a total smaller by a
    share of 1 / block. Order and draws follow from `key` (from 0 to PRIME - 1; by default a hash of identity), so that reruns agree.

    Null pips count as 0; groups may be null; trades of equal key and pips can't be told apart and needn't be.
    """
    key = trade_key(*(identity or ["ts"]), seed=seed) if key is None else key
    rows = trades.select(*by, key.cast("long").alias("trade"), F.coalesce(c(pips).cast("double"), F.lit(0.0)).alias("x"))
    sizes = rows.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / block).alias("__n")).select(*(c(b).alias(f"__{b}") for b in by), "__n")
    rows = rows.join(sizes, reduce(lambda a, b: a & b, [c(b).eqNullSafe(c(f"__{b}")) for b in by], F.lit(True)))
    rows = rows.select(*by, "trade", "x", (scrambled(c("trade"), F.lit(DEAL).cast("long")) % c("__n")).alias("block"))
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*by).schema]
    each = rows.groupBy(*by, "block").applyInPandas(_path_summaries(by, n, replace), ", ".join([*kinds, "block long", "sim int", "total double", "top double", "low double", "fall double"]))
    over = Window.partitionBy(*by, "sim").orderBy(scrambled(c("block") % PRIME, c("sim").cast("long") + PLACE), "block").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("start", F.coalesce(F.sum("total").over(over), F.lit(0.0)))
    each = each.withColumn("peak", F.max(c("start") + c("top")).over(over))
    fall = F.greatest(c("fall"), c("peak") - (c("start") + c("low")))
    return each.groupBy(*by, "sim").agg(F.sum("total").alias("total"), F.max(fall).alias("max_drawdown"))


def resample_summary(paths: DataFrame, by: list[str], ruin: float) -> DataFrame:
    return paths.groupBy(*by).agg(F.count(F.lit(1)).alias("n_sims"), F.avg("total").alias("mean_total"), F.stddev_samp("total").alias("std_total"), F.percentile("max_drawdown", F.lit(0.05)).alias("drawdown_p5"), F.percentile("max_drawdown", F.lit(0.95)).alias("drawdown_p95"), F.avg((c("total") > 0).cast("double")).alias("p_profit"), F.avg((c("max_drawdown") > ruin).cast("double")).alias("p_ruin"))


def by_regime(trades: DataFrame, regime: str, weak: float = 0.0) -> DataFrame:
    out = trades.groupBy(regime).agg(F.count(F.lit(1)).alias("n_trades"), F.avg((c("outcome") == "WIN").cast("double")).alias("win_rate"), F.avg("pips_result").alias("avg_pips"))
    return out.withColumn("weak", c("avg_pips") < weak)


def final_report(trades: DataFrame, parts: dict[str, str]) -> DataFrame:
    """(section, item, ...): results of all trades and by each of the columns named (section -> column), from one scan."""
    items = [F.struct(F.lit("all").alias("section"), F.lit("all").alias("item")), *(F.struct(F.lit(s).alias("section"), c(x).cast("string").alias("item")) for s, x in parts.items())]
    rows = trades.select(F.explode(F.array(*items)).alias("i"), (c("outcome") == "WIN").cast("int").alias("w"), c("pips_result").alias("p"))
    gains, losses = F.sum(F.when(c("p") > 0, c("p")).otherwise(0.0)), F.sum(F.when(c("p") < 0, -c("p")).otherwise(0.0))
    out = rows.groupBy("i.section", "i.item").agg(F.count(F.lit(1)).alias("n_trades"), F.sum("w").alias("wins"), F.sum("p").alias("total_pips"), F.try_divide(gains, losses).alias("profit_factor"))
    return out.withColumns({"win_rate": c("wins") / c("n_trades"), "avg_pips": c("total_pips") / c("n_trades"), "weak": c("total_pips") < 0})
