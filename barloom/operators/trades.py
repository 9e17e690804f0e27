"""Analytics of a trade log: what separates wins from losses, sessions, confidence, rules and their impact."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.distributions import t_two_sided

from .metrics import loss, win
from .stats import exact_quantiles

c = F.col


def summary(trades: DataFrame) -> DataFrame:
    return trades.agg(F.count(F.lit(1)).alias("n_trades"), F.count_if(win()).alias("wins"), F.count_if(loss()).alias("losses"), F.count_distinct("config_id").alias("n_configs"), F.sum("pips_result").alias("total_pips"))


def config_list(trades: DataFrame) -> DataFrame:
    return trades.groupBy("config_id").agg(F.count(F.lit(1)).alias("n_trades"), F.count_if(win()).alias("wins"), (F.count_if(win()) * 100 / F.count(F.lit(1))).alias("win_percent"))


def _two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([t_two_sided(None if pd.isna(x) else x, None if pd.isna(n) else n) for x, n in zip(t, df)], dtype=float)


def feature_comparison(trades: DataFrame, features: list[str], least: int = 30, alpha: float = 0.05) -> DataFrame:
    """Losses against wins, all features in one pass over the trades; the tests are made on one row a feature.

    difference: mean of losses less that of wins, and in percent of the latter; t, df and p_value of Welch's test of wins against
    losses; effect_size: Cohen's d, of which deviations are pooled with equal weights; place: significant ones first, then by
    effect_size.
    """
    long = trades.filter(win() | loss()).select(win().alias("w"), *(c(f).cast("double").alias(f) for f in features))
    long = long.unpivot(["w"], features, "feature", "value").filter("value is not null")
    sides = {"win": c("w"), "loss": ~c("w")}
    one = [f(F.when(x, c("value"))).alias(f"{n}_{s}") for s, x in sides.items() for f, n in ((F.count, "n"), (F.avg, "mean"), (F.stddev_samp, "std"))]
    m = long.groupBy("feature").agg(*one).filter((c("n_win") >= least) & (c("n_loss") >= least))
    vw, vl = c("std_win") ** 2 / c("n_win"), c("std_loss") ** 2 / c("n_loss")
    d = c("mean_loss") - c("mean_win")
    pooled = F.sqrt((c("std_win") ** 2 + c("std_loss") ** 2) / 2)
    m = m.withColumns({
        "difference": d,
        "difference_percent": F.coalesce(F.try_divide(d * 100, F.abs("mean_win")), F.lit(0.0)),
        "t": F.try_divide(-d, F.sqrt(vw + vl)),
        "df": F.try_divide((vw + vl) ** 2, vw**2 / (c("n_win") - 1) + vl**2 / (c("n_loss") - 1)),
        "effect_size": F.coalesce(F.abs(F.try_divide(d, pooled)), F.lit(0.0)),
        "direction": F.when(d > 0, "higher_in_losses").otherwise("higher_in_wins"),
    })
    m = m.withColumn("p_value", F.pandas_udf(_two_sided, "double")("t", "df")).withColumn("is_significant", F.coalesce(c("p_value") < alpha, F.lit(False)))
    first = Window.orderBy(F.desc("is_significant"), F.round("effect_size", 9).desc(), "feature")  # a row for each feature
    return m.withColumn("place", F.row_number().over(first))


SESSIONS = {"Asian": "is_asian_session", "London": "is_london_session", "NY": "is_ny_session", "Overlap": "is_overlap_session"}


def sessions(trades: DataFrame, below: float = 0.10, least: int = 10) -> DataFrame:
    """Win rates by session and off hours; problematic if more than `below` under the overall rate."""
    flags = [F.when(c(x) == 1, F.lit(n)) for n, x in SESSIONS.items()]
    none = reduce(lambda a, b: a & b, [c(x) == 0 for x in SESSIONS.values()])
    names = F.filter(F.array(*flags, F.when(none, F.lit("Off-Hours"))), lambda s: s.isNotNull())
    by = trades.withColumn("session", F.explode(names)).groupBy("session").agg(F.count_if(win() | loss()).alias("n_trades"), F.count_if(win()).alias("wins"), F.count_if(loss()).alias("losses")).filter(c("n_trades") >= least)
    overall = trades.agg(F.avg(win().cast("double")).alias("overall"))  # one row
    return by.join(overall).withColumn("win_rate", c("wins") / c("n_trades")).withColumn("problematic", c("win_rate") < c("overall") - below).drop("overall")


def confidence_buckets(trades: DataFrame, least: int = 5) -> DataFrame:
    p = c("model_probability")
    edges = [0.50, 0.55, 0.60, 0.65, 0.70, 0.75, 0.80, 1.01]
    bucket = reduce(lambda x, i: x.when((p >= edges[i]) & (p < edges[i + 1]), F.lit(f"{edges[i]:.2f}-{edges[i + 1]:.2f}")), range(1, len(edges) - 1), F.when((p >= edges[0]) & (p < edges[1]), F.lit("0.50-0.55")))
    out = trades.withColumn("bucket", bucket).filter("bucket is not null").groupBy("bucket").agg(F.count(F.lit(1)).alias("n_trades"), F.count_if(win()).alias("wins"), F.avg("pips_result").alias("avg_pips")).filter(c("n_trades") >= least)
    return out.withColumn("win_rate", c("wins") / c("n_trades"))


def best_confidence(trades: DataFrame, lo: int = 50, hi: int = 85) -> DataFrame:
    """The cut in hundredths with the best win rate, before the first that leaves fewer than 10 % of trades (or 10)."""
    cuts = F.sequence(F.lit(lo), F.least(F.floor(c("model_probability") * 100 + 1e-9).cast("int"), F.lit(hi)))
    cum = trades.filter(c("model_probability") >= lo / 100).withColumn("cut", F.explode(cuts)).groupBy("cut").agg(F.count(F.lit(1)).alias("n_trades"), F.count_if(win()).alias("wins"))
    total = trades.agg(F.count(F.lit(1)).alias("total"))
    short = F.max(F.when(c("n_trades") < F.greatest(c("total") * 0.1, F.lit(10)), 1).otherwise(0)).over(Window.orderBy("cut").rowsBetween(Window.unboundedPreceding, 0))  # hi - lo + 1 rows
    ok = cum.join(total).withColumn("short", short).filter("short = 0").withColumn("win_rate", c("wins") / c("n_trades"))
    return ok.agg(F.max_by("cut", F.struct(F.round("win_rate", 9), -c("cut"))).alias("cut"), F.max("win_rate").alias("win_rate"))


def alignment(trades: DataFrame, least: int = 10) -> DataFrame:
    groups = {"supports_short": c("d1_supports_short") == 1, "does_not_support_short": c("d1_supports_short") == 0, "opposes_short": c("d1_opposes_short") == 1, "trending_up": c("d1_is_trending_up") == 1, "not_trending_up": c("d1_is_trending_up") == 0}
    names = F.filter(F.array(*(F.when(x, F.lit(n)) for n, x in groups.items())), lambda s: s.isNotNull())
    by = trades.withColumn("category", F.explode(names)).groupBy("category").agg(F.count(F.lit(1)).alias("n_trades"), F.count_if(win()).alias("wins")).filter(c("n_trades") >= least)
    total = trades.agg(F.count(F.lit(1)).alias("total"))
    return by.join(total).select("category", "n_trades", "wins", (c("wins") / c("n_trades")).alias("win_rate"), (c("n_trades") * 100 / c("total")).alias("percent_of_all"))


def loss_report(trades: DataFrame, features: list[str], least: int = 30, most: int = 10, hints: int = 5) -> DataFrame:
    """(section, item, place, value, hint): the whole log, what predicts losses, sessions to avoid and the best cut of confidence.

    hint marks what to act on: the first `hints` predictors, every problematic session, and a cut over 0.50."""
    row = lambda d, section, item, place, value, hint: d.select(F.lit(section).alias("section"), item.alias("item"), place.cast("int").alias("place"), value.cast("double").alias("value"), hint.alias("hint"))
    one, no = F.lit(1), F.lit(False)
    s = summary(trades).withColumn("win_rate", F.try_divide("wins", "n_trades"))
    each = F.array(*(F.struct(F.lit(n).alias("item"), c(n).cast("double").alias("value")) for n in ("n_trades", "wins", "losses", "win_rate", "total_pips")))
    totals = s.select(F.explode(each).alias("s")).select("s.*")
    found = feature_comparison(trades, features, least).filter(c("is_significant") & (c("place") <= most))
    avoid = sessions(trades).filter("problematic")
    cut = best_confidence(trades).filter("cut is not null")
    parts = [
        row(totals, "summary", c("item"), one, c("value"), no),
        row(found, "predictor", F.concat_ws(" ", "feature", "direction"), c("place"), c("difference_percent"), c("place") <= hints),
        row(avoid, "session", c("session"), one, c("win_rate"), F.lit(True)),
        row(cut, "confidence", F.lit("model_probability"), one, c("cut") / 100, c("cut") > 50),
    ]
    return reduce(DataFrame.unionByName, parts)


def confluence(trades: DataFrame, least: int = 5) -> DataFrame:
    x = c("mtf_confluence_score")
    bucket = F.when(x >= 0.75, "high").when(x >= 0.5, "medium").when(x < 0.5, "low")
    out = trades.withColumn("bucket", bucket).filter("bucket is not null").groupBy("bucket").agg(F.count(F.lit(1)).alias("n_trades"), F.count_if(win()).alias("wins"), F.avg(x).alias("avg_score")).filter(c("n_trades") >= least)
    return out.withColumn("win_rate", c("wins") / c("n_trades"))


@dataclass(frozen=True)
class Rule:
    """Keep trades for which `feature op value` holds."""

    feature: str
    op: str
    value: float

    @property
    def name(self) -> str:
        return f"{self.feature} {self.op} {self.value:g}"

    def column(self, columns: list[str]) -> Column:
        """A missing column keeps every trade."""
        if self.feature not in columns:
            return F.lit(True)
        x, v = c(self.feature), F.lit(self.value)
        kept = {">=": x >= v, "<=": x <= v, ">": x > v, "<": x < v, "==": x == v, "!=": x != v}[self.op]
        return F.coalesce(kept, F.lit(False))


# The candidate rules.
CUTS = {
    "model_probability": (0.55, 0.58, 0.60, 0.63, 0.65, 0.70, 0.75), "rsi_value": (60, 65, 68, 70, 72, 75), "d1_rsi_value": (50, 55, 60, 65), "mtf_confluence_score": (0.50, 0.60, 0.70, 0.75), "bb_position": (0.80, 0.85, 0.88, 0.90, 0.93, 0.95),
    "adx": (15, 20, 25), "volume_ratio": (0.8, 1.0, 1.2), "consecutive_bullish": (2, 3), "exhaustion_score": (0.3, 0.5, 0.7),
}
EQUAL = {"is_asian_session": 0, "is_overlap_session": 1, "is_london_session": 1, "is_ny_session": 1, "d1_opposes_short": 0, "d1_supports_short": 1, "d1_is_trending_up": 0, "mtf_rsi_aligned": 1, "mtf_trend_aligned": 1, "mtf_bb_aligned": 1, "mtf_strong_short_setup": 1}


def candidate_rules(columns: list[str]) -> list[Rule]:
    rules = [Rule(f, ">=", v) for f, vs in CUTS.items() for v in vs] + [Rule(f, "==", v) for f, v in EQUAL.items()] + [Rule("d1_trend_direction", "<=", 0.3)]
    return [r for r in rules if r.feature in columns]


def dynamic_rules(trades: DataFrame, features: list[str], cuts: tuple[float, ...] = (0.25, 0.5, 0.75, 0.9)) -> list[Rule]:
    """Rules at exact percentiles of each feature, kept above and below; a number for each feature and cut comes to the driver."""
    found = {(r.feature, r.q): r.value for r in exact_quantiles(trades, features, list(cuts)).collect()}
    return [Rule(f, op, round(found[f, q], 6)) for f in features for q in cuts if (f, q) in found for op in (">=", "<")]


#: Rules whose bits one word of a signature holds, if no name needs more.
WORD = 8


def words_of(rules: dict[str, list[Rule]], most: int = WORD) -> list[tuple[list[Rule], dict[str, int]]]:
    """The names dealt into words: the rules that are a word's bits, and for each name of the word the mask of its rules' bits."""
    words: list[tuple[list[Rule], list[str]]] = []
    for name, own in rules.items():
        for bits, names in words:
            new = [r for r in dict.fromkeys(own) if r not in bits]
            if len(bits) + len(new) <= most:
                bits += new
                names.append(name)
                break
        else:
            words.append((list(dict.fromkeys(own)), [name]))
    return [(bits, {n: sum(1 << bits.index(r) for r in set(rules[n])) for n in names}) for bits, names in words]


def signatures(trades: DataFrame, words: list[list[Rule]], by: list[str] | None = None) -> DataFrame:
    """(by, word, bits, n, wins, losses, pips): trades counted by which rules of each word they meet (bit k: the word's k-th rule).

    One scan, summed up on the map side: a row for each word and each set of its rules that occurs, however many trades there are.
    """
    bit = lambda k, r: F.when(r.column(trades.columns), F.lit(1 << k)).otherwise(F.lit(0))
    every = [F.struct(F.lit(i).alias("word"), reduce(lambda a, b: a + b, [bit(k, r) for k, r in enumerate(bits)]).cast("long").alias("bits")) for i, bits in enumerate(words)]
    own = trades.select(*(by or []), win().cast("int").alias("w"), loss().cast("int").alias("l"), c("pips_result").alias("p"), F.explode(F.array(*every)).alias("s"))
    sums = [F.count(F.lit(1)).alias("n"), F.sum("w").alias("wins"), F.sum("l").alias("losses"), F.sum("p").alias("pips")]
    return own.groupBy(*(by or []), "s.word", "s.bits").agg(*sums)


def impact(trades: DataFrame, rules: dict[str, list[Rule]], tp: float, sl: float, by: list[str] | None = None) -> DataFrame:
    """What keeping only the trades that meet all rules of a name would change, rolled up from the trades' signatures."""
    by, words = by or [], words_of(rules)
    names = F.array(*(F.array(*(F.struct(F.lit(n).alias("rule"), F.lit(m).cast("long").alias("mask")) for n, m in masks.items())) for _, masks in words))
    rows = signatures(trades, [bits for bits, _ in words], by).withColumn("r", F.explode(F.get(names, c("word"))))
    met = c("bits").bitwiseAND(c("r.mask")) == c("r.mask")
    parts = {"n": "n", "wins": "wins", "losses": "losses", "pips": "pips"}
    zero = {"pips": F.lit(0.0)}
    sums = [F.sum(x).alias(f"{k}_before") for k, x in parts.items()]
    sums += [F.coalesce(F.sum(F.when(met, c(x))), zero.get(k, F.lit(0))).alias(f"{k}_after") for k, x in parts.items()]
    out = rows.groupBy(*by, c("r.rule").alias("rule")).agg(*sums)
    out = out.select(*by, "n_before", "wins_before", "losses_before", "pips_before", "rule", "n_after", "wins_after", "losses_after", "pips_after")
    out = out.withColumns({"wins_removed": c("wins_before") - c("wins_after"), "losses_removed": c("losses_before") - c("losses_after")})
    out = out.withColumns({"pips_saved": c("losses_removed") * float(sl), "pips_lost": c("wins_removed") * float(tp)})
    out = out.withColumns({
        "net_pips": c("pips_saved") - c("pips_lost"),
        "efficiency": F.when(c("wins_removed") > 0, c("losses_removed") / c("wins_removed")),
        "loss_removal": F.coalesce(F.try_divide("losses_removed", "losses_before"), F.lit(0.0)),
        "win_preservation": F.coalesce(F.try_divide("wins_after", "wins_before"), F.lit(0.0)),
    })
    return out.withColumn("percent_improvement", F.coalesce(F.try_divide(c("net_pips") * 100, F.abs("pips_before")), F.lit(0.0)))


def kept(trades: DataFrame, rules: list[Rule]) -> DataFrame:
    """(rule, n): how many trades meet each rule, by its place in the list. A sum for each rule in one scan; trades aren't copied for words."""
    counts = trades.agg(*(F.count_if(r.column(trades.columns)).alias(str(i)) for i, r in enumerate(rules)))
    return counts.select(F.posexplode(F.array(*(c(f"`{i}`") for i in range(len(rules)))).cast("array<bigint>")).alias("rule", "n"))


def filter_comparison(trades: DataFrame, filters: dict[str, Column], least: int = 50) -> DataFrame:
    """Trades that each filter leaves against all of them (filter `none`): counts, win rate, pips and gain; better from `least`
    trades on. One scan, as for rules."""
    every = {"none": F.lit(True)} | filters
    met = F.array_compact(F.array(*(F.when(x, F.lit(n)) for n, x in every.items())))
    by = trades.select(F.explode(met).alias("filter"), win().cast("int").alias("w"), c("pips_result").alias("p")).groupBy("filter")
    out = by.agg(F.count(F.lit(1)).alias("n_trades"), F.sum("w").alias("wins"), F.sum("p").alias("total_pips"))
    base = out.filter("filter = 'none'").select(c("total_pips").alias("base_pips"))  # one row
    out = out.join(base).withColumns({"win_rate": c("wins") / c("n_trades"), "avg_pips": c("total_pips") / c("n_trades"), "gain": c("total_pips") - c("base_pips")})
    return out.withColumn("better", (c("n_trades") >= least) & (c("gain") > 0)).drop("base_pips")


def verdicts(impacts: DataFrame, n: int | None = None) -> DataFrame:
    """Add a verdict and order by net pips; no wins removed counts as unlimited efficiency."""
    at_least = lambda x: c("efficiency").isNull() | (c("efficiency") >= x)
    out = impacts.withColumn("verdict", F.when(at_least(3) & (c("net_pips") > 1000), "STRONG").when(at_least(2) & (c("net_pips") > 300), "MODERATE").when(c("net_pips") > 0, "WEAK").otherwise("NOT"))
    out = out.orderBy(F.desc("net_pips"), "rule")
    return out.limit(n) if n else out


def rule_combinations(trades: DataFrame, rules: list[Rule], tp: float, sl: float, top: int = 5) -> DataFrame:
    """Impact of pairs and triples of the rules with the best net pips; those that gain."""
    best = [r["rule"] for r in verdicts(impact(trades, {r.name: [r] for r in rules}, tp, sl), top).select("rule").collect()]
    known = {r.name: r for r in rules}
    sets = [s for k in (2, 3) for s in combinations(best, k)]
    return impact(trades, {" & ".join(s): [known[x] for x in s] for s in sets}, tp, sl).filter("net_pips > 0")


def out_of_sample(trades: DataFrame, rules: list[Rule], tp: float, sl: float, first_folds: int = 3) -> DataFrame:
    """Impact on early and late folds side by side; overfit where the early gain for each trade is twice the late one."""
    split = trades.withColumn("part", F.when(c("fold") <= first_folds, "in").otherwise("out"))
    i = impact(split, {r.name: [r] for r in rules}, tp, sl, ["part"]).withColumn("gain", F.try_divide(c("net_pips"), c("n_before")))
    both = i.groupBy("rule").agg(F.max(F.when(c("part") == "in", c("gain"))).alias("gain_in"), F.max(F.when(c("part") == "out", c("gain"))).alias("gain_out"))
    return both.withColumn("overfit_ratio", F.try_divide("gain_in", "gain_out")).withColumn("robust", (c("gain_in") > 0) & (c("gain_out") > 0) & (c("overfit_ratio") < 2))
