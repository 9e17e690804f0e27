"""Queries and SQL: trade analytics, metrics, statistics, run ledger and strategy, over a trade log that Spark derives from
lineitem: every row is a trade whose outcome, features and probability follow from the row's own columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators import metrics, runs, signals, stats, strategy, trades

from . import feature_queries as fq
from .feature_queries import read, shown
from .sqltext import query as cte

QUERIES: dict[str, fq.Query] = {}
SQL: dict[str, str] = {}

# One column after the other, in words that both engines read alike.
_TRADE = {
    "tp": "50 + 50 * (l_suppkey % 3)", "sl": "30 + 10 * (l_linenumber % 3)", "hold": "12 + 12 * (l_orderkey % 3)", "fold": "CAST(1 + l_orderkey % 5 AS INT)", "key": "l_returnflag", "ts": "l_shipdate",
    "is_asian_session": "CASE WHEN l_quantity % 4 = 0 THEN 1 ELSE 0 END", "is_london_session": "CASE WHEN l_quantity % 4 = 1 THEN 1 ELSE 0 END", "is_ny_session": "CASE WHEN l_quantity % 4 = 2 THEN 1 ELSE 0 END", "is_overlap_session": "CASE WHEN l_quantity % 8 = 2 THEN 1 ELSE 0 END",
    "d1_opposes_short": "CASE WHEN l_discount >= 0.08 THEN 1 ELSE 0 END", "d1_supports_short": "CASE WHEN l_tax <= 0.03 THEN 1 ELSE 0 END", "model_probability": "CAST((40 + (l_partkey * 3 + l_linenumber * 17) % 50) AS DOUBLE) / 100", "rsi_value": "40 + l_quantity", "bb_position": "l_discount * 10", "d1_rsi_value": "CAST(35 + l_partkey % 40 AS DOUBLE)", "adx": "CAST(10 + l_suppkey % 25 AS DOUBLE)", "volume_ratio": "CAST(5 + l_orderkey % 20 AS DOUBLE) / 10", "mtf_confluence_score": "CAST(l_linenumber % 5 AS DOUBLE) / 4", "exhaustion_score": "CAST((l_orderkey + l_linenumber) % 10 AS DOUBLE) / 10", "consecutive_bullish": "CAST(l_linenumber % 5 AS INT)", "luck": "(l_orderkey * 7 + l_partkey * 13 + l_linenumber * 31) % 100",
}
_MORE = {"d1_is_trending_up": "CASE WHEN d1_rsi_value > 55 THEN 1 ELSE 0 END", "outcome": "CASE WHEN luck < 45 - 30 * is_asian_session - 20 * d1_opposes_short THEN 'WIN' ELSE 'LOSS' END", "config_id": "concat('TP', CAST(tp AS VARCHAR(9)), '_SL', CAST(sl AS VARCHAR(9)), '_H', CAST(hold AS VARCHAR(9)))"}
_LAST = {"pips_result": "CASE WHEN outcome = 'WIN' THEN CAST(tp AS DOUBLE) ELSE CAST(-sl AS DOUBLE) END"}
TRADES = [
    "t0 AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, " + ", ".join(f"{v} AS {k}" for k, v in _TRADE.items()) + " FROM lineitem)",
    "t1 AS (SELECT *, " + ", ".join(f"{v} AS {k}" for k, v in _MORE.items()) + " FROM t0)",
    "trades AS (SELECT *, " + ", ".join(f"{v} AS {k}" for k, v in _LAST.items()) + " FROM t1)",
]
ORDER = ["ts", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
FEATURES = ["rsi_value", "bb_position", "d1_rsi_value", "adx", "volume_ratio", "mtf_confluence_score", "exhaustion_score", "model_probability", "is_asian_session", "d1_opposes_short"]


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = read(spark, sf_dir, "lineitem")
    for layer in (_TRADE, _MORE, _LAST):
        out = out.select(*(["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"] if layer is _TRADE else ["*"]), *(F.expr(v.replace("VARCHAR(9)", "STRING")).alias(k) for k, v in layer.items()))
    return out


def query(name: str, select: str | None = None, ctes: list[str] | None = None):
    def put(f):
        QUERIES[name] = lambda s, d: shown(f(log(s, d)))
        if select:
            SQL[name] = cte([*TRADES, *(ctes or [])], select)
        return f

    return put


WIN = "count(*) FILTER (outcome = 'WIN')"
RATE = f"round({WIN} / count(*)::DOUBLE, 6)"
query("trade_summary", f"SELECT count(*) AS n_trades, {WIN} AS wins, count(*) FILTER (outcome = 'LOSS') AS losses, count(DISTINCT config_id) AS n_configs, sum(pips_result) + 0.0 AS total_pips FROM trades")(trades.summary)
query("config_list", f"SELECT config_id, count(*) AS n_trades, {WIN} AS wins, round({WIN} * 100 / count(*)::DOUBLE, 6) AS win_percent FROM trades GROUP BY 1")(trades.config_list)

_long = "long AS (" + " UNION ALL ".join(f"SELECT '{f}' AS feature, outcome, {f}::DOUBLE AS v FROM trades" for f in FEATURES) + ")"
_cmp = "m AS (SELECT feature, count(v) FILTER (outcome = 'WIN') AS n_win, avg(v) FILTER (outcome = 'WIN') AS mean_win, stddev_samp(v) FILTER (outcome = 'WIN') AS std_win, count(v) FILTER (outcome = 'LOSS') AS n_loss, avg(v) FILTER (outcome = 'LOSS') AS mean_loss, stddev_samp(v) FILTER (outcome = 'LOSS') AS std_loss FROM long GROUP BY feature)"
_vw, _vl = "(std_win ** 2 / n_win)", "(std_loss ** 2 / n_loss)"
_z = 1.959963984540054  # of a two-sided test at 5 %
_t = f"((mean_win - mean_loss) / sqrt({_vw} + {_vl}))"
_df = f"(({_vw} + {_vl}) ** 2 / ({_vw} ** 2 / (n_win - 1) + {_vl} ** 2 / (n_loss - 1)))"
# Student's critical value by its expansion in 1 / df.
_critical = f"({_z} + {(_z**3 + _z) / 4} / {_df} + {(5 * _z**5 + 16 * _z**3 + 3 * _z) / 96} / {_df} ** 2 + {(3 * _z**7 + 19 * _z**5 + 17 * _z**3 - 15 * _z) / 384} / {_df} ** 3)"
_effect = "coalesce(abs(mean_loss - mean_win) / nullif(sqrt((std_win ** 2 + std_loss ** 2) / 2), 0), 0)"
_significant = f"coalesce(abs({_t}) > {_critical}, false)"
_compared = f"""SELECT feature, n_win, round(mean_win, 6) + 0.0 AS mean_win, round(std_win, 6) AS std_win,
  n_loss, round(mean_loss, 6) + 0.0 AS mean_loss, round(std_loss, 6) AS std_loss,
  round(mean_loss - mean_win, 6) + 0.0 AS difference, round(coalesce((mean_loss - mean_win) * 100 / nullif(abs(mean_win), 0), 0), 6) + 0.0 AS difference_percent,
  round({_t}, 6) + 0.0 AS t, round({_df}, 6) AS df, round({_effect}, 6) + 0.0 AS effect_size,
  CASE WHEN mean_loss > mean_win THEN 'higher_in_losses' ELSE 'higher_in_wins' END AS direction, {_significant} AS is_significant,
  row_number() OVER (ORDER BY {_significant} DESC, round({_effect}, 9) DESC, feature) AS place
FROM m WHERE n_win >= 30 AND n_loss >= 30"""
query("feature_comparison", _compared, [_long, _cmp])(lambda t: trades.feature_comparison(t, FEATURES).drop("p_value").withColumn("place", F.col("place").cast("long")))
# With the tail probabilities, of which DuckDB has none; tests compare them with an integral.
query("feature_significance")(lambda t: trades.feature_comparison(t, FEATURES).select("feature", "t", "df", "p_value", "is_significant", "place"))
_sess = "s AS (" + " UNION ALL ".join(f"SELECT '{n}' AS session, outcome FROM trades WHERE {c} = 1" for n, c in trades.SESSIONS.items()) + " UNION ALL SELECT 'Off-Hours', outcome FROM trades WHERE " + " AND ".join(f"{c} = 0" for c in trades.SESSIONS.values()) + ")"
query("session_analysis", f"SELECT session, count(*) AS n_trades, {WIN} AS wins, count(*) FILTER (outcome = 'LOSS') AS losses, {RATE} AS win_rate, {WIN} / count(*)::DOUBLE < (SELECT avg(CASE WHEN outcome = 'WIN' THEN 1.0 ELSE 0.0 END) FROM trades) - 0.1 AS problematic FROM s GROUP BY session HAVING count(*) >= 10", [_sess])(trades.sessions)
query("confidence_buckets", f"SELECT CASE WHEN model_probability < 0.55 THEN '0.50-0.55' WHEN model_probability < 0.6 THEN '0.55-0.60' WHEN model_probability < 0.65 THEN '0.60-0.65' WHEN model_probability < 0.7 THEN '0.65-0.70' WHEN model_probability < 0.75 THEN '0.70-0.75' WHEN model_probability < 0.8 THEN '0.75-0.80' ELSE '0.80-1.01' END AS bucket, count(*) AS n_trades, {WIN} AS wins, round(avg(pips_result), 6) + 0.0 AS avg_pips, {RATE} AS win_rate FROM trades WHERE model_probability >= 0.5 GROUP BY 1 HAVING count(*) >= 5")(trades.confidence_buckets)
_cuts = f"k AS (SELECT cut, count(*) AS n, {WIN} / count(*)::DOUBLE AS r FROM trades, range(50, 86) c(cut) WHERE floor(model_probability * 100 + 1e-9) >= cut GROUP BY cut)"
_cut = "SELECT arg_max(cut, (round(r, 9), -cut))::INT AS cut, round(max(r), 6) AS win_rate FROM (SELECT *, max(CASE WHEN n < greatest((SELECT count(*) FROM trades) * 0.1, 10) THEN 1 ELSE 0 END) OVER (ORDER BY cut) AS short FROM k) WHERE short = 0"
query("optimal_confidence", _cut, [_cuts])(trades.best_confidence)
_al = {"supports_short": "d1_supports_short = 1", "does_not_support_short": "d1_supports_short = 0", "opposes_short": "d1_opposes_short = 1", "trending_up": "d1_is_trending_up = 1", "not_trending_up": "d1_is_trending_up = 0"}
query("alignment", f"SELECT category, count(*) AS n_trades, {WIN} AS wins, {RATE} AS win_rate, round(count(*) * 100 / (SELECT count(*) FROM trades)::DOUBLE, 6) AS percent_of_all FROM a GROUP BY category HAVING count(*) >= 10", ["a AS (" + " UNION ALL ".join(f"SELECT '{n}' AS category, outcome FROM trades WHERE {x}" for n, x in _al.items()) + ")"])(trades.alignment)
query("confluence", f"SELECT CASE WHEN mtf_confluence_score >= 0.75 THEN 'high' WHEN mtf_confluence_score >= 0.5 THEN 'medium' ELSE 'low' END AS bucket, count(*) AS n_trades, {WIN} AS wins, round(avg(mtf_confluence_score), 6) AS avg_score, {RATE} AS win_rate FROM trades GROUP BY 1 HAVING count(*) >= 5")(trades.confluence)

_report = "\nUNION ALL ".join([
    f"SELECT 'summary' AS section, item, 1 AS place, round(value, 6) + 0.0 AS value, false AS hint FROM (SELECT count(*)::DOUBLE AS n_trades, ({WIN})::DOUBLE AS wins, count(*) FILTER (outcome = 'LOSS')::DOUBLE AS losses, ({WIN}) / count(*)::DOUBLE AS win_rate, sum(pips_result)::DOUBLE AS total_pips FROM trades) UNPIVOT (value FOR item IN (n_trades, wins, losses, win_rate, total_pips))",
    "SELECT 'predictor', feature || ' ' || direction, place::INT, difference_percent, place <= 5 FROM compared WHERE is_significant AND place <= 10",
    f"SELECT 'session', session, 1, {RATE}, true FROM s GROUP BY session HAVING count(*) >= 10 AND {WIN} / count(*)::DOUBLE < (SELECT avg(CASE WHEN outcome = 'WIN' THEN 1.0 ELSE 0.0 END) FROM trades) - 0.1",
    f"SELECT 'confidence', 'model_probability', 1, cut / 100.0::DOUBLE, cut > 50 FROM ({_cut}) WHERE cut IS NOT NULL",
])
query("loss_report", _report, [_long, _cmp, f"compared AS ({_compared})", _sess, _cuts])(lambda t: trades.loss_report(t, FEATURES))

# Rules

_columns = [*_TRADE, *_MORE, *_LAST]
RULES = trades.candidate_rules(_columns)


def _impact(rules: dict[str, list[trades.Rule]], tp: float, sl: float, source: str = "trades", by: str = "") -> list[str]:
    rows = " UNION ALL ".join(f"SELECT {by + ', ' if by else ''}'{n}' AS rule, count(*) AS n_before, {WIN} AS wins_before, count(*) FILTER (outcome = 'LOSS') AS losses_before, sum(pips_result) AS pips_before, count(*) FILTER ({x}) AS n_after, count(*) FILTER (({x}) AND outcome = 'WIN') AS wins_after, count(*) FILTER (({x}) AND outcome = 'LOSS') AS losses_after, coalesce(sum(pips_result) FILTER ({x}), 0) AS pips_after FROM {source} {'GROUP BY ' + by if by else ''}" for n, x in ((n, " AND ".join(f"{r.feature} {'=' if r.op == '==' else r.op} {r.value!r}" for r in rs)) for n, rs in rules.items()))
    return [f"i0 AS ({rows})", f"impact AS (SELECT *, wins_before - wins_after AS wins_removed, losses_before - losses_after AS losses_removed, (losses_before - losses_after) * {sl}::DOUBLE AS pips_saved, (wins_before - wins_after) * {tp}::DOUBLE AS pips_lost, (losses_before - losses_after) * {sl}::DOUBLE - (wins_before - wins_after) * {tp}::DOUBLE AS net_pips, round((losses_before - losses_after) / nullif(wins_before - wins_after, 0)::DOUBLE, 6) AS efficiency, round(coalesce((losses_before - losses_after) / nullif(losses_before, 0)::DOUBLE, 0), 6) AS loss_removal, round(coalesce(wins_after / nullif(wins_before, 0)::DOUBLE, 0), 6) AS win_preservation, round(((losses_before - losses_after) * {sl}::DOUBLE - (wins_before - wins_after) * {tp}::DOUBLE) * 100 / abs(pips_before), 6) + 0.0 AS percent_improvement FROM i0)"]


_each = {r.name: [r] for r in RULES}
_verdict = "CASE WHEN coalesce(efficiency, 1e9) >= 3 AND net_pips > 1000 THEN 'STRONG' WHEN coalesce(efficiency, 1e9) >= 2 AND net_pips > 300 THEN 'MODERATE' WHEN net_pips > 0 THEN 'WEAK' ELSE 'NOT' END"
query("filter_impact", "SELECT * FROM impact", _impact(_each, 100, 40))(lambda t: trades.impact(t, _each, 100, 40))
query("filter_rank", f"SELECT *, {_verdict} AS verdict FROM impact ORDER BY net_pips DESC, rule LIMIT 10", _impact(_each, 100, 40))(lambda t: trades.verdicts(trades.impact(t, _each, 100, 40), 10))


def _combos(top: int) -> str:
    """Pairs and triples of the best single rules: the rules a trade meets are bits of one number."""
    test = lambda r: f"{r.feature} {'=' if r.op == '==' else r.op} {r.value!r}"
    bits = " + ".join(f"CASE WHEN {test(r)} THEN {1 << k}::BIGINT ELSE 0 END" for k, r in enumerate(RULES))
    names = ", ".join(f"('{r.name}', {1 << k}::BIGINT)" for k, r in enumerate(RULES))
    counted = lambda source: f"""SELECT s.rule, count(*) AS n_before, {WIN} AS wins_before, count(*) FILTER (outcome = 'LOSS') AS losses_before, sum(pips_result) AS pips_before,
      count(*) FILTER (met) AS n_after, count(*) FILTER (met AND outcome = 'WIN') AS wins_after, count(*) FILTER (met AND outcome = 'LOSS') AS losses_after, coalesce(sum(pips_result) FILTER (met), 0) AS pips_after
      FROM (SELECT g.outcome, g.pips_result, s.rule, g.bits & s.mask = s.mask AS met FROM signed g, {source} s) s GROUP BY s.rule"""  # noqa: E731
    shown_ = _impact({}, 100, 40)[1].removeprefix("impact AS (").removesuffix(")")
    return cte([
        *TRADES, f"signed AS MATERIALIZED (SELECT outcome, pips_result, {bits} AS bits FROM trades)", f"single AS (SELECT * FROM (VALUES {names}) v(rule, mask))",
        f"i1 AS ({counted('single')})", "best AS (SELECT i1.rule, mask, row_number() OVER (ORDER BY (losses_before - losses_after) * 40 - (wins_before - wins_after) * 100 DESC, i1.rule) AS r FROM i1 JOIN single ON i1.rule = single.rule)",
        f"sets AS (SELECT a.rule || ' & ' || b.rule AS rule, a.mask | b.mask AS mask FROM best a JOIN best b ON a.r < b.r AND b.r <= {top} UNION ALL SELECT a.rule || ' & ' || b.rule || ' & ' || c.rule, a.mask | b.mask | c.mask FROM best a JOIN best b ON a.r < b.r JOIN best c ON b.r < c.r AND c.r <= {top})",
        f"i0 AS ({counted('sets')})", f"impact AS ({shown_})",
    ], "SELECT * FROM impact WHERE net_pips > 0")


query("filter_combos")(lambda t: trades.rule_combinations(t, RULES, 100, 40, 4))
query("filter_combos_all")(lambda t: trades.rule_combinations(t, RULES, 100, 40))
SQL |= {"filter_combos": _combos(4), "filter_combos_all": _combos(5)}
_cuts = (0.25, 0.5, 0.75, 0.9)
_dynamic = [f"SELECT '{f}' AS feature, '{op}' AS op, {q}::DOUBLE AS cut, round(c, 6) + 0.0 AS value, (SELECT count(*) FROM trades WHERE {f} {op} round(c, 6)) AS n_after FROM (SELECT quantile_cont({f}::DOUBLE, {q}) AS c FROM trades)" for f in FEATURES for q in _cuts for op in (">=", "<")]


def _filter_dynamic(t: DataFrame) -> DataFrame:
    rules = trades.dynamic_rules(t, FEATURES, _cuts)
    names = [(i, r.feature, r.op, _cuts[i // 2 % len(_cuts)], float(r.value)) for i, r in enumerate(rules)]
    named = t.sparkSession.createDataFrame(names, "id int, feature string, op string, cut double, value double")
    return trades.kept(t, rules).join(named, F.col("rule") == F.col("id")).select("feature", "op", "cut", "value", F.col("n").alias("n_after"))


query("filter_dynamic", " UNION ALL ".join(_dynamic))(_filter_dynamic)
query("filter_oos", "SELECT rule, round(gi, 6) + 0.0 AS gain_in, round(go, 6) + 0.0 AS gain_out, round(gi / nullif(go, 0), 6) + 0.0 AS overfit_ratio, (gi > 0 AND go > 0 AND gi / go < 2) AS robust FROM (SELECT rule, max(net_pips / n_before) FILTER (part = 'in') AS gi, max(net_pips / n_before) FILTER (part = 'out') AS go FROM impact GROUP BY rule)", ["parted AS (SELECT *, CASE WHEN fold <= 3 THEN 'in' ELSE 'out' END AS part FROM trades)", *_impact(_each, 100, 40, "parted", "part")])(lambda t: trades.out_of_sample(t, RULES, 100, 40))

# Metrics

_run = "run AS (SELECT *, sum(pips_result) OVER (PARTITION BY config_id{by} ORDER BY ts, l_orderkey, l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING) AS s FROM {src})"
_dd = "fall AS (SELECT *, max(s) OVER (PARTITION BY config_id{by} ORDER BY ts, l_orderkey, l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING) - s AS f FROM run)"
_profit = f"count(*) AS n_trades, {WIN} AS wins, count(*) FILTER (outcome = 'LOSS') AS losses, sum(pips_result) + 0.0 AS total_pips, round(avg(pips_result), 6) + 0.0 AS avg_pips, round(avg(pips_result) FILTER (pips_result > 0), 6) AS avg_win, round(avg(-pips_result) FILTER (pips_result < 0), 6) AS avg_loss, {RATE} AS win_rate, round(coalesce(avg(pips_result) / nullif(stddev_pop(pips_result), 0) * sqrt(252), 0), 6) + 0.0 AS sharpe, round(coalesce(sum(pips_result) FILTER (pips_result > 0), 0) / coalesce(-sum(pips_result) FILTER (pips_result < 0), 1), 6) AS profit_factor, round({WIN} / count(*)::DOUBLE * coalesce(avg(pips_result) FILTER (pips_result > 0), 0) - (1 - {WIN} / count(*)::DOUBLE) * coalesce(avg(-pips_result) FILTER (pips_result < 0), 0), 6) + 0.0 AS expectancy, max(f) + 0.0 AS max_drawdown"
query("profit_metrics", f"SELECT config_id, {_profit} FROM fall GROUP BY config_id", [_run.format(by="", src="trades"), _dd.format(by="")])(lambda t: metrics.profit(t, ["config_id"], ORDER, bucket=F.date_format("ts", "yyyy-MM")))
_th = [0.45, 0.55, 0.65, 0.75, 0.85]
_spread = "spread AS (SELECT *, x.threshold FROM trades, (VALUES " + ", ".join(f"({x}::DOUBLE)" for x in _th) + ") x(threshold) WHERE model_probability >= x.threshold)"
query("threshold_sweep", f"SELECT config_id, threshold, {_profit} FROM fall GROUP BY config_id, threshold", [_spread, _run.format(by=", threshold", src="spread"), _dd.format(by=", threshold")])(lambda t: metrics.threshold_sweep(t, _th, ORDER, ["config_id"], F.date_format("ts", "yyyy-MM")))
query("best_threshold", "SELECT arg_max(threshold, (round(a, 9), -threshold)) AS threshold, round(max(a), 6) AS avg_pips FROM (SELECT threshold, avg(pips_result) AS a FROM spread GROUP BY threshold HAVING count(*) >= 100)", [_spread])(lambda t: metrics.best_threshold(metrics.threshold_sweep(t.withColumn("config_id", F.lit("all")), _th, ORDER, bucket=F.date_format("ts", "yyyy-MM")), "avg_pips"))
query("ev_threshold", f"SELECT fold, threshold, n_trades, wins, round(p, 6) AS precision, round(ev, 6) + 0.0 AS ev FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY round(ev, 9) DESC, threshold) AS r FROM (SELECT fold, threshold, count(*) AS n_trades, {WIN} AS wins, {WIN} / count(*)::DOUBLE AS p, {WIN} / count(*)::DOUBLE * 100 - (1 - {WIN} / count(*)::DOUBLE) * 40 AS ev FROM spread GROUP BY fold, threshold HAVING count(*) >= 20)) WHERE r = 1", [_spread])(lambda t: metrics.ev_threshold(t, 100, 40, _th, ["fold"]))
_cls = [
    "sc AS (SELECT fold, model_probability AS q, count(*) FILTER (outcome = 'WIN') AS p, count(*) FILTER (outcome <> 'WIN') AS n FROM trades GROUP BY 1, 2)",
    "cum AS (SELECT *, sum(p) OVER (PARTITION BY fold ORDER BY q DESC) AS cp, sum(n) OVER (PARTITION BY fold ORDER BY q DESC) AS cn, sum(p) OVER (PARTITION BY fold) AS ap, sum(n) OVER (PARTITION BY fold) AS an FROM sc)",
    "area AS (SELECT fold, sum((cp - p / 2.0) * n / (ap * an)::DOUBLE) AS roc_auc, sum(p / ap::DOUBLE * (cp / (cp + cn)::DOUBLE)) AS average_precision FROM cum GROUP BY fold)",
    "cell AS (SELECT fold, count(*) FILTER (model_probability >= 0.6 AND outcome = 'WIN') AS tp, count(*) FILTER (model_probability >= 0.6 AND outcome <> 'WIN') AS fp, count(*) FILTER (model_probability < 0.6 AND outcome = 'WIN') AS fn, count(*) FILTER (model_probability < 0.6 AND outcome <> 'WIN') AS tn FROM trades GROUP BY fold)",
]
query("classification_metrics", "SELECT fold, tp, fp, fn, tn, round(roc_auc, 6) AS roc_auc, round(average_precision, 6) AS average_precision, round(tp / (tp + fp)::DOUBLE, 6) AS precision, round(tp / (tp + fn)::DOUBLE, 6) AS recall, round(2 * (tp / (tp + fp)::DOUBLE) * (tp / (tp + fn)::DOUBLE) / (tp / (tp + fp)::DOUBLE + tp / (tp + fn)::DOUBLE), 6) AS f1 FROM cell JOIN area USING (fold)", _cls)(lambda t: metrics.classification(t, ["fold"], 0.6))
FOLDS = f"folds AS (SELECT config_id, tp, sl, hold, fold, count(*) AS n_trades, {WIN} / count(*)::DOUBLE AS precision, avg(pips_result) AS ev, CAST((40 + (sum(l_linenumber) % 4) * 10) AS DOUBLE) / 100 AS threshold FROM trades WHERE model_probability >= 0.6 GROUP BY ALL)"


def folds(t: DataFrame) -> DataFrame:
    return t.filter("model_probability >= 0.6").groupBy("config_id", "tp", "sl", "hold", "fold").agg(F.count(F.lit(1)).alias("n_trades"), (F.count_if(metrics.win()) / F.count(F.lit(1))).alias("precision"), F.avg("pips_result").alias("ev"), ((F.lit(40) + (F.sum("l_linenumber") % 4) * 10).cast("double") / 100).alias("threshold"))


_agg = ", ".join(f"avg({m}) AS {m}_mean, stddev_pop({m}) AS {m}_std, stddev_pop({m}) / nullif(abs(avg({m})), 0) AS {m}_cv" for m in ("precision", "ev"))
_agg_shown = ", ".join(f"round({m}_{s}, 6) + 0.0 AS {m}_{s}" for m in ("precision", "ev") for s in ("mean", "std", "cv"))
query("fold_aggregate", f"SELECT config_id, {_agg_shown}, n_folds FROM (SELECT config_id, {_agg}, count(*) AS n_folds FROM folds GROUP BY config_id)", [FOLDS])(lambda t: metrics.fold_aggregate(folds(t), ["config_id"], ["precision", "ev"]))
query("fold_stability", "SELECT config_id, metric, round(m, 6) + 0.0 AS mean, round(s, 6) AS std, round(s / nullif(abs(m), 0), 6) AS cv, CASE WHEN s / abs(m) < 0.1 THEN 'A' WHEN s / abs(m) < 0.2 THEN 'B' WHEN s / abs(m) < 0.35 THEN 'C' ELSE 'F' END AS grade FROM (" + " UNION ALL ".join(f"SELECT config_id, '{m}' AS metric, avg({m}) AS m, stddev_pop({m}) AS s FROM folds GROUP BY config_id" for m in ("precision", "ev")) + ")", [FOLDS])(lambda t: stats.fold_stability(folds(t), ["config_id"], ["precision", "ev"]))
query("consensus_threshold", "SELECT config_id, round(med, 6) AS median, round(mean, 6) AS mean, CASE WHEN mx * 2 > n THEN mode END AS majority FROM (SELECT config_id, median(threshold) AS med, avg(threshold) AS mean, count(*) AS n FROM folds GROUP BY config_id) JOIN (SELECT config_id, arg_max(threshold, (k, -threshold)) AS mode, max(k) AS mx FROM (SELECT config_id, threshold, count(*) AS k FROM folds GROUP BY 1, 2) GROUP BY config_id) USING (config_id)", [FOLDS])(lambda t: metrics.consensus_threshold(folds(t), ["config_id"]))
query("paired_t", "SELECT a, b, n, round(m, 6) + 0.0 AS mean_difference, round(m / nullif(s / sqrt(n), 0), 5) + 0.0 AS t, (n - 1)::DOUBLE AS df FROM (SELECT x.config_id AS a, y.config_id AS b, count(*) AS n, avg(x.precision - y.precision) AS m, stddev_samp(x.precision - y.precision) AS s FROM folds x JOIN folds y ON x.fold = y.fold AND x.config_id < y.config_id GROUP BY 1, 2) WHERE n > 1", [FOLDS])(lambda t: stats.paired_t(folds(t), "precision").withColumn("t", F.round("t", 5)))
query("brier_ece", "SELECT fold, round(brier, 6) AS brier, round(ece, 6) AS ece FROM (SELECT fold, avg((model_probability - CASE WHEN outcome = 'WIN' THEN 1.0 ELSE 0.0 END) ** 2) AS brier FROM trades GROUP BY fold) JOIN (SELECT fold, sum(n * abs(mp - wr)) / sum(n) AS ece FROM (SELECT fold, least(floor(model_probability * 10), 9) AS bin, count(*) AS n, avg(model_probability) AS mp, avg(CASE WHEN outcome = 'WIN' THEN 1.0 ELSE 0.0 END) AS wr FROM trades GROUP BY 1, 2) GROUP BY fold) USING (fold)")(lambda t: metrics.calibration(t, ["fold"])[1])
query("calibration_curve", "SELECT least(floor(model_probability * 10), 9)::INT AS bin, fold, count(*) AS n, round(avg(model_probability), 6) AS mean_probability, round(avg(CASE WHEN outcome = 'WIN' THEN 1.0 ELSE 0.0 END), 6) AS win_rate FROM trades GROUP BY 1, 2")(lambda t: metrics.calibration(t, ["fold"])[0])

# Ledger

LEDGER = [
    FOLDS,
    f"agg AS (SELECT config_id, tp, sl, hold, {_agg}, avg(precision) AS f1_mean, sum(n_trades)::BIGINT AS total_trades, count(*) AS n_folds FROM folds GROUP BY ALL)",
    "led AS (SELECT *, tp / sl::DOUBLE AS risk_reward, CASE WHEN tp / sl::DOUBLE >= 2.5 THEN 0 ELSE 1 END AS tier, sl / (tp + sl)::DOUBLE AS min_win_rate, list_filter([CASE WHEN precision_mean <= sl / (tp + sl)::DOUBLE + 0.05 THEN 'precision' END, CASE WHEN ev_mean <= 0 THEN 'ev' END, CASE WHEN total_trades / greatest(n_folds, 1)::DOUBLE < 30 THEN 'trades' END, CASE WHEN precision_std / nullif(precision_mean, 0) > 0.3 THEN 'cv' END], lambda x: x IS NOT NULL) AS reasons FROM agg)",
    "ledger AS (SELECT *, len(reasons) = 0 AS passed, CASE WHEN precision_mean - min_win_rate >= 0.15 THEN 'GOLD' WHEN precision_mean - min_win_rate >= 0.08 THEN 'SILVER' ELSE 'BRONZE' END AS medal FROM led)",
]


def ledger(t: DataFrame) -> DataFrame:
    f = folds(t)
    agg = metrics.fold_aggregate(f, ["config_id", "tp", "sl", "hold"], ["precision", "ev"])
    totals = f.groupBy(F.col("config_id").alias("__c")).agg(F.avg("precision").alias("f1_mean"), F.sum("n_trades").alias("total_trades"))
    j = agg.join(totals, F.col("config_id") == F.col("__c")).drop("__c")
    return runs.medals(metrics.acceptance(runs.tiers(j.drop("config_id"))))


query("acceptance", "SELECT config_id, array_to_string(reasons, ',') AS reasons, passed FROM ledger", LEDGER)(lambda t: ledger(t).select("config_id", F.array_join("reasons", ",").alias("reasons"), "passed"))
query("tiers", "SELECT config_id, round(risk_reward, 6) AS risk_reward, tier, round(min_win_rate, 6) AS min_win_rate FROM ledger", LEDGER)(lambda t: ledger(t).select("config_id", "risk_reward", "tier", "min_win_rate"))
query("medals", "SELECT config_id, medal FROM ledger", LEDGER)(lambda t: ledger(t).select("config_id", "medal"))
query("best_config", "SELECT arg_max(config_id, (ev_mean, f1_mean, precision_mean, config_id)) AS config_id, round(max(ev_mean), 6) + 0.0 AS ev_mean FROM ledger", LEDGER)(lambda t: runs.best_config(ledger(t)))
query("run_progress", "SELECT count(*) AS n_done, count(*) FILTER (passed) AS n_passed, count(*) FILTER (NOT passed) AS n_failed, count(*) FILTER (passed AND tier = 0) AS n_tier0, count(*) FILTER (medal = 'GOLD') AS n_gold, round(max(ev_mean), 6) + 0.0 AS best_ev, round(count(*) * 100 / 27.0::DOUBLE, 6) AS percent_done FROM ledger", LEDGER)(lambda t: runs.progress(ledger(t), 27))
query("param_patterns", " UNION ALL ".join(f"SELECT '{n}' AS parameter, {x} AS value, count(*) AS n, round(avg(CASE WHEN passed THEN 1.0 ELSE 0.0 END), 6) AS pass_rate, round(avg(ev_mean), 6) + 0.0 AS mean_ev FROM ledger GROUP BY 2" for n, x in (("tp", "tp::VARCHAR"), ("sl", "sl::VARCHAR"), ("hold", "hold::VARCHAR"), ("rr", "CASE WHEN risk_reward < 1.5 THEN '<1.5' WHEN risk_reward < 2.5 THEN '1.5-2.5' ELSE '>=2.5' END"))), LEDGER)(lambda t: runs.parameter_patterns(ledger(t)))
query("rejection_hist", "SELECT reason, count(*) AS n FROM (SELECT unnest(reasons) AS reason FROM ledger) GROUP BY reason", LEDGER)(lambda t: runs.rejection_histogram(ledger(t)))
query("near_miss", "SELECT config_id, round(ev_mean, 6) + 0.0 AS ev_mean, round(precision_mean, 6) AS precision_mean, array_to_string(reasons, ',') AS issues FROM ledger WHERE NOT passed AND len(reasons) <= 2", LEDGER)(lambda t: runs.near_misses(ledger(t), 2))
query("top_configs", "SELECT config_id, round(ev_mean, 6) + 0.0 AS ev_mean, row_number() OVER (ORDER BY ev_mean DESC, config_id)::INT AS rank, round(max(ev_mean) OVER () - ev_mean, 6) + 0.0 AS behind FROM ledger ORDER BY ev_mean DESC, config_id LIMIT 5", LEDGER)(lambda t: stats.distance_to_best(ledger(t), "ev_mean", 5).select("config_id", "ev_mean", "rank", "behind"))
query("recommendations", "SELECT code, triggered FROM (SELECT avg(CASE WHEN passed THEN 1.0 ELSE 0.0 END) AS rate, max(ev_mean) AS ev, avg(CASE WHEN tier = 0 THEN CASE WHEN passed THEN 1.0 ELSE 0.0 END END) AS r0, avg(CASE WHEN tier = 1 THEN CASE WHEN passed THEN 1.0 ELSE 0.0 END END) AS r1 FROM ledger), LATERAL (VALUES ('no_config_passes', rate = 0), ('few_configs_pass', rate > 0 AND rate < 0.2), ('many_configs_pass', rate >= 0.5), ('no_positive_value', ev <= 0), ('prefer_tier0', coalesce(r0 > r1, false)), ('prefer_tier1', coalesce(r1 > r0, false))) v(code, triggered)", LEDGER)(lambda t: runs.recommendations(ledger(t)))
query("pending_configs", "SELECT g.tp::INT AS tp, g.sl::INT AS sl, g.hold::INT AS hold FROM (SELECT a.tp, b.sl, c.hold FROM range(50, 201, 50) a(tp), range(30, 61, 10) b(sl), range(12, 49, 12) c(hold)) g ANTI JOIN ledger l ON g.tp = l.tp AND g.sl = l.sl AND g.hold = l.hold", LEDGER)(lambda t: runs.pending(runs.parameter_grid(t.sparkSession, (50, 200, 50), (30, 60, 10), (12, 48, 12)), ledger(t)))
query("compare_runs", "SELECT a.n AS n_a, round(a.p, 6) AS pass_a, round(a.e, 6) + 0.0 AS ev_a, b.n AS n_b, round(b.p, 6) AS pass_b, round(b.e, 6) + 0.0 AS ev_b, round(b.p - a.p, 6) + 0.0 AS pass_delta, round(b.e - a.e, 6) + 0.0 AS ev_delta, round((b.e - a.e) / sqrt(a.v / a.n + b.v / b.n), 5) + 0.0 AS t, round((a.v / a.n + b.v / b.n) ** 2 / ((a.v / a.n) ** 2 / (a.n - 1) + (b.v / b.n) ** 2 / (b.n - 1)), 5) AS df FROM (SELECT count(*) n, avg(CASE WHEN passed THEN 1.0 ELSE 0.0 END) p, avg(ev_mean) e, var_samp(ev_mean) v FROM ledger WHERE hold = 12) a, (SELECT count(*) n, avg(CASE WHEN passed THEN 1.0 ELSE 0.0 END) p, avg(ev_mean) e, var_samp(ev_mean) v FROM ledger WHERE hold > 12) b", LEDGER)(lambda t: (lambda x: runs.compare(x.filter("hold = 12"), x.filter("hold > 12")).withColumns({"t": F.round("t", 5), "df": F.round("df", 5)}))(ledger(t)))


# Features chosen in a fold: those whose mean differs between wins and losses by a tenth of a deviation
def selected(t: DataFrame) -> DataFrame:
    chosen = [F.when(F.abs(F.avg(F.when(metrics.win(), F.col(f))) - F.avg(F.when(metrics.loss(), F.col(f)))) > 0.1 * F.stddev_samp(f), F.lit(f)) for f in FEATURES]
    return t.groupBy("config_id", "fold").agg(F.filter(F.array(*chosen), lambda x: x.isNotNull()).alias("features"))


CHOSEN = "chosen AS (SELECT config_id, fold, list_filter([" + ", ".join(f"CASE WHEN abs(avg({f}) FILTER (outcome = 'WIN') - avg({f}) FILTER (outcome = 'LOSS')) > 0.1 * stddev_samp({f}) THEN '{f}' END" for f in FEATURES) + "], lambda x: x IS NOT NULL) AS features FROM trades GROUP BY 1, 2)"
query("feature_frequency", "SELECT feature, count(*) AS n, round(count(*) / (SELECT count(*) FROM chosen)::DOUBLE, 6) AS share FROM (SELECT unnest(features) AS feature FROM chosen) GROUP BY feature", [CHOSEN])(lambda t: runs.feature_frequency(selected(t)))
query("consensus_features", "SELECT config_id, feature, n_folds, round(s, 6) AS share, CASE WHEN s = 1 THEN 'always' WHEN s >= 0.5 THEN 'sometimes' ELSE 'rarely' END AS stability, s >= 0.6 AS consensus FROM (SELECT f.config_id, feature, count(DISTINCT fold) AS n_folds, count(DISTINCT fold) / any_value(k)::DOUBLE AS s FROM (SELECT config_id, fold, unnest(features) AS feature FROM chosen) f JOIN (SELECT config_id, count(DISTINCT fold) AS k FROM chosen GROUP BY 1) USING (config_id) GROUP BY 1, 2)", [CHOSEN])(lambda t: runs.consensus_features(selected(t), ["config_id"]))
query("shared_features", "SELECT coalesce(a.f, b.f) AS feature, CASE WHEN a.f IS NOT NULL AND b.f IS NOT NULL THEN 'both' WHEN a.f IS NOT NULL THEN 'first' ELSE 'second' END AS side FROM (SELECT DISTINCT unnest(features) AS f FROM chosen WHERE fold <= 2) a FULL JOIN (SELECT DISTINCT unnest(features) AS f FROM chosen WHERE fold > 2) b USING (f)".replace("FULL JOIN", "FULL OUTER JOIN").replace("USING (f)", "ON a.f = b.f"), [CHOSEN])(lambda t: (lambda x: runs.shared_features(x.filter("fold <= 2"), x.filter("fold > 2")))(selected(t)))
query("chi_square", "SELECT round(sum(n * n * total / (er * ek)::DOUBLE) - max(total), 5) AS chi2, (count(DISTINCT r) - 1) * (count(DISTINCT k) - 1) AS df FROM (SELECT r, k, n, sum(n) OVER (PARTITION BY r) AS er, sum(n) OVER (PARTITION BY k) AS ek, sum(n) OVER () AS total FROM (SELECT fold AS r, outcome AS k, count(*)::DOUBLE AS n FROM trades GROUP BY 1, 2))")(lambda t: stats.chi_square(t, "fold", F.col("outcome")).select(F.round("chi2", 5).alias("chi2"), "df"))
query("two_groups", f"SELECT fold, n_in, n_out, round(mi, 6) + 0.0 AS mean_in, round(mo, 6) + 0.0 AS mean_out, round((mi - mo) / sqrt(((n_in - 1) * vi + (n_out - 1) * vo) / (n_in + n_out - 2) * (1.0::DOUBLE / n_in + 1.0::DOUBLE / n_out)), 6) + 0.0 AS t, (n_in + n_out - 2)::DOUBLE AS df, round((mi - mo) * 100 / abs(mo), 6) + 0.0 AS edge_percent FROM (SELECT fold, count(*) FILTER (g) AS n_in, count(*) FILTER (NOT g) AS n_out, avg(pips_result) FILTER (g) AS mi, avg(pips_result) FILTER (NOT g) AS mo, var_samp(pips_result) FILTER (g) AS vi, var_samp(pips_result) FILTER (NOT g) AS vo FROM (SELECT *, d1_supports_short = 1 AS g FROM trades) GROUP BY fold)")(lambda t: stats.two_groups(t, ["fold"], F.col("d1_supports_short") == 1, "pips_result"))
for _n, _x, _s in (("effect_by_horizon", "hold % 24", "hold % 24"), ("effect_by_weekday", "weekday(ts)", "isodow(ts) - 1")):
    query(_n, f"SELECT CAST({_s} AS BIGINT) AS g, count(*) AS n_trades, {WIN} AS wins, round(avg(pips_result), 6) + 0.0 AS avg_pips, {RATE} AS win_rate FROM trades GROUP BY 1")(lambda t, x=_x: stats.effect_by(t, F.expr(x).cast("long"), "g"))
query("feature_prefilter")(lambda t: stats.prefilter(t.withColumn("label", metrics.win().cast("int")), FEATURES))

# Folds

query("walk_forward_index", "SELECT key, fold::INT AS fold, floor(n * (1 - 0.1::DOUBLE * (5 - fold + 1) - 0.05))::BIGINT AS train_end, floor(n * (1 - 0.1::DOUBLE * (5 - fold + 1)))::BIGINT AS cal_end, floor(n * (1 - 0.1::DOUBLE * (5 - fold)))::BIGINT AS test_end FROM (SELECT key, count(*) AS n FROM trades GROUP BY key), range(1, 6) f(fold)")(lambda t: runs.index_folds(t, 5))
_folds = ["dates AS (SELECT fold::INT AS fold, (SELECT max(ts)::DATE FROM trades) + 1 - ((4 - fold) * 180)::INT AS test_end FROM range(1, 5) f(fold))"]
query("walk_forward_dates", "SELECT fold, strftime(test_end - 270, '%Y-%m-%d') AS cal_start, strftime(test_end - 180, '%Y-%m-%d') AS test_start, strftime(test_end, '%Y-%m-%d') AS test_end FROM dates", _folds)(lambda t: runs.date_folds(t, 4, 180, 90))
query("walk_forward_rows", f"SELECT d.fold, CASE WHEN ts::DATE < test_end - 270 THEN 'train' WHEN ts::DATE < test_end - 180 THEN 'cal' ELSE 'test' END AS part, count(*) AS n, {WIN} AS wins FROM trades JOIN dates d ON ts::DATE < test_end GROUP BY ALL", _folds)(lambda t: runs.assign_folds(t.drop("fold"), runs.date_folds(t, 4, 180, 90)).groupBy("fold", "part").agg(F.count(F.lit(1)).alias("n"), F.count_if(metrics.win()).alias("wins")))

# Strategy

_pred = "pred AS MATERIALIZED (SELECT row_number() OVER () AS rid, l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(20.01 + l_quantity AS DOUBLE) AS atr_pips, CAST(15 + l_partkey % 60 AS DOUBLE) AS predicted_mae, CAST((l_suppkey % 100) AS DOUBLE) / 100 AS volatility, 0.95 - l_discount AS p30, 0.75 - l_discount * 2 AS p50, 0.5 - l_tax * 3 AS p100 FROM lineitem)"
_stop = "stopped AS (SELECT *, round(greatest(15.0, least(100.0, CASE WHEN volatility > 0.75 THEN greatest(atr_pips * 1.5, predicted_mae * 1.2) WHEN volatility < 0.25 THEN least(atr_pips * 1.5, predicted_mae * 1.2) * 1.1 ELSE (atr_pips * 1.5 + predicted_mae * 1.2) / 2 END))::DOUBLE, 1) AS sl FROM pred)".replace("1.5", "1.5::DOUBLE").replace("1.2", "1.2::DOUBLE").replace("1.1 ", "1.1::DOUBLE ")
_levels = {30: "p30", 40: "p30 + (p50 - p30) * 0.5::DOUBLE", 50: "p50", 80: "p50 + (p100 - p50) * 0.6::DOUBLE", 100: "p100"}
_opt = "opt AS (SELECT s.*, x.tp, x.p, round(x.p * x.tp - (1 - x.p) * sl, 9) AS ev FROM stopped s, LATERAL (VALUES " + ", ".join(f"({k}::DOUBLE, {v})" for k, v in _levels.items()) + ") x(tp, p))"
_pick = "picked AS (SELECT s.l_orderkey, s.l_linenumber, s.l_partkey, s.l_suppkey, s.sl, b.tp, b.p, b.ev FROM stopped s LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY ev DESC, tp) AS r FROM opt WHERE tp / sl >= 1 AND ev >= 0) b ON s.rid = b.rid AND b.r = 1)"
_kelly = "(p * (tp / sl) - (1 - p)) / (tp / sl)"


def _off_ties(df: DataFrame) -> DataFrame:
    """Kelly shares are products of decimals, whose ties at the last digit either engine may round up or down."""
    return shown(df.withColumns({x: F.round(F.col(x) + 1e-9, 6) for x in ("full_kelly", "risk_percent")}))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *(F.expr(x).alias(n) for n, x in {"atr_pips": "20.01D + l_quantity", "predicted_mae": "cast(15 + l_partkey % 60 as double)", "volatility": "cast(l_suppkey % 100 as double) / 100", "p30": "0.95D - l_discount", "p50": "0.75D - l_discount * 2", "p100": "0.5D - l_tax * 3"}.items()))


QUERIES["trade_decision"] = lambda s, d: _off_ties(strategy.decide(predictions(s, d), {30: F.col("p30"), 50: F.col("p50"), 100: F.col("p100")}, [30, 40, 50, 80, 100]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "sl", "action", F.col("optimal_tp").cast("double").alias("optimal_tp"), "tp_probability", "tp_ev", "full_kelly", "risk_percent", "lots", "confidence"))
SQL["trade_decision"] = cte([_pred, _stop, _opt, _pick], f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, sl + 0.0 AS sl, CASE WHEN tp IS NULL THEN 'NO_TRADE' ELSE 'TRADE' END AS action, tp + 0.0 AS optimal_tp, round(p, 6) + 0.0 AS tp_probability, round(ev, 6) + 0.0 AS tp_ev, round({_kelly} + 1e-9::DOUBLE, 6) + 0.0 AS full_kelly, round(CASE WHEN tp IS NULL THEN 0.1 ELSE greatest(0.0, least(0.1, {_kelly} * 0.5)) END::DOUBLE + 1e-9::DOUBLE, 6) AS risk_percent, round(CASE WHEN tp IS NULL THEN 0.1 ELSE greatest(0.0, least(0.1, {_kelly} * 0.5)) END::DOUBLE * 10000 / (sl * 10), 6) AS lots, CASE WHEN {_kelly} > 0.2 THEN 'high' WHEN {_kelly} > 0.1 THEN 'medium' WHEN {_kelly} > 0 THEN 'low' ELSE 'none' END AS confidence FROM picked")
_eq = [
    "eq0 AS (SELECT *, exp(sum(ln(1 + pips_result / 50 * 0.001::DOUBLE)) OVER (PARTITION BY config_id ORDER BY ts, l_orderkey, l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING)) AS equity, pips_result / 50 * 0.001::DOUBLE AS ret FROM trades)",
    "eq AS (SELECT *, (1 - equity / greatest(1.0, max(equity) OVER (PARTITION BY config_id ORDER BY ts, l_orderkey, l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING))) * 100 AS dd FROM eq0)",
]
query("equity_curve", "SELECT config_id, count(*) AS n_trades, round((exp(sum(ln(1 + ret))) - 1) * 100, 5) + 0.0 AS total_return_percent, round(max(dd), 5) + 0.0 AS max_drawdown_percent, round(avg(ret) / stddev_samp(ret) * sqrt(1512), 5) + 0.0 AS sharpe FROM eq GROUP BY config_id", _eq)(lambda t: shown(strategy.equity_summary(strategy.equity(t, ["config_id"], ORDER, 0.001), ["config_id"]), digits=5))
query("regime_performance", f"SELECT d1_is_trending_up, count(*) AS n_trades, {RATE} AS win_rate, round(avg(pips_result), 6) + 0.0 AS avg_pips, avg(pips_result) < 0 AS weak FROM trades GROUP BY 1")(lambda t: strategy.by_regime(t, "d1_is_trending_up"))
# Simulations: both engines scramble numbers alike. The SQL walks every path whole, without blocks' summaries.
_P = strategy.PRIME
_TRADE_KEY = f"((l_orderkey * 8 + l_linenumber) * 48271 + l_partkey * 69621 + l_suppkey) % {_P}"


def _simulated(replace: bool, n: int = 1000) -> tuple[list[str], str]:
    step = lambda name, source, **columns: f"{name} AS (SELECT *, {', '.join(f'{v} AS {k}' for k, v in columns.items())} FROM {source})"
    # Each round of scrambling is a step of its own, so that its value is computed once.
    mixed = lambda name, source, x, sim, out: [
        step(f"{name}a", source, **{f"{out}1": f"(({x}) * 48271 + ({sim}) * 69621 + 11) % {_P}"}), step(f"{name}b", f"{name}a", **{f"{out}2": f"({out}1 * {out}1 + ({x})) % {_P}"}), step(name, f"{name}b", **{out: f"({out}2 * {out}2 + ({sim})) % {_P}"}),
    ]
    ctes = [f"r0 AS (SELECT config_id, ({_TRADE_KEY})::BIGINT AS trade, pips_result AS x, (count(*) OVER (PARTITION BY config_id) + {strategy.BLOCK - 1}) // {strategy.BLOCK} AS n FROM trades)"]
    ctes += mixed("r1", "r0", "trade", f"{strategy.DEAL}::BIGINT", "b") + ["r2 AS (SELECT config_id, trade, x, b % n AS block FROM r1)"]
    ctes += ["r3 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY config_id, block ORDER BY trade, x) - 1 AS k, count(*) OVER (PARTITION BY config_id, block) AS m FROM r2)"]
    ctes += [f"s0 AS (SELECT r3.*, sim::BIGINT AS sim FROM r3, range({n}) t(sim))"] + mixed("s1", "s0", "trade", "sim", "h")
    ctes += mixed("o", f"(SELECT DISTINCT config_id, block, sim::BIGINT AS sim FROM r3, range({n}) t(sim))", "block", f"sim + {strategy.PLACE}", "place")
    if replace:
        ctes += ["s2 AS (SELECT s1.config_id, s1.block, s1.sim, s1.k AS spot, s1.k, v.x FROM s1 JOIN r3 v ON v.config_id = s1.config_id AND v.block = s1.block AND v.k = s1.h % s1.m)"]
    else:
        ctes += ["s2 AS (SELECT config_id, block, sim, h AS spot, k, x FROM s1)"]
    ctes += ["s3 AS (SELECT s2.*, o.place FROM s2 JOIN o USING (config_id, block, sim))"]
    ctes += ["s4 AS (SELECT config_id, sim, x, sum(x) OVER w AS s, row_number() OVER w AS i FROM s3 WINDOW w AS (PARTITION BY config_id, sim ORDER BY place, block, spot, k ROWS UNBOUNDED PRECEDING))"]
    ctes += ["s5 AS (SELECT config_id, sim, x, max(s) OVER (PARTITION BY config_id, sim ORDER BY i ROWS UNBOUNDED PRECEDING) - s AS d FROM s4)"]
    ctes += ["paths AS (SELECT config_id, sim, sum(x) AS total, max(d) AS max_drawdown FROM s5 GROUP BY 1, 2)"]
    select = """SELECT config_id, count(*) AS n_sims, round(avg(total), 6) + 0.0 AS mean_total, round(stddev_samp(total), 6) + 0.0 AS std_total, round(quantile_cont(max_drawdown, 0.05), 6) + 0.0 AS drawdown_p5,
  round(quantile_cont(max_drawdown, 0.95), 6) + 0.0 AS drawdown_p95, round(avg((total > 0)::INT), 6) AS p_profit, round(avg((max_drawdown > 2000)::INT), 6) AS p_ruin FROM paths GROUP BY config_id"""
    return ctes, select


def _simulate(replace: bool):
    return lambda t: strategy.resample_summary(strategy.resample(t, ["config_id"], replace=replace, key=F.expr(_TRADE_KEY)), ["config_id"], 2000)


for _name, _replace in (("permutation_mc", False), ("bootstrap_mc", True)):
    _ctes, _select = _simulated(_replace)
    query(_name, _select, _ctes)(_simulate(_replace))


# Filters, thresholds by fold, fixed folds, reports

_filtered = {"atr_pct": "volume_ratio / 100", "bb_width_pct": "adx / 1000", "d1_trend_strength": "mtf_confluence_score"}
_median, _low = "(SELECT quantile_cont(atr_pct, 0.5) FROM ready)", "(SELECT quantile_cont(bb_width_pct, 0.2) FROM ready)"
_sql_filters = {
    "none": "true", "avoid_mon_fri": "isodow(ts) NOT IN (1, 5)", "london_ny_only": "hour(ts) IN (8, 12, 16)", "avoid_asian": "hour(ts) NOT IN (0, 4)",
    "min_atr": f"atr_pct >= {_median} * 0.7::DOUBLE", "no_squeeze": f"bb_width_pct >= {_low}", "rsi_strong": "(rsi_value > 55 OR rsi_value < 45)", "d1_strong": "d1_trend_strength > 0.5",
}
_sql_filters["basic"] = f"{_sql_filters['avoid_mon_fri']} AND {_sql_filters['avoid_asian']}"
_sql_filters["volatility"] = f"{_sql_filters['min_atr']} AND {_sql_filters['no_squeeze']}"
_sql_filters["all"] = f"{_sql_filters['basic']} AND {_sql_filters['volatility']} AND {_sql_filters['d1_strong']}"
_ready = "ready AS (SELECT * REPLACE (ts + to_hours(CAST(4 * (l_orderkey % 6) AS INTEGER)) AS ts), " + ", ".join(f"{v} AS {k}" for k, v in _filtered.items()) + " FROM trades WHERE model_probability >= 0.6)"
_each_filter = "f AS (" + " UNION ALL ".join(f"SELECT '{n}' AS filter, outcome, pips_result FROM ready WHERE {x}" for n, x in _sql_filters.items()) + ")"
_filter_rows = f"g AS (SELECT filter, count(*) AS n_trades, {WIN} AS wins, sum(pips_result) AS total_pips FROM f GROUP BY 1)"


@query("filter_comparison", """SELECT filter, n_trades, wins, total_pips + 0.0 AS total_pips, round(wins / n_trades::DOUBLE, 6) AS win_rate, round(total_pips / n_trades, 6) + 0.0 AS avg_pips,
  total_pips - b AS gain, n_trades >= 50 AND total_pips > b AS better FROM g, (SELECT total_pips AS b FROM g WHERE filter = 'none')""", [_ready, _each_filter, _filter_rows])
def filter_comparison(t: DataFrame) -> DataFrame:
    """Filters at the threshold 0.6; hours, of which ship dates have none, follow from the order."""
    ready = t.filter("model_probability >= 0.6").withColumn("ts", F.expr("ts + make_interval(0, 0, 0, 0, cast(4 * (l_orderkey % 6) as int))"))
    ready = ready.withColumns({k: F.expr(v) for k, v in _filtered.items()})
    cuts = ready.agg(F.percentile("atr_pct", F.lit(0.5)).alias("atr_pct"), F.percentile("bb_width_pct", F.lit(0.2)).alias("bb_width_pct")).first().asDict()
    empty = {k: float("inf") if v is None else v for k, v in cuts.items()}
    return trades.filter_comparison(ready, signals.trade_filters(empty))


_levels_ = [0.40, 0.45, 0.50, 0.55, 0.60, 0.65, 0.70]
_by_fold = [
    "th AS (SELECT * FROM (VALUES " + ", ".join(f"({x}::DOUBLE)" for x in _levels_) + ") v(threshold))",
    "base AS (SELECT fold, avg(pips_result) AS b FROM trades GROUP BY 1)",
    f"cut AS (SELECT fold, threshold, count(*) AS n, {WIN} AS w, sum(pips_result) AS p FROM trades JOIN th ON model_probability >= threshold GROUP BY 1, 2 HAVING count(*) >= 5)",
    """folds_at AS (SELECT base.fold, th.threshold, coalesce(n, 0) AS n_trades, coalesce(w, 0) AS wins, coalesce(p, 0.0) AS total_pips, coalesce(w / n::DOUBLE, 0.0) AS win_rate,
  coalesce(p / n, 0.0) AS avg_pips, coalesce(p / n > b, false) AS improved FROM base CROSS JOIN th LEFT JOIN cut ON cut.fold = base.fold AND cut.threshold = th.threshold)""",
]
query("fold_thresholds", "SELECT fold, threshold, n_trades, wins, total_pips + 0.0 AS total_pips, round(win_rate, 6) AS win_rate, round(avg_pips, 6) + 0.0 AS avg_pips, improved FROM folds_at", _by_fold)(lambda t: metrics.fold_thresholds(t, _levels_))
query("improved_folds", """SELECT threshold, count(*) AS n_folds, count(*) FILTER (improved) AS n_improved, CAST(sum(n_trades) AS BIGINT) AS n_trades, CAST(sum(wins) AS BIGINT) AS wins, sum(total_pips) + 0.0 AS total_pips,
  round(coalesce(sum(wins) / nullif(sum(n_trades), 0)::DOUBLE, 0.0), 6) AS win_rate, round(coalesce(sum(total_pips) / nullif(sum(n_trades), 0), 0.0), 6) + 0.0 AS avg_pips FROM folds_at GROUP BY 1""", _by_fold)(lambda t: metrics.improved_folds(metrics.fold_thresholds(t, _levels_)))

_fixed = [("Fold1", "1996-01-01", "1997-01-01"), ("Fold2", "1997-01-01", "1998-01-01"), ("Fold3", "1998-01-01", "1999-01-01"), ("Fold4", "1999-01-01", "2000-01-01"), ("Fold5", "2000-01-01", "2001-06-01")]
_fixed_rows = "x AS (" + " UNION ALL ".join(f"SELECT '{n}' AS fold, CASE WHEN ts < DATE '{a}' THEN 'train' WHEN ts < DATE '{b}' THEN 'test' END AS part, outcome, pips_result FROM trades" for n, a, b in _fixed) + ")"
query("fixed_date_folds", f"SELECT fold, part, count(*) AS n, {WIN} AS wins, sum(pips_result) + 0.0 AS pips FROM x WHERE part IS NOT NULL GROUP BY ALL", [_fixed_rows])(
    lambda t: runs.fixed_folds(t.drop("fold"), _fixed).groupBy("fold", "part").agg(F.count(F.lit(1)).alias("n"), F.count_if(metrics.win()).alias("wins"), F.sum("pips_result").alias("pips"))
)
_sections = {"fold": "fold", "regime": "d1_is_trending_up", "config": "config_id"}
_report = "x AS (SELECT 'all' AS section, 'all' AS item, outcome, pips_result FROM trades UNION ALL " + " UNION ALL ".join(f"SELECT '{n}', CAST({x} AS VARCHAR), outcome, pips_result FROM trades" for n, x in _sections.items()) + ")"
query("final_report", f"""SELECT section, item, count(*) AS n_trades, {WIN} AS wins, sum(pips_result) + 0.0 AS total_pips,
  round(sum(CASE WHEN pips_result > 0 THEN pips_result ELSE 0 END) / nullif(sum(CASE WHEN pips_result < 0 THEN -pips_result ELSE 0 END), 0), 6) AS profit_factor,
  {RATE} AS win_rate, round(avg(pips_result), 6) + 0.0 AS avg_pips, sum(pips_result) < 0 AS weak FROM x GROUP BY 1, 2""", [_report])(lambda t: strategy.final_report(t, _sections))
