"""Pieces of the SQL that the bar-series queries are compared with: bars, base indicators and window shorthands."""

from __future__ import annotations


def bars(every: str = "4 hours", key: str = "event_type", name: str = "bars") -> str:
    return f"""{name} AS (SELECT CAST({key} AS VARCHAR) AS key, time_bucket(INTERVAL '{every}', ts) AS ts, arg_min(value, (ts, event_id)) AS open,
  max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*) AS volume FROM events GROUP BY 1, 2)"""


def W(n: int) -> str:
    return f"(PARTITION BY key ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def R(agg: str, x: str, n: int, more: str = "") -> str:
    return f"CASE WHEN count({x}) OVER {W(n)} = {n} THEN {agg}({x}{more}) OVER {W(n)} END"


def L(x: str, k: int = 1) -> str:
    return f"lag({x}, {k}) OVER (PARTITION BY key ORDER BY ts)"


def flag(condition: str) -> str:
    return f"CASE WHEN {condition} THEN 1 ELSE 0 END"


def chg(x: str, k: int = 1) -> str:
    return f"({x} / nullif({L(x, k)}, 0) - 1)"


def diff(x: str, k: int = 1) -> str:
    return f"({x} - {L(x, k)})"


def z(x: str, n: int, floor: str = "0") -> str:
    return f"coalesce(({x} - {R('avg', x, n)}) / nullif({R('stddev_samp', x, n)} + {floor}, 0), 0)"


def prank(x: str, n: int) -> str:
    held = f"list({x}) OVER {W(n)}"
    return f"CASE WHEN count({x}) OVER {W(n)} = {n} THEN (len(list_filter({held}, lambda v: v < {x})) + (len(list_filter({held}, lambda v: v = {x})) + 1) / 2.0) / {n} END"


def layer(name: str, source: str, columns: dict[str, str]) -> str:
    return f"{name} AS (SELECT *, " + ",\n  ".join(f"{v} AS {k}" for k, v in columns.items()) + f" FROM {source})"


TRUE_RANGE = f"greatest(high - low, abs(high - {L('close')}), abs(low - {L('close')}))"
BASE = [
    {"_d": diff("close"), "_tr": TRUE_RANGE, "middle_band": R("avg", "close", 20), "_sd": R("stddev_samp", "close", 20), "volume_ratio": f"volume::DOUBLE / nullif({R('avg', 'volume::DOUBLE', 20)}, 0)", "candle_body_pct": "abs(close - open) / (high - low + 0.00001)", "candle_rejection": "(high - greatest(open, close)) / (high - low + 0.00001)"},
    {"_g": "CASE WHEN _d IS NOT NULL THEN greatest(_d, 0.0) END", "_l": "CASE WHEN _d IS NOT NULL THEN greatest(-_d, 0.0) END", "atr": R("avg", "_tr", 14), "upper_band": "middle_band + 2 * _sd", "lower_band": "middle_band - 2 * _sd"},
    {"rsi_value": f"100 - 100 / (1 + ({R('avg', '_g', 14)}) / (({R('avg', '_l', 14)}) + 0.0001))", "atr_pct": "atr / nullif(close, 0)", "bb_position": "(close - lower_band) / nullif(upper_band - lower_band, 0)", "bb_width_pct": "(upper_band - lower_band) / nullif(middle_band, 0)", "trend_strength": "CASE WHEN (close - middle_band) / nullif(2 * _sd, 0) IS NOT NULL THEN greatest(-1.0, least(1.0, (close - middle_band) / nullif(2 * _sd, 0))) END"},
]
ADX = [
    {"_xtr": TRUE_RANGE, "_up": "CASE WHEN " + f"{diff('high')} > ({L('low')} - low) AND {diff('high')} > 0 THEN {diff('high')} ELSE 0.0 END", "_dn": "CASE WHEN " + f"({L('low')} - low) > {diff('high')} AND ({L('low')} - low) > 0 THEN {L('low')} - low ELSE 0.0 END"},
    {"_xatr": R("avg", "_xtr", 14), "_pu": R("avg", "_up", 14), "_pd": R("avg", "_dn", 14)},
    {"plus_di": "100 * _pu / nullif(_xatr, 0)", "minus_di": "100 * _pd / nullif(_xatr, 0)"},
    {"_dx": "100 * abs(plus_di - minus_di) / nullif(plus_di + minus_di, 0)", "di_diff": "plus_di - minus_di", "di_ratio": "plus_di / (minus_di + 0.001)"},
    {"adx": R("avg", "_dx", 14)},
    {"adx_slope": diff("adx", 3), "is_trending": flag("adx > 25"), "is_ranging": flag("adx < 20"), "trend_direction_h4": f"coalesce(sign(close - {R('avg', 'close', 20)})::DOUBLE, 0)"},
]


def stack(source: str, layers: list[dict[str, str]], prefix: str) -> tuple[list[str], str]:
    """CTEs of layers on top of source, and the name of the last one."""
    out = []
    for i, x in enumerate(layers):
        out.append(layer(f"{prefix}{i}", source, x))
        source = f"{prefix}{i}"
    return out, source


def query(ctes: list[str], select: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + select


STAMP = "strftime(ts, '%Y-%m-%d %H:%M:%S')"


def rounded(x: str, n: int = 6) -> str:
    return f"round({x}, {n}) + 0.0 AS {x}"


def feature_query(layers: list[dict[str, str]], *, base: bool = True, whole: tuple[str, ...] = (), digits: int = 6, extra: list[list[dict[str, str]]] | None = None, ctes: list[str] | None = None, source: str = "bars") -> str:
    """SQL of a feature family: all columns of its layers but helpers, rounded unless they are whole numbers."""
    out, last = list(ctes or [bars()]), source
    for i, part in enumerate(([BASE] if base else []) + (extra or []) + [layers]):
        more, last = stack(last, part, f"s{i}_")
        out += more
    names = [k for x in layers for k in x if not k.startswith("_")]
    return query(out, f"SELECT key, {STAMP} AS ts, " + ", ".join(f"CAST({k} AS INT) AS {k}" if k in whole or layers_flag(layers, k) else rounded(k, digits) for k in names) + f" FROM {last}")


def layers_flag(layers: list[dict[str, str]], name: str) -> bool:
    """Whether a column is a flag."""
    return any(x.get(name, "").startswith("CASE WHEN ") and x[name].endswith(" THEN 1 ELSE 0 END") for x in layers)
