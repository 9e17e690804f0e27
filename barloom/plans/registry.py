"""Registered queries over the bar-series operators, and the SQL that gives the same rows."""

from __future__ import annotations

from . import feature_queries, label_queries, model_queries, series_queries, trade_queries

QUERIES = feature_queries.QUERIES | label_queries.QUERIES | trade_queries.QUERIES | model_queries.QUERIES | series_queries.QUERIES
SQL = feature_queries.SQL | label_queries.SQL | trade_queries.SQL | series_queries.SQL

SQL["fold_ledger"] = model_queries.FOLD_SQL
SQL["stream_asof_prev_day"] = SQL["asof_prev_day"]  # the same bars, joined in batch

#: Also run over one series for each user.
BY_USER = ("f_zscores", "f_percentiles", "f_adx", "mtf_features", "label_grid", "signals_31")
for _name in BY_USER:
    QUERIES[f"{_name}_user"] = feature_queries.by_user(QUERIES[_name])
    SQL[f"{_name}_user"] = SQL[_name].replace("CAST(event_type AS VARCHAR)", "CAST(user_id AS VARCHAR)")
