"""Queries of what users are told: filings, and stored screens that arriving positions pass. The SQL twin of screens evaluates each by itself."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import alerts, percolate
from .catalog import PERIOD, add
from .derived import Derived
from .people import ALERT_SQL, NOW
from .screens import SQL as SCREEN_SQL
from .screens import tables, test_sql

#: Stored screens as they were saved: id, name, filters, how many of those don't read any more, and what the twin asks of a change.
SAVED = [
    (1, "New buys", {"action": ["new"]}, 0, {"action": ["new"]}),
    (2, "Large adds", {"action": ["add"], "min_value": ["30000"]}, 0, {"action": ["add"], "min_value": 30000}),
    (3, "Three filers", {"filer_slug": ["supplier-000000001", "supplier-000000007", "gone"]}, 1, {"filer_slug": ["supplier-000000001", "supplier-000000007"]}),
    (4, "Big bets", {"filer_category": ["activist", "quant"], "min_weight": ["4"]}, 0, {"filer_category": ["activist", "quant"], "min_weight": 4}),
    (5, "Bought and held", {"net_flow": ["buy"], "min_holders": ["25"]}, 0, {"net_flow": "buy", "min_holders": 25}),
    (6, "Leaving", {"action": ["exit", "trim"], "min_exits": ["15"]}, 0, {"action": ["exit", "trim"], "min_exits": 15}),
    (7, "Twice added", {"added_quarters": ["2"]}, 0, {"added_quarters": 2}),
    (8, "Clusters", {"insider_cluster": ["true"]}, 0, {"insider_cluster": True}),
    (9, "Insiders", {"insider_buyers": ["8"], "is_new_position": ["true"]}, 0, {"insider_buyers": 8, "is_new_position": True}),
    (10, "Misspelled", {"action": ["new"], "min_wieght": ["5"]}, 1, {"action": ["new"]}),
    (11, "Shrinking", {"weight_change": ["-2"]}, 0, {"weight_change": -2}),
    (12, "No cluster", {"insider_cluster": ["False"], "min_value": ["much"]}, 1, {"insider_cluster": False}),
    (13, "Nobody", {"filer_slug": ["gone"]}, 1, {}),
    (14, "Sold by many", {"net_flow": ["sell"], "action": ["trim", "bought"]}, 1, {"net_flow": "sell"}),
    (15, "No rule", {"action": ["new"]}, 0, None),
]


def _saved(t: Derived) -> DataFrame:
    return t.spark.createDataFrame([(i, name, filters) for i, name, filters, _, _ in SAVED], "screen_id long, name string, filters map<string, array<string>>")


_RULES = "SELECT id AS rule_id, id % 5 AS user_id, id % 14 + 1 AS target, CAST(concat('1998-10-', lpad(CAST(id % 28 + 1 AS STRING), 2, '0')) AS TIMESTAMP) AS created_at FROM"


def _fresh(t: Derived) -> DataFrame:
    return alerts.fresh_pairs(t.snapshot, t.filing, NOW)


def _heard(t: Derived) -> DataFrame:
    return percolate.heard_screens(_saved(t), t.spark.sql(f"{_RULES} range(40)"), tables(t), _fresh(t).where(F.col("period") == F.lit(PERIOD).cast("date"))).withColumn("largest", F.element_at("stocks", 1))


_PASSED = " UNION ALL ".join(
    f"SELECT {i} AS screen_id, '{name}' AS screen, {ignored} AS ignored, c.* FROM change c WHERE c.period = DATE '{PERIOD}' AND {test_sql(read)}" for i, name, _, ignored, read in SAVED if read is not None
)
add(
    "str10_screen_events", "rule_id:l user_id:l screen_id:l filer_id:l period:d matches:l ignored:l largest:s title:s dedupe_key:s",
    """SELECT rule_id, user_id, e.*, e.filer_name || ': ' || matches || CASE WHEN matches = 1 THEN ' position passes ' ELSE ' positions pass ' END || '“' || screen || '”' AS title,
        'saved_filter_match:' || screen_id || ':' || slug || ':' || year(period) || 'Q' || quarter(period) AS dedupe_key
      FROM (SELECT screen_id, p.filer_id, p.period, any_value(screen) AS screen, any_value(ignored) AS ignored, any_value(filed_at) AS filed_at, any_value(filer.name) AS filer_name, any_value(slug) AS slug,
              count(*) AS matches, arg_min(coalesce(security.ticker, security.name), (-value_usd, cusip)) AS largest
            FROM passed p JOIN fresh ON fresh.filer_id = p.filer_id AND fresh.period = p.period JOIN filer ON filer.filer_id = p.filer_id JOIN security USING (security_id)
            WHERE NOT (action IN ('add', 'trim') AND EXISTS (SELECT 1 FROM splitlike z WHERE NOT z.is_split AND z.filer_id = p.filer_id AND z.period = p.period AND z.security_id = p.security_id)) GROUP BY 1, 2, 3) e
      JOIN rule ON rule.target = e.screen_id WHERE created_at <= filed_at""",
    **(SCREEN_SQL | ALERT_SQL | {"passed": _PASSED, "rule": _RULES.replace("STRING", "VARCHAR") + " range(40) r(id)"}),
)(_heard)
add(
    "str10_filed_events", "filer_id:l period:d filed_at:t positions:l value_usd:f new:l add:l trim:l exit:l",
    """SELECT s.*, filed_at, coalesce(new, 0) AS new, coalesce(adds, 0) AS "add", coalesce(trim, 0) AS trim, coalesce("exit", 0) AS "exit" FROM (SELECT filer_id, period, count(*) AS positions, sum(value_usd) AS value_usd FROM snapshot GROUP BY 1, 2) s JOIN fresh USING (filer_id, period)
      LEFT JOIN (SELECT filer_id, period, count(*) FILTER (action = 'new') AS new, count(*) FILTER (action = 'add') AS adds, count(*) FILTER (action = 'trim') AS trim, count(*) FILTER (action = 'exit') AS "exit" FROM told GROUP BY 1, 2) USING (filer_id, period)""",
    **ALERT_SQL,
)(lambda t: alerts.filed_events(t.change, _fresh(t), t.snapshot, t.filing))
