"""DuckDB text of the bar views that the SQL twins share."""

LINEITEM_BARS = """
lb AS MATERIALIZED (
  SELECT CASE l_returnflag WHEN 'N' THEN 'WIN' WHEN 'A' THEN 'ES' WHEN 'R' THEN 'WDO' END AS symbol, l_shipdate::TIMESTAMP AS ts,
    arg_min(l_extendedprice, o)::DOUBLE AS open, max(l_extendedprice)::DOUBLE AS high, min(l_extendedprice)::DOUBLE AS low, arg_max(l_extendedprice, o)::DOUBLE AS close,
    count(*)::DOUBLE AS trades, sum(l_quantity)::DOUBLE AS volume
  FROM (SELECT *, row(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS o FROM lineitem WHERE l_returnflag IN ('N', 'A', 'R')) GROUP BY 1, 2
)"""

EVENT_BARS = """
eb AS MATERIALIZED (
  SELECT CASE event_type WHEN 'view' THEN 'WIN' WHEN 'click' THEN 'ES' WHEN 'purchase' THEN 'WDO' END AS symbol, date_trunc('hour', ts::TIMESTAMP) + INTERVAL 1 HOUR AS ts,
    arg_min(value, row(ts, event_id))::DOUBLE AS open, max(value)::DOUBLE AS high, min(value)::DOUBLE AS low, arg_max(value, row(ts, event_id))::DOUBLE AS close,
    count(*)::DOUBLE AS trades, count(*)::DOUBLE AS volume
  FROM events WHERE event_type IN ('view', 'click', 'purchase') AND value IS NOT NULL GROUP BY 1, 2
)"""


def frame(view: str) -> str:
    return f"""
b AS MATERIALIZED (
  SELECT m.ts, m.open, m.high, m.low, m.close, m.trades, m.volume, (m.high + m.low + m.close) / 3 AS vwap, e.close AS ref_ES, w.close AS ref_WDO, m.ts::DATE AS day,
    hour(m.ts) * 60 + minute(m.ts) AS tod
  FROM {view} m JOIN {view} e ON e.ts = m.ts AND e.symbol = 'ES' JOIN {view} w ON w.ts = m.ts AND w.symbol = 'WDO' WHERE m.symbol = 'WIN'
)"""


L = f"WITH {LINEITEM_BARS}, {frame('lb')}"
E = f"WITH {EVENT_BARS}, {frame('eb')}"
