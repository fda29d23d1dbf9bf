"""SQL twins of the listings."""

from junctura.plans.cycle_sql import END, START

_SITE = "SELECT 'SITE-' || s_suppkey AS signal_id, s_name AS primary_street, (SELECT r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey = s_nationkey) AS region_id, 'C-' || s_suppkey % 7 AS corridor_id, (SELECT n_name FROM nation WHERE n_nationkey = s_nationkey) AS jurisdiction_id, s_suppkey % 9 <> 0 AS enabled FROM supplier"
_AUDIT = """SELECT o_orderkey AS audit_id, 'SITE-' || o_custkey % 40 AS signal_id, o_orderdate AS changed_at, 'user-' || o_custkey % 3 AS changed_by,
CASE o_orderstatus WHEN 'O' THEN 'INSERT' WHEN 'F' THEN 'UPDATE' ELSE 'DELETE' END AS operation, CASE WHEN o_orderstatus <> 'O' THEN '{"priority":"3"}' END AS old_values,
CASE WHEN o_orderstatus IN ('O', 'F') THEN '{"priority":"' || o_orderpriority[1] || '","cost":"' || CAST(trunc(o_totalprice) AS BIGINT) || '"}' END AS new_values FROM orders"""
_CHECK = f"SELECT CASE WHEN user_id % 3 = 0 THEN 'sensor' ELSE 'controller' END AS device_type, 'DEV-' || user_id AS device_id, event_type AS method, make_timestamp(max({START} + (epoch_us(ts) - {START}) // 60)) AS last_event_timestamp, count(*) AS events_ingested, count(*) FILTER (value > 150) AS consecutive_errors FROM events GROUP BY ALL"

SQL = {
    "config_signal_list": f"SELECT * FROM ({_SITE}) WHERE enabled AND corridor_id = 'C-1'",
    "config_audit_pages": f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY signal_id ORDER BY changed_at DESC, audit_id DESC) AS place FROM ({_AUDIT})) WHERE place BETWEEN 6 AND 10 AND signal_id IN (SELECT 'SITE-' || s_suppkey FROM supplier)",
    "config_changed_fields": f"""SELECT audit_id, signal_id, changed_at, 'priority' AS field, old_values->>'priority' AS "old", new_values->>'priority' AS "new" FROM ({_AUDIT}) WHERE old_values->>'priority' IS DISTINCT FROM new_values->>'priority'
UNION ALL SELECT audit_id, signal_id, changed_at, 'cost', NULL, new_values->>'cost' FROM ({_AUDIT}) WHERE new_values IS NOT NULL""",
    "config_checkpoint_list": f"SELECT * FROM ({_CHECK}) WHERE device_type = 'controller'",
    "config_checkpoint_health": f"SELECT device_type, device_id, method, last_event_timestamp, consecutive_errors, CASE WHEN consecutive_errors >= 2 THEN 'erring' WHEN epoch_us(last_event_timestamp) > {END} THEN 'ahead' WHEN epoch_us(last_event_timestamp) < {END - 1_200_000_000} THEN 'stale' ELSE 'ok' END AS state FROM ({_CHECK})",
}
