"""Queries of the usage, account and retention reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import usage as A
from .registry import columns, register
from .views import AS_OF

_T = f"TIMESTAMP '{AS_OF}'"
_c = F.col
_DAILY = f"SELECT user_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, count(*) AS total, count(*) FILTER (WHERE ok) AS ok, count(*) FILTER (WHERE NOT ok) AS failed FROM usage_events WHERE ts > {_T} - INTERVAL 30 DAY GROUP BY 1, 2"
register("usage_daily", ("usage_events",), lambda e: A.usage_daily(e, AS_OF, 30), _DAILY)
register("usage_recent", ("usage_events",), lambda e: A.usage_recent(e, AS_OF, 30, 5).select("user_id", "event_id", "nth"),
         f"SELECT user_id, event_id, CAST(nth AS INT) AS nth FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS nth FROM usage_events WHERE ts > {_T} - INTERVAL 30 DAY) WHERE nth <= 5")
register("success_rate", ("usage_events",), lambda e: A.success_rate(A.usage_daily(e, AS_OF, 30)),
         f"SELECT user_id, CAST(sum(ok) + sum(failed) AS BIGINT) AS total, CAST(CASE WHEN sum(ok) + sum(failed) = 0 THEN 100 ELSE floor(sum(ok) * 100.0 / (sum(ok) + sum(failed)) + 0.5) END AS INT) AS percent FROM ({_DAILY}) GROUP BY user_id")
_UNITS = f"SELECT user_id, CAST(coalesce(sum(units) FILTER (WHERE ts > {_T} - INTERVAL 5 HOUR), 0) AS BIGINT) AS units_5h, CAST(sum(units) AS BIGINT) AS units_7d FROM usage_events WHERE billable AND ts > {_T} - INTERVAL 168 HOUR GROUP BY user_id"
register("billable_units_window", ("usage_events",), lambda e: A.billable_units_window(e, AS_OF), _UNITS)
register("units_before_event", ("usage_events",), lambda e: A.units_before_event(e).select("event_id", "units_so_far"),
         "SELECT event_id, CAST(coalesce(sum(units) FILTER (WHERE billable) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '4 hours 59 minutes 59.999999 seconds' PRECEDING AND CURRENT ROW), 0) AS BIGINT) AS units_so_far FROM usage_events")
_BALANCE = "SELECT a.user_id, CAST(coalesce(sum(l.units_delta), 0) AS BIGINT) AS balance FROM accounts a LEFT JOIN credit_ledger l ON a.user_id = l.user_id GROUP BY a.user_id"
register("topup_balance", ("credit_ledger", "accounts"), A.topup_balance, _BALANCE)
_PLAN = f"""SELECT user_id, CASE WHEN (manual_unlimited OR manual_plan_code IS NOT NULL) AND (manual_expires_at IS NULL OR manual_expires_at > {_T}) THEN CASE WHEN manual_unlimited THEN 'unlimited' ELSE manual_plan_code END
  WHEN billing_status IN ('active', 'trialing') AND (current_period_end IS NULL OR current_period_end > {_T}) THEN plan_code ELSE 'free' END AS plan FROM entitlements"""
register("effective_plan", ("entitlements",), lambda e: A.effective_plan(e, AS_OF).select("user_id", "plan"), _PLAN)
_DIM = "(VALUES ('free', 'Free', 0, 20, 100), ('starter', 'Starter', 19, 150, 750), ('pro', 'Pro', 39, 500, 2500), ('scale', 'Scale', 129, 2000, 10000), ('unlimited', 'Unlimited', 0, NULL, NULL)) AS d(plan, name, price_eur, limit_5h, limit_7d)"
register("plan_dim", ("entitlements",), lambda e: A.effective_plan(e, AS_OF).groupBy("plan").agg(F.count(F.lit(1)).alias("users")).join(F.broadcast(A.plan_dim(e.sparkSession)), "plan", "right").fillna(0, ["users"]),
         f"SELECT d.*, coalesce(n.users, 0) AS users FROM {_DIM} LEFT JOIN (SELECT plan, count(*) AS users FROM ({_PLAN}) GROUP BY plan) n ON d.plan = n.plan")
_OVER = f"""SELECT b.user_id, coalesce(p.plan, 'free') AS plan, b.balance, coalesce(u.units_5h, 0) AS units_5h, coalesce(u.units_7d, 0) AS units_7d, d.limit_5h, d.limit_7d,
  CAST(CASE WHEN d.limit_5h > 0 THEN least(100, floor(coalesce(u.units_5h, 0) * 100.0 / d.limit_5h + 0.5)) END AS INT) AS percent_5h, CAST(CASE WHEN d.limit_7d > 0 THEN least(100, floor(coalesce(u.units_7d, 0) * 100.0 / d.limit_7d + 0.5)) END AS INT) AS percent_7d
FROM ({_BALANCE}) b LEFT JOIN ({_PLAN}) p ON b.user_id = p.user_id LEFT JOIN ({_UNITS}) u ON b.user_id = u.user_id JOIN {_DIM} ON d.plan = coalesce(p.plan, 'free')"""
_ALL = ("usage_events", "credit_ledger", "entitlements", "accounts")
register("billing_overview", _ALL, lambda e, l, n, a: A.billing_overview(e, l, n, a, AS_OF), _OVER)
register("quota_decision", _ALL, lambda e, l, n, a: A.quota_decision(A.billing_overview(e, l, n, a, AS_OF), _c("user_id") % 40 + 1).select("user_id", "needed", "allowed", "debit"),
         f"WITH o AS ({_OVER}), q AS (SELECT user_id, balance, CASE WHEN limit_5h IS NULL THEN 0 ELSE greatest(0, user_id % 40 + 1 - least(greatest(0, limit_5h - units_5h), greatest(0, limit_7d - units_7d))) END AS needed FROM o) SELECT user_id, CAST(needed AS BIGINT) AS needed, needed <= balance AS allowed, CASE WHEN needed <= balance THEN CAST(needed AS BIGINT) ELSE 0 END AS debit FROM q")
columns("listing_units", "part", ("p_partkey",), {"units": (lambda: A.listing_units(F.when(_c("p_size") % 9 != 0, _c("p_size") * 7), _c("p_partkey") % 2 == 0), "CAST(CASE WHEN p_partkey % 2 = 0 THEN greatest(2, ceil(least(250, coalesce(CASE WHEN p_size % 9 <> 0 THEN p_size * 7 END, 150)) / 20)) ELSE greatest(1, ceil(least(250, coalesce(CASE WHEN p_size % 9 <> 0 THEN p_size * 7 END, 150)) / 50)) END AS INT)")})
register("user_directory", ("accounts", "entitlements"), A.user_directory,
         "SELECT a.user_id, lower(trim(a.email)) AS email, a.role, a.created_at, coalesce(e.plan_code, 'free') AS plan_code, coalesce(e.billing_status, 'none') AS billing_status, coalesce(e.manual_unlimited, false) AS manual_unlimited FROM accounts a LEFT JOIN entitlements e ON a.user_id = e.user_id")
register("invite_status", ("tokens",), lambda t: A.invite_status(t, AS_OF).select("token_id", "status"), f"SELECT token_id, CASE WHEN used_at IS NOT NULL THEN 'used' WHEN expires_at <= {_T} THEN 'expired' ELSE 'pending' END AS status FROM tokens")
register("live_tokens", ("tokens",), lambda t: A.live_tokens(t, AS_OF).select("token_id", "user_id"), f"SELECT token_id, user_id FROM tokens WHERE used_at IS NULL AND revoked_at IS NULL AND expires_at > {_T}")
register("early_access", ("tokens",), lambda t: A.early_access(t).select("token_id", "total"),
         "WITH k AS (SELECT *, row_number() OVER (PARTITION BY provider_order_id ORDER BY created_at, token_id) AS r FROM tokens), u AS (SELECT * FROM k WHERE provider_order_id IS NULL OR r = 1) SELECT token_id, (SELECT count(*) FROM u) AS total FROM u ORDER BY created_at DESC, token_id DESC LIMIT 500")
columns("proxy_source_label", "usage_events", ("event_id",), {"label": (lambda: A.proxy_source_label(F.when(_c("event_id") % 2 == 0, " p "), F.when(_c("event_id") % 3 == 0, _c("endpoint")), F.when(_c("event_id") % 5 == 0, "  ").otherwise(_c("used_proxy"))), "CASE WHEN event_id % 2 = 0 THEN 'request' WHEN event_id % 3 = 0 THEN 'user' WHEN event_id % 5 = 0 THEN 'none' WHEN used_proxy IS NOT NULL THEN 'env' ELSE 'none' END")})
_HOOK = """CASE o_orderkey % 4 WHEN 0 THEN 'subscription.updated' WHEN 1 THEN 'order.paid' WHEN 2 THEN 'customer.created' ELSE 'order.created' END"""
_BODY = f"""'{{"type":"' || {_HOOK} || '","data":{{"id":"d' || CAST(o_orderkey AS STRING) || '",' || CASE WHEN o_orderkey % 3 = 0 THEN '"customer":{{"email":" C' || CAST(o_custkey AS STRING) || '@X.Y "}},' ELSE '"customer_email":"e@x.y",' END || '"product_id":"prod-' || CAST(o_orderkey % 5 AS STRING) || '","status":"active","current_period_end":"2024-03-01 00:00:00"}}}}'"""
register("subscription_state", ("orders",), lambda o: A.subscription_state(o.select(F.col("o_orderkey").alias("id"), F.expr(_BODY).alias("body")), o.sparkSession.createDataFrame([("prod-0", "starter", None), ("prod-1", None, 500), ("prod-2", None, 2500)], "product_id string, plan_code string, units int")).select("id", "kind", "email", "plan_code", "units", "provider_id", "period_end"),
         f"WITH w AS (SELECT o_orderkey AS id, json({_BODY}) AS v FROM orders), r AS (SELECT id, v->>'$.type' AS type, lower(trim(coalesce(v->>'$.data.customer.email', v->>'$.data.customer_email'))) AS email, v->>'$.data.product_id' AS product_id, v->>'$.data.id' AS provider_id, CAST(v->>'$.data.current_period_end' AS TIMESTAMP) AS period_end FROM w), "
         "j AS (SELECT r.*, p.plan_code, p.units FROM r LEFT JOIN (VALUES ('prod-0', 'starter', NULL), ('prod-1', NULL, 500), ('prod-2', NULL, 2500)) AS p(product_id, plan_code, units) ON r.product_id = p.product_id) "
         "SELECT id, CASE WHEN type LIKE 'subscription.%' THEN 'subscription' ELSE 'order' END AS kind, email, plan_code, units, provider_id, period_end FROM j WHERE type LIKE 'subscription.%' OR (type LIKE 'order.%' AND units IS NOT NULL)")
register("api_key_report", ("tokens",), A.api_key_report, "SELECT user_id, token_id, created_at, last_used_at, revoked_at IS NULL AS active, CAST(row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, token_id DESC) AS INT) AS nth FROM tokens")
register("delivery_billing", ("fetch_log",), lambda f: A.delivery_billing(f).select("page_id", "attempt", "billable", "units"), "SELECT page_id, attempt, status BETWEEN 200 AND 299 AS billable, CASE WHEN status BETWEEN 200 AND 299 THEN 1 ELSE 0 END AS units FROM fetch_log")
register("endpoint_usage_cube", ("usage_events",), A.endpoint_usage_cube, "SELECT coalesce(endpoint, '*') AS endpoint, coalesce(used_proxy, '*') AS used_proxy, count(*) AS calls, count(*) FILTER (WHERE ok) AS ok_calls, CAST(sum(units) AS BIGINT) AS units FROM (SELECT endpoint, coalesce(used_proxy, 'none') AS used_proxy, ok, units FROM usage_events) GROUP BY CUBE (endpoint, used_proxy)")
register("runs_expired", ("runs",), lambda r: A.runs_expired(r, AS_OF, 14).select("run_id"), f"SELECT run_id FROM runs WHERE created_at < {_T} - INTERVAL 14 DAY")
register("runs_over_cap", ("runs",), lambda r: A.runs_over_cap(r, 50).select("run_id", "domain"), "SELECT run_id, domain FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY created_at DESC, run_id DESC) AS nth FROM runs) WHERE nth > 50")
register("storage_stats", ("runs",), lambda r: A.storage_stats(r, 10**11), "SELECT domain, count(*) AS runs, CAST(sum(bytes) AS BIGINT) AS bytes, least(100.0, round(sum(bytes) * 100.0 / 100000000000, 6)) AS percent FROM runs GROUP BY domain")
