"""Queries of the snapshot operators over the best-seller views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import snapshots as N
from .registry import register

BOTH = ("rank_snapshots", "rank_items")
PAIRS = "SELECT listing_key, snapshot_id, checked_at, lag(snapshot_id) OVER (PARTITION BY listing_key ORDER BY checked_at, snapshot_id) AS previous_snapshot_id FROM rank_snapshots"
CHANGES = f"""pairs AS ({PAIRS}),
p AS (SELECT q.snapshot_id, i.product_key, i.rank, i.url, i.title FROM rank_items i JOIN pairs q ON i.snapshot_id = q.previous_snapshot_id),
c AS (SELECT snapshot_id, product_key, rank, url, title FROM rank_items),
changes AS (
  SELECT coalesce(c.snapshot_id, p.snapshot_id) AS snapshot_id, coalesce(c.product_key, p.product_key) AS product_key, coalesce(c.url, p.url) AS url, coalesce(c.title, p.title) AS title,
         p.rank AS previous_rank, c.rank AS current_rank, p.rank - c.rank AS delta,
         CASE WHEN p.rank IS NULL THEN 'new' WHEN c.rank IS NULL THEN 'missing' WHEN p.rank > c.rank THEN 'up' WHEN p.rank < c.rank THEN 'down' ELSE 'same' END AS direction
  FROM p FULL OUTER JOIN c ON p.snapshot_id = c.snapshot_id AND p.product_key = c.product_key)"""
SUMMARY = "count(*) FILTER (WHERE direction <> 'missing') AS tracked, count(*) FILTER (WHERE direction = 'new') AS new, count(*) FILTER (WHERE direction = 'up') AS moved_up, count(*) FILTER (WHERE direction = 'down') AS moved_down, count(*) FILTER (WHERE direction = 'same') AS unchanged, count(*) FILTER (WHERE direction = 'missing') AS missing"

register("latest_snapshot", BOTH, lambda h, i: N.latest_snapshot(h, i).select("listing_key", "snapshot_id", "rank", "product_key", "title"),
         "WITH n AS (SELECT snapshot_id, row_number() OVER (PARTITION BY listing_key ORDER BY checked_at DESC, snapshot_id DESC) AS r FROM rank_snapshots) SELECT i.listing_key, i.snapshot_id, i.rank, i.product_key, i.title FROM rank_items i JOIN n USING (snapshot_id) WHERE r = 1")
register("snapshot_history", BOTH, lambda h, i: N.snapshot_history(h, 10).select("listing_key", "snapshot_id", "item_count", "nth"),
         "SELECT listing_key, snapshot_id, item_count, CAST(nth AS INT) AS nth FROM (SELECT *, row_number() OVER (PARTITION BY listing_key ORDER BY checked_at DESC, snapshot_id DESC) AS nth FROM rank_snapshots) WHERE nth <= 10")
register("snapshot_items", BOTH, lambda h, i: N.snapshot_items(i, "Brand#11:1997-03").select("rank", "product_key"),
         "SELECT rank, product_key FROM rank_items WHERE snapshot_id = 'Brand#11:1997-03'")
_MONTH = lambda i: i.withColumn("month", F.right("snapshot_id", F.lit(7)))
_BEFORE = lambda i: i.withColumn("month", F.date_format(F.add_months(F.to_date(F.concat(F.right("snapshot_id", F.lit(7)), F.lit("-01"))), 1), "yyyy-MM"))
register("rank_diff", BOTH, lambda h, i: N.rank_diff(_BEFORE(i), _MONTH(i), on=("listing_key", "month")),
         """SELECT coalesce(c.listing_key, p.listing_key) AS listing_key, coalesce(c.month, p.month) AS month, coalesce(c.product_key, p.product_key) AS product_key, coalesce(c.url, p.url) AS url, coalesce(c.title, p.title) AS title,
  p.rank AS previous_rank, c.rank AS current_rank, p.rank - c.rank AS delta,
  CASE WHEN p.rank IS NULL THEN 'new' WHEN c.rank IS NULL THEN 'missing' WHEN p.rank > c.rank THEN 'up' WHEN p.rank < c.rank THEN 'down' ELSE 'same' END AS direction
FROM (SELECT *, strftime((right(snapshot_id, 7) || '-01')::DATE + INTERVAL 1 MONTH, '%Y-%m') AS month FROM rank_items) p
FULL OUTER JOIN (SELECT *, right(snapshot_id, 7) AS month FROM rank_items) c ON p.listing_key = c.listing_key AND p.month = c.month AND p.product_key = c.product_key""")
register("rank_diff_all", BOTH, N.rank_diff_all, f"WITH {CHANGES} SELECT changes.*, pairs.listing_key, pairs.checked_at, pairs.previous_snapshot_id FROM changes JOIN pairs USING (snapshot_id)")
register("direction", BOTH, lambda h, i: i.select("snapshot_id", "product_key", N.direction(F.col("rank") - 5).alias("direction")),
         "SELECT snapshot_id, product_key, CASE WHEN rank > 5 THEN 'up' WHEN rank < 5 THEN 'down' ELSE 'same' END AS direction FROM rank_items")
register("diff_summary", BOTH, lambda h, i: N.diff_summary(N.rank_diff_all(h, i), "snapshot_id"), f"WITH {CHANGES} SELECT snapshot_id, {SUMMARY} FROM changes GROUP BY snapshot_id")
_ENDS = "WITH n AS (SELECT *, row_number() OVER (PARTITION BY listing_key ORDER BY checked_at, snapshot_id) AS a, row_number() OVER (PARTITION BY listing_key ORDER BY checked_at DESC, snapshot_id DESC) AS b FROM rank_snapshots)"
register("prune_snapshots", BOTH, lambda h, i: N.prune_snapshots(h, i)[0].select("listing_key", "snapshot_id"), f"{_ENDS} SELECT listing_key, snapshot_id FROM n WHERE a = 1 OR b = 1")
register("prune_snapshot_items", BOTH, lambda h, i: N.prune_snapshots(h, i)[1].select("snapshot_id", "product_key", "rank"), f"{_ENDS} SELECT i.snapshot_id, i.product_key, i.rank FROM rank_items i JOIN n USING (snapshot_id) WHERE a = 1 OR b = 1")
register("rank_history", BOTH, N.rank_history, """
SELECT listing_key, product_key, snapshot_id, checked_at, rank, lag(rank) OVER w - rank AS delta, first_value(rank) OVER w - rank AS since_first, min(rank) OVER p AS best, max(rank) OVER p AS worst,
       round(avg(rank) OVER (PARTITION BY listing_key, product_key ORDER BY checked_at, snapshot_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS moving_mean, count(*) OVER p AS runs
FROM rank_items WINDOW p AS (PARTITION BY listing_key, product_key), w AS (PARTITION BY listing_key, product_key ORDER BY checked_at, snapshot_id)""")
register("biggest_movers", BOTH, lambda h, i: N.biggest_movers(N.rank_diff_all(h, i)).select("snapshot_id", "product_key", "delta", "nth"),
         f"WITH {CHANGES} SELECT snapshot_id, product_key, delta, CAST(nth AS INT) AS nth FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_id ORDER BY abs(delta) DESC, product_key) AS nth FROM changes WHERE delta <> 0) WHERE nth <= 5")
register("owner_scope", ("customer",), lambda c: N.owner_scope(c.withColumnRenamed("c_nationkey", "owner"), 7).select("c_custkey", "owner").unionByName(N.owner_scope(c.withColumnRenamed("c_nationkey", "owner"), None).select("c_custkey", "owner")),
         "SELECT c_custkey, c_nationkey AS owner FROM customer WHERE c_nationkey = 7 UNION ALL SELECT c_custkey, c_nationkey FROM customer")
register("backfill_owner", ("customer", "accounts"), lambda c, u: N.backfill_owner(c.select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.col("c_nationkey").cast("long")).alias("owner")), u),
         "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_nationkey::BIGINT ELSE (SELECT user_id FROM accounts WHERE role <> 'admin' ORDER BY created_at, user_id LIMIT 1) END AS owner FROM customer")
register("upsert_latest", ("orders",), lambda o: N.upsert_latest(
    o.where("o_orderkey % 2 = 0").groupBy(F.col("o_custkey").alias("customer")).agg(F.min("o_orderkey").alias("version"), F.lit("old").alias("status"), F.min("o_orderpriority").alias("billing_id")),
    o.where("o_orderkey % 2 = 1").select(F.col("o_custkey").alias("customer"), F.col("o_orderkey").alias("version"), F.col("o_orderstatus").alias("status"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).alias("billing_id")),
    ["customer"], ["version"], ("billing_id",)), """
WITH rows AS (SELECT o_custkey AS customer, 0 AS n, min(o_orderkey) AS version, 'old' AS status, min(o_orderpriority) AS billing_id FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1
  UNION ALL SELECT o_custkey, 1, o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END FROM orders WHERE o_orderkey % 2 = 1),
last AS (SELECT *, row_number() OVER (PARTITION BY customer ORDER BY n DESC, version DESC) AS r FROM rows),
held AS (SELECT customer, billing_id, row_number() OVER (PARTITION BY customer ORDER BY n DESC, version DESC) AS r FROM rows WHERE billing_id IS NOT NULL)
SELECT l.customer, l.version, l.status, h.billing_id FROM last l LEFT JOIN held h ON l.customer = h.customer AND h.r = 1 WHERE l.r = 1""")
register("insert_if_absent", ("credit_ledger",), lambda d: N.insert_if_absent(d.where("event_id % 2 = 0"), d.where("event_id % 2 = 1"), "provider_order_id", ["created_at", "event_id"]).select("event_id", "provider_order_id"), """
WITH fresh AS (SELECT *, row_number() OVER (PARTITION BY provider_order_id ORDER BY created_at, event_id) AS r FROM credit_ledger WHERE event_id % 2 = 1)
SELECT event_id, provider_order_id FROM fresh WHERE provider_order_id IS NULL OR (r = 1 AND provider_order_id NOT IN (SELECT provider_order_id FROM credit_ledger WHERE event_id % 2 = 0 AND provider_order_id IS NOT NULL))""")
