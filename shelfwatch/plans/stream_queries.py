"""Batch forms of the streaming operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import streams as Z
from .registry import register

_c = F.col
stamped = lambda e: e.withColumn("ts", _c("ts").cast("timestamp"))
PROGRESS = lambda e: e.select(_c("user_id").cast("string").alias("run_id"), _c("event_id").alias("seq"), F.when(_c("event_id") % 50 == 0, "complete").otherwise(_c("event_type")).alias("phase"), _c("props").alias("message"))
register("progress_tail", ("events",), lambda e: Z.progress_tail(PROGRESS(e), 5).select("run_id", "seq"), """
WITH p AS (SELECT CAST(user_id AS VARCHAR) AS run_id, event_id AS seq, event_id % 50 = 0 AS done FROM events), d AS (SELECT run_id, max(seq) FILTER (WHERE done) AS last FROM p GROUP BY run_id),
r AS (SELECT p.run_id, p.seq, row_number() OVER (PARTITION BY p.run_id ORDER BY p.seq DESC) AS n FROM p JOIN d USING (run_id) WHERE last IS NULL OR seq > last) SELECT run_id, seq FROM r WHERE n <= 5""")
register("rate_limit_windows", ("usage_events",), lambda e: Z.rate_limit_windows(stamped(e), 1), "SELECT CAST(date_trunc('minute', ts) AS TIMESTAMP) AS minute, user_id, count(*) AS requests, count(*) > 1 AS limited FROM usage_events GROUP BY 1, 2")
register("usage_stream_daily", ("usage_events",), lambda e: Z.usage_stream_daily(stamped(e)), "SELECT user_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, count(*) AS total, count(*) FILTER (WHERE ok) AS ok, count(*) FILTER (WHERE NOT ok) AS failed FROM usage_events GROUP BY 1, 2")
register("quota_stream", ("usage_events",), lambda e: Z.quota_stream(stamped(e), 5, "1 hour"), """
SELECT user_id, CAST(time_bucket(INTERVAL 1 HOUR, ts) + k * INTERVAL 1 HOUR AS TIMESTAMP) AS until, CAST(sum(units) AS BIGINT) AS units FROM usage_events CROSS JOIN (SELECT unnest(range(1, 6)) AS k) WHERE billable GROUP BY 1, 2""")
register("idempotent_events", ("credit_ledger",), lambda d: Z.idempotent_events(d.withColumn("ts", _c("created_at")), "provider_order_id").select("event_id"), """
SELECT event_id FROM (SELECT *, row_number() OVER (PARTITION BY provider_order_id ORDER BY created_at, event_id) AS n FROM credit_ledger) WHERE provider_order_id IS NULL OR n = 1""")
