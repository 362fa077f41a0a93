"""Usage, quota and account reports, and run retention. Time is always the parameter ``as_of``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

# Plans with their limits (null: none) and top-up packs.
PLANS = [
    ("free", "Free", 0, 20, 100), ("starter", "Starter", 19, 150, 750), ("pro", "Pro", 39, 500, 2500),
    ("scale", "Scale", 129, 2000, 10000), ("unlimited", "Unlimited", 0, None, None),
]
PACKS = [("boost_500", 8, 500), ("boost_2500", 28, 2500), ("boost_10000", 98, 10000)]


def _at(as_of: str) -> Column:
    return F.lit(as_of).cast("timestamp")


def _since(ts: Column, as_of: str, hours: int) -> Column:
    return ts > _at(as_of) - F.make_dt_interval(hours=F.lit(hours))


def usage_daily(events: DataFrame, as_of: str, days: int) -> DataFrame:
    """Calls by user and day in the last days. An unknown outcome counts in the total only."""
    recent = events.where(_since(F.col("ts"), as_of, 24 * days))
    return recent.groupBy("user_id", F.date_trunc("day", "ts").alias("day")).agg(
        F.count(F.lit(1)).alias("total"), F.count_if("ok").alias("ok"), F.count_if(~F.col("ok")).alias("failed")
    )


def usage_recent(events: DataFrame, as_of: str, days: int, limit: int) -> DataFrame:
    """Each user's newest events of the last days, ``limit`` at most."""
    order = Window.partitionBy("user_id").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    recent = events.where(_since(F.col("ts"), as_of, 24 * days))
    return recent.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= limit)


def success_rate(daily: DataFrame) -> DataFrame:
    """By user, of the calls with a known outcome; 100 where there are none."""
    sums = daily.groupBy("user_id").agg(F.sum("ok").alias("ok"), F.sum("failed").alias("failed"))
    known = F.col("ok") + F.col("failed")
    return sums.select("user_id", known.alias("total"), F.when(known == 0, 100).otherwise(F.floor(F.col("ok") * 100 / known + 0.5)).cast("int").alias("percent"))


def billable_units_window(events: DataFrame, as_of: str) -> DataFrame:
    """Billable units by user in the last five hours and seven days."""
    units = lambda hours: F.coalesce(F.sum(F.when(_since(F.col("ts"), as_of, hours), F.col("units"))), F.lit(0))
    recent = events.where(F.col("billable") & _since(F.col("ts"), as_of, 168))
    return recent.groupBy("user_id").agg(units(5).alias("units_5h"), units(168).alias("units_7d"))


#: Microseconds of the buckets that a user's events are dealt into, and of an hour.
BUCKET, HOUR = 300_000_000, 3_600_000_000


def units_before_event(events: DataFrame, hours: int = 5) -> DataFrame:
    """At each event, its user's billable units in the hours up to it; further columns stay.

    Whole buckets of five minutes are summed first. What a window holds of its first and last bucket comes from one running
    sum within the bucket: an event counts from its time on, and is taken off again as many hours later. So one user's events
    spread over tasks by bucket, and no task holds more of them than two buckets have.
    """
    span = hours * HOUR // BUCKET
    ts = F.unix_micros(F.col("ts").cast("timestamp"))
    units = F.coalesce(F.when(F.col("billable"), F.col("units")), F.lit(0)).cast("long")
    rows = events.select("user_id", ts.alias("_at"), units.alias("_units"), F.struct(*events.columns).alias("_row"))
    rows = rows.withColumn("_bucket", F.floor(F.col("_at") / BUCKET))
    ended = rows.where("_units <> 0").select("user_id", (F.col("_at") + hours * HOUR).alias("_at"), (-F.col("_units")).alias("_units"), F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"), (F.col("_bucket") + span).alias("_bucket"))
    inside = Window.partitionBy("user_id", "_bucket").orderBy("_at").rangeBetween(Window.unboundedPreceding, 0)
    running = rows.unionByName(ended).withColumn("_here", F.sum("_units").over(inside)).where("_row is not null")
    sums = rows.groupBy("user_id", "_bucket").agg(F.sum("_units").alias("_sum"))
    before = F.sum("_sum").over(Window.partitionBy("user_id").orderBy("_bucket").rangeBetween(-span, -1))
    sums = sums.select(F.col("user_id").alias("_user"), F.col("_bucket").alias("_of"), F.coalesce(before, F.lit(0)).alias("_before"))
    found = running.join(sums, F.col("user_id").eqNullSafe(F.col("_user")) & (F.col("_bucket") == F.col("_of")))
    return found.select("_row.*", (F.col("_here") + F.col("_before")).alias("units_so_far"))


def topup_balance(ledger: DataFrame, users: DataFrame) -> DataFrame:
    """The sum of each user's ledger, 0 without entries."""
    sums = ledger.groupBy("user_id").agg(F.sum("units_delta").alias("balance"))
    return users.select("user_id").join(sums, "user_id", "left").select("user_id", F.coalesce("balance", F.lit(0)).alias("balance"))


def plan_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PLANS, "plan string, name string, price_eur int, limit_5h int, limit_7d int")


def effective_plan(entitlements: DataFrame, as_of: str) -> DataFrame:
    """An override that hasn't run out, else a live subscription, else free; unknown plans are free."""
    live = lambda c: F.col(c).isNull() | (F.col(c) > _at(as_of))
    granted = F.coalesce("manual_unlimited", F.lit(False))
    override = (granted | F.col("manual_plan_code").isNotNull()) & live("manual_expires_at")
    paid = F.col("billing_status").isin("active", "trialing") & live("current_period_end")
    code = F.when(override & granted, "unlimited").when(override, F.col("manual_plan_code")).when(paid, F.col("plan_code"))
    return entitlements.withColumn("plan", F.when(code.isin(*[p[0] for p in PLANS]), code).otherwise("free"))


def billing_overview(events: DataFrame, ledger: DataFrame, entitlements: DataFrame, users: DataFrame, as_of: str) -> DataFrame:
    """Plan, usage, limits and balance of every user."""
    plans = effective_plan(entitlements, as_of).select("user_id", "plan")
    rows = topup_balance(ledger, users).join(plans, "user_id", "left").join(billable_units_window(events, as_of), "user_id", "left")
    rows = rows.withColumn("plan", F.coalesce("plan", F.lit("free"))).fillna(0, ["units_5h", "units_7d"])
    rows = rows.join(F.broadcast(plan_dim(users.sparkSession).select("plan", "limit_5h", "limit_7d")), "plan")
    percent = lambda used, limit: F.when(F.col(limit) > 0, F.least(F.lit(100), F.floor(F.col(used) * 100 / F.col(limit) + 0.5))).cast("int")
    return rows.withColumn("percent_5h", percent("units_5h", "limit_5h")).withColumn("percent_7d", percent("units_7d", "limit_7d"))


def quota_decision(overview: DataFrame, units: Column) -> DataFrame:
    """How many top-up units a call of ``units`` needs and whether it is allowed. No limit: none."""
    left = lambda used, limit: F.when(F.col(limit).isNotNull(), F.greatest(F.lit(0), F.col(limit) - F.col(used)))
    included = F.least(left("units_5h", "limit_5h"), left("units_7d", "limit_7d"))
    need = F.when(F.col("limit_5h").isNull() & F.col("limit_7d").isNull(), 0).otherwise(F.greatest(F.lit(0), units - included)).cast("long")
    return overview.withColumn("needed", need).withColumn("allowed", F.col("needed") <= F.col("balance")).withColumn("debit", F.when(F.col("allowed"), F.col("needed")).otherwise(0))


def listing_units(n: Column, enrich: Column) -> Column:
    n = F.greatest(F.lit(1), F.least(F.lit(250), F.coalesce(n, F.lit(150))))
    return F.when(enrich, F.greatest(F.lit(2), F.ceil(n / 20))).otherwise(F.greatest(F.lit(1), F.ceil(n / 50))).cast("int")


def user_directory(users: DataFrame, entitlements: DataFrame) -> DataFrame:
    """Users with their entitlement, or the defaults."""
    rows = users.join(entitlements, "user_id", "left")
    return rows.select("user_id", F.lower(F.trim("email")).alias("email"), "role", "created_at", F.coalesce("plan_code", F.lit("free")).alias("plan_code"), F.coalesce("billing_status", F.lit("none")).alias("billing_status"), F.coalesce("manual_unlimited", F.lit(False)).alias("manual_unlimited"))


def invite_status(invites: DataFrame, as_of: str) -> DataFrame:
    status = F.when(F.col("used_at").isNotNull(), "used").when(F.col("expires_at") <= _at(as_of), "expired").otherwise("pending")
    return invites.withColumn("status", status)


def live_tokens(tokens: DataFrame, as_of: str) -> DataFrame:
    return tokens.where(F.col("used_at").isNull() & F.col("revoked_at").isNull() & (F.col("expires_at") > _at(as_of)))


def early_access(signups: DataFrame, limit: int = 500) -> DataFrame:
    """The newest signups, each order once (its first), with the number of all; a top list by design."""
    once = Window.partitionBy("provider_order_id").orderBy("created_at", "token_id")
    named = signups.where("provider_order_id is not null").withColumn("_n", F.row_number().over(once)).where("_n = 1").drop("_n")
    kept = named.unionByName(signups.where("provider_order_id is null"))
    total = kept.agg(F.count(F.lit(1)).alias("total"))
    return kept.orderBy(F.col("created_at").desc(), F.col("token_id").desc()).limit(limit).join(F.broadcast(total), how="left")


def proxy_source_label(request: Column, user: Column, env: Column) -> Column:
    given = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    return F.when(given(request), "request").when(given(user), "user").when(given(env), "env").otherwise("none")


def subscription_state(webhooks: DataFrame, products: DataFrame) -> DataFrame:
    """Payment events (id, body JSON) -> entitlement rows (kind subscription) and top-up rows (kind order)."""
    v = F.try_parse_json("body")
    get = lambda path, kind="string": F.try_variant_get(v, path, kind)
    rows = webhooks.select(
        "id", get("$.type").alias("type"), F.lower(F.trim(F.coalesce(get("$.data.customer.email"), get("$.data.customer_email"), get("$.data.user.email"), get("$.data.email")))).alias("email"),
        F.coalesce(get("$.data.product_id"), get("$.data.product.id")).alias("product_id"), get("$.data.status").alias("status"), get("$.data.id").alias("provider_id"), F.to_timestamp(get("$.data.current_period_end")).alias("period_end"),
    ).join(products, "product_id", "left")
    kind = F.when(F.col("type").startswith("subscription."), "subscription").when(F.col("type").startswith("order.") & F.col("units").isNotNull(), "order")
    return rows.withColumn("kind", kind).where("kind is not null")


def api_key_report(keys: DataFrame) -> DataFrame:
    """Each user's keys, newest first, with whether they are active."""
    order = Window.partitionBy("user_id").orderBy(F.col("created_at").desc(), F.col("token_id").desc())
    return keys.select("user_id", "token_id", "created_at", "last_used_at", F.col("revoked_at").isNull().alias("active"), F.row_number().over(order).alias("nth"))


def delivery_billing(log: DataFrame) -> DataFrame:
    """Calls with the units they cost: one if the answer was delivered."""
    good = F.col("status").between(200, 299)
    return log.withColumn("billable", good).withColumn("units", F.when(good, 1).otherwise(0))


def endpoint_usage_cube(events: DataFrame) -> DataFrame:
    """Calls by endpoint and proxy source, with all subtotals (a subtotal's column says ``*``)."""
    rows = events.select("endpoint", F.coalesce("used_proxy", F.lit("none")).alias("used_proxy"), "ok", "units")
    made = rows.cube("endpoint", "used_proxy").agg(F.count(F.lit(1)).alias("calls"), F.count_if("ok").alias("ok_calls"), F.sum("units").alias("units"))
    return made.select(F.coalesce("endpoint", F.lit("*")).alias("endpoint"), F.coalesce("used_proxy", F.lit("*")).alias("used_proxy"), "calls", "ok_calls", "units")


def runs_expired(runs: DataFrame, as_of: str, days: int) -> DataFrame:
    """Runs older than the days kept; none if retention is off (0 or fewer)."""
    return runs.where(F.lit(days > 0) & (F.col("created_at") < _at(as_of) - F.make_dt_interval(days=F.lit(days))))


def runs_over_cap(runs: DataFrame, n: int) -> DataFrame:
    """All but each domain's newest ``n`` runs.

    Only the newest n of a domain are ranked (a limit that tasks apply before the shuffle); the last of them is the
    border that the domain's other runs are held against, in as many tasks as they fill.
    """
    order = Window.partitionBy("domain").orderBy(F.col("created_at").desc(), F.col("run_id").desc())
    newest = runs.select("domain", "created_at", "run_id").withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= max(n, 1))
    border = newest.where(F.col("nth") == max(n, 1)).select("domain", F.struct("created_at", "run_id").alias("border"))
    rows = runs.join(border, "domain")
    own = F.struct("created_at", "run_id")
    return rows.where(own < F.col("border") if n > 0 else own <= F.col("border")).select(*runs.columns)


def storage_stats(runs: DataFrame, capacity: int) -> DataFrame:
    """Runs and bytes by domain, with their share of the capacity in percent."""
    sums = runs.groupBy("domain").agg(F.count(F.lit(1)).alias("runs"), F.sum("bytes").alias("bytes"))
    return sums.withColumn("percent", F.least(F.lit(100.0), F.round(F.col("bytes") * 100 / capacity, 6)))
