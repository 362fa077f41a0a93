"""Rank snapshots: latest, history, differences between runs, retention, and keyed writes.

Headers are (snapshot_id, listing_key, checked_at, ...), items (snapshot_id, listing_key, rank, product_key, ...).
Ties in time are broken by snapshot_id everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def _newest() -> list[Column]:
    return [F.col("checked_at").desc(), F.col("snapshot_id").desc()]


def latest_snapshot(headers: DataFrame, items: DataFrame) -> DataFrame:
    """The items of each listing's newest snapshot."""
    newest = headers.groupBy("listing_key").agg(F.max(F.struct("checked_at", "snapshot_id")).alias("m"))
    return items.join(newest.select("m.snapshot_id"), "snapshot_id", "left_semi")


def snapshot_history(headers: DataFrame, n: int = 50) -> DataFrame:
    """The newest ``n`` headers of each listing, numbered from the newest."""
    at = F.row_number().over(Window.partitionBy("listing_key").orderBy(*_newest()))
    return headers.withColumn("nth", at).where(F.col("nth") <= n)


def snapshot_items(items: DataFrame, snapshot_id: str) -> DataFrame:
    return items.where(F.col("snapshot_id") == snapshot_id).orderBy("rank")


def direction(delta: Column) -> Column:
    return F.when(delta > 0, "up").when(delta < 0, "down").otherwise("same")


def rank_diff(previous: DataFrame, current: DataFrame, on: tuple[str, ...] = ()) -> DataFrame:
    """(product_key, rank, url, title) of two runs -> a row for each product of either.

    ``on`` names further columns that pair the runs. A product of the current run alone is new, one of the
    previous run alone is missing and keeps what was known of it.
    """
    keys = [*on, "product_key"]
    p = previous.select(*keys, F.col("rank").alias("previous_rank"), F.col("url").alias("_url"), F.col("title").alias("_title"))
    c = current.select(*keys, F.col("rank").alias("current_rank"), "url", "title")
    both = p.join(c, keys, "full_outer")
    delta = F.col("previous_rank") - F.col("current_rank")
    way = F.when(F.col("previous_rank").isNull(), "new").when(F.col("current_rank").isNull(), "missing").otherwise(direction(delta))
    return both.select(*keys, F.coalesce("url", "_url").alias("url"), F.coalesce("title", "_title").alias("title"), "previous_rank", "current_rank", delta.alias("delta"), way.alias("direction"))


def snapshot_pairs(headers: DataFrame) -> DataFrame:
    """Each snapshot with the one before it in its listing (null for the first)."""
    before = F.lag("snapshot_id").over(Window.partitionBy("listing_key").orderBy("checked_at", "snapshot_id"))
    return headers.select("listing_key", "snapshot_id", "checked_at", before.alias("previous_snapshot_id"))


def rank_diff_all(headers: DataFrame, items: DataFrame) -> DataFrame:
    """``rank_diff`` of every snapshot with the one before it, for all listings in one job.

    Both sides of the outer join are keyed by the current snapshot and the product, so a listing of any length
    spreads over tasks.
    """
    pairs = snapshot_pairs(headers)
    known = items.select("snapshot_id", "product_key", "rank", "url", "title")
    before = known.withColumnRenamed("snapshot_id", "previous_snapshot_id").join(pairs.select("snapshot_id", "previous_snapshot_id"), "previous_snapshot_id").drop("previous_snapshot_id")
    return rank_diff(before, known, on=("snapshot_id",)).join(pairs, "snapshot_id")


def diff_summary(changes: DataFrame, *by: str) -> DataFrame:
    """Counts of changes by kind; ``tracked`` is the products of the current run."""
    count = lambda kind: F.count_if(F.col("direction") == kind)
    return changes.groupBy(*by).agg(
        F.count_if(F.col("direction") != "missing").alias("tracked"), count("new").alias("new"), count("up").alias("moved_up"),
        count("down").alias("moved_down"), count("same").alias("unchanged"), count("missing").alias("missing"),
    )


def prune_snapshots(headers: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Keep each listing's oldest and newest snapshot, and their items."""
    ends = headers.groupBy("listing_key").agg(F.min(F.struct("checked_at", "snapshot_id")).alias("a"), F.max(F.struct("checked_at", "snapshot_id")).alias("b"))
    kept = ends.select(F.explode(F.array_distinct(F.array("a.snapshot_id", "b.snapshot_id"))).alias("snapshot_id"))
    return headers.join(kept, "snapshot_id", "left_semi"), items.join(kept, "snapshot_id", "left_semi")


def rank_history(headers: DataFrame, items: DataFrame) -> DataFrame:
    """Each product's series: change against the run before and the first run, best, worst, moving mean, runs tracked."""
    rows = items.drop("checked_at").join(headers.select("snapshot_id", "checked_at"), "snapshot_id")
    own = Window.partitionBy("listing_key", "product_key")
    line = own.orderBy("checked_at", "snapshot_id")
    return rows.select(
        "listing_key", "product_key", "snapshot_id", "checked_at", "rank",
        (F.lag("rank").over(line) - F.col("rank")).alias("delta"),
        (F.first("rank").over(line) - F.col("rank")).alias("since_first"),
        F.min("rank").over(own).alias("best"), F.max("rank").over(own).alias("worst"),
        F.round(F.avg("rank").over(line.rowsBetween(-2, 0)), 6).alias("moving_mean"), F.count(F.lit(1)).over(own).alias("runs"),
    )


def history_state(rows: DataFrame) -> DataFrame:
    """Ranks (listing_key, product_key, checked_at, snapshot_id, rank) -> what has to be known of each product to go on.

    First rank, best, worst, sum and number of ranks, and the last two with their time: all of it can be merged.
    """
    at = F.struct("checked_at", "snapshot_id", "rank")
    line = Window.partitionBy("listing_key", "product_key").orderBy("checked_at", "snapshot_id")
    made = rows.select("listing_key", "product_key", "rank", at.alias("at"), F.lag(at).over(line).alias("before")).groupBy("listing_key", "product_key").agg(
        F.min("at").alias("first"), F.max(F.struct("at", "before")).alias("last"), F.min("rank").alias("best"), F.max("rank").alias("worst"), F.sum("rank").alias("ranks"), F.count(F.lit(1)).alias("runs")
    )
    return made.withColumn("recent", F.filter(F.array("last.at", "last.before"), lambda r: r.isNotNull())).drop("last")


def advance_history(state: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A state and the ranks of later snapshots -> (the state with them, their rows of ``rank_history`` but for best, worst and runs).

    Ranks that were there before are not read again: a product's last two stand for them. The new snapshots of a listing must
    lie behind those of the state; they may be several.
    """
    new = rows.select("listing_key", "product_key", "checked_at", "snapshot_id", "rank", F.lit(True).alias("_new"))
    old = state.select("listing_key", "product_key", F.explode("recent").alias("r")).select("listing_key", "product_key", "r.checked_at", "r.snapshot_id", "r.rank", F.lit(False).alias("_new"))
    known = state.select("listing_key", "product_key", F.col("first.rank").alias("_first"))
    line = Window.partitionBy("listing_key", "product_key").orderBy("checked_at", "snapshot_id")
    seen = old.unionByName(new).select(
        "listing_key", "product_key", "snapshot_id", "checked_at", "rank", "_new", (F.lag("rank").over(line) - F.col("rank")).alias("delta"), F.first("rank").over(line).alias("_begun"),
        F.round(F.avg("rank").over(line.rowsBetween(-2, 0)), 6).alias("moving_mean"),
    ).where("_new")
    seen = seen.join(known, ["listing_key", "product_key"], "left").withColumn("since_first", F.coalesce("_first", "_begun") - F.col("rank"))
    added = history_state(rows)
    both = state.unionByName(added).groupBy("listing_key", "product_key").agg(
        F.min("first").alias("first"), F.min("best").alias("best"), F.max("worst").alias("worst"), F.sum("ranks").alias("ranks"), F.sum("runs").alias("runs"), F.flatten(F.collect_list("recent")).alias("recent")
    )
    last = F.slice(F.reverse(F.array_sort("recent")), 1, 2)
    return both.withColumn("recent", last), seen.select("listing_key", "product_key", "snapshot_id", "checked_at", "rank", "delta", "since_first", "moving_mean")


def with_history(rows: DataFrame, state: DataFrame) -> DataFrame:
    """Rows of ``advance_history`` with the best and worst rank and the runs of the state: those of ``rank_history``."""
    return rows.join(state.select("listing_key", "product_key", "best", "worst", "runs"), ["listing_key", "product_key"])


def biggest_movers(changes: DataFrame, k: int = 5, by: str = "snapshot_id") -> DataFrame:
    """The ``k`` products that moved most in each run; ties by product_key."""
    order = Window.partitionBy(by).orderBy(F.abs("delta").desc(), "product_key")
    moved = changes.where(F.col("delta") != 0)
    return moved.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k)


def owner_scope(df: DataFrame, owner: int | None) -> DataFrame:
    """The rows of one owner; all rows for None."""
    return df if owner is None else df.where(F.col("owner") == owner)


def backfill_owner(listings: DataFrame, users: DataFrame) -> DataFrame:
    """Give listings without an owner to the oldest user who isn't an admin (ties by id)."""
    oldest = users.where(F.col("role") != "admin").agg(F.min(F.struct("created_at", "user_id")).alias("m"))
    return listings.join(F.broadcast(oldest.select(F.col("m.user_id").alias("_oldest"))), how="left").withColumn("owner", F.coalesce("owner", "_oldest")).drop("_oldest")


def unique_items(items: DataFrame) -> DataFrame:
    """One row for each product of a snapshot: that of the best rank."""
    order = Window.partitionBy("snapshot_id", "product_key").orderBy("rank", "url")
    return items.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def upsert_latest(target: DataFrame, updates: DataFrame, keys: list[str], order: list[str], keep_old_when_null: tuple[str, ...] = ()) -> DataFrame:
    """Target rows with the last update of each key put over them, and the updates of new keys.

    Null keys are equal to each other. Columns in ``keep_old_when_null`` keep the newest value that isn't null.
    """
    rows = target.withColumn("_new", F.lit(0)).unionByName(updates.withColumn("_new", F.lit(1)))
    when = F.struct("_new", *order)
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), when)).alias(c) if c in keep_old_when_null else F.max_by(c, when).alias(c) for c in target.columns if c not in keys]
    return rows.groupBy(*keys).agg(*last).select(*target.columns)


def insert_if_absent(target: DataFrame, rows: DataFrame, unique: str, order: list[str]) -> DataFrame:
    """The rows to insert: the first of each unique value that the target lacks; rows without a value always."""
    first = Window.partitionBy(unique).orderBy(*order)
    named = rows.where(F.col(unique).isNotNull()).join(target.select(unique), unique, "left_anti")
    named = named.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return named.select(*rows.columns).unionByName(rows.where(F.col(unique).isNull()))
