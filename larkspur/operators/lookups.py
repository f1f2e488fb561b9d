"""Joins that assemble views over items, likes, scores, rooms and crawls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.text import norm_token
from larkspur.functions.url import url_signature
from larkspur.operators.confidence import score_band


def liked_items(likes: DataFrame, items: DataFrame, session_id=None) -> DataFrame:
    """Likes with their item; likes of missing items drop. One session's list is newest first."""
    if session_id is not None:
        one = likes.where(F.col("session_id") == session_id)
        return one.join(items, "item_id").orderBy(F.desc("ts"), "item_id")
    return likes.join(items, "item_id")


def room_items(room_rows: DataFrame, items: DataFrame) -> DataFrame:
    """Room or shortlist rows with item details; missing items keep defaults."""
    joined = room_rows.join(items.select("item_id", "title", "price_amount", "retailer"), "item_id", "left")
    return joined.withColumn("title", F.coalesce("title", F.lit("Unknown")))


def resolve_items(gold: DataFrame, items: DataFrame, columns: list[str], active_only: bool = True) -> DataFrame:
    """Curated row wins, else the catalog row: full outer join with one coalesce per column."""
    keep = lambda df: df.where(F.col("is_active")) if active_only else df
    side = lambda df, tag: keep(df).select("item_id", F.struct(*columns).alias(tag))
    joined = side(gold, "_g").join(side(items, "_i"), "item_id", "full")
    won = F.coalesce("_g", "_i")
    return joined.select("item_id", *[won[c].alias(c) for c in columns], F.col("_g").isNotNull().alias("from_gold"))


RECYCLE_DAYS = 7


def unseen(candidates: DataFrame, swipes: DataFrame, as_of: Column, days: int = RECYCLE_DAYS) -> DataFrame:
    """Candidates not swiped inside the recycle window."""
    recent = swipes.where(F.col("ts") >= as_of - F.make_dt_interval(F.lit(days))).select("session_id", "item_id")
    return candidates.join(recent, ["session_id", "item_id"], "left_anti")


def recycle(candidates: DataFrame, fresh: DataFrame) -> DataFrame:
    """Fresh candidates; a session with none gets all of its candidates back."""
    served = fresh.select("session_id").distinct()
    back = candidates.join(served, "session_id", "left_anti")
    return fresh.withColumn("recycled", F.lit(False)).unionByName(back.withColumn("recycled", F.lit(True)))


def item_quality(items: DataFrame, scores: DataFrame, window: str = "30d") -> DataFrame:
    """Creative score from the row with most impressions in the window."""
    best = scores.where((F.col("time_window") == window) & F.col("creative_score").isNotNull()).groupBy("item_id").agg(
        F.max_by("creative_score", "impressions").alias("quality"))
    return items.join(best, "item_id", "left")


def retailer_catalog(items: DataFrame, controls: DataFrame, scores: DataFrame, window: str = "30d") -> DataFrame:
    """Catalog rows with inclusion control and best score.

    Scores collapse to one row per item before the join, so all three inputs
    meet on (retailer, item) or item keys without fan-out.
    """
    best = scores.where(F.col("time_window") == window).groupBy("item_id").agg(
        F.max_by(F.struct("score", "impressions", "reason_codes"), "score").alias("_s"))
    base = items.where(~F.col("is_active").eqNullSafe(F.lit(False)))
    joined = base.join(controls.withColumnRenamed("included", "_inc"), ["retailer", "item_id"], "left").join(
        best, "item_id", "left")
    default = F.col("catalog_included") if "catalog_included" in items.columns else F.lit(True)
    return joined.select(
        "retailer", "item_id", F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.lit("Untitled")).alias("title"),
        "price_amount", F.coalesce("_inc", default, F.lit(True)).alias("included"), F.col("reason").alias("inclusion_reason"),
        F.col("_s.score").alias("score"), score_band(F.col("_s.score")).alias("_band"),
        F.col("_s.impressions").alias("impressions"), F.col("_s.reason_codes").alias("reason_codes"),
    ).withColumn("band", F.when(F.col("score").isNotNull(), F.col("_band"))).drop("_band")


def stale_items(items: DataFrame, seen_urls: DataFrame) -> DataFrame:
    """Active items of crawled sources with no url signature in the latest crawl.

    Items need item_id, source_id and an array column `urls`; items without any
    url are left alone, and sources with no crawled url deactivate nothing.
    """
    seen = seen_urls.select("source_id", url_signature(F.col("url")).alias("sig")).where("sig IS NOT NULL").distinct()
    active = items.where(F.col("is_active"))
    keyed = active.select("item_id", "source_id", F.explode(F.array_distinct(F.array_compact(
        F.transform("urls", lambda u: url_signature(u))))).alias("sig"))
    in_scope = keyed.join(seen.select("source_id").distinct(), "source_id", "left_semi")
    alive = in_scope.join(seen, ["source_id", "sig"], "left_semi").select("item_id").distinct()
    candidates = in_scope.select("item_id", "source_id").distinct()
    return candidates.join(alive, "item_id", "left_anti").withColumn(
        "deactivated_reason", F.lit("missing_in_latest_crawl"))


def comments_with_users(comments: DataFrame, users: DataFrame, room_id=None, limit: int | None = None) -> DataFrame:
    """Comments with author names; unknown authors are Anonymous. One room's list is newest first."""
    rows = comments
    if room_id is not None:
        rows = rows.where(F.col("room_id") == room_id).orderBy(F.desc("ts"), "comment_id")
        rows = rows if limit is None else rows.limit(limit)
    return rows.join(users, "user_id", "left").withColumn(
        "display_name", F.coalesce("display_name", F.lit("Anonymous")))


def review_rows(queue: DataFrame, items: DataFrame, status: str = "pending") -> DataFrame:
    return queue.where(F.col("status") == status).join(
        items.select("item_id", "title", "brand", "price_amount"), "item_id", "left")


def explain_items(items: DataFrame, gold: DataFrame, review: DataFrame) -> DataFrame:
    """Classification, decision, gold and review state of each item in one row."""
    g = gold.select("item_id", F.lit(True).alias("_gold"), F.col("surfaces").alias("gold_surfaces"))
    r = review.select("item_id", F.col("status").alias("review_status"))
    return items.join(g, "item_id", "left").join(r, "item_id", "left").withColumn(
        "in_gold", F.coalesce("_gold", F.lit(False))).drop("_gold")


CURATED_COUNT = 6


def curated_items(curated: DataFrame, items: DataFrame, n: int = CURATED_COUNT) -> DataFrame:
    """The curated list when all n of its items show an image, else n fallback items with one.

    Both sides are cut to n rows before the choice, so the global ranks run
    over at most 2n rows whatever the catalog holds.
    """
    shown = items.where(F.col("image_count") > 0).select("item_id", "title")
    head = curated.orderBy("position").limit(n)
    picked = head.join(shown, "item_id").select("item_id", "title", F.col("position").cast("bigint").alias("position"))
    spare = shown.orderBy("item_id").limit(n).select(
        "item_id", "title", F.row_number().over(Window.orderBy("item_id")).cast("bigint").alias("position"))
    complete = picked.agg((F.count("*") >= n).alias("_ok")).scalar()
    tagged = picked.where(complete).withColumn("curated", F.lit(True)).unionByName(
        spare.where(~complete).withColumn("curated", F.lit(False)))
    return tagged


def user_sessions(sessions: DataFrame, users: DataFrame) -> DataFrame:
    """Linked sessions per user, distinct and sorted; users without sessions keep an empty list.

    Pairs are made distinct first; the list is the linked-session column of a
    user row, as long as that user has sessions.
    """
    pairs = sessions.where(F.col("user_id").isNotNull()).select("user_id", "session_id").distinct()
    lists = pairs.groupBy("user_id").agg(F.array_sort(F.collect_list("session_id")).alias("sessions"))
    return users.join(lists, "user_id", "left").withColumn(
        "sessions", F.coalesce("sessions", F.array().cast(lists.schema["sessions"].dataType)))


def changed_pages(pages: DataFrame, known: DataFrame, key: str = "url") -> DataFrame:
    """Pages that are new or whose content hash differs from every stored one; a row per page.

    `key` names what a page is known by. Several stored hashes of a key do not repeat its pages.
    """
    hashed = pages.withColumn("html_hash", F.sha2("html", 256))
    hashes = lambda c: F.coalesce(c, F.lit(""))
    stored = known.groupBy(key).agg(F.collect_set(hashes(F.col("html_hash"))).alias("_known"))
    rows = hashed.join(stored, key, "left").withColumn("is_new", F.col("_known").isNull())
    return rows.where(F.col("is_new") | ~F.array_contains("_known", hashes(F.col("html_hash")))).drop("_known")


def like_state(events: DataFrame) -> DataFrame:
    """Liked where the number of toggles per (session, item) is odd."""
    return events.groupBy("session_id", "item_id").agg(
        (F.count("*") % 2 == 1).alias("liked"), F.max("ts").alias("changed_at"))


def visible_segments(templates: DataFrame, retailer: DataFrame, own: DataFrame) -> DataFrame:
    """Template, retailer and own segments, distinct by id; the earlier list wins."""
    tagged = [df.withColumn("_rank", F.lit(i)) for i, df in enumerate((templates, retailer, own))]
    union = tagged[0].unionByName(tagged[1]).unionByName(tagged[2])
    others = [c for c in union.columns if c not in ("segment_id", "_rank")]
    return union.groupBy("segment_id").agg(F.min_by(F.struct(*others), "_rank").alias("_r")).select("segment_id", "_r.*")


def vote_tally(votes: DataFrame, window: tuple[str, ...] = ("room", "item_id")) -> DataFrame:
    """Up and down counts from each user's latest vote."""
    latest = votes.groupBy(*window, "user_id").agg(F.max_by("vote", F.struct("ts", "vote_id")).alias("vote"))
    return latest.groupBy(*window).agg(
        F.count_if(F.col("vote") == "up").alias("votes_up"), F.count_if(F.col("vote") == "down").alias("votes_down"))


def room_participants(votes: DataFrame) -> DataFrame:
    """Distinct voters per room, in two steps so a busy room is collapsed before its final count."""
    return votes.select("room", "user_id").distinct().groupBy("room").agg(F.count("*").alias("participants"))


def normalized_key(c: str) -> Column:
    return norm_token(F.col(c))
