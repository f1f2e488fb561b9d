"""Campaign gates, validation, pacing, spend, reports and retailer insights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.numbers import js_round, safe_ratio

PACING_BUFFER, MIN_BUFFER_CENTS, DEFAULT_CAP, COST_PER_IMPRESSION_CENTS = 0.2, 5000, 12, 100


def spent_on(daily: DataFrame, day: Column) -> DataFrame:
    return daily.where(F.col("dt") == day).groupBy("campaign_id").agg(F.sum("spend_cents").alias("spent_today"))


def active_campaigns(campaigns: DataFrame, daily: DataFrame, today: Column) -> DataFrame:
    """Campaigns with the gates as columns and `serving` where all pass.

    Gates: total budget left, daily budget left, spend within the linear pace
    plus a buffer, and the schedule.
    """
    c = F.col
    rows = campaigns.join(spent_on(daily, F.date_format(today, "yyyy-MM-dd")), "campaign_id", "left").withColumn(
        "spent_today", F.coalesce("spent_today", F.lit(0)))
    length = F.datediff("end_date", "start_date")
    elapsed = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.datediff(today, c("start_date")) / length))
    buffer = F.greatest(c("budget_cents") * PACING_BUFFER, F.coalesce(c("budget_daily_cents") * 0.5, F.lit(0.0)), F.lit(float(MIN_BUFFER_CENTS)))
    unpaced = c("budget_cents").isNull() | (c("budget_cents") <= 0) | c("end_date").isNull() | (length <= 0)
    gates = {
        "budget_left": F.coalesce(c("spent_cents") < c("budget_cents"), F.lit(True)),
        "daily_left": F.coalesce(c("spent_today") < c("budget_daily_cents"), F.lit(True)),
        "on_pace": F.when(unpaced, True).otherwise(c("spent_cents") <= c("budget_cents") * elapsed + buffer),
        "in_schedule": F.coalesce(today >= c("start_date"), F.lit(True)) & F.coalesce(today <= c("end_date"), F.lit(True))}
    return rows.withColumns(gates).withColumn(
        "serving", (c("status") == "active") & c("budget_left") & c("daily_left") & c("on_pace") & c("in_schedule"))


def frequency_cap(campaigns: DataFrame, default: int = DEFAULT_CAP) -> DataFrame:
    """Smallest cap of the campaigns and the default, at least 2."""
    return campaigns.agg(F.greatest(F.lit(2), F.least(F.lit(default), F.coalesce(F.min(
        F.coalesce("frequency_cap", F.lit(default))), F.lit(default)))).cast("bigint").alias("frequency_cap"))


def campaign_issues(campaigns: DataFrame) -> DataFrame:
    c = F.col
    return campaigns.withColumn("issues", F.array_compact(F.array(
        F.when(c("budget_cents") <= 0, "budgetTotal"), F.when(c("budget_daily_cents") <= 0, "budgetDaily"),
        F.when(c("start_date") > c("end_date"), "startDate/endDate"),
        F.when((c("frequency_cap") < 2) | (c("frequency_cap") > 60), "frequencyCap"))))


def featured_spend(impressions: DataFrame, cost_cents: int = COST_PER_IMPRESSION_CENTS) -> DataFrame:
    """Impressions and spend per campaign and day; rows without a campaign are legacy and do not count."""
    return impressions.where(F.col("campaign_id").isNotNull()).groupBy(
        "campaign_id", F.date_format("ts", "yyyy-MM-dd").alias("dt")).agg(
        F.count("*").alias("impressions"), (F.count("*") * cost_cents).alias("spend_cents"))


def sum_daily_map(m: Column, lo: str | None, hi: str | None) -> Column:
    """Sum of a date-keyed map inside a date range."""
    keep = lambda k, v: (F.lit(True) if lo is None else k >= lo) & (F.lit(True) if hi is None else k <= hi)
    return F.aggregate(F.map_values(F.map_filter(m, keep)), F.lit(0.0), lambda a, v: a + F.coalesce(v, F.lit(0.0)))


def campaign_totals(campaigns: DataFrame, daily: DataFrame, lo: str | None = None, hi: str | None = None) -> DataFrame:
    """Spend and impressions per campaign in the range; outcomes stay lifetime totals."""
    rows = daily
    if lo:
        rows = rows.where(F.col("dt") >= lo)
    if hi:
        rows = rows.where(F.col("dt") <= hi)
    sums = rows.groupBy("campaign_id").agg(F.sum("spend_cents").alias("spend_cents"), F.sum("impressions").alias("range_impressions"))
    return campaigns.join(sums, "campaign_id", "left").select(
        "retailer_id", "campaign_id", "segment_id", "name", "status", F.coalesce("spend_cents", F.lit(0)).alias("spend_cents"),
        F.coalesce("range_impressions", F.lit(0)).alias("impressions"), F.col("clicks").alias("outcomes_lifetime"))


def _money(cents: Column) -> Column:
    return js_round(cents / 100.0, 2)


def _cp(outcomes: Column, cents: Column) -> Column:
    return js_round(safe_ratio(outcomes, cents) * 10000.0, 2)


def retailer_report(totals: DataFrame) -> DataFrame:
    """Totals, by segment and by campaign of each retailer from one pass (grouping sets)."""
    r, c, s = F.col("retailer_id"), F.col("campaign_id"), F.col("segment_id")
    cube = totals.groupingSets([[r, c], [r, s], [r]], r, c, s).agg(
        F.grouping("campaign_id").alias("_gc"), F.grouping("segment_id").alias("_gs"), F.sum("spend_cents").alias("spend_cents"),
        F.sum("impressions").alias("impressions"), F.sum("outcomes_lifetime").alias("outcomes_lifetime"))
    level = F.when(F.col("_gc") == 0, "campaign").when(F.col("_gs") == 0, "segment").otherwise("total")
    return cube.select("retailer_id", level.alias("level"), F.coalesce("campaign_id", "segment_id").alias("id"),
                       _money(F.col("spend_cents")).alias("spend"), "impressions", "outcomes_lifetime",
                       _cp(F.col("outcomes_lifetime"), F.col("spend_cents")).alias("cp_score"))


def report_rows(totals: DataFrame) -> DataFrame:
    """Report lines of each retailer with a TOTAL line, as text-ready columns."""
    cols = [F.col("retailer_id").cast("string").alias("retailer_id"), F.col("campaign_id").cast("string").alias("campaign_id"), "name", "status"]
    lines = totals.select(*cols, "spend_cents", "impressions", "outcomes_lifetime", F.col("retailer_id").alias("_r"))
    total = totals.groupBy(F.col("retailer_id").alias("_r")).agg(
        *[F.sum(c).alias(c) for c in ("spend_cents", "impressions", "outcomes_lifetime")]).select(
        F.lit("TOTAL").alias("retailer_id"), F.lit("").alias("campaign_id"), F.lit("").alias("name"), F.lit("").alias("status"),
        "spend_cents", "impressions", "outcomes_lifetime", "_r")
    return lines.unionByName(total).select(
        F.col("_r").alias("report"), "retailer_id", "campaign_id", "name", "status", _money(F.col("spend_cents")).alias("spend"),
        "impressions", "outcomes_lifetime", _cp(F.col("outcomes_lifetime"), F.col("spend_cents")).alias("cp_score"))


def top_products(impressions: DataFrame, campaigns: DataFrame, items: DataFrame, n: int = 40) -> DataFrame:
    """Most shown products of each retailer with title; counts collapse per (campaign, item) before any join."""
    counts = impressions.groupBy("campaign_id", "item_id").agg(F.count("*").alias("n"))
    per = counts.join(campaigns.select("campaign_id", "retailer_id"), "campaign_id").groupBy("retailer_id", "item_id").agg(
        F.sum("n").alias("impressions"), F.min("campaign_id").alias("campaign_id"))
    w = Window.partitionBy("retailer_id").orderBy(F.desc("impressions"), "item_id")
    top = per.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    return top.join(items.select("item_id", "title"), "item_id", "left").withColumn("title", F.coalesce("title", F.lit("Untitled")))


def recommend_products(scores: DataFrame, gold: DataFrame, items: DataFrame, limit: int = 24) -> DataFrame:
    """Per retailer: best scored products, then curated, then catalog items, each product once.

    scores: (item_id, score); gold and items: (item_id, retailer, is_active).
    """
    live = items.where(F.col("is_active")).select("item_id", "retailer")
    scored = scores.select("item_id", "score").join(live, "item_id").select(
        "retailer", "item_id", F.lit(0).alias("source"), (-F.col("score")).cast("double").alias("order"))
    tail = lambda df, i: df.where(F.col("is_active")).select(
        "retailer", "item_id", F.lit(i).alias("source"), F.col("item_id").cast("double").alias("order"))
    union = scored.unionByName(tail(gold, 1)).unionByName(tail(items, 2))
    once = union.groupBy("retailer", "item_id").agg(F.min(F.struct("source", "order")).alias("b"))
    w = Window.partitionBy("retailer").orderBy("b.source", "b.order", "item_id")
    return once.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select(
        "retailer", "item_id", F.col("b.source").alias("source"), "rank")


# ---- alerts and insights -----------------------------------------------------------------------------


def low_confidence(scores: DataFrame) -> DataFrame:
    return scores.where((F.col("time_window") == "30d") & (F.col("score") < 45) & (F.col("impressions") >= 20)
                        & (F.col("saves") < F.col("impressions") * 0.05))


def underperforming(campaigns: DataFrame) -> DataFrame:
    """Active campaigns whose impressions per 100 of total budget are below 0.3."""
    fill = F.col("impressions") / (F.col("budget_cents") / 100.0) * 100.0
    return campaigns.where((F.col("status") == "active") & (F.col("budget_cents") > 0)).withColumn("fill_rate", fill).where(F.col("fill_rate") < 0.3)


def no_traction(items: DataFrame, scores: DataFrame, since_day: int) -> DataFrame:
    recent = items.where(F.col("updated_day") >= since_day)
    return recent.join(scores.where((F.col("time_window") == "7d") & (F.col("impressions") < 10)).select("item_id", "impressions"), "item_id")


def pacing_alerts(campaigns: DataFrame, daily: DataFrame, today: Column) -> DataFrame:
    """Daily budget over 85 % used, or total spend over 110 % of the linear expectation."""
    c = F.col
    rows = campaigns.where(c("status") == "active").join(
        spent_on(daily, F.date_format(today, "yyyy-MM-dd")), "campaign_id", "left").withColumn("spent_today", F.coalesce("spent_today", F.lit(0)))
    day_used = c("spent_today") / c("budget_daily_cents")
    total_days, gone = F.datediff("end_date", "start_date"), F.datediff(today, c("start_date"))
    expected = c("budget_cents") * gone / total_days
    left = F.greatest(F.lit(0), F.datediff(c("end_date"), today))
    daily_hit = (c("budget_daily_cents") > 0) & (day_used > 0.85)
    total_hit = (c("budget_cents") > 0) & (total_days > 0) & (gone > 0) & (c("spent_cents") > expected * 1.1)
    kind = F.when(daily_hit, "daily").when(total_hit, "total")
    used = F.when(daily_hit, day_used).otherwise(c("spent_cents") / c("budget_cents"))
    priority = F.when(daily_hit, F.when(c("spent_today") > c("budget_daily_cents"), "high").otherwise("medium")).otherwise(
        F.when(left <= 2, "high").otherwise("medium"))
    return rows.withColumns({"kind": kind, "used_pct": js_round(used * 100.0), "priority": priority}).where(c("kind").isNotNull()).select(
        "retailer_id", "campaign_id", "kind", "used_pct", "priority")


def score_improvers(scores: DataFrame, min_gain: int = 5) -> DataFrame:
    """Products whose 7-day score beats the 30-day one by more than min_gain; one pivoting aggregate, no self join."""
    at = lambda w: F.max(F.when(F.col("time_window") == w, F.col("score")))
    both = scores.where(F.col("time_window").isin("7d", "30d")).groupBy("item_id").agg(at("7d").alias("score_7d"), at("30d").alias("score_30d"))
    return both.withColumn("gain", F.col("score_7d") - F.coalesce("score_30d", "score_7d")).where(F.col("gain") > min_gain)


def insights(items: DataFrame, campaigns: DataFrame, daily: DataFrame, scores: DataFrame, today: Column, since_day: int) -> DataFrame:
    """(retailer_id, type, priority, metric): at most one card of each of six types per retailer."""
    owner = items.select("item_id", F.col("retailer").cast("bigint").alias("retailer_id"))
    card = lambda df, kind, priority, metric: df.select(
        "retailer_id", F.lit(kind).alias("type"), priority.alias("priority"), metric.cast("bigint").alias("metric"))
    running = campaigns.where(F.col("status") == "active").select("retailer_id").distinct()
    low = low_confidence(scores).join(owner, "item_id").groupBy("retailer_id").agg(F.count("*").alias("n"), F.avg("score").alias("m")).join(
        running, "retailer_id", "left_semi")
    under = underperforming(campaigns).groupBy("retailer_id").agg(F.min("fill_rate").alias("worst"))
    fresh = no_traction(items, scores, since_day).withColumn("retailer_id", F.col("retailer").cast("bigint")).groupBy("retailer_id").agg(F.count("*").alias("n"))
    pace = pacing_alerts(campaigns, daily, today).groupBy("retailer_id").agg(F.min_by(F.struct("priority", "used_pct"), "campaign_id").alias("p"))
    rise = score_improvers(scores).join(owner, "item_id").groupBy("retailer_id").agg(F.max(F.struct("gain", -F.col("item_id"))).alias("g")).join(
        running, "retailer_id", "left_semi")
    owned = campaigns.groupBy("retailer_id").agg(F.count("*").alias("n"))
    idle = owner.select("retailer_id").unionByName(campaigns.select("retailer_id")).distinct().join(running, "retailer_id", "left_anti").join(
        owned, "retailer_id", "left")
    hi = lambda cond, other="medium": F.when(cond, "high").otherwise(other)
    parts = [
        card(low, "low_confidence_score", hi(F.col("n") >= 3), js_round(F.col("m"))),
        card(under, "campaign_underperforming", hi(F.col("worst") < 0.1), js_round(F.col("worst") * 1000.0)),
        card(fresh, "new_products_no_traction", hi(F.col("n") >= 5), F.col("n")),
        card(pace, "budget_pacing", F.col("p.priority"), F.col("p.used_pct")),
        card(rise, "top_performer", F.lit("low"), F.col("g.gain")),
        card(idle, "no_active_campaigns", hi(F.col("n").isNull()), F.coalesce("n", F.lit(0)))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ---- pacing plans ------------------------------------------------------------------------------------------


def _allocate(rows: DataFrame, part: list[str], order: str, budget: Column, weight: Column) -> DataFrame:
    """Integer shares of a budget by weight: rounded, never past the budget, the last row takes the rest."""
    w = Window.partitionBy(*part)
    run = w.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    staged = rows.withColumn("_w", weight).withColumn("_share", js_round(budget * (F.col("_w") / F.sum("_w").over(w))))
    capped = staged.withColumn("_cum", F.least(F.sum("_share").over(run), budget)).withColumns({
        "_prev": F.coalesce(F.lag("_cum").over(w.orderBy(order)), F.lit(0)), "_last": F.max(order).over(w)})
    amount = F.when(F.col(order) == F.col("_last"), budget - F.col("_prev")).otherwise(F.col("_cum") - F.col("_prev"))
    return capped.withColumn("cents", amount.cast("bigint")).drop("_w", "_share", "_cum", "_prev", "_last")


def _even(budget: Column, n: Column, i: Column) -> Column:
    """Floor share, with the remainder cents given to the first rows."""
    return F.floor(budget / n) + F.when(i < budget % n, 1).otherwise(0)


def pacing_daily(campaigns: DataFrame, strategy: str) -> DataFrame:
    """(campaign_id, day, cents): the budget spread over the schedule; even, frontload or backload.

    A campaign contributes one row per day, so its window is as long as its schedule.
    """
    c = F.col
    days = campaigns.where((c("budget_cents") > 0) & (c("start_date") <= c("end_date"))).select(
        "campaign_id", "budget_cents", (F.datediff("end_date", "start_date") + 1).alias("n"),
        F.posexplode(F.sequence("start_date", "end_date")).alias("i", "day"))
    if strategy == "even":
        return days.select("campaign_id", "day", _even(c("budget_cents"), c("n"), c("i")).cast("bigint").alias("cents"))
    base = (c("n") - c("i")) if strategy == "frontload" else (c("i") + 1)
    return _allocate(days, ["campaign_id"], "i", c("budget_cents"), F.pow(base.cast("double"), F.lit(1.5))).select("campaign_id", "day", "cents")


PEAK_HOURS = {"frontload": (8, 12), "backload": (18, 22)}


def pacing_hourly(budgets: DataFrame, strategy: str) -> DataFrame:
    """(campaign_id, hour, cents) of a daily budget: peak hours weigh 3, waking hours 1, night 0.2."""
    hours = budgets.where(F.col("budget_daily_cents") > 0).select(
        "campaign_id", F.col("budget_daily_cents").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour"))
    if strategy == "even":
        return hours.select("campaign_id", "hour", _even(F.col("b"), F.lit(24), F.col("hour")).cast("bigint").alias("cents"))
    lo, hi = PEAK_HOURS[strategy]
    h = F.col("hour")
    weight = F.when((h >= lo) & (h < hi), 3.0).when((h >= 6) & (h < 23), 1.0).otherwise(0.2)
    return _allocate(hours, ["campaign_id"], "hour", F.col("b"), weight).select("campaign_id", "hour", "cents")
