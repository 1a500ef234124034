"""The transaction ledger: keyed merges and refunds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LOOKBACK_DAYS = 180


def merge(old: DataFrame, new: DataFrame, keys: list[str], rules: dict[str, Column | str], order: list[Column]) -> DataFrame:
    """old with new rows merged in by key, as one full outer join; rows have old's columns.

    Of several new rows of a key the last by `order` counts. rules says what a column of an existing row becomes: a
    Column over `old.` and `new.`, or 'new', 'old', or 'first' (the old value unless null). Columns without a rule stay.
    """
    last = Window.partitionBy(*keys).orderBy(*order)
    fresh = new.withColumn("_nth", F.row_number().over(last)).where("_nth = 1").drop("_nth")
    both = old.withColumn("_old", F.lit(True)).alias("old").join(fresh.withColumn("_new", F.lit(True)).alias("new"), _same(keys), "full")
    out = []
    for c in old.columns:
        was, now = F.col(f"old.{c}"), F.col(f"new.{c}") if c in new.columns else F.lit(None)
        rule = rules.get(c, "old")
        changed = {"new": now, "old": was, "first": F.coalesce(was, now)}[rule] if isinstance(rule, str) else rule
        out.append(F.when(F.col("_old").isNull(), now).when(F.col("_new").isNull(), was).otherwise(changed).alias(c))
    return both.select(*out)


def _same(keys: list[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(f"old.{k}").eqNullSafe(F.col(f"new.{k}"))
    return cond


def upsert_transactions(ledger: DataFrame, batch: DataFrame, order: list[Column]) -> DataFrame:
    """Merge on txn_id. A settled row stays settled; category keeps its first value; account and booking date never change."""
    sticky = F.when(F.col("old.status") == "settled", "settled").otherwise(F.col("new.status"))
    fresh = ("txn_type", "description_raw", "description_canonical", "currency", "amount", "amount_gbp")
    return merge(ledger, batch, ["txn_id"], {**dict.fromkeys(fresh, "new"), "status": sticky, "category": "first"}, order)


def link_refunds(ledger: DataFrame, lookback_days: int = LOOKBACK_DAYS) -> DataFrame:
    """(txn_id, purchase_id, category) of every refund: the latest earlier positive row of the same account and description.

    Of rows of one day the smallest id counts. The days with a purchase are spread over the stretch of lookback_days that
    each belongs to and the next one. A refund so has two stretches to look at, and a merchant with a long history is
    split over its stretches. In a stretch a refund meets no purchases but their days, of which there are lookback_days.
    """
    keys = ["account", "description_canonical"]
    rows = ledger.where("txn_type = 'refund' OR amount > 0").select("txn_id", *keys, "booking_date", "amount", "txn_type", "category")
    first = rows.where("amount > 0").groupBy(*keys, F.col("booking_date").alias("_day")).agg(F.min("txn_id").alias("purchase_id"))
    number = lambda c: F.unix_date(F.col(c).cast("date"))
    stretch = lambda c: F.floor(number(c) / (lookback_days + 1))
    days = first.select(*keys, "_day", stretch("_day").alias("_stretch"))
    # (1) of each day with a refund, the latest purchase day of its own stretch up to it; (2) the last one of the stretch before
    marks = rows.where("txn_type = 'refund'").select(*keys, F.col("booking_date").alias("_asked"), stretch("booking_date").alias("_stretch")).distinct()
    both = marks.select(*keys, "_stretch", F.col("_asked").alias("_at"), F.lit(None).cast("date").alias("_day")).unionByName(
        days.select(*keys, "_stretch", F.col("_day").alias("_at"), "_day")
    )
    upto = Window.partitionBy(*keys, "_stretch").orderBy("_at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    own = both.withColumn("_own", F.max("_day").over(upto)).where("_day IS NULL").select(*keys, "_stretch", F.col("_at").alias("_asked"), "_own")
    before = days.groupBy(*keys, (F.col("_stretch") + 1).alias("_stretch")).agg(F.max("_day").alias("_before"))
    latest = own.join(before, [*keys, "_stretch"], "left").withColumn("_day", F.coalesce("_own", "_before"))
    near = latest.where(F.datediff("_asked", "_day") <= lookback_days).join(first, [*keys, "_day"]).select(
        *keys, F.col("_asked").alias("booking_date"), "purchase_id",
    )
    found = rows.where("txn_type = 'refund'").join(near, [*keys, "booking_date"], "left")
    return found.select(
        "txn_id", "purchase_id",
        F.when(F.col("purchase_id").isNull(), "orphan_refund").otherwise(F.coalesce("category", F.lit("refund_matched"))).alias("category"),
    )
