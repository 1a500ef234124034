"""Running sums and refunds of one key that holds all rows, dealt over many tasks."""

from __future__ import annotations

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyweave.operators import ledger, updates

CALLS = "run string, at int, id int, cost decimal(18,2), extra string"


def plain_sums(rows):
    out, spent = {}, {}
    for run, at, i, cost, _ in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        spent[run] = spent.get(run, Decimal(0)) + (cost or 0)
        out[i] = spent[run]
    return out


@pytest.mark.parametrize("hot", [True, False])
def test_running_sums_of_a_hot_key(spark, monkeypatch, hot):
    r = random.Random(5)
    rows = [("a" if hot else r.choice("abc") if r.random() < 0.9 else None, r.randrange(300), k, None if k % 50 == 7 else Decimal(r.randrange(1, 900)) / 100, "x") for k in range(4000)]
    df = spark.createDataFrame(rows, CALLS)
    kept, sizes = updates.written, []

    def noted(x):
        out = kept(x)
        sizes.extend(n["count"] for n in out.groupBy("_range").count().collect())
        return out

    monkeypatch.setattr(updates, "written", noted)
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        found = updates.spending(df, "run", ["at", "id"], "cost", "40.00").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert {x["id"]: x["spent"] for x in found} == plain_sums(rows)
    assert all(x["granted"] == (x["spent"] <= 40) and x["extra"] == "x" for x in found) and len(found) == 4000
    assert len(sizes) >= 6 and max(sizes) < 0.3 * 4000  # no task has more than its share of the hot run
    assert updates.spending(df.limit(0), "run", ["at", "id"], "cost", "40.00").count() == 0


LEDGER = "txn_id string, account string, description_canonical string, booking_date date, amount int, txn_type string, category string"


@pytest.mark.parametrize(("names", "days"), [(1, 2000), (3, 700), (40, 3000)])
def test_refunds_against_looking_at_all_purchases(spark, names, days):
    r = random.Random(names)
    rows = []
    for k in range(1500):
        refund = r.random() < 0.3
        day = dt.date(2020, 1, 1) + dt.timedelta(r.randrange(days))
        rows.append((f"t{k:05}", r.choice(["amex", None]) if names > 1 else "amex", f"m{r.randrange(names)}", day, r.choice([-5, 5]) if refund else r.choice([7, 7, -7]), "refund" if refund else "purchase", "kept" if k % 9 == 0 else None))
    bought = [x for x in rows if x[4] > 0]
    expected = {}
    for t, account, name, day, _, kind, category in rows:
        if kind == "refund":
            able = [(p[3], p[0]) for p in bought if account is not None and p[1] == account and p[2] == name and 0 <= (day - p[3]).days <= 180]
            last = max((d for d, _ in able), default=None)
            purchase = min((p for d, p in able if d == last), default=None)
            expected[t] = (purchase, "orphan_refund" if purchase is None else category or "refund_matched")
    df = spark.createDataFrame(rows, LEDGER)
    found = {x["txn_id"]: (x["purchase_id"], x["category"]) for x in ledger.link_refunds(df).collect()}
    assert found == expected and {x[1] for x in found.values()} >= {"orphan_refund", "refund_matched"}


def test_a_hot_merchant_is_split_by_stretches(spark):
    """The ordered pass runs over a merchant's days of one stretch, never over its whole history."""
    days = spark.range(4000).select(
        F.format_string("t%05d", "id").alias("txn_id"), F.lit("amex").alias("account"), F.lit("m").alias("description_canonical"),
        F.date_add(F.lit("2010-01-01").cast("date"), F.col("id").cast("int")).alias("booking_date"), F.when(F.col("id") % 5 == 0, -5).otherwise(7).alias("amount"),
        F.when(F.col("id") % 5 == 0, "refund").otherwise("purchase").alias("txn_type"), F.lit(None).cast("string").alias("category"),
    )
    found = ledger.link_refunds(days)
    windows = [line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Window" in line and "max(" in line]
    assert windows and all("_stretch" in w for w in windows)
    assert found.where("purchase_id IS NULL").count() == 1 and found.count() == 800
