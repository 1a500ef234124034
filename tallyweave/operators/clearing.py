"""Card statements cleared by the one transfer that pays them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.operators.rangejoin import interval_join

FIRST_DAY, LAST_DAY, TOLERANCE = 1, 35, "0.50"


def near_transfers(statements: DataFrame, ledger: DataFrame, tolerance: str = TOLERANCE) -> DataFrame:
    """(msg_id, txn_id, delta): transfers from a bank account in a statement's window and near its bill."""
    pence = F.lit(tolerance).cast("decimal(18,2)")
    # amounts within the tolerance share one of two neighbouring bins, so dates and amounts both prune
    step = F.greatest(pence, F.lit("0.01").cast("decimal(18,2)"))
    bin_of = lambda c: F.floor(F.col(c) / step).cast("bigint")
    transfers = ledger.where("txn_type = 'transfer' AND (account LIKE 'wise%' OR account LIKE 'monzo%')")
    debits = transfers.select("txn_id", "booking_date", F.abs("amount").alias("debit")).withColumn("_bin", bin_of("debit"))
    bills = statements.withColumn("_bin", F.explode(F.sequence(bin_of("billed") - 1, bin_of("billed") + 1)))
    pairs = interval_join(bills, debits, "close_date", "booking_date", -FIRST_DAY, LAST_DAY, on=("_bin",))
    delta = F.col("debit") - F.col("billed")
    return pairs.where(F.abs(delta) <= pence).select("msg_id", "txn_id", delta.alias("delta"))


def clear(statements: DataFrame, ledger: DataFrame, tolerance: str = TOLERANCE) -> DataFrame:
    """(msg_id, outcome, debit_txn_id, delta, n_candidates) of every statement (msg_id, billed, close_date).

    outcome is matched for exactly one transfer from a bank account in the window and near the bill, else
    no_candidate or multiple_candidates.
    """
    near = near_transfers(statements, ledger, tolerance)
    found = near.groupBy("msg_id").agg(
        F.count("*").alias("n"), F.min_by("txn_id", "txn_id").alias("txn"), F.min_by("delta", "txn_id").alias("d"),
    )
    n = F.coalesce("n", F.lit(0))
    return statements.join(found, "msg_id", "left").select(
        "msg_id", F.when(n == 1, "matched").when(n == 0, "no_candidate").otherwise("multiple_candidates").alias("outcome"),
        F.when(n == 1, F.col("txn")).alias("debit_txn_id"), F.when(n == 1, F.col("d")).cast("decimal(18,2)").alias("delta"), n.cast("bigint").alias("n_candidates"),
    )


def apply(ledger: DataFrame, statements: DataFrame, tolerance: str = TOLERANCE) -> DataFrame:
    """ledger with the decisions written to category.

    A candidate of an ambiguous statement becomes 'transfer_unconfirmed', whatever it was; the one transfer of a matched
    statement becomes 'amex_clearing' unless it has a category. So the order of the statements makes no difference.
    """
    near = near_transfers(statements, ledger, tolerance)
    several = near.groupBy("msg_id").agg((F.count("*") > 1).alias("_several"))
    marks = near.join(several, "msg_id").groupBy("txn_id").agg(F.max("_several").alias("_unclear"))
    rows = ledger.join(marks, "txn_id", "left")
    category = F.when(F.col("_unclear"), "transfer_unconfirmed").when(
        ~F.col("_unclear"), F.coalesce("category", F.lit("amex_clearing")),
    ).otherwise(F.col("category"))
    return rows.withColumn("category", category).select(*ledger.columns)
