"""Currency conversion by the latest rate at or before a day, at most five days old. Only recorded rates serve."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.operators.rangejoin import asof_backward

TOLERANCE_DAYS = 5
HOME = "GBP"


def with_rate(rows: DataFrame, rates: DataFrame, day: str, currency: str = "currency", to: str = "fx_rate") -> DataFrame:
    """rows with the rate into HOME; null for HOME itself and where no rate is near enough."""
    into = rates.where(F.col("to_ccy") == HOME).select(F.col("from_ccy").alias(currency), "day", "rate")
    return asof_backward(rows, into, day, "day", "rate", [currency], TOLERANCE_DAYS, to)


def convert(rows: DataFrame, rates: DataFrame, day: str, amount: str = "amount", currency: str = "currency") -> DataFrame:
    """rows with fx_rate, amount_gbp (two decimals, half up) and fx_missing.

    Without a rate amount_gbp is the native amount, so that a ledger row can be written; fx_missing tells such rows.
    """
    found = with_rate(rows, rates, day, currency)
    home = F.col(currency) == HOME
    converted = F.round(F.col(amount) * F.col("fx_rate"), 2)
    return found.withColumn(
        "amount_gbp", F.when(home | F.col("fx_rate").isNull(), F.col(amount)).otherwise(converted).cast("decimal(18,2)"),
    ).withColumn("fx_missing", ~home & F.col("fx_rate").isNull())


def backfill(invoices: DataFrame, rates: DataFrame, force: bool = False) -> DataFrame:
    """Invoices with amount_gross_gbp filled in where it is missing, or fx_error set. force tries those with an error again."""
    todo = F.col("amount_gross_gbp").isNull() & F.col("deleted_reason").isNull() & (F.lit(True) if force else F.col("fx_error").isNull())
    found = with_rate(invoices, rates, "invoice_date", to="_rate")
    value = F.when(F.col("currency") == HOME, F.col("amount_gross")).otherwise(
        F.round(F.col("amount_gross") * F.col("_rate"), 2)
    ).cast("decimal(18,2)")
    error = F.when(value.isNull(), F.concat(F.lit("no rate for "), "currency", F.lit(" near "), F.col("invoice_date").cast("string")))
    return found.select(
        *(
            F.col(c) for c in invoices.columns if c not in ("amount_gross_gbp", "fx_error")
        ), F.when(todo, value).otherwise(F.col("amount_gross_gbp")).alias("amount_gross_gbp"), F.when(todo, error).otherwise(F.col("fx_error")).alias("fx_error")
    )
