"""The tabs of the report workbook: which cells a row has, as text that a sheet won't compute."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions import scalars as S

# fixed values: headers of the tabs, in order, each with the column that fills it
TABS = {
    "reconciliation": (
        ("Row ID", "row_id"),
        ("Fiscal Year", "fiscal_year"),
        ("State", "state"),
        ("Score", "score"),
        ("Invoice ID", "invoice_id"),
        ("Invoice Number", "invoice_number"),
        ("Invoice Date", "invoice_date"),
        ("Supplier", "supplier"),
        ("Category", "category"),
        ("Currency", "currency"),
        ("Amount Gross", "amount_gross"),
        ("Amount GBP", "amount_gbp"),
        ("Transaction ID", "txn_id"),
        ("Booking Date", "booking_date"),
        ("Account", "account"),
        ("Description", "description"),
        ("Match Reason", "match_reason"),
        ("Verified", "verified"),
        ("Override Match", "override_match"),
        ("Personal?", "personal"),
        ("Ignore?", "ignored"),
        ("Category Override", "category_override"),
        ("Notes", "notes"),
        ("Drive Link", "drive_link"),
    ),
    "unmatched_invoices": (
        ("Invoice ID", "invoice_id"),
        ("Supplier", "supplier"),
        ("Invoice Number", "invoice_number"),
        ("Invoice Date", "invoice_date"),
        ("Currency", "currency"),
        ("Amount Gross", "amount_gross"),
        ("Category", "category"),
        ("Drive Link", "drive_link"),
    ),
    "unmatched_transactions": (
        ("Transaction ID", "txn_id"),
        ("Booking Date", "booking_date"),
        ("Account", "account"),
        ("Description", "description"),
        ("Currency", "currency"),
        ("Amount", "amount"),
        ("Amount GBP", "amount_gbp"),
        ("txn_type", "txn_type"),
        ("Category", "category"),
    ),
    "exceptions": (
        ("Kind", "kind"),
        ("Subject", "subject"),
        ("Amount", "amount"),
        ("Detected At", "detected_at"),
        ("Detail", "detail"),
        ("Action Needed", "action_needed"),
    ),
    "sales": (
        ("Row ID", "row_id"),
        ("Date", "date"),
        ("Counterparty", "counterparty"),
        ("Currency", "currency"),
        ("Amount", "amount"),
        ("Amount GBP", "amount_gbp"),
        ("Matched Invoice", "matched_invoice"),
        ("Notes", "notes"),
    ),
    "run_status": (
        ("Run ID", "run_id"),
        ("Started At", "started_at"),
        ("Ended At", "ended_at"),
        ("Status", "status"),
        ("Adapters", "adapters"),
        ("Warnings", "warnings"),
        ("Errors", "errors"),
        ("Spent (GBP)", "spent"),
    ),
}


def score_cell(c: Column) -> Column:
    """Four decimals."""
    return c.cast("decimal(18,4)").cast("string")


def _cells(rows: DataFrame, tab: str) -> list[Column]:
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def cell(name: str) -> Column:
        if name not in kinds:
            return F.lit("")
        if kinds[name] == "boolean":
            return S.flag_cell(F.col(name))
        if kinds[name] == "timestamp":
            return S.sheet_cell(F.date_format(name, "yyyy-MM-dd'T'HH:mm:ss"))
        return S.sheet_cell(score_cell(F.col(name)) if name in ("score", "spent") else F.col(name))

    return [cell(c).alias(c) for _, c in TABS[tab]]


def cells(rows: DataFrame, tab: str) -> DataFrame:
    """rows as the tab's columns, all of them text. Columns that rows lack are empty; booleans become TRUE or FALSE."""
    return rows.select(*_cells(rows, tab))


def rectangle(rows: DataFrame, tab: str) -> DataFrame:
    """(tab, header, cells): what is written to the tab, a row of headers and those of the cells, each with its width."""
    head = rows.sparkSession.range(1).select(
        F.lit(tab).alias("tab"), F.lit(True).alias("header"), F.array(*(F.lit(h) for h, _ in TABS[tab])).alias("cells"),
    )
    return head.unionByName(rows.select(F.lit(tab).alias("tab"), F.lit(False).alias("header"), F.array(*_cells(rows, tab)).alias("cells")))
