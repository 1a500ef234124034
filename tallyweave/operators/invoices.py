"""Checks of extracted invoices, and their filing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyweave.functions import scalars as S

# fixed values: fields and thresholds of the checks
VAT = r"^GB\d{9}(\d{3})?$"
CRITICAL = ("supplier_vat_number", "invoice_number", "invoice_date", "amount_gross", "amount_vat", "currency")
QUOTED = ("invoice_number", "supplier_vat_number", "supplier_address", "customer_address")
AMOUNTS = ("amount_net", "amount_vat", "amount_gross")
NULL_BELOW, OVERALL_FLOOR, CRITICAL_FLOOR, DATE_DAYS, PENCE = 0.5, 0.75, 0.70, 90, "0.02"


def _amount(c: str) -> Column:
    return F.regexp_replace(F.col(c), ",", "").try_cast("decimal(18,4)")


def _reject(rows: DataFrame, field: str, bad: Column) -> DataFrame:
    """The field nulled and its confidence zeroed where bad."""
    mark = F.coalesce(bad, F.lit(False))
    return rows.withColumns(
        {field: F.when(~mark, F.col(field)), f"conf_{field}": F.when(mark, F.lit(0.0)).otherwise(F.col(f"conf_{field}"))}
    )


def sanitise(rows: DataFrame) -> DataFrame:
    """Extracted fields checked in turn; each step sees what the ones before left.

    rows: text fields, conf_<field> doubles, arithmetic_ok, source_text, received_date. Doubtful fields are nulled, then
    malformed VAT numbers, unknown currencies, fields that the source doesn't quote, and amounts that are no numbers.
    Then the sum is checked, and a date far from the receipt loses confidence. overall_confidence is the least of the
    critical ones.
    """
    fields = [c.removeprefix("conf_") for c in rows.columns if c.startswith("conf_")]
    for f in fields:
        rows = _reject(rows, f, F.col(f).isNotNull() & (F.col(f"conf_{f}") < NULL_BELOW))
    if "supplier_vat_number" in fields:
        rows = _reject(rows, "supplier_vat_number", ~F.col("supplier_vat_number").rlike(VAT))
    rows = _reject(rows, "currency", ~F.col("currency").isin(*S.CURRENCIES))
    bare = lambda c: F.lower(F.regexp_replace(c, r"\s", ""))
    source = bare(F.coalesce("source_text", F.lit("")))
    for f in QUOTED:
        if f in fields:
            rows = _reject(rows, f, (source != "") & ~source.contains(bare(F.col(f))))
    for f in AMOUNTS:
        rows = _reject(rows, f, F.col(f).isNotNull() & _amount(f).isNull())
    off = F.abs(_amount("amount_net") + _amount("amount_vat") - _amount("amount_gross"))
    rows = rows.withColumn("arithmetic_ok", F.coalesce(off <= F.lit(PENCE).cast("decimal(4,2)"), F.col("arithmetic_ok")))
    day = F.try_to_date("invoice_date", "yyyy-MM-dd")
    rows = _reject(rows, "invoice_date", F.col("invoice_date").isNotNull() & day.isNull())
    far = F.abs(F.datediff(day, "received_date")) > DATE_DAYS
    rows = rows.withColumn(
        "conf_invoice_date",
        F.when(F.coalesce(far, F.lit(False)), F.least("conf_invoice_date", F.lit(0.3))).otherwise(F.col("conf_invoice_date")),
    )
    return rows.withColumn("overall_confidence", F.least(*(F.col(f"conf_{f}") for f in CRITICAL)))


def escalations() -> Column:
    """Why a checked result should be extracted anew; empty if it needn't."""
    amounts = F.lit(True)
    for f in AMOUNTS:
        amounts = amounts & F.col(f).isNotNull()
    far = F.abs(F.datediff(F.try_to_date("invoice_date", "yyyy-MM-dd"), "received_date")) > DATE_DAYS
    reasons = [F.when(F.col("overall_confidence") < OVERALL_FLOOR, F.lit("overall"))]
    reasons += [F.when(F.col(f"conf_{f}") < CRITICAL_FLOOR, F.lit(f)) for f in CRITICAL]
    reasons += [F.when(amounts & ~F.col("arithmetic_ok"), F.lit("arithmetic")), F.when(far, F.lit("date_window"))]
    return F.array_compact(F.array(*reasons))


def file(incoming: DataFrame, filed: DataFrame) -> DataFrame:
    """(invoice_id, decision, filed_number) of incoming invoices (invoice_id, vendor_id, number, gross, received_at).

    The first of a vendor and number is created, unless filed has a live one. A later one of the same gross is a resend;
    another gross makes it a corrected invoice, whose number gets a suffix from its id.
    """
    order = Window.partitionBy("vendor_id", "number").orderBy("received_at", "invoice_id")
    old = filed.groupBy("vendor_id", F.col("invoice_number").alias("number")).agg(F.min_by("amount_gross", "invoice_id").alias("_gross"))
    rows = incoming.join(old, ["vendor_id", "number"], "left").withColumns(
        {"_n": F.row_number().over(order), "_first": F.first("gross").over(order)}
    )
    standing = F.coalesce("_gross", F.when(F.col("_n") > 1, F.col("_first")))
    decision = F.when(standing.isNull(), "created").when(standing == F.col("gross"), "duplicate_resend").otherwise("corrected_invoice")
    number = F.when(
        decision == "corrected_invoice", F.concat("number", F.lit("-corrected-"), F.substring(F.sha2("invoice_id", 256), 1, 6)),
    ).otherwise(F.col("number"))
    return rows.select("invoice_id", decision.alias("decision"), number.alias("filed_number"))
