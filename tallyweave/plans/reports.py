"""Filters, joins, aggregates and report tabs over the derived views."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyweave.functions import scalars as S
from tallyweave.plans.fixtures import FY, FY_END, FY_START, Views
from tallyweave.plans.registry import query

SPAN = f"BETWEEN DATE '{FY_START}' AND DATE '{FY_END}'"
MAIL_START, MAIL_END = "2024-01-05", "2024-01-20"
CENTS = "decimal(38,2)"
AS_CENTS = "CAST({} AS DECIMAL(38,2))"


def live() -> Column:
    return F.col("deleted_reason").isNull()


def in_year(day: str) -> Column:
    return F.col(day).between(F.lit(FY_START).cast("date"), F.lit(FY_END).cast("date"))


def total(c: str) -> Column:
    """Money sums are decimal sums."""
    return F.coalesce(F.sum(c), F.lit(0)).cast(CENTS)


def filters(
    fy: str | None = None, vendor: str | None = None, category: str | None = None, search: str | None = None,
    exported: bool | None = None, first: str | None = None, last: str | None = None,
) -> Column:
    """Live invoices (joined with vendors) under those conditions that are given."""
    conds = [live()]
    if fy:
        a, b = S.label_bounds(fy)
        conds.append(F.col("invoice_date").between(F.lit(a).cast("date"), F.lit(b).cast("date")))
    if vendor:
        conds.append(F.col("vendor_id") == vendor)
    if category:
        conds.append(F.col("category") == category)
    if search:
        conds.append(S.like_prefix(F.col("canonical_name"), search) | S.like_prefix(F.col("invoice_number"), search))
    if exported is not None:
        conds.append(F.col("last_exported_at").isNotNull() if exported else F.col("last_exported_at").isNull())
    if first:
        conds.append(F.col("invoice_date") >= F.lit(first).cast("date"))
    if last:
        conds.append(F.col("invoice_date") <= F.lit(last).cast("date"))
    out = conds[0]
    for c in conds[1:]:
        out = out & c
    return out


# --- filters and projections ---


@query("SELECT invoice_id, invoice_date FROM invoices WHERE deleted_reason IS NULL")
def flt_soft_delete(v: Views):
    return v.invoices.where(live()).select("invoice_id", "invoice_date")


@query(f"SELECT invoice_id, amount_gross FROM invoices WHERE invoice_date {SPAN}")
def flt_fy(v: Views):
    return v.invoices.where(in_year("invoice_date")).select("invoice_id", "amount_gross")


@query(f"SELECT msg_id FROM emails WHERE CAST(received_at AS DATE) BETWEEN DATE '{MAIL_START}' AND DATE '{MAIL_END}'")
def flt_email_fy(v: Views):
    return v.emails.where(F.to_date("received_at").between(F.lit(MAIL_START).cast("date"), F.lit(MAIL_END).cast("date"))).select("msg_id")


@query("""SELECT txn_id, txn_type, status FROM transactions
    WHERE txn_type NOT IN ('transfer') AND status <> 'reversed' AND account IN ('amex', 'wise-GBP')""")
def flt_in_list(v: Views):
    return v.transactions.where(
        ~F.col("txn_type").isin("transfer") & (F.col("status") != "reversed") & F.col("account").isin("amex", "wise-GBP")
    ).select("txn_id", "txn_type", "status")


@query("""SELECT run_id, operation FROM runs WHERE operation NOT IN (SELECT operation FROM runs
    WHERE status = 'failed' AND ended_at IS NULL)""")
def flt_not_in_subq(v: Views):
    return v.runs.join(
        v.runs.where("status = 'failed' AND ended_at IS NULL").select("operation").distinct(), "operation", "left_anti",
    ).select("run_id", "operation")


@query("SELECT invoice_id FROM invoices i WHERE EXISTS (SELECT 1 FROM recon r WHERE r.invoice_id = i.invoice_id AND r.state = 'suggested')")
def flt_exists(v: Views):
    return v.invoices.join(v.recon.where("state = 'suggested'"), "invoice_id", "left_semi").select("invoice_id")


@query("SELECT vendor_id, canonical_name FROM vendors WHERE starts_with(lower(canonical_name), 'small')")
def flt_like_prefix(v: Views):
    return v.vendors.where(S.like_prefix(F.col("canonical_name"), "SMALL")).select("vendor_id", "canonical_name")


@query("SELECT vendor_id FROM vendors WHERE contains(lower(canonical_name), 'ring') OR contains(lower(domain), 'v12')")
def flt_like_infix(v: Views):
    return v.vendors.where(S.like_infix(F.col("canonical_name"), "Ring") | S.like_infix(F.col("domain"), "V12")).select("vendor_id")


@query(f"""SELECT invoice_id, canonical_name, category FROM invoices JOIN vendors USING (vendor_id)
    WHERE deleted_reason IS NULL AND invoice_date {SPAN} AND category = 'travel' AND last_exported_at IS NULL
    AND invoice_date >= DATE '1998-06-01' AND (starts_with(lower(canonical_name), 's') OR starts_with(lower(invoice_number), 's'))""")
def flt_dynamic(v: Views):
    return v.invoices.join(v.vendors, "vendor_id").where(
        filters(fy=FY, category="travel", exported=False, first="1998-06-01", search="S")
    ).select("invoice_id", "canonical_name", "category")


@query("SELECT last_exported_at IS NOT NULL AS exported, count(*) AS n FROM invoices WHERE deleted_reason IS NULL GROUP BY 1")
def flt_null_flag(v: Views):
    return v.invoices.where(live()).groupBy(F.col("last_exported_at").isNotNull().alias("exported")).agg(F.count("*").alias("n"))


@query("""SELECT invoice_id, source_msg_id, vendor_id, upper(canonical_name) AS vendor_name_raw, invoice_number, invoice_date, currency,
    CAST(amount_gross - vat AS DECIMAL(18,2)) AS amount_net, vat AS amount_vat, amount_gross, amount_gross_gbp,
    CAST(0.20 AS DECIMAL(4,2)) AS vat_rate, category, CASE WHEN category = default_category THEN 'vendor' ELSE 'model' END AS category_source,
    'f' || k AS drive_file_id, 'https://drive.example.com/f' || k AS drive_web_view_link, last_exported_at, deleted_reason, canonical_name AS vendor_name,
    fx_error, canonical_name
    FROM (SELECT *, CAST(floor(amount_gross * 100 / 6) / 100 AS DECIMAL(18,2)) AS vat FROM invoices) i LEFT JOIN vendors USING (vendor_id)
    WHERE deleted_reason IS NULL""")
def prj_list(v: Views):
    """The list's columns; what the tables lack follows from those that they have (a fifth on top as tax, files by key)."""
    vat = (F.floor(F.col("amount_gross") * 100 / 6) / 100).cast("decimal(18,2)")
    file = F.concat(F.lit("f"), "k")
    both = v.invoices.join(v.vendors, "vendor_id", "left").where(live()).withColumn("amount_vat", vat)
    return both.select(
        "invoice_id", "source_msg_id", "vendor_id", F.upper("canonical_name").alias("vendor_name_raw"), "invoice_number", "invoice_date", "currency",
        (F.col("amount_gross") - F.col("amount_vat")).cast("decimal(18,2)").alias("amount_net"), "amount_vat", "amount_gross", "amount_gross_gbp",
        F.lit("0.20").cast("decimal(4,2)").alias("vat_rate"), "category",
        F.when(F.col("category") == F.col("default_category"), "vendor").otherwise("model").alias("category_source"), file.alias("drive_file_id"),
        F.concat(F.lit("https://drive.example.com/"), file).alias("drive_web_view_link"), "last_exported_at", "deleted_reason",
        F.col("canonical_name").alias("vendor_name"), "fx_error", "canonical_name",
    )


@query("SELECT invoices.*, canonical_name FROM invoices LEFT JOIN vendors USING (vendor_id) WHERE invoice_number = 'N-96'")
def prj_detail(v: Views):
    return v.invoices.where("invoice_number = 'N-96'").join(v.vendors.select("vendor_id", "canonical_name"), "vendor_id", "left")


@query("SELECT invoice_id, amount_gross FROM invoices WHERE invoice_id IN ('inv-8', 'inv-97', 'inv-100', 'inv-101', 'inv-102', 'inv-103')")
def prj_by_ids(v: Views):
    return v.invoices.where(
        F.col("invoice_id").isin("inv-8", "inv-97", "inv-100", "inv-101", "inv-102", "inv-103")
    ).select("invoice_id", "amount_gross")


@query("""SELECT msg_id, CASE WHEN domain IN (SELECT domain FROM blocked) THEN 'neither' ELSE outcome END AS outcome
    FROM (SELECT *, lower(split_part(from_addr, '@', 2)) AS domain FROM emails)""")
def flt_blocked(v: Views):
    flagged = v.blocked.withColumn("_blocked", F.lit(True))
    e = v.emails.withColumn("domain", S.domain(F.col("from_addr"))).join(flagged, "domain", "left")
    return e.select("msg_id", F.when(F.col("_blocked"), "neither").otherwise(F.col("outcome")).alias("outcome"))


@query("""SELECT run_id, CASE WHEN starts_with(run_id, 'run-1') THEN 'ingest_email' WHEN starts_with(run_id,
    'run-2') THEN 'ingest_invoice' ELSE operation END AS operation FROM runs""")
def prj_case_backfill(v: Views):
    return v.runs.select(
        "run_id",
        F.when(F.col("run_id").startswith("run-1"), "ingest_email").when(
            F.col("run_id").startswith("run-2"), "ingest_invoice",
        ).otherwise(F.col("operation")).alias("operation"),
    )


@query("SELECT invoice_id, coalesce(amount_gross_gbp, amount_gross) AS amount, coalesce(nullif(fx_error, ''), '-') AS note FROM invoices")
def prj_coalesce(v: Views):
    return v.invoices.select(
        "invoice_id", F.coalesce("amount_gross_gbp", "amount_gross").alias("amount"),
        F.coalesce(F.when(F.col("fx_error") != "", F.col("fx_error")), F.lit("-")).alias("note"),
    )


# --- joins ---


@query("SELECT invoice_id, canonical_name FROM invoices LEFT JOIN vendors USING (vendor_id)")
def jn_inv_vendor_left(v: Views):
    return v.invoices.join(v.vendors, "vendor_id", "left").select("invoice_id", "canonical_name")


@query("SELECT invoice_id, domain FROM invoices JOIN vendors USING (vendor_id)")
def jn_inv_vendor_inner(v: Views):
    return v.invoices.join(v.vendors, "vendor_id").select("invoice_id", "domain")


@query("SELECT vendor_id, count(invoice_id) AS n FROM vendors LEFT JOIN invoices USING (vendor_id) GROUP BY vendor_id")
def jn_vendor_inv_left(v: Views):
    return v.vendors.join(v.invoices, "vendor_id", "left").groupBy("vendor_id").agg(F.count("invoice_id").alias("n"))


@query("""SELECT row_id, state, i.invoice_number, t.description_raw FROM recon r LEFT JOIN invoices i USING (invoice_id) LEFT
    JOIN transactions t ON t.txn_id = r.txn_id""")
def jn_recon_3way(v: Views):
    return v.recon.join(v.invoices, "invoice_id", "left").join(
        v.transactions.select("txn_id", "description_raw"), "txn_id", "left",
    ).select("row_id", "state", "invoice_number", "description_raw")


@query("""SELECT invoice_id FROM invoices WHERE deleted_reason IS NULL AND invoice_id NOT IN (SELECT invoice_id FROM recon
    WHERE state <> 'unmatched')""")
def jn_unmatched_inv(v: Views):
    """Anti-join form: an invoice with several rows comes once."""
    return v.invoices.where(live()).join(v.recon.where("state <> 'unmatched'"), "invoice_id", "left_anti").select("invoice_id")


@query("SELECT txn_id FROM transactions t WHERE txn_type <> 'transfer' AND NOT EXISTS (SELECT 1 FROM recon r WHERE r.txn_id = t.txn_id)")
def jn_unmatched_txn(v: Views):
    return v.transactions.where("txn_type <> 'transfer'").join(v.recon, "txn_id", "left_anti").select("txn_id")


@query("""SELECT invoice_id, category FROM invoices WHERE invoice_id IN (SELECT invoice_id FROM recon
    WHERE state IN ('auto_matched', 'user_verified'))""")
def jn_exists_state(v: Views):
    return v.invoices.join(
        v.recon.where("state IN ('auto_matched', 'user_verified')"), "invoice_id", "left_semi",
    ).select("invoice_id", "category")


@query("SELECT invoice_id FROM invoices WHERE source_msg_id IN (SELECT msg_id FROM emails WHERE outcome = 'error')")
def jn_exists_err(v: Views):
    return v.invoices.join(v.emails.where("outcome = 'error'"), F.col("source_msg_id") == F.col("msg_id"), "left_semi").select("invoice_id")


@query("SELECT msg_id, value, subject FROM feedback JOIN (SELECT msg_id, subject FROM emails) USING (msg_id)")
def jn_feedback(v: Views):
    return v.feedback.join(v.emails.select("msg_id", "subject"), "msg_id").select("msg_id", "value", "subject")


@query("""SELECT invoice_id, coalesce(n, 0) AS confirmed FROM invoices LEFT
    JOIN (SELECT vendor_id, CAST(sum(confirmed_count) AS BIGINT) AS n FROM hints GROUP BY 1) USING (vendor_id)""")
def jn_hints(v: Views):
    h = v.hints.groupBy("vendor_id").agg(F.sum("confirmed_count").alias("n"))
    return v.invoices.join(h, "vendor_id", "left").select("invoice_id", F.coalesce("n", F.lit(0)).alias("confirmed"))


@query("SELECT txn_id FROM transactions WHERE txn_id NOT IN (SELECT txn_id FROM recon WHERE txn_id IS NOT NULL)")
def jn_txn_semi_readme(v: Views):
    return v.transactions.join(v.recon.where("txn_id IS NOT NULL"), "txn_id", "left_anti").select("txn_id")


@query("""SELECT a.invoice_id, b.invoice_id AS twin_id, CASE WHEN a.amount_gross = b.amount_gross THEN 'duplicate_resend'
    ELSE 'corrected_invoice' END AS kind FROM invoices a
    JOIN invoices b ON a.vendor_id = b.vendor_id AND a.invoice_number = b.invoice_number AND b.invoice_id < a.invoice_id
    WHERE a.deleted_reason IS NULL AND b.deleted_reason IS NULL""")
def jn_dup_invoice(v: Views):
    rows = v.invoices.where(live()).select("invoice_id", "vendor_id", "invoice_number", "amount_gross")
    b = rows.select(F.col("invoice_id").alias("twin_id"), "vendor_id", "invoice_number", F.col("amount_gross").alias("twin_gross"))
    both = rows.join(b, ["vendor_id", "invoice_number"]).where("twin_id < invoice_id")
    return both.select(
        "invoice_id", "twin_id",
        F.when(F.col("amount_gross") == F.col("twin_gross"), "duplicate_resend").otherwise("corrected_invoice").alias("kind"),
    )


# --- aggregates, windows, sorts ---


@query(f"""SELECT count(*) AS n, {AS_CENTS.format('coalesce(sum(amount_gross_gbp), 0)')} AS total FROM invoices
    WHERE deleted_reason IS NULL AND invoice_date {SPAN}""")
def ag_totals(v: Views):
    return v.invoices.where(live() & in_year("invoice_date")).agg(F.count("*").alias("n"), total("amount_gross_gbp").alias("total"))


@query(f"SELECT state, count(*) AS n FROM recon WHERE fiscal_year = '{FY}' GROUP BY state")
def ag_recon_status(v: Views):
    return v.recon.where(F.col("fiscal_year") == FY).groupBy("state").agg(F.count("*").alias("n"))


@query(f"""SELECT category, {AS_CENTS.format('sum(amount_gross_gbp)')} AS total FROM invoices
    WHERE deleted_reason IS NULL AND invoice_date {SPAN} GROUP BY category ORDER BY total DESC, category""")
def ag_category(v: Views):
    return v.invoices.where(live() & in_year("invoice_date")).groupBy("category").agg(
        F.sum("amount_gross_gbp").cast(CENTS).alias("total")
    ).orderBy(F.desc("total"), "category")


TOP = f"""SELECT vendor_id, min(canonical_name) AS name, {AS_CENTS.format('sum(amount_gross_gbp)')} AS total FROM invoices
    JOIN vendors USING (vendor_id) WHERE deleted_reason IS NULL AND invoice_date {SPAN} GROUP BY vendor_id
    ORDER BY total DESC NULLS LAST, vendor_id LIMIT 5"""


@query(TOP)
def ag_top_vendors(v: Views):
    """Sums by vendor before the names are joined, so the join sees one row a vendor."""
    sums = v.invoices.where(live() & in_year("invoice_date")).groupBy("vendor_id").agg(F.sum("amount_gross_gbp").cast(CENTS).alias("total"))
    named = sums.join(v.vendors.select("vendor_id", F.col("canonical_name").alias("name")), "vendor_id")
    return named.orderBy(F.desc_nulls_last("total"), "vendor_id").limit(5)


@query(f"""SELECT count(*) AS n FROM emails
    WHERE processed_at IS NULL AND CAST(received_at AS DATE) BETWEEN DATE '{MAIL_START}' AND DATE '{MAIL_END}'""")
def ag_pending_emails(v: Views):
    return v.emails.where(
        F.col("processed_at").isNull() & F.to_date("received_at").between(F.lit(MAIL_START).cast("date"), F.lit(MAIL_END).cast("date"))
    ).agg(F.count("*").alias("n"))


@query(
    f"""SELECT (SELECT count(*) FROM invoices WHERE deleted_reason IS NULL AND invoice_date {SPAN}) AS invoice_count,
    (SELECT {AS_CENTS.format('coalesce(sum(amount_gross_gbp), 0)')} FROM invoices
        WHERE deleted_reason IS NULL AND invoice_date {SPAN}) AS total_spend,
    (SELECT '[' || string_agg('{{"state":"' || state || '","n":' || n || '}}', ',' ORDER BY state) || ']'
        FROM (SELECT state, count(*) AS n FROM recon WHERE fiscal_year = '{FY}' GROUP BY state)) AS recon_json,
    (SELECT '[' || string_agg('{{"vendor_id":"' || vendor_id || '","total":' || total || '}}', ',' ORDER BY total DESC, vendor_id) || ']'
        FROM ({TOP})) AS vendors_json,
    (SELECT count(*) FROM emails WHERE processed_at IS NULL) AS pending_emails"""
)
def ag_dashboard(v: Views):
    """One row: every part is aggregated to one row before the parts meet, so the cross joins have one row a side."""
    states = ag_recon_status(v).agg(F.to_json(F.array_sort(F.collect_list(F.struct("state", "n")))).alias("recon_json"))
    order = lambda a, b: F.when(a["total"] > b["total"], -1).when(a["total"] < b["total"], 1).when(a["vendor_id"] < b["vendor_id"], -1).otherwise(1)
    top = ag_top_vendors(v).agg(
        F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("vendor_id", "total")), order), lambda x: x)).alias("vendors_json")
    )
    pending = v.emails.where("processed_at IS NULL").agg(F.count("*").alias("pending_emails"))
    return ag_totals(v).select(
        F.col("n").alias("invoice_count"), F.col("total").alias("total_spend"),
    ).crossJoin(states).crossJoin(top).crossJoin(pending)


@query("""SELECT fiscal_year, '[' || string_agg('{"state":"' || state || '","count":' || n || '}', ',' ORDER BY state) || ']' AS states
    FROM (SELECT fiscal_year, state, count(*) AS n FROM recon GROUP BY 1, 2) GROUP BY fiscal_year""")
def ag_json_group(v: Views):
    """Counts by state as one JSON text a year: the array has an object for each of the few states, however many rows there are."""
    counts = v.recon.groupBy("fiscal_year", "state").agg(F.count("*").alias("count"))
    return counts.groupBy("fiscal_year").agg(F.to_json(F.array_sort(F.collect_list(F.struct("state", "count")))).alias("states"))


@query("SELECT count(*) AS n, min(invoice_date) AS first_day, max(invoice_date) AS last_day FROM invoices WHERE deleted_reason IS NULL")
def ag_coverage(v: Views):
    return v.invoices.where(live()).agg(
        F.count("*").alias("n"), F.min("invoice_date").alias("first_day"), F.max("invoice_date").alias("last_day"),
    )


@query(f"""SELECT vendor_id, canonical_name, count(invoice_id) AS invoice_count,
    {AS_CENTS.format('coalesce(sum(CASE WHEN currency = ' + chr(39) + 'GBP' + chr(39) + ' THEN amount_gross END), 0)')} AS gbp_total,
    max(invoice_date) AS last_day, count(CASE WHEN deleted_reason IS NULL THEN invoice_id END) AS live_count FROM vendors LEFT
    JOIN invoices USING (vendor_id) GROUP BY vendor_id, canonical_name""")
def ag_vendor_list(v: Views):
    sums = v.invoices.groupBy("vendor_id").agg(
        F.count("*").alias("n"), F.sum(F.when(F.col("currency") == "GBP", F.col("amount_gross"))).alias("s"),
        F.max("invoice_date").alias("last_day"), F.count(F.when(live(), 1)).alias("l"),
    )
    return v.vendors.join(sums, "vendor_id", "left").select(
        "vendor_id", "canonical_name", F.coalesce("n", F.lit(0)).alias("invoice_count"),
        F.coalesce("s", F.lit(0)).cast(CENTS).alias("gbp_total"), "last_day", F.coalesce("l", F.lit(0)).alias("live_count"),
    )


@query("SELECT DISTINCT category FROM invoices WHERE deleted_reason IS NULL ORDER BY category")
def ag_distinct_cat(v: Views):
    return v.invoices.where(live()).select("category").distinct().orderBy("category")


@query("""SELECT count(*) AS invoices, count(fx_error) AS fx_errors, count(CASE WHEN last_exported_at IS NULL THEN 1 END) AS unexported
    FROM invoices WHERE deleted_reason IS NULL""")
def ag_counts(v: Views):
    return v.invoices.where(live()).agg(
        F.count("*").alias("invoices"), F.count("fx_error").alias("fx_errors"),
        F.count(F.when(F.col("last_exported_at").isNull(), 1)).alias("unexported"),
    )


@query("SELECT max(CAST(received_at AS DATE)) AS last_day FROM emails")
def ag_max_date(v: Views):
    return v.emails.agg(F.max(F.to_date("received_at")).alias("last_day"))


@query("SELECT vendor_id, CAST(coalesce(sum(confirmed_count), 0) AS BIGINT) AS confirmed FROM hints GROUP BY vendor_id")
def ag_hint_sum(v: Views):
    return v.hints.groupBy("vendor_id").agg(F.coalesce(F.sum("confirmed_count"), F.lit(0)).alias("confirmed"))


@query("""SELECT count(*) AS seen, count(CASE WHEN outcome = 'invoice' THEN 1 END) AS invoices, count(CASE
    WHEN outcome = 'receipt' THEN 1 END) AS receipts, count(CASE WHEN outcome = 'error' THEN 1 END) AS errors, count(CASE
    WHEN processed_at IS NULL THEN 1 END) AS pending FROM emails""")
def ag_process_stats(v: Views):
    n = lambda o: F.count(F.when(F.col("outcome") == o, 1))
    return v.emails.agg(
        F.count("*").alias("seen"), n("invoice").alias("invoices"), n("receipt").alias("receipts"), n("error").alias("errors"),
        F.count(F.when(F.col("processed_at").isNull(), 1)).alias("pending"),
    )


@query("""SELECT outcome, count(*) AS calls, CAST(sum(k % 4000) AS BIGINT) AS tokens, CAST(sum(CAST(round_even(CAST(((k % 4000) * CASE
    WHEN outcome = 'invoice' THEN 3.00 ELSE 0.80 END) * 0.79 AS DECIMAL(18,4)) / 1000000.0,
    4) AS DECIMAL(12,4))) AS DECIMAL(38,4)) AS cost FROM emails WHERE outcome IS NOT NULL GROUP BY outcome""")
def ag_llm_cost(v: Views):
    """Each call's cost is rounded half to even to four decimals, then the costs are summed."""
    price = F.when(F.col("outcome") == "invoice", F.lit("3.00")).otherwise(F.lit("0.80")).cast("decimal(4,2)")
    tokens = F.col("k") % 4000
    cost = F.bround(
        (tokens.cast("decimal(12,0)") * price * F.lit("0.79").cast("decimal(3,2)")).cast("decimal(18,4)").cast("decimal(28,10)") / 1000000,
        4,
    ).cast("decimal(12,4)")
    return v.emails.where("outcome IS NOT NULL").groupBy("outcome").agg(
        F.count("*").alias("calls"), F.sum(tokens).alias("tokens"), F.sum(cost).cast("decimal(38,4)").alias("cost"),
    )


@query("""SELECT operation, run_id, status FROM (SELECT *, row_number() OVER (PARTITION BY operation
    ORDER BY started_at DESC, run_id) AS n FROM runs WHERE status <> 'running') WHERE n = 1""")
def wn_latest_run(v: Views):
    """max_by combines before the shuffle, so an operation with most of the runs is no burden."""
    last = v.runs.where("status <> 'running'").groupBy("operation").agg(
        F.min_by(F.struct("run_id", "status"), F.struct(-F.unix_micros("started_at"), "run_id")).alias("r")
    )
    return last.select("operation", "r.run_id", "r.status")


@query("SELECT txn_id, row_number() OVER (PARTITION BY account, booking_date ORDER BY k) - 1 AS ordinal FROM transactions")
def wn_ordinal(v: Views):
    return v.transactions.select(
        "txn_id", (F.row_number().over(Window.partitionBy("account", "booking_date").orderBy("k")) - 1).cast("bigint").alias("ordinal"),
    )


@query("SELECT vendor_id, arg_min(invoice_id, k) AS invoice_id FROM invoices GROUP BY vendor_id")
def wn_first_seen(v: Views):
    return v.invoices.groupBy("vendor_id").agg(F.min_by("invoice_id", "k").alias("invoice_id"))


@query("SELECT vendor_id, canonical_name FROM vendors ORDER BY canonical_name, vendor_id")
def so_vendors(v: Views):
    return v.vendors.select("vendor_id", "canonical_name").orderBy("canonical_name", "vendor_id")


@query("SELECT invoice_id, invoice_date FROM invoices ORDER BY invoice_date DESC, invoice_id LIMIT 50")
def tk_limit(v: Views):
    return v.invoices.select("invoice_id", "invoice_date").orderBy(F.desc("invoice_date"), "invoice_id").limit(50)


@query("""(SELECT msg_id, value FROM feedback WHERE value = 'negative' ORDER BY created_at DESC, msg_id LIMIT 5)
    UNION ALL (SELECT msg_id, value FROM feedback WHERE value = 'positive' ORDER BY created_at DESC, msg_id LIMIT 5)""")
def tk_feedback(v: Views):
    last = lambda x: v.feedback.where(F.col("value") == x).orderBy(F.desc("created_at"), "msg_id").limit(5)
    return last("negative").unionByName(last("positive")).select("msg_id", "value")


@query("""SELECT run_id, ended_at FROM runs WHERE status IN ('ok', 'partial') AND ended_at IS NOT NULL
    ORDER BY ended_at DESC, run_id LIMIT 1""")
def tk_last_ok(v: Views):
    return v.runs.where(
        "status IN ('ok', 'partial') AND ended_at IS NOT NULL"
    ).select("run_id", "ended_at").orderBy(F.desc("ended_at"), "run_id").limit(1)


@query("SELECT run_id, status FROM runs WHERE status = 'running' UNION ALL SELECT run_id, status FROM runs WHERE status = 'failed'")
def st_union_all(v: Views):
    return v.runs.where("status = 'running'").unionByName(v.runs.where("status = 'failed'")).select("run_id", "status")


@query("""SELECT s.operation, coalesce(CASE WHEN r.operation IS NOT NULL THEN 'running' END, l.status, 'never') AS status
    FROM (VALUES ('ingest_email'), ('ingest_invoice'), ('reconcile')) s(operation) LEFT JOIN (SELECT DISTINCT operation FROM runs
    WHERE status = 'running') r USING (operation)
    LEFT JOIN (SELECT operation, arg_max(status, (started_at, run_id)) AS status FROM runs WHERE status <> 'running'
    GROUP BY 1) l ON l.operation = s.operation""")
def st_running_first(v: Views):
    spine = v.spark.createDataFrame([("ingest_email",), ("ingest_invoice",), ("reconcile",)], "operation string")
    running = v.runs.where("status = 'running'").select("operation", F.lit("running").alias("_running")).distinct()
    latest = v.runs.where("status <> 'running'").groupBy("operation").agg(
        F.max_by("status", F.struct("started_at", "run_id")).alias("_last")
    )
    return spine.join(running, "operation", "left").join(latest, "operation", "left").select(
        "operation", F.coalesce("_running", "_last", F.lit("never")).alias("status"),
    )


# --- report tabs ---

_CELL = "CASE WHEN regexp_matches(x, '^[=+\\-@]') THEN '''' || x ELSE x END"


@query(f"""SELECT invoice_id, canonical_name, invoice_number, invoice_date, currency, amount_gross, category FROM invoices LEFT
    JOIN vendors USING (vendor_id) WHERE deleted_reason IS NULL AND invoice_date {SPAN} AND invoice_id NOT IN (SELECT invoice_id
    FROM recon WHERE state <> 'unmatched')""")
def rp_unmatched_inv(v: Views):
    open_ = v.invoices.where(live() & in_year("invoice_date")).join(v.recon.where("state <> 'unmatched'"), "invoice_id", "left_anti")
    return open_.join(v.vendors, "vendor_id", "left").select(
        "invoice_id", "canonical_name", "invoice_number", "invoice_date", "currency", "amount_gross", "category",
    )


@query(f"""SELECT txn_id, booking_date, account, description_raw, currency, amount, amount_gbp, txn_type, category FROM transactions t
    WHERE booking_date {SPAN} AND txn_type <> 'transfer' AND NOT EXISTS (SELECT 1 FROM recon r WHERE r.txn_id = t.txn_id)""")
def rp_unmatched_txn(v: Views):
    rows = v.transactions.where(in_year("booking_date")).where("txn_type <> 'transfer'").join(v.recon, "txn_id", "left_anti")
    return rows.select("txn_id", "booking_date", "account", "description_raw", "currency", "amount", "amount_gbp", "txn_type", "category")


@query("""SELECT txn_id, booking_date, description_raw, currency, amount, amount_gbp, invoice_id FROM transactions t LEFT
    JOIN (SELECT txn_id AS rt, min(invoice_id) AS invoice_id FROM recon WHERE txn_id IS NOT NULL GROUP BY 1) ON rt = txn_id
    WHERE txn_type = 'income'""")
def rp_sales(v: Views):
    linked = v.recon.where("txn_id IS NOT NULL").groupBy("txn_id").agg(F.min("invoice_id").alias("invoice_id"))
    return v.transactions.where("txn_type = 'income'").join(linked, "txn_id", "left").select(
        "txn_id", "booking_date", "description_raw", "currency", "amount", "amount_gbp", "invoice_id",
    )


@query("""SELECT run_id, operation, started_at, ended_at, status, CAST(date_diff('second', started_at, ended_at) AS BIGINT) AS seconds
    FROM runs""")
def rp_run_status(v: Views):
    return v.runs.select(
        "run_id", "operation", "started_at", "ended_at", "status",
        F.timestamp_diff("SECOND", F.col("started_at"), F.col("ended_at")).alias("seconds"),
    )


@query("""SELECT msg_id, outcome, received_at FROM emails
    WHERE outcome IN ('error', 'no_attachment', 'needs_manual_download') AND dismissed_at IS NULL
    ORDER BY received_at DESC, msg_id LIMIT 50""")
def rp_pending_actions(v: Views):
    rows = v.emails.where(F.col("outcome").isin("error", "no_attachment", "needs_manual_download") & F.col("dismissed_at").isNull())
    return rows.select("msg_id", "outcome", "received_at").orderBy(F.desc("received_at"), "msg_id").limit(50)


@query("""SELECT invoice_id, currency, fx_error FROM invoices WHERE deleted_reason IS NULL AND fx_error IS NOT NULL
    ORDER BY invoice_date DESC, invoice_id LIMIT 50""")
def rp_fx_errors(v: Views):
    return v.invoices.where(live() & F.col("fx_error").isNotNull()).orderBy(F.desc("invoice_date"), "invoice_id").select("invoice_id", "currency", "fx_error").limit(50)


@query("""SELECT invoice_id, category FROM invoices WHERE deleted_reason IS NULL AND source_msg_id IN (SELECT msg_id FROM emails
    WHERE outcome = 'error') ORDER BY invoice_date DESC, invoice_id LIMIT 500""")
def rp_exception_invoices(v: Views):
    bad = v.invoices.where(live()).join(v.emails.where("outcome = 'error'"), F.col("source_msg_id") == F.col("msg_id"), "left_semi")
    return bad.orderBy(F.desc("invoice_date"), "invoice_id").select("invoice_id", "category").limit(500)


STATS = """told AS (SELECT *, date_part('minute', started_at) AS m FROM runs)"""


@query("""SELECT run_id, operation, status, started_at, ended_at, CASE WHEN m % 4 = 0 THEN NULL ELSE m END AS seen,
    CASE WHEN m % 4 = 0 THEN NULL ELSE m % 7 END AS failed FROM told ORDER BY started_at DESC, run_id LIMIT 10""", more=STATS)
def rp_runs_list(v: Views):
    """The latest runs with their statistics, which are JSON; of a text that is none there are no statistics."""
    m = F.minute("started_at")
    stats = F.when(m % 4 == 0, "{broken").otherwise(F.to_json(F.struct(m.alias("seen"), (m % 7).alias("failed"))))
    runs = v.runs.withColumn("stats_json", stats).orderBy(F.desc("started_at"), "run_id").limit(10)
    parsed = runs.withColumn("stats", F.from_json("stats_json", "seen bigint, failed bigint"))
    return parsed.select("run_id", "operation", "status", "started_at", "ended_at", "stats.seen", "stats.failed")


@query("""SELECT operation, max(CASE WHEN status IN ('ok', 'partial') THEN ended_at END) AS last_ok, CASE WHEN max(CASE
    WHEN status IN ('ok', 'partial') THEN ended_at END) >= TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 36 HOUR THEN 'ok' WHEN max(CASE
    WHEN status IN ('ok', 'partial') THEN ended_at END) >= TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 72 HOUR THEN 'warn'
    ELSE 'error' END AS health FROM runs GROUP BY operation""")
def rp_health(v: Views):
    """Age of each operation's last success at a given time: warned of after 36 hours, an error after 72."""
    now = F.lit("2024-01-30 12:00:00").cast("timestamp")
    last = v.runs.groupBy("operation").agg(F.max(F.when(F.col("status").isin("ok", "partial"), F.col("ended_at"))).alias("last_ok"))
    return last.withColumn(
        "health",
        F.when(F.col("last_ok") >= now - F.expr("INTERVAL 36 HOURS"), "ok").when(
            F.col("last_ok") >= now - F.expr("INTERVAL 72 HOURS"), "warn",
        ).otherwise("error"),
    )


@query(f"""SELECT strftime(invoice_date, '%Y-%m') AS month, count(*) AS n, {AS_CENTS.format('sum(amount_gross)')} AS total FROM invoices
    WHERE deleted_reason IS NULL GROUP BY 1""")
def rp_readme(v: Views):
    return v.invoices.where(live()).groupBy(S.year_month(F.col("invoice_date")).alias("month")).agg(
        F.count("*").alias("n"), F.sum("amount_gross").cast(CENTS).alias("total"),
    )


@query("SELECT domain, value, count(*) AS n FROM feedback GROUP BY domain, value")
def rp_directives(v: Views):
    return v.feedback.groupBy("domain", "value").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT currency FROM invoices WHERE fx_error IS NOT NULL")
def rp_fx_currencies(v: Views):
    return v.invoices.where("fx_error IS NOT NULL").select("currency").distinct()
