"""Keyed updates, filing, runs and the report workbook over the derived views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.functions import scalars as S
from tallyweave.functions import sheet
from tallyweave.operators import clearing, pending, updates
from tallyweave.operators import invoices as inv
from tallyweave.plans.fixtures import FY, FY_END, FY_START, Views
from tallyweave.plans.registry import query
from tallyweave.streaming import ingest

C = F.col
NOW = "2024-02-01 00:00:00"
SPAN = f"BETWEEN DATE '{FY_START}' AND DATE '{FY_END}'"


def at(text: str = NOW):
    return F.lit(text).cast("timestamp")


# --- mail ---

AGAIN = "outcome IN ('error', 'no_attachment') AND dismissed_at IS NULL"


@query(f"""SELECT msg_id, CASE WHEN {AGAIN} THEN NULL ELSE outcome END AS outcome, CASE WHEN {AGAIN} THEN NULL
    ELSE error_code END AS error_code,
    CASE WHEN {AGAIN} THEN NULL ELSE processed_at END AS processed_at FROM emails""")
def sink_retry_errors(v: Views):
    return updates.retry_errors(v.emails).select("msg_id", "outcome", "error_code", "processed_at")


@query("""SELECT msg_id, coalesce(outcome, 'pending') AS outcome FROM emails
    UNION ALL SELECT 'new-' || msg_id, 'pending' FROM emails WHERE outcome = 'neither'""")
def sink_email_ignore(v: Views):
    """Incoming messages are inserted unless their id is known."""
    old = v.emails.select("msg_id", F.coalesce("outcome", F.lit("pending")).alias("outcome"))
    new = v.emails.where("outcome = 'neither'").select(F.concat(F.lit("new-"), "msg_id").alias("msg_id"))
    return updates.insert_new(old, v.emails.select("msg_id").union(new))


@query("""SELECT msg_id, CASE WHEN outcome = 'neither' OR processed_at IS NOT NULL THEN 'again: ' || subject ELSE subject END AS subject,
    CASE WHEN processed_at IS NULL THEN outcome END AS outcome,
    CASE WHEN outcome = 'neither' THEN 'new' WHEN processed_at IS NULL THEN 'skipped' ELSE 'updated' END AS what FROM emails""")
def sink_email_rescan(v: Views):
    """All mail is seen again with another subject, by a mailbox that doesn't know what was sorted out."""
    known = v.emails.where("outcome IS NULL OR outcome <> 'neither'").select("msg_id", "subject", "outcome", "processed_at")
    seen = v.emails.select("msg_id", F.concat(F.lit("again: "), "subject").alias("subject"))
    return updates.rescan(known, seen).select("msg_id", "subject", "outcome", "what")


@query("""SELECT 'email' AS kind, msg_id AS id FROM emails WHERE k % 5 = 0
    UNION ALL SELECT DISTINCT 'mark', outcome FROM emails WHERE outcome IS NOT NULL AND outcome <> 'error'""")
def sink_email_reset(v: Views):
    """What is left: mail of other sources, other marks, and no invoice."""
    mail = v.emails.withColumn("source", F.when(C("k") % 5 == 0, "upload").otherwise("error"))
    marks = v.emails.where("outcome IS NOT NULL").select(C("outcome").alias("source")).distinct()
    invoices, mail, marks = updates.reset(v.invoices, mail, marks, "error")
    rows = mail.select(F.lit("email").alias("kind"), C("msg_id").alias("id")).unionByName(
        marks.select(F.lit("mark").alias("kind"), C("source").alias("id"))
    )
    return rows.unionByName(invoices.select(F.lit("invoice").alias("kind"), C("invoice_id").alias("id")))


@query(f"""SELECT msg_id, CASE WHEN k % 4 = 0 THEN 'error' ELSE outcome END AS outcome, CASE WHEN k % 4 = 0 THEN 'E7'
    ELSE error_code END AS error_code,
    CASE WHEN k % 4 = 0 THEN 'no answer from <email> for ' || k END AS error_message,
    CASE WHEN k % 4 = 0 THEN TIMESTAMP '{NOW}' ELSE processed_at END AS processed_at FROM emails""")
def sink_email_outcome(v: Views):
    """Every fourth message fails with a message that names its sender, as does one that isn't known."""
    failed = v.emails.where("k % 4 = 0").select(
        "msg_id", F.concat(F.lit("no answer from "), "from_addr", F.lit(" for "), "k").alias("error_message"),
    )
    failed = failed.union(v.spark.createDataFrame([("unknown", "x")], "msg_id string, error_message string"))
    outcomes = failed.select("msg_id", F.lit("error").alias("outcome"), F.lit("E7").alias("error_code"), "error_message")
    mail = v.emails.withColumn("error_message", F.lit(None).cast("string"))
    return updates.set_outcomes(mail, outcomes, at()).select("msg_id", "outcome", "error_code", "error_message", "processed_at")


@query(f"""SELECT msg_id, CASE WHEN outcome = 'error' THEN TIMESTAMP '{NOW}' ELSE dismissed_at END AS dismissed_at,
    CASE WHEN outcome = 'error' THEN 'resolved' END AS dismissed_reason FROM emails""")
def sink_dismiss(v: Views):
    """All failed messages at once."""
    done = updates.dismiss(v.emails, v.emails.where("outcome = 'error'").select("msg_id"), "resolved", at())
    return done.select("msg_id", "dismissed_at", "dismissed_reason")


@query("""SELECT msg_id, 'dismiss' AS feedback_type, 'not_invoice' AS feedback_value, from_addr, subject, lower(split_part(from_addr,
    '@', 2)) AS sender_domain
    FROM emails WHERE outcome = 'neither'""")
def sink_dismiss_feedback(v: Views):
    return updates.dismissal_feedback(v.emails, v.emails.where("outcome = 'neither'").select("msg_id"), "not_invoice")


@query("SELECT domain FROM blocked UNION SELECT lower(split_part(from_addr, '@', 2)) FROM emails WHERE outcome = 'neither'")
def sink_block_domain(v: Views):
    return updates.block(v.blocked, v.emails.where("outcome = 'neither'"))


# --- vendors, invoices, rates ---


@query("""SELECT vendor_id, canonical_name FROM vendors
    UNION ALL SELECT 'new-' || vendor_id, canonical_name FROM vendors WHERE starts_with(canonical_name, 'red')""")
def sink_vendor_get_or_create(v: Views):
    old = v.vendors.select("vendor_id", "canonical_name")
    new = old.where("canonical_name LIKE 'red%'").select(F.concat(F.lit("new-"), "vendor_id").alias("vendor_id"), "canonical_name")
    return updates.get_or_create(old, old.unionByName(new))


@query("""SELECT invoice_id, CASE WHEN deleted_reason IS NULL AND category = 'travel' THEN DATE '2002-01-01'
    ELSE last_exported_at END AS last_exported_at
    FROM invoices""")
def sink_mark_exported(v: Views):
    chosen = v.invoices.where("category = 'travel'").select("invoice_id")
    return updates.mark_exported(v.invoices, chosen, F.lit("2002-01-01").cast("date")).select("invoice_id", "last_exported_at")


FILED = """filed AS (SELECT vendor_id, invoice_number, arg_min(amount_gross, invoice_id) AS gross FROM invoices
        WHERE k % 3 = 0 AND deleted_reason IS NULL GROUP BY vendor_id, invoice_number),
    incoming AS (SELECT *, row_number() OVER w AS n, first_value(amount_gross) OVER w AS first_gross FROM invoices
        WHERE k % 3 <> 0 WINDOW w AS (PARTITION BY vendor_id, invoice_number ORDER BY invoice_date, invoice_id)),
    standing AS (SELECT i.*, coalesce(f.gross, CASE WHEN n > 1 THEN first_gross END) AS was FROM incoming i LEFT
    JOIN filed f USING (vendor_id, invoice_number)),
    decided AS (SELECT *, CASE WHEN was IS NULL THEN 'created' WHEN was = amount_gross THEN 'duplicate_resend'
    ELSE 'corrected_invoice' END AS decision,
        CASE WHEN was <> amount_gross THEN invoice_number || '-corrected-' || substr(sha256(invoice_id), 1, 6)
    ELSE invoice_number END AS filed_number FROM standing)"""


def _filing(v: Views) -> tuple[DataFrame, DataFrame]:
    """(invoices on file, decisions on the others): every third invoice is on file, and its vendor sends it again."""
    filed = v.invoices.where("k % 3 = 0")
    incoming = v.invoices.where("k % 3 <> 0")
    asked = incoming.select(
        "invoice_id", "vendor_id", C("invoice_number").alias("number"), C("amount_gross").alias("gross"),
        C("invoice_date").alias("received_at"),
    )
    return filed, inv.file(asked, filed.where("deleted_reason IS NULL"))


@query("SELECT invoice_id, decision, filed_number FROM decided", more=FILED)
def sink_invoice_file(v: Views):
    return _filing(v)[1]


@query("""SELECT invoice_id, invoice_number, amount_gross FROM invoices WHERE k % 3 = 0
    UNION ALL SELECT invoice_id, filed_number, amount_gross FROM decided WHERE decision <> 'duplicate_resend'""", more=FILED)
def sink_invoice_row(v: Views):
    """The invoices on file after the decisions."""
    filed, decisions = _filing(v)
    new = v.invoices.drop("invoice_number").join(decisions, "invoice_id").withColumnRenamed("filed_number", "invoice_number")
    return updates.append_filed(filed, v.emails, new, at())[0].select("invoice_id", "invoice_number", "amount_gross")


@query(f"""SELECT msg_id, CASE WHEN hit THEN 'invoice' ELSE outcome END AS outcome, CASE WHEN hit THEN TIMESTAMP '{NOW}'
    ELSE processed_at END AS processed_at
    FROM (SELECT *, msg_id IN (SELECT source_msg_id FROM invoices WHERE k % 3 <> 0) AS hit FROM emails)""")
def sink_invoice_mail(v: Views):
    """The mail that brought them, resends included."""
    filed, decisions = _filing(v)
    new = v.invoices.drop("invoice_number").join(decisions, "invoice_id").withColumnRenamed("filed_number", "invoice_number")
    return updates.append_filed(filed, v.emails, new, at())[1].select("msg_id", "outcome", "processed_at")


@query("""SELECT day, from_ccy, CAST(CASE WHEN from_ccy = 'USD' AND date_diff('day', DATE '1970-01-01', day) % 2 = 0 THEN rate + 0.1
    ELSE rate END AS DECIMAL(18,6)) AS rate
    FROM fx_rates UNION ALL SELECT DATE '2030-01-01', 'USD', 0.5""")
def sink_fx_store(v: Views):
    """Rates of even days are fetched anew, and that of a day without one."""
    even = v.fx_rates.where((C("from_ccy") == "USD") & (F.unix_date("day") % 2 == 0))
    fetched = even.withColumn("rate", (C("rate") + F.lit("0.1").cast("decimal(2,1)")).cast("decimal(18,6)"))
    late = v.spark.createDataFrame([("2030-01-01", "USD", "GBP", "0.5")], "day string, from_ccy string, to_ccy string, rate string")
    late = late.select(C("day").cast("date"), "from_ccy", "to_ccy", C("rate").cast("decimal(18,6)"))
    return updates.store_rates(v.fx_rates, fetched.select(*late.columns).unionByName(late)).select("day", "from_ccy", "rate")


# --- sources and runs ---


@query("""SELECT source, CAST(max(day) AS DATE) AS mark FROM (SELECT account AS source, booking_date AS day FROM transactions
    UNION ALL SELECT 'amex', DATE '2005-01-01' UNION ALL SELECT 'cash', NULL) GROUP BY source""")
def sink_watermark(v: Views):
    """Marks merged by source; a null mark keeps the old one."""
    old = v.transactions.groupBy(C("account").alias("source")).agg(F.max("booking_date").alias("mark"))
    new = v.spark.createDataFrame([("amex", "2005-01-01"), ("wise-GBP", None), ("cash", None)], "source string, mark string")
    return updates.advance_marks(old, new.select("source", C("mark").cast("date").alias("mark")))


@query("""SELECT source, CAST(CASE WHEN source = 'ms365' THEN 1 ELSE n + 1 END AS BIGINT) AS retry_count
    FROM (SELECT domain AS source, count(*) AS n FROM feedback GROUP BY domain UNION ALL SELECT 'ms365', 0)
    WHERE source NOT IN (SELECT domain FROM blocked)""")
def sink_reauth(v: Views):
    """All sources and a new one fail once more; then some work again."""
    old = v.feedback.groupBy(C("domain").alias("source")).agg(F.count("*").alias("retry_count"))
    failed = old.select("source").union(v.spark.createDataFrame([("ms365",)], "source string"))
    return updates.resolve_reauth(updates.count_reauth(old, failed), v.blocked.select(C("domain").alias("source")))


LATE = "TIMESTAMP '2024-01-30 12:00:00'"


@query(f"""SELECT run_id, CASE WHEN status = 'running' AND started_at < {LATE} - INTERVAL 1 HOUR THEN 'interrupted'
    ELSE status END AS status FROM runs""")
def sink_run_stale(v: Views):
    """Runs of more than an hour are interrupted."""
    return updates.interrupt_stale(v.runs, at("2024-01-30 12:00:00")).select("run_id", "status")


@query("SELECT run_id, CASE WHEN status = 'running' AND operation = 'other' THEN 'cancelled' ELSE status END AS status FROM runs")
def sink_run_cancel(v: Views):
    return updates.cancel(v.runs, v.runs.where("operation = 'other'").select("run_id")).select("run_id", "status")


@query(f"""SELECT run_id, operation, CASE WHEN status = 'running' AND operation = 'ingest_email'
    AND started_at < {LATE} - INTERVAL 1 HOUR THEN 'interrupted' ELSE status END AS status
    FROM runs UNION ALL SELECT 'email-1', 'ingest_email', 'running'""")
def sink_run_begin(v: Views):
    """A run begins, twice under one name; stale ones of its operation are interrupted."""
    now = at("2024-01-30 12:00:00")
    once = updates.begin_run(v.runs.withColumn("stats_json", F.lit("{}")), "email-1", "ingest_email", now)
    return updates.begin_run(once, "email-1", "ingest_email", now).select("run_id", "operation", "status")


@query("SELECT run_id, status, CASE WHEN status = 'running' THEN '{\"seen\": 1}' ELSE '{}' END AS stats_json FROM runs")
def sink_run_update(v: Views):
    runs = v.runs.withColumn("stats_json", F.lit("{}"))
    stats = runs.where("status = 'running'").select("run_id", F.lit('{"seen": 1}').alias("stats_json"))
    return updates.update_stats(runs, stats).select("run_id", "status", "stats_json")


@query(f"""SELECT run_id, CASE WHEN status = 'running' THEN 'partial' ELSE status END AS status, CASE WHEN status = 'running' THEN {LATE}
    ELSE ended_at END AS ended_at FROM runs""")
def sink_run_complete(v: Views):
    runs = v.runs.withColumn("stats_json", F.lit("{}"))
    done = runs.where("status = 'running'").select("run_id", F.lit("partial").alias("status"), F.lit('{"seen": 2}').alias("stats_json"))
    return updates.complete_runs(runs, done, at("2024-01-30 12:00:00")).select("run_id", "status", "ended_at")


@query("""SELECT account AS source, 'ok:' || count(*) AS outcome FROM transactions GROUP BY account
    UNION ALL SELECT 'lost', 'error:AnalysisException'""")
def sm_partial(v: Views):
    """A source without a folder fails; the others are read as streams nevertheless."""
    of = lambda name: lambda: ingest.folder_stream(v.spark, ingest.landed(v.transactions.where(C("account") == name), 3))
    lost = lambda: ingest.folder_stream(v.spark, f"{v.dir}/no_such_table.parquet")
    return ingest.each_source(v.spark, {name: of(name) for name in ("amex", "wise-GBP", "monzo-GBP")} | {"lost": lost})[0]


@query("""SELECT msg_id, CAST(s AS DECIMAL(38,2)) AS spent, s <= 5000.00 AS granted
    FROM (SELECT msg_id, sum(value) OVER (PARTITION BY CAST(received_at AS DATE) ORDER BY received_at, msg_id) AS s FROM emails)""")
def ag_budget(v: Views):
    """Each day's run spends up to a ceiling."""
    calls = v.emails.withColumn("run", F.to_date("received_at"))
    return updates.spending(calls, "run", ["received_at", "msg_id"], "value", "5000.00").select("msg_id", "spent", "granted")


# --- clearing and pending rows in the ledger ---


@query("""SELECT txn_id, CASE WHEN unclear THEN 'transfer_unconfirmed' WHEN NOT unclear THEN coalesce(category, 'amex_clearing')
    ELSE category END AS category
    FROM transactions LEFT JOIN (SELECT txn_id, max(n > 1) AS unclear FROM (SELECT txn_id, count(*) OVER (PARTITION BY msg_id) AS n
    FROM statements s JOIN transactions t
        ON txn_type = 'transfer' AND (account LIKE 'wise%' OR account LIKE 'monzo%') AND booking_date BETWEEN close_date + 1
    AND close_date + 35
        AND abs(abs(amount) - billed) <= 0.50) GROUP BY txn_id) m USING (txn_id)""")
def clr_apply(v: Views):
    return clearing.apply(v.transactions, v.statements).select("txn_id", "category")


@query("""SELECT auth_id, txn_id, day, CASE WHEN NOT known AND seen = first THEN 'recorded' WHEN txn_id = registered THEN 'already_known'
    ELSE 'ambiguous' END AS outcome
    FROM (SELECT s.auth_id, s.txn_id, s.day, row(s.day, s.txn_id) AS seen, min(row(s.day, s.txn_id)) OVER w AS first,
    l.pending IS NOT NULL AS known,
            coalesce(l.pending, first_value(s.txn_id) OVER (PARTITION BY s.auth_id ORDER BY s.day, s.txn_id)) AS registered
        FROM (SELECT auth_id, txn_id, seen + unnest([0, 1]) AS day FROM auths WHERE kind = 'pending') s
        LEFT JOIN (SELECT auth_id, min(txn_id) AS pending FROM auths WHERE k % 7 = 0
    GROUP BY 1) l USING (auth_id) WINDOW w AS (PARTITION BY s.auth_id))""")
def pend_record(v: Views):
    """Every pending row is seen on two days; some authorisations are known."""
    links = v.auths.where("k % 7 = 0").groupBy("auth_id").agg(F.min("txn_id").alias("pending_txn_id"))
    twice = v.auths.where("kind = 'pending'").select("auth_id", "txn_id", F.explode(F.array("seen", F.date_add("seen", 1))).alias("seen"))
    return pending.record(links, twice).withColumnRenamed("seen", "day")


RESOLVED = """resolved AS (SELECT auth_id, arg_min(txn_id, (seen, txn_id)) FILTER (WHERE kind = 'pending') AS pending_txn_id,
    arg_min(txn_id, (seen, txn_id)) FILTER (WHERE kind = 'settled') AS settled_txn_id, min(seen)
    FILTER (WHERE kind = 'pending') AS first_seen FROM auths GROUP BY auth_id)"""


@query("""SELECT txn_id, CASE WHEN status <> 'reversed' AND txn_id IN (SELECT pending_txn_id FROM resolved
    WHERE settled_txn_id IS NULL AND first_seen < DATE '2000-01-01' - 14)
    THEN 'pending_stale' ELSE category END AS category FROM transactions""", more=RESOLVED)
def pend_stale(v: Views):
    live = C("status") != "reversed"
    return pending.flag_stale(v.transactions, pending.resolve(v.auths), "2000-01-01", live).select("txn_id", "category")


# --- the workbook ---

TEXT = "regexp_replace(coalesce(CAST({0} AS VARCHAR), ''), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g')"


def cell(expr: str) -> str:
    text = TEXT.format(expr)
    return f"CASE WHEN regexp_matches({text}, '^[=+\\-@]') THEN '''' || {text} ELSE {text} END"


def flag(expr: str) -> str:
    return f"CASE WHEN {expr} THEN 'TRUE' ELSE 'FALSE' END"


def moment(expr: str) -> str:
    return f"coalesce(strftime({expr}, '%Y-%m-%dT%H:%M:%S'), '')"


#: For each tab: its cells in order as SQL ('' where the views have nothing to fill it), and where its rows come from.
SQL_TABS = {
    "reconciliation": (
        [cell(c) for c in ("row_id", "fiscal_year", "state", "match_score", "invoice_id", "invoice_number", "invoice_date", "canonical_name", "i.category", "i.currency",
                           "amount_gross", "amount_gross_gbp", "r.txn_id", "booking_date", "account", "description_raw", "match_reason")]
        + [flag("state = 'user_verified'"), "''", flag("state = 'user_personal'"), flag("state = 'user_ignore'"), "''", "''", "''"],
        f"recon r LEFT JOIN invoices i USING (invoice_id) LEFT JOIN vendors n ON n.vendor_id = i.vendor_id LEFT JOIN transactions t ON t.txn_id = r.txn_id WHERE fiscal_year = '{FY}'",
    ),
    "unmatched_invoices": (
        [
            cell(c) for c in ("invoice_id", "canonical_name", "invoice_number", "invoice_date", "currency", "amount_gross", "category")
        ] + ["''"],
        f"""invoices LEFT JOIN vendors USING (vendor_id)
            WHERE deleted_reason IS NULL AND invoice_date {SPAN} AND invoice_id NOT IN (SELECT invoice_id FROM recon
            WHERE state <> 'unmatched')""",
    ),
    "unmatched_transactions": (
        [cell(c) for c in (
            "txn_id", "booking_date", "account", "description_raw", "currency", "amount", "amount_gbp", "txn_type", "category",
        )],
        f"""transactions t WHERE booking_date {SPAN} AND txn_type <> 'transfer' AND NOT EXISTS (SELECT 1 FROM recon r
            WHERE r.txn_id = t.txn_id)""",
    ),
    "exceptions": (
        ["kind", cell("subject"), cell("amount"), moment("detected_at"), cell("detail"), "action_needed"],
        """(SELECT 'email_error' AS kind, subject, value AS amount, received_at AS detected_at, error_code AS detail,
            'retry or dismiss' AS action_needed
                FROM emails WHERE outcome = 'error' AND dismissed_at IS NULL
            UNION ALL SELECT 'fx_error', invoice_number, amount_gross, CAST(invoice_date AS TIMESTAMP), fx_error, 'set a rate'
            FROM invoices WHERE deleted_reason IS NULL AND fx_error IS NOT NULL
            UNION ALL SELECT 'orphan_refund', description_raw, amount, CAST(booking_date AS TIMESTAMP), account, 'link a purchase'
            FROM transactions t WHERE txn_type = 'refund'
                AND NOT EXISTS (SELECT 1 FROM transactions p
            WHERE p.account = t.account AND p.description_canonical = t.description_canonical AND p.amount > 0
                    AND p.booking_date BETWEEN t.booking_date - 180 AND t.booking_date))""",
    ),
    "sales": (
        [
            cell("txn_id"), cell("booking_date"), cell("description_raw"), cell("currency"), cell("amount"), cell("amount_gbp"),
            cell("invoice_id"), "''",
        ],
        """transactions t LEFT JOIN (SELECT txn_id AS rt, min(invoice_id) AS invoice_id FROM recon WHERE txn_id IS NOT NULL
            GROUP BY 1) ON rt = txn_id WHERE txn_type = 'income'""",
    ),
    "run_status": ([cell("run_id"), moment("started_at"), moment("ended_at"), cell("status"), "''", "''", "''", "''"], "runs"),
}


def tabs(v: Views) -> dict[str, DataFrame]:
    """The rows of each tab, with the columns that the views can fill."""
    from tallyweave.operators.ledger import link_refunds
    from tallyweave.plans.reports import in_year, live

    names = v.vendors.select("vendor_id", C("canonical_name").alias("supplier"))
    txns = v.transactions.select("txn_id", "booking_date", "account", C("description_raw").alias("description"))
    recon = v.recon.where(C("fiscal_year") == FY).join(v.invoices.drop("k"), "invoice_id", "left").join(names, "vendor_id", "left").join(txns, "txn_id", "left")
    state = lambda s: C("state") == s
    recon = recon.withColumns(
        {
            "score": C("match_score"), "amount_gbp": C("amount_gross_gbp"), "verified": state("user_verified"),
            "personal": state("user_personal"), "ignored": state("user_ignore"),
        }
    )
    open_ = v.invoices.where(live() & in_year("invoice_date")).join(
        v.recon.where("state <> 'unmatched'"), "invoice_id", "left_anti",
    ).join(names, "vendor_id", "left")
    free = v.transactions.where(in_year("booking_date")).where("txn_type <> 'transfer'").join(v.recon, "txn_id", "left_anti").withColumn("description", C("description_raw"))
    linked = v.recon.where("txn_id IS NOT NULL").groupBy("txn_id").agg(F.min("invoice_id").alias("matched_invoice"))
    sales = v.transactions.where("txn_type = 'income'").join(linked, "txn_id", "left")
    sales = sales.select(
        C("txn_id").alias("row_id"), C("booking_date").alias("date"), C("description_raw").alias("counterparty"), "currency", "amount",
        "amount_gbp", "matched_invoice",
    )
    orphans = link_refunds(v.transactions).where("purchase_id IS NULL").select("txn_id").join(v.transactions, "txn_id")

    def trouble(rows: DataFrame, kind: str, subject: str, amount: str, day: str, detail: str, action: str) -> DataFrame:
        return rows.select(
            F.lit(kind).alias("kind"), C(subject).alias("subject"), C(amount).alias("amount"),
            C(day).cast("timestamp").alias("detected_at"), C(detail).alias("detail"), F.lit(action).alias("action_needed"),
        )

    exceptions = (
        trouble(
            v.emails.where("outcome = 'error' AND dismissed_at IS NULL"), "email_error", "subject", "value", "received_at", "error_code",
            "retry or dismiss",
        )
        .unionByName(
            trouble(
                v.invoices.where(live() & C("fx_error").isNotNull()), "fx_error", "invoice_number", "amount_gross", "invoice_date",
                "fx_error", "set a rate",
            )
        )
        .unionByName(trouble(orphans, "orphan_refund", "description_raw", "amount", "booking_date", "account", "link a purchase"))
    )
    return {
        "reconciliation": recon.drop("description_canonical"), "unmatched_invoices": open_, "unmatched_transactions": free,
        "exceptions": exceptions, "sales": sales, "run_status": v.runs.select("run_id", "started_at", "ended_at", "status"),
    }


def _tab_query(name: str, tab: str) -> None:
    columns = [c for _, c in sheet.TABS[tab]]
    exprs, rows = SQL_TABS[tab]
    sql = "SELECT " + ", ".join(f"{e} AS {c}" for e, c in zip(exprs, columns, strict=True)) + f" FROM {rows}"
    query(sql, name=name)(lambda v: sheet.cells(tabs(v)[tab], tab))


_tab_query("rp_reconciliation", "reconciliation")
_tab_query("rp_exceptions", "exceptions")
for _tab in ("unmatched_invoices", "unmatched_transactions", "sales", "run_status"):
    _tab_query(f"fn_cells_{_tab}", _tab)


def _all_tabs() -> str:
    parts = []
    for tab, (exprs, rows) in SQL_TABS.items():
        heads = " || '|' || ".join("'" + h.replace("'", "''") + "'" for h, _ in sheet.TABS[tab])
        parts.append(f"SELECT '{tab}' AS tab, true AS header, {heads} AS line")
        parts.append(f"SELECT '{tab}', false, " + " || '|' || ".join(f"({e})" for e in exprs) + f" FROM {rows}")
    return " UNION ALL ".join(parts)


@query(_all_tabs())
def sink_sheet_rect(v: Views):
    """All tabs of the workbook, each a rectangle of headers and cells."""
    out = None
    for tab, rows in tabs(v).items():
        part = sheet.rectangle(rows, tab).select("tab", "header", F.array_join("cells", "|").alias("line"))
        out = part if out is None else out.unionByName(part)
    return out


# --- small scalar rules and sample queries ---


@query(f"""SELECT o_orderkey, currency IN {S.STRICT_CURRENCIES} AS strict, currency IN {S.CURRENCIES} AS wide
    FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'GBP' WHEN 1 THEN 'SGD' WHEN 2 THEN 'PLN' ELSE 'XAU' END AS currency
    FROM orders)""")
def fn_ccy_strict(v: Views):
    """The narrow list of currencies for money beside the wide one for extracted fields."""
    ccy = F.element_at(F.array(*map(F.lit, ("GBP", "SGD", "PLN", "XAU"))), (C("o_orderkey") % 4 + 1).cast("int"))
    rows = v.table("orders").select("o_orderkey", ccy.alias("currency"))
    return rows.select(
        "o_orderkey", C("currency").isin(*S.STRICT_CURRENCIES).alias("strict"), C("currency").isin(*S.CURRENCIES).alias("wide"),
    )


@query("SELECT l_orderkey, l_linenumber, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) AS text FROM lineitem")
def fn_money_str(v: Views):
    return v.table("lineitem").select("l_orderkey", "l_linenumber", S.money_text(C("l_extendedprice").cast("string")).alias("text"))


@query("""SELECT 'FY-' || y || '-' || lpad(CAST((y + 1) % 100 AS VARCHAR), 2, '0') AS label, CAST(date_diff('day', make_date(y, 3, 1),
    make_date(y + 1, 3, 1)) AS INTEGER) AS days FROM (SELECT unnest(range(min(fy), max(fy) + 1)) AS y
    FROM (SELECT year(invoice_date) - CASE WHEN month(invoice_date) < 3 THEN 1 ELSE 0 END AS fy FROM invoices))""")
def fn_fy_iter(v: Views):
    """The fiscal years from the first invoice's to the last one's, with their days."""
    first, last = v.invoices.agg(F.min(S.fiscal_year(C("invoice_date"))), F.max(S.fiscal_year(C("invoice_date")))).first()
    return S.fiscal_years(v.spark, first, last)


@query(r"""SELECT p_partkey, replace(replace(replace(name, '\', '\\'), '%', '\%'), '_', '\_') AS pattern, true AS itself, contains(name, '%') AS other
    FROM (SELECT p_partkey, replace(p_name, ' ', CASE p_partkey % 4 WHEN 0 THEN '_' WHEN 1 THEN '%' WHEN 2 THEN '\' ELSE ' ' END) AS name FROM part)""")
def fn_escape_like(v: Views):
    """Names with signs that LIKE reads, escaped: the pattern finds the name itself, and nothing where a sign is another letter."""
    sign = F.get(F.array(*map(F.lit, ("_", "%", "\\", " "))), (C("p_partkey") % 4).cast("int"))
    named = v.table("part").select("p_partkey", F.replace("p_name", F.lit(" "), sign).alias("name"))
    told = named.withColumn("pattern", S.escape_like(C("name")))
    moved = F.translate("name", "_\\", "xx")  # a percent sign stays
    return told.select("p_partkey", "pattern", F.expr("name LIKE pattern").alias("itself"), (moved.eqNullSafe(C("name")) & C("name").contains("%")).alias("other"))


@query("SELECT o_orderkey, (o_orderdate + INTERVAL 23 HOUR) AT TIME ZONE 'Europe/London' AT TIME ZONE 'UTC' AS at FROM orders")
def fn_utc(v: Views):
    """London times as moments in UTC."""
    local = (C("o_orderdate") + F.expr("INTERVAL 23 HOURS")).cast("timestamp_ntz")
    return v.table("orders").select("o_orderkey", S.london_to_utc(local).alias("at"))


@query("""SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'stripe' WHEN 1 THEN 'paddle' WHEN 2 THEN 'login_gated' WHEN 3 THEN 'unknown'
    ELSE 'generic' END AS value FROM pages""")
def fn_provider(v: Views):
    """Hosts of each kind in turn, and an address without one."""
    hosts = F.array(*map(F.lit, ("https://PAY.stripe.com", "https://vendors.paddle.com", "https://accounts.webflow.com", "", None)))
    host = F.get(hosts, (C("page_id") % 5).cast("int"))
    return v.table("pages").select(
        "page_id",
        S.provider(
            F.when(host.isNull(), C("url")).when(host == "", F.lit("no address")).otherwise(F.concat(host, F.lit("/invoice/1")))
        ).alias("value"),
    )


def sample(name: str, sql: str, plan) -> None:
    query(sql, name=name)(plan)


sample("rp_readme_month", f"SELECT invoice_id, amount_gross, invoice_date FROM invoices WHERE invoice_date >= DATE '{FY_START}'",
       lambda v: v.invoices.where(
           C("invoice_date") >= F.lit(FY_START).cast("date")
       ).select("invoice_id", "amount_gross", "invoice_date"))
sample("rp_readme_unmatched", """SELECT booking_date, description_raw, amount_gbp FROM transactions WHERE txn_id NOT IN (SELECT txn_id
    FROM recon WHERE txn_id IS NOT NULL)""",
       lambda v: v.transactions.join(
           v.recon.select("txn_id"), "txn_id", "left_anti",
       ).select("booking_date", "description_raw", "amount_gbp"))
sample("rp_readme_errors", "SELECT msg_id, error_code FROM emails WHERE outcome = 'error'",
       lambda v: v.emails.where("outcome = 'error'").select("msg_id", "error_code"))
sample("rp_readme_expenses", f"""SELECT CAST(sum(amount_gbp) AS DECIMAL(38,2)) AS total FROM transactions
    WHERE txn_type = 'purchase' AND booking_date >= DATE '{FY_START}'""",
       lambda v: v.transactions.where(
           (C("txn_type") == "purchase") & (C("booking_date") >= F.lit(FY_START).cast("date"))
       ).agg(F.sum("amount_gbp").cast("decimal(38,2)").alias("total")))
sample("rp_readme_vendors", """SELECT v.vendor_id, min(canonical_name) AS canonical_name, count(invoice_id) AS n FROM vendors v LEFT
    JOIN invoices i ON i.vendor_id = v.vendor_id GROUP BY v.vendor_id""",
       lambda v: v.vendors.join(v.invoices.groupBy("vendor_id").agg(F.count("*").alias("n")), "vendor_id", "left").select(
           "vendor_id", "canonical_name", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
       ))
sample("rp_readme_vendor", """SELECT invoice_date, amount_gross, currency FROM invoices WHERE vendor_id IN (SELECT vendor_id FROM vendors
    WHERE contains(canonical_name, 'red'))""",
       lambda v: v.invoices.join(
           v.vendors.where(C("canonical_name").contains("red")), "vendor_id", "left_semi",
       ).select("invoice_date", "amount_gross", "currency"))
sample("rp_directives_recent", "SELECT run_id, started_at, status FROM runs ORDER BY started_at DESC, run_id LIMIT 5",
       lambda v: v.runs.orderBy(F.desc("started_at"), "run_id").select("run_id", "started_at", "status").limit(5))
sample("rp_directives_running", "SELECT run_id, operation, started_at FROM runs WHERE status = 'running'",
       lambda v: v.runs.where("status = 'running'").select("run_id", "operation", "started_at"))
sample("rp_directives_waiting", "SELECT count(*) AS n FROM emails WHERE processed_at IS NULL",
       lambda v: v.emails.where("processed_at IS NULL").agg(F.count("*").alias("n")))
sample("rp_directives_outcomes", "SELECT outcome, count(*) AS n FROM emails GROUP BY outcome",
       lambda v: v.emails.groupBy("outcome").agg(F.count("*").alias("n")))


@query("""SELECT run_id, operation, started_at, ended_at, status, CASE WHEN k % 6 <> 0 THEN k % 90 END AS seen
    FROM (SELECT *, CAST(substr(run_id, 5) AS BIGINT) AS k FROM runs) WHERE status = 'running'""")
def rp_runs_running(v: Views):
    """Runs that still run, with what their statistics say; malformed ones say nothing."""
    k = F.substring("run_id", 5, 20).cast("bigint")
    json = F.concat(F.lit('{"seen": '), k % 90, F.when(k % 6 == 0, "").otherwise("}"))
    rows = v.runs.where("status = 'running'").withColumn("stats_json", json)
    return rows.select(
        "run_id", "operation", "started_at", "ended_at", "status",
        F.try_variant_get(F.try_parse_json("stats_json"), "$.seen", "bigint").alias("seen"),
    )
