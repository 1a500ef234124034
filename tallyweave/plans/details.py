"""Scalar rules, feeds, validators, keyed updates and streams over the derived views and the text tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions import category, scalars as S
from tallyweave.operators import invoices as inv
from tallyweave.operators.ledger import merge
from tallyweave.plans.fixtures import Views, canonical_sql, fiscal_sql, txn_type_sql
from tallyweave.plans.registry import query
from tallyweave.sources import feeds
from tallyweave.streaming import ingest

C = F.col
_CTRL = "'[\\x00-\\x1f\\x7f]'"
KEY = "substr(sha256({}), 1, 16)"
NUL = " || chr(0) || "

# --- scalar rules ---


def scalar(name: str, view: str, key: str, expr: Column | None, sql: str, column: str = "value"):
    """A query of one scalar rule over a view."""

    def plan(v: Views) -> DataFrame:
        source = getattr(v, view) if hasattr(Views, view) else v.table(view)
        return source.select(key, expr().alias(column))

    query(f"SELECT {key}, {sql} AS {column} FROM {view}", name=name)(plan)


scalar("fn_canon_desc", "transactions", "txn_id", lambda: S.canonical_description(C("description_raw")), canonical_sql("description_raw"))
scalar(
    "fn_clean_text", "documents", "doc_id", lambda: F.md5(S.clean_text(C("text"))),
    f"md5(trim(regexp_replace(regexp_replace(coalesce(text, ''), {_CTRL}, '', 'g'), '\\s+', ' ', 'g')))",
)
scalar("fn_txn_id_amex", "transactions", "txn_id", lambda: S.card_txn_id(
    F.when(C("k") % 2 == 0, C("txn_id")), C("account"), C("booking_date"), C("description_canonical"), C("amount"), F.lit(0),
),
       f"""CASE WHEN k % 2 = 0 THEN {KEY.format('account' + NUL + 'txn_id')}
           ELSE {
               KEY.format(NUL.join(('account', 'booking_date', 'description_canonical', 'amount', chr(39) + '0' + chr(39))))
           } END""")  # fmt: skip
scalar("fn_txn_id_wise", "transactions", "txn_id", lambda: S.bank_txn_id(
    F.when(C("k") % 3 == 1, C("txn_id")), C("account"), C("booking_date"), C("description_canonical"), C("amount"),
),
       f"""CASE WHEN k % 3 = 1 THEN {KEY.format('account' + NUL + 'txn_id')}
           ELSE {KEY.format(NUL.join(('account', 'booking_date', 'description_canonical', 'amount')))} END""")  # fmt: skip
scalar("fn_txn_id_monzo", "transactions", "txn_id", lambda: S.key16(C("account"), C("txn_id")), KEY.format("account" + NUL + "txn_id"))
scalar(
    "fn_invoice_id", "invoices", "invoice_id", lambda: S.key16(C("source_msg_id"), F.lit("0")), KEY.format("source_msg_id" + NUL + "'0'"),
)
scalar(
    "fn_vendor_id", "vendors", "vendor_id", lambda: S.vendor_id(C("canonical_name"), C("domain")),
    "substr(sha256(lower(trim(canonical_name))), 1, 16)", "key",
)
scalar("fn_surrogate_no", "invoices", "invoice_id", lambda: S.effective_number(
    C("invoice_number"), F.when(C("currency") == "USD", 0.5).otherwise(0.9), C("vendor_id"), C("invoice_date"), C("amount_gross"),
    F.lit(0),
),
       f"""CASE WHEN currency = 'USD' THEN 'SYN-' || upper(substr(sha256({
           NUL.join(('vendor_id', 'invoice_date', 'amount_gross'))
       } || chr(0) || '0'),
           1, 8)) ELSE invoice_number END""")  # fmt: skip
scalar(
    "fn_corrected_no", "invoices", "invoice_id",
    lambda: F.concat(C("invoice_number"), F.lit("-corrected-"), F.substring(F.sha2("invoice_id", 256), 1, 6)),
    "invoice_number || '-corrected-' || substr(sha256(invoice_id), 1, 6)",
)
SLUG = "regexp_replace(substr(regexp_replace(regexp_replace(lower({}), '[^a-z0-9]+', '-', 'g'), '(^-+|-+$)', '', 'g'), 1, {}), '(^-+|-+$)', '', 'g')"
scalar("fn_slug", "pages", "page_id", lambda: S.slug(C("url"), S.VENDOR_SLUG, C("page_id").cast("string")), SLUG.format("url", 60))
scalar("fn_drive_name", "invoices", "invoice_id", lambda: S.drive_name(
    C("invoice_date"), C("vendor_id"), C("amount_gross"), C("currency"), C("invoice_number"), C("vendor_id"),
),
       f"invoice_date || '_' || {SLUG.format('vendor_id', 60)} || '_' || amount_gross || '-' || currency || '_' || {SLUG.format('invoice_number', 64)} || '.pdf'")
scalar("fn_year_month", "invoices", "invoice_id", lambda: S.year_month(C("invoice_date")), "strftime(invoice_date, '%Y-%m')")
scalar("fn_fy_of", "invoices", "invoice_id", lambda: S.fiscal_year(C("invoice_date")), fiscal_sql("invoice_date"))
scalar("fn_fy_bounds", "invoices", "invoice_id", lambda: F.datediff(
    S.fiscal_bounds(C("invoice_date"))[1], S.fiscal_bounds(C("invoice_date"))[0],
) + 1,
       """CAST(date_diff('day', make_date(year(invoice_date) - CASE WHEN month(invoice_date) < 3 THEN 1 ELSE 0 END, 3, 1),
           make_date(year(invoice_date) + CASE WHEN month(invoice_date) < 3 THEN 0 ELSE 1 END, 3, 1)) AS INTEGER)""", "days")  # fmt: skip
scalar(
    "fn_london", "orders", "o_orderkey",
    lambda: S.london_date((C("o_orderdate") + F.expr("INTERVAL 23 HOURS 30 MINUTES")).cast("timestamp")),
    "CAST((o_orderdate + INTERVAL 23 HOUR + INTERVAL 30 MINUTE) AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/London' AS DATE)",
)
scalar("fn_category_valid", "invoices", "invoice_id", lambda: C("category").isin(*S.CATEGORIES), f"category IN {S.CATEGORIES}")
scalar("fn_ccy_valid", "invoices", "invoice_id", lambda: C("currency").isin(*S.CURRENCIES), f"currency IN {S.CURRENCIES}")
scalar("fn_money", "lineitem", "l_orderkey", lambda: S.money(C("l_extendedprice").cast("string")), "CAST(l_extendedprice AS DECIMAL(18,2))")
scalar("fn_parse_amount", "transactions", "txn_id", lambda: S.parse_amount(F.concat(F.lit("£"), F.format_number("amount", 2))), "amount")
scalar("fn_parse_date", "transactions", "txn_id", lambda: S.parse_date(F.date_format("booking_date", "dd/MM/yyyy")), "booking_date")
scalar(
    "fn_body_date", "transactions", "txn_id",
    lambda: S.body_date(F.concat(F.lit("posted on "), F.date_format("booking_date", "d MMMM yyyy"), F.lit(" in full"))),
    """CASE WHEN year(booking_date) >= 2000 THEN booking_date END""",
)
scalar(
    "fn_classify_txn", "transactions", "txn_id", lambda: S.txn_type(C("amount"), C("description_canonical"), C("account")),
    txn_type_sql("amount", "description_canonical", "account"),
)
scalar("fn_fee_hint", "transactions", "txn_id", lambda: S.fee_hint(C("description_canonical")), f"""CASE WHEN regexp_matches(description_canonical,
    '{S.FEES}') THEN 'bank_fee' END""")
scalar("fn_domain", "emails", "msg_id", lambda: S.domain(C("from_addr")), "lower(split_part(from_addr, '@', 2))")
scalar("fn_domain_sql", "emails", "msg_id", lambda: S.domain_first(C("from_addr")), "lower(substr(from_addr, instr(from_addr, '@') + 1))")
scalar(
    "fn_html_text", "pages", "page_id", lambda: F.md5(S.html_text(C("html"))),
    "md5(trim(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')))",
)
scalar("fn_urls", "pages", "page_id", lambda: F.array_join(
    S.invoice_urls(F.concat(C("html"), F.lit(" "), F.regexp_replace("url", r"/\w+/", "/billing/"), F.lit(".pdf). ")), C("url")), " ",
),
       "regexp_replace(regexp_extract(regexp_replace(url, '/\\w+/', '/billing/') || '.pdf). ', '(?i)https?://[^\\s<>\"'']+\\.pdf\\b', 0), '[.,;:)]+$', '')")
REDACTED = "text"
for _p, _r in S.SECRETS:
    REDACTED = f"regexp_replace({REDACTED}, '{_p}', '{_r.replace('$1', chr(92) + '1').replace('$2', chr(92) + '2')}', 'g')"
scalar("fn_redact", "documents", "doc_id", lambda: F.md5(S.redact(C("text"))), f"md5(substr({REDACTED}, 1, {S.ERROR_CAP}))")
scalar("fn_sanitize_cell", "transactions", "txn_id", lambda: S.sheet_cell(C("amount")), """CASE WHEN amount < 0 THEN '''' || amount
    ELSE CAST(amount AS VARCHAR) END""")
scalar("fn_bool_cell", "invoices", "invoice_id", lambda: S.flag_cell(C("fx_error").isNotNull()), """CASE WHEN fx_error IS NOT NULL THEN 'TRUE'
    ELSE 'FALSE' END""")
scalar("fn_md_fence", "events", "event_id", lambda: S.unfence(F.concat(F.lit("```json\n"), C("props"), F.lit("\n```"))), "props")
scalar("fn_truncate", "documents", "doc_id", lambda: F.md5(S.truncated(C("text"), 4000)), """md5(CASE WHEN length(text) > 4000 THEN substr(text,
    1, 4000) || chr(10) || '[truncated]' ELSE text END)""")
scalar("fn_tokens", "documents", "doc_id", lambda: S.token_estimate(C("text")), "CAST(ceil(length(text) / 4.0) AS BIGINT)")
scalar("fn_json_parse", "events", "event_id", lambda: F.from_json(
    F.when(C("event_type") == "error", F.lit("{broken")).otherwise(C("props")), "k bigint", {"mode": "PERMISSIVE"},
)["k"], """CASE WHEN event_type <> 'error' THEN CAST(json_extract(props,
    '$.k') AS BIGINT) END""")


# --- categories ---

_HOSTED = """hosted AS (SELECT vendor_id, canonical_name, CASE WHEN p % 5 = 0 THEN 'billing.stripe.com' WHEN p % 5 = 1 THEN 'easyjet.com'
    WHEN p % 5 = 2 THEN 'x.bingads.microsoft.com' ELSE domain END AS host FROM (SELECT *, CAST(substr(vendor_id, 2) AS BIGINT) AS p
    FROM vendors))"""


@query("""SELECT vendor_id, CASE WHEN starts_with(canonical_name, 'red') THEN 'utilities'
    WHEN host LIKE '%stripe.com' OR host LIKE '%microsoft.com' THEN 'software_saas' WHEN host = 'easyjet.com' THEN 'travel'
    ELSE 'other' END AS resolved_category, CASE WHEN starts_with(canonical_name, 'red') THEN 'override'
    WHEN host LIKE 'v%' THEN 'fallback' ELSE 'domain_hint' END AS category_source FROM hosted""", more=_HOSTED)
def fn_category(v: Views):
    p = F.substring("vendor_id", 2, 20).cast("bigint") % 5
    host = F.when(p == 0, "billing.stripe.com").when(p == 1, "easyjet.com").when(p == 2, "x.bingads.microsoft.com").otherwise(C("domain"))
    overrides = v.vendors.where("canonical_name LIKE 'red%'").select(C("canonical_name").alias("key"), F.lit("utilities").alias("category"))
    return category.resolve(
        v.vendors.withColumn("host", host), "vendor_id", "host", "canonical_name", overrides,
    ).select("vendor_id", "resolved_category", "category_source")


# --- validators and filing ---


def extracted(v: Views) -> DataFrame:
    i = v.invoices
    fields = (
        "invoice_number", "supplier_vat_number", "supplier_address", "customer_address", "invoice_date", "currency", "amount_net",
        "amount_vat", "amount_gross",
    )
    net = (C("amount_gross") - F.when(C("currency") == "EUR", 5).otherwise(10)).cast("decimal(18,2)")
    rows = i.select(
        "invoice_id", "invoice_number", F.when(C("currency") == "USD", "US1").otherwise("GB123456789").alias("supplier_vat_number"), F.lit("1 Road").alias("supplier_address"), F.lit("2 Lane").alias("customer_address"),
        F.date_add(
            "invoice_date", F.when(C("category") == "travel", 200).otherwise(0),
        ).cast("string").alias("invoice_date"), F.when(C("category") == "other", "XXX").otherwise(C("currency")).alias("currency"), net.cast("string").alias("amount_net"),
        F.lit("10.00").alias("amount_vat"), F.when(C("category") == "utilities", "n/a").otherwise(C("amount_gross").cast("string")).alias("amount_gross"), F.lit(True).alias("arithmetic_ok"),
        F.concat(
            F.lit("Invoice "), "invoice_number", F.lit(" GB 123 456 789, 1  road, US1"),
        ).alias("source_text"), C("invoice_date").alias("received_date"),
    )
    return rows.withColumns(
        {f"conf_{f}": F.lit(0.9) for f in fields} | {"conf_amount_vat": F.when(C("currency") == "EUR", 0.4).otherwise(0.8)}
    )


_VALID = """checked AS (SELECT invoice_id, CASE WHEN currency = 'USD' THEN NULL ELSE 'GB123456789' END AS vat, CASE
    WHEN category = 'other' THEN NULL ELSE currency END AS ccy, category, currency AS c0,
    CASE WHEN category = 'utilities' THEN NULL ELSE CAST(amount_gross AS VARCHAR) END AS gross, CASE WHEN currency = 'EUR'
    AND category <> 'other' THEN NULL ELSE '10.00' END AS vat_amount FROM invoices)"""


@query("""SELECT invoice_id, vat AS supplier_vat_number, ccy AS currency, gross AS amount_gross, vat_amount AS amount_vat,
    c0 <> 'EUR' OR vat_amount IS NULL OR gross IS NULL AS arithmetic_ok, CAST(CASE
    WHEN vat IS NULL OR ccy IS NULL OR gross IS NULL OR vat_amount IS NULL THEN 0.0 WHEN category = 'travel' THEN 0.3
    ELSE 0.8 END AS DOUBLE) AS overall_confidence FROM checked""", more=_VALID)
def va_sanitise(v: Views):
    return inv.sanitise(extracted(v)).select(
        "invoice_id", "supplier_vat_number", "currency", "amount_gross", "amount_vat", "arithmetic_ok", "overall_confidence",
    )


@query("""SELECT invoice_id, CASE
    WHEN vat IS NULL OR ccy IS NULL OR gross IS NULL OR vat_amount IS NULL OR category = 'travel' THEN 'overall' ELSE '' END || CASE
    WHEN vat IS NULL THEN ',supplier_vat_number' ELSE '' END
    || CASE WHEN category = 'travel' THEN ',invoice_date' ELSE '' END || CASE WHEN gross IS NULL THEN ',amount_gross' ELSE '' END || CASE
    WHEN vat_amount IS NULL THEN ',amount_vat' ELSE '' END || CASE WHEN ccy IS NULL THEN ',currency' ELSE '' END
    || CASE WHEN c0 = 'EUR' AND vat_amount IS NOT NULL AND gross IS NOT NULL THEN ',arithmetic' ELSE '' END || CASE
    WHEN category = 'travel' THEN ',date_window' ELSE '' END AS reasons FROM checked""", more=_VALID)  # fmt: skip
def va_escalation(v: Views):
    done = inv.sanitise(extracted(v))
    return done.select("invoice_id", F.array_join(inv.escalations(), ",").alias("reasons"))


# --- feeds: raw rows are made from the ledger and parsed back ---


@query("SELECT description_canonical, account, booking_date, amount, count(*) AS n FROM transactions WHERE account = 'amex' GROUP BY ALL")
def src_amex_csv(v: Views):
    t = v.transactions.where("account = 'amex'")
    blank = {c: F.lit(None).cast("string") for c in feeds.CARD_COLUMNS}
    made = blank | {
        "Date": F.date_format("booking_date", "dd/MM/yyyy"), "Description": F.concat(F.lit("  "), "description_raw", F.lit("\t ")),
        "Amount": F.concat(F.lit("£"), F.format_number("amount", 2)),
    }
    raw = t.select(*(x.alias(c) for c, x in made.items()), F.lit("a.csv").alias("file"), C("k").alias("line"))
    return feeds.parse_card(raw).groupBy("description_canonical", "account", "booking_date", "amount").agg(F.count("txn_id").alias("n"))


@query(f"""SELECT txn_id AS auth_id, booking_date, amount,
    {KEY.format(chr(39) + 'wise-' + chr(39) + ' || currency' + NUL + 'txn_id')} AS txn_id FROM transactions WHERE account = 'wise-GBP'""")
def src_wise(v: Views):
    t = v.transactions.where("account = 'wise-GBP'")
    line = F.struct(
        C("txn_id").alias("referenceNumber"), F.date_format("booking_date", "yyyy-MM-dd'T'10:00:00'Z'").alias("date"),
        F.struct(C("amount").cast("string").alias("value"), "currency").alias("amount"),
        F.struct(C("description_raw").alias("description")).alias("details"),
    )
    return feeds.parse_wise(t.select(F.to_json(line).alias("value"))).select("auth_id", "booking_date", "amount", "txn_id")


@query(f"""SELECT {KEY.format(chr(39) + 'monzo-' + chr(39) + ' || currency' + NUL + 'txn_id')} AS txn_id, amount, description_canonical,
    CASE WHEN status = 'pending' THEN 'pending' ELSE 'settled' END AS status FROM transactions
    WHERE account = 'monzo-GBP' AND status <> 'reversed'""")
def src_monzo(v: Views):
    t = v.transactions.where("account = 'monzo-GBP'")
    created = F.date_format("booking_date", "yyyy-MM-dd'T'10:00:00'Z'")
    line = F.struct(
        C("txn_id").alias("id"), (C("amount") * 100).cast("bigint").alias("amount"), "currency", created.alias("created"),
        F.when(C("status") != "pending", created).otherwise("").alias("settled"),
        F.when(C("status") == "reversed", "DECLINED").alias("decline_reason"), F.struct(F.lit(" ").alias("name")).alias("merchant"),
        C("description_raw").alias("notes"),
    )
    return feeds.parse_monzo(t.select(F.to_json(line).alias("value"))).select("txn_id", "amount", "description_canonical", "status")


for _name, _mark in (("src_wise_window", "2001-06-01"), ("src_monzo_window", None)):
    query(
        f"""SELECT txn_id, booking_date FROM transactions WHERE booking_date >= DATE '{'2001-06-01' if _mark else '2001-05-12'}'""",
        name=_name,
    )(lambda v, m=_mark: feeds.since(v.transactions.select("txn_id", "booking_date"), "booking_date", m, "2001-07-11"))


def mail_lines(v: Views) -> DataFrame:
    e = v.emails
    stamp = F.date_format("received_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    line = F.struct(
        C("msg_id").alias("id"), "subject", F.struct(F.struct(C("from_addr").alias("address")).alias("emailAddress")).alias("from"),
        stamp.alias("receivedDateTime"),
        F.struct(
            F.when(C("outcome") == "receipt", "html").otherwise("text").alias("contentType"),
            F.concat(F.lit("body of "), "msg_id").alias("content"),
        ).alias("body"),
        F.when(C("outcome") == "error", F.struct(F.lit("deleted").alias("reason"))).alias("@removed"),
    )
    return e.select(F.to_json(line).alias("value"))


@query("""SELECT msg_id, lower(from_addr) AS from_addr, date_trunc('second', received_at) AS received_at, subject FROM emails
    WHERE outcome IS NULL OR outcome <> 'error'""")
def src_mail_delta(v: Views):
    return feeds.parse_mail(mail_lines(v)).select("msg_id", "from_addr", "received_at", "subject")


@query("""SELECT msg_id FROM emails
    WHERE lower(from_addr) LIKE '%@d3.example.com' AND CAST(received_at AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'
    AND (outcome IS NULL OR outcome <> 'error')""")
def src_mail_search(v: Views):
    """Search by sender and date; lines sent twice count once."""
    m = feeds.parse_mail(mail_lines(v).union(mail_lines(v)))
    return m.where(
        C("from_addr").endswith("@d3.example.com") & F.to_date("received_at").between(
            F.lit("2024-01-05").cast("date"), F.lit("2024-01-20").cast("date"),
        )
    ).select("msg_id")


@query("""SELECT msg_id, CASE WHEN outcome = 'receipt' THEN 'body of ' || msg_id END AS html, CASE
    WHEN outcome IS NULL OR outcome <> 'receipt' THEN 'body of ' || msg_id END AS text FROM emails
    WHERE outcome IS NULL OR outcome <> 'error'""")
def src_mail_body(v: Views):
    return feeds.parse_mail(mail_lines(v)).select("msg_id", "html", "text")


@query("""SELECT msg_id, CAST(0 AS INTEGER) AS n, props AS content, event_id % 2 = 0 AS is_pdf FROM (SELECT 'm' || event_id AS msg_id, *
    FROM events)""")
def src_attach(v: Views):
    e = v.table("events")
    item = lambda kind, pdf: F.struct(
        F.lit(kind).alias("kind"), F.when(pdf, "A.PDF").otherwise("a.txt").alias("name"),
        F.lit("application/octet-stream").alias("contentType"), F.base64(C("props").cast("binary")).alias("content"),
    )
    m = e.select(
        F.concat(F.lit("m"), "event_id").alias("msg_id"),
        F.array(item("#x.fileAttachment", C("event_id") % 2 == 0), item("#x.itemAttachment", F.lit(True))).alias("attachments"),
    )
    return feeds.attachments(m).select("msg_id", "n", C("content").cast("string").alias("content"), "is_pdf")


def card_mails(v: Views) -> DataFrame:
    t = v.transactions.where("amount > 0")
    charge = F.concat(
        F.lit("You used your card for £"), F.format_number("amount", 2), F.lit(" at SHOP NO "), C("k").cast("string"), F.lit(" on "),
        F.date_format("booking_date", "yyyy-MM-dd"), F.lit(". Approval code: AB"), F.lpad((C("k") % 100000).cast("string"), 5, "0"),
    )
    bill = F.concat(
        F.lit("New balance: £"), F.format_number("amount", 2), F.lit(". Closing date: "), F.date_format("booking_date", "d MMM yyyy"),
    )
    is_bill = C("account") == "amex"
    return t.select(
        C("txn_id").alias("msg_id"), F.when(is_bill, "Your statement is ready").otherwise("Alert").alias("subject"),
        F.when(is_bill, bill).otherwise(charge).alias("body"), F.date_add("booking_date", 1).alias("received_date"),
    )


@query("""SELECT txn_id AS msg_id, CASE WHEN account = 'amex' THEN 'statement_closing' ELSE 'transaction_notification' END AS kind
    FROM transactions WHERE amount > 0""")
def src_email_kind(v: Views):
    return card_mails(v).select("msg_id", feeds.email_kind(C("subject"), C("body")).alias("kind"))


@query("""SELECT txn_id AS msg_id, amount, 'SHOP NO ' || k AS merchant, CASE WHEN year(booking_date) >= 2000 THEN booking_date
    ELSE booking_date + 1 END AS posted_date, 'AB' || lpad(CAST(k % 100000 AS VARCHAR), 5, '0') AS approval_code FROM transactions
    WHERE amount > 0 AND account <> 'amex'""")
def src_email_notif(v: Views):
    return feeds.parse_notification(card_mails(v).where("subject = 'Alert'"))


@query("""SELECT txn_id AS msg_id, amount AS billed, CASE WHEN year(booking_date) >= 2000 THEN booking_date
    ELSE booking_date + 1 END AS close_date FROM transactions WHERE amount > 0 AND account = 'amex'""")
def src_email_stmt(v: Views):
    return feeds.parse_statement(card_mails(v).where("subject <> 'Alert'"))


@query("SELECT msg_id FROM emails WHERE outcome = 'invoice'")
def src_dmarc(v: Views):
    header = F.when(C("outcome") == "invoice", "mx; spf=pass; DMARC = pass (p=none)").when(C("outcome") == "receipt", "mx; dmarc=fail")
    return v.emails.where(feeds.dmarc_passed(header)).select("msg_id")


# --- keyed updates ---


@query("""SELECT row_id, invoice_id, txn_id, amount_gross_gbp AS allocated FROM recon LEFT JOIN invoices USING (invoice_id)
    WHERE state IN ('auto_matched', 'suggested', 'user_verified', 'user_overridden')""")
def sink_link_upsert(v: Views):
    """Links of rows that have a match, merged twice: the null-safe key finds the row again."""
    links = v.recon.where(C("state").isin("auto_matched", "suggested", "user_verified", "user_overridden")).join(
        v.invoices.select("invoice_id", C("amount_gross_gbp").alias("allocated")), "invoice_id", "left",
    ).select("row_id", "invoice_id", "txn_id", "allocated")
    return merge(links, links, ["row_id", "invoice_id", "txn_id"], {"allocated": "new"}, [F.desc("allocated")])


@query("""SELECT page_id, regexp_matches(url, '^https://') AND NOT contains(split_part(split_part(url, '://', 2), '/', 1), '@') AS ok
    FROM pages""")
def sink_source_url(v: Views):
    part = lambda p: F.try_parse_url("url", F.lit(p))
    ok = (part("PROTOCOL") == "https") & part("USERINFO").isNull() & (F.coalesce(part("HOST"), F.lit("")) != "")
    return v.table("pages").select("page_id", F.coalesce(ok, F.lit(False)).alias("ok"))


# --- streams: the same rows as their batch twins ---


@query("SELECT event_id, event_type FROM events")
def sm_dedup(v: Views):
    """The table as a stream that is sent twice; each id comes out once."""
    s = ingest.table_stream(v.spark, v.dir, "events").withColumn("ts", C("ts").cast("timestamp"))
    twice = s.select("event_id", "event_type", "ts", F.explode(F.array(F.lit(1), F.lit(2))).alias("_copy")).drop("_copy")
    return ingest.drain(ingest.deduplicated(twice, "event_id", "ts")).select("event_id", "event_type")


@query("""SELECT d AS start, event_type, count(*) AS n FROM (SELECT CAST(CAST(ts AS DATE) AS TIMESTAMP) AS d, event_type FROM events)
    WHERE d + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM events) GROUP BY d, event_type""")
def sm_watermark(v: Views):
    """Daily counts of the days that the watermark has passed."""
    s = ingest.table_stream(v.spark, v.dir, "events").withColumn("ts", C("ts").cast("timestamp"))
    return ingest.drain(ingest.windowed_counts(s, "ts", "event_type"))
