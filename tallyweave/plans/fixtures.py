"""The accounting domain derived from the test tables, twice: as DataFrames, and as SQL common table expressions.

Integer arithmetic on keys decides everything, so both sides have the same rows.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.functions import scalars as S

#: A fiscal year of which the tables hold every day.
FY = "FY-1998-99"
FY_START, FY_END = S.label_bounds(FY)


def _pick(k: Column, *values: str | None) -> Column:
    """values[k mod their number]."""
    return F.element_at(F.array(*(F.lit(v) for v in values)), (F.pmod(k, F.lit(len(values))) + 1).cast("int"))


class Views:
    """Derived frames over one folder of tables; each is built when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def vendors(self) -> DataFrame:
        k = F.col("p_partkey")
        return self.table("part").select(
            F.concat(F.lit("v"), k).alias("vendor_id"), F.lower(F.concat_ws(" ", "p_name", "p_type", F.lit("ltd"))).alias("canonical_name"),
            F.concat(F.lit("v"), k, F.lit(".example.com")).alias("domain"), _pick(k, *S.CATEGORIES).alias("default_category"),
        )

    @cached_property
    def invoices(self) -> DataFrame:
        k = F.col("o_orderkey")
        ccy = _pick(k, "USD", "EUR", "GBP", "GBP", "GBP")
        gross = F.col("o_totalprice").cast("decimal(18,2)")
        factor = F.when(ccy == "USD", F.lit("0.79")).when(ccy == "EUR", F.lit("0.86")).otherwise(F.lit("1.00")).cast("decimal(3,2)")
        lost = (k % 15 == 0) & (ccy != "GBP")
        return self.table("orders").where("o_orderpriority IN ('1-URGENT', '2-HIGH')").select(
            F.concat(F.lit("inv-"), k).alias("invoice_id"), F.concat(F.lit("v"), F.col("o_custkey") % 200).alias("vendor_id"),
            k.alias("k"), F.col("o_orderdate").cast("date").alias("invoice_date"),
            ccy.alias("currency"), gross.alias("amount_gross"), F.when(
                ~lost, (gross * factor).cast("decimal(18,2)"),
            ).alias("amount_gross_gbp"),
            F.when(lost, F.lit("no rate")).alias("fx_error"), _pick(F.floor(k / 4), *S.CATEGORIES).alias("category"),
            F.when(k % 97 == 0, F.lit("duplicate")).alias("deleted_reason"), F.when(
                k % 24 == 0, F.date_add(F.col("o_orderdate").cast("date"), 30),
            ).alias("last_exported_at"),
            F.concat(F.lit("m"), k).alias("source_msg_id"),
        ).withColumn("invoice_number", F.concat(F.lit("N-"), (F.col("k") - F.col("k") % 8).cast("string")))

    @cached_property
    def transactions(self) -> DataFrame:
        """The ledger; its amounts keep their sign."""
        k = F.col("o_orderkey")
        o = self.table("orders").where("o_orderstatus <> 'P'").withColumn("vendor_id", F.concat(F.lit("v"), F.col("o_custkey") % 200))
        o = o.join(self.vendors.select("vendor_id", "canonical_name"), "vendor_id")
        gross = F.col("o_totalprice").cast("decimal(18,2)")
        amount = F.when(k % 7 == 0, (gross * F.lit("1.02").cast("decimal(3,2)")).cast("decimal(18,2)")).otherwise(gross)
        raw = F.concat(F.upper("canonical_name"), _pick(k % 17, " LONDON", " GB 12345", ""))
        raw = F.when(k % 29 == 0, F.concat(F.lit("WISE TRANSFER "), raw)).when(k % 31 == 0, F.concat(raw, F.lit(" FX FEE"))).otherwise(raw)
        rows = o.select(
            F.concat(F.lit("t"), k).alias("txn_id"), k.alias("k"), "vendor_id", _pick(k % 11, "amex", "wise-GBP", "monzo-GBP").alias("account"),
            F.date_add(
                F.col("o_orderdate").cast("date"), ((k * 7) % 21 - 10).cast("int"),
            ).alias("booking_date"), raw.alias("description_raw"),
            _pick(k, "USD", "EUR", "GBP", "GBP", "GBP").alias("currency"), F.when(k % 13 == 0, -amount).otherwise(amount).cast("decimal(18,2)").alias("amount"),
            F.when(k % 89 == 0, "reversed").when(k % 41 == 0, "pending").otherwise("settled").alias("status"),
        )
        ccy = F.col("currency")
        factor = F.when(ccy == "USD", F.lit("0.79")).when(ccy == "EUR", F.lit("0.86")).otherwise(F.lit("1.00")).cast("decimal(3,2)")
        rows = rows.withColumn("amount_gbp", (F.col("amount") * factor).cast("decimal(18,2)")).withColumn(
            "description_canonical", S.canonical_description(F.col("description_raw")),
        )
        return rows.withColumn(
            "txn_type", S.txn_type(F.col("amount"), F.col("description_canonical"), F.col("account")),
        ).withColumn("category", S.fee_hint(F.col("description_canonical")))

    @cached_property
    def fx_rates(self) -> DataFrame:
        """Rates of weekdays, without every tenth day; n counts days since 1970."""
        days = self.spark.sql("SELECT explode(sequence(date'1994-12-01', date'2001-12-31')) AS day").withColumn("n", F.unix_date("day"))
        days = days.where((F.weekday("day") < 5) & (F.col("n") % 10 != 0))
        rate = (
            (F.lit(700000) + (F.col("n") * 37 + F.when(F.col("from_ccy") == "EUR", 50000).otherwise(0)) % 90000) / F.lit(1000000)
        ).cast("decimal(18,6)")
        return days.withColumn("from_ccy", F.explode(F.array(F.lit("USD"), F.lit("EUR")))).select(
            "day", "from_ccy", F.lit("GBP").alias("to_ccy"), rate.alias("rate"),
        )

    @cached_property
    def hints(self) -> DataFrame:
        k = F.col("p_partkey")
        return self.table("part").where("p_size > 10").select(
            F.concat(F.lit("v"), k).alias("vendor_id"), _pick(k, *S.CATEGORIES).alias("category"),
            (k % 6).cast("bigint").alias("confirmed_count"),
        )

    @cached_property
    def recon(self) -> DataFrame:
        """Reconciliation rows as an earlier run may have left them."""
        k = F.col("k")
        state = _pick(F.floor(k / 12), "auto_matched", "suggested", "unmatched", "user_verified", "user_personal", "user_ignore", "voided")
        return self.invoices.where("category <> 'other'").select(
            F.concat(F.lit("r"), k).alias("row_id"), S.fiscal_year(F.col("invoice_date")).alias("fiscal_year"), "invoice_id", F.when(k % 3 != 0, F.concat(F.lit("t"), k)).alias("txn_id"), state.alias("state"),
            (k % 10000 / 10000).cast("decimal(10,4)").alias("match_score"), F.concat(F.lit("score "), (k % 100).cast("string")).alias("match_reason"), F.date_add("invoice_date", (k % 50).cast("int")).alias("updated_at"),
        )

    @cached_property
    def emails(self) -> DataFrame:
        k = F.col("event_id")
        kind = F.col("event_type")
        done = kind != "view"
        outcome = F.when(kind == "purchase", "invoice").when(kind == "signup", "receipt").when(kind == "error", "error").when(
            (kind == "click") & (k % 3 == 0), "no_attachment",
        ).when(
            (kind == "click") & (k % 3 == 1), "needs_manual_download",
        ).when(kind == "click", "neither")
        return self.table("events").select(
            F.concat(F.lit("m"), k).alias("msg_id"), k.alias("k"), F.col("ts").cast("timestamp").alias("received_at"), F.concat(
                F.lit("U"), "user_id", F.lit("@D"), (F.col("user_id") % 17).cast("string"), F.lit(".Example.com"),
            ).alias("from_addr"),
            F.concat(F.lit("subject "), (k % 50).cast("string")).alias("subject"), F.when(done, F.col("ts").cast("timestamp")).alias("processed_at"), outcome.alias("outcome"),
            F.when(kind == "error", F.lit("E42")).alias("error_code"), F.when(k % 19 == 0, F.col("ts").cast("timestamp")).alias("dismissed_at"), F.col("value").cast("decimal(18,2)").alias("value"),
        )

    @cached_property
    def runs(self) -> DataFrame:
        k = F.col("event_id")
        return self.table("events").where("event_type IN ('signup', 'error')").select(
            F.concat(F.lit("run-"), k).alias("run_id"), _pick(
                F.floor(k / 20), "ingest_email", "ingest_invoice", "other",
            ).alias("operation"), F.col("ts").cast("timestamp").alias("started_at"),
            F.when(
                k % 100 != 0, (F.col("ts") + F.expr("INTERVAL 90 SECONDS")).cast("timestamp"),
            ).alias("ended_at"), _pick(F.floor(k / 20), "running", "ok", "partial", "failed", "ok").alias("status"),
        )

    @cached_property
    def feedback(self) -> DataFrame:
        return self.emails.where("outcome = 'neither'").select(
            "msg_id", F.when(F.col("k") % 2 == 0, "positive").otherwise("negative").alias("value"),
            F.col("received_at").alias("created_at"), S.domain(F.col("from_addr")).alias("domain"),
        )

    @cached_property
    def blocked(self) -> DataFrame:
        return self.spark.createDataFrame([(f"d{n}.example.com",) for n in (3, 7, 11)], "domain string")

    @cached_property
    def statements(self) -> DataFrame:
        """Card statements: the bill of a transfer from another account, dated a few days before it."""
        t = self.transactions.where("txn_type = 'transfer' AND account <> 'amex'")
        return t.select(
            F.concat(F.lit("s"), "k").alias("msg_id"), F.abs("amount").alias("billed"),
            F.date_sub("booking_date", (F.col("k") % 40).cast("int")).alias("close_date"),
        )

    @cached_property
    def auths(self) -> DataFrame:
        """Provider authorisations: pending sightings and settlements, some of them contradictory, late or missing."""
        k = F.col("k")
        return self.transactions.select(
            F.concat(F.lit("a"), F.floor(k / 3).cast("string")).alias("auth_id"), "txn_id", "k", F.when(k % 4 == 0, "settled").otherwise("pending").alias("kind"), F.col("booking_date").alias("seen"),
        )


def _case(expr: str, *values: str) -> str:
    return f"(CASE ({expr}) % {len(values)} " + " ".join(f"WHEN {n} THEN '{v}'" for n, v in enumerate(values)) + " END)"


_FACTOR = "CAST(CASE {c} WHEN 'USD' THEN 0.79 WHEN 'EUR' THEN 0.86 ELSE 1.00 END AS DECIMAL(3,2))"
_CITIES = "|".join(S.CITIES)


def canonical_sql(raw: str) -> str:
    steps = f"trim(regexp_replace(upper(regexp_replace({raw}, '[\\x00-\\x1f\\x7f]', '', 'g')), '\\s+', ' ', 'g'))"
    for ending in (r"\s+GB\s*\d*$", r"\s+[A-Z0-9]{8,12}$", rf"\s+({_CITIES})(\s.*)?$"):
        steps = f"regexp_replace({steps}, '{ending}', '')"
    return f"trim(regexp_replace({steps}, '\\s+', ' ', 'g'))"


def txn_type_sql(amount: str, text: str, account: str) -> str:
    return f"""(CASE WHEN regexp_matches({text}, '{S.FEES}') THEN 'purchase' WHEN regexp_matches({text}, '{S.TRANSFERS}') THEN 'transfer'
        WHEN {amount} < 0 THEN 'refund' WHEN {amount} > 0 AND {account} <> 'amex' THEN 'income' ELSE 'purchase' END)"""


def fiscal_sql(day: str) -> str:
    y = f"(year({day}) - CASE WHEN month({day}) < 3 THEN 1 ELSE 0 END)"
    return f"('FY-' || {y} || '-' || lpad(CAST(({y} + 1) % 100 AS VARCHAR), 2, '0'))"


CTES = {
    "vendors": f"""SELECT 'v' || p_partkey AS vendor_id, lower(p_name || ' ' || p_type || ' ltd') AS canonical_name,
        'v' || p_partkey || '.example.com' AS domain,
        {_case('p_partkey', *S.CATEGORIES)} AS default_category FROM part""",
    "invoices": f"""SELECT 'inv-' || k AS invoice_id, vendor_id, k, invoice_date, currency, amount_gross,
        CASE WHEN NOT lost THEN CAST(amount_gross * {_FACTOR.format(c='currency')} AS DECIMAL(18,2)) END AS amount_gross_gbp, CASE
        WHEN lost THEN 'no rate' END AS fx_error,
        {_case('k // 4', *S.CATEGORIES)} AS category, CASE WHEN k % 97 = 0 THEN 'duplicate' END AS deleted_reason, CASE
        WHEN k % 24 = 0 THEN invoice_date + 30 END AS last_exported_at,
        'm' || k AS source_msg_id, 'N-' || (k - k % 8) AS invoice_number
        FROM (SELECT o_orderkey AS k, 'v' || (o_custkey % 200) AS vendor_id, CAST(o_orderdate AS DATE) AS invoice_date,
        {_case('o_orderkey', 'USD', 'EUR', 'GBP', 'GBP', 'GBP')} AS currency,
            CAST(o_totalprice AS DECIMAL(18,2)) AS amount_gross, o_orderkey % 15 = 0 AND o_orderkey % 5 < 2 AS lost FROM orders
        WHERE o_orderpriority IN ('1-URGENT', '2-HIGH'))""",
    "transactions": f"""SELECT *, {txn_type_sql('amount', 'description_canonical', 'account')} AS txn_type, CASE
        WHEN regexp_matches(description_canonical, '{S.FEES}') THEN 'bank_fee' END AS category FROM (
        SELECT *, CAST(amount * {_FACTOR.format(c='currency')} AS DECIMAL(18,2)) AS amount_gbp,
        {canonical_sql('description_raw')} AS description_canonical FROM (
            SELECT 't' || k AS txn_id, k, vendor_id, {_case('k % 11', 'amex', 'wise-GBP', 'monzo-GBP')} AS account,
        day + CAST((k * 7) % 21 - 10 AS INTEGER) AS booking_date,
                CASE WHEN k % 29 = 0 THEN 'WISE TRANSFER ' || raw WHEN k % 31 = 0 THEN raw || ' FX FEE' ELSE raw END AS description_raw,
        {_case('k', 'USD', 'EUR', 'GBP', 'GBP', 'GBP')} AS currency,
                CAST(CASE WHEN k % 13 = 0 THEN -size ELSE size END AS DECIMAL(18,2)) AS amount, CASE WHEN k % 89 = 0 THEN 'reversed'
        WHEN k % 41 = 0 THEN 'pending' ELSE 'settled' END AS status
            FROM (SELECT o_orderkey AS k, vendor_id, CAST(o_orderdate AS DATE) AS day,
        upper(canonical_name) || {_case('o_orderkey % 17', ' LONDON', ' GB 12345', '')} AS raw,
                    CASE WHEN o_orderkey % 7 = 0 THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 1.02 AS DECIMAL(18,2))
        ELSE CAST(o_totalprice AS DECIMAL(18,2)) END AS size
                FROM orders JOIN vendors ON vendor_id = 'v' || (o_custkey % 200) WHERE o_orderstatus <> 'P')))""",
    "fx_rates": """SELECT day, from_ccy, 'GBP' AS to_ccy, CAST((700000 + (n * 37 + CASE WHEN from_ccy = 'EUR' THEN 50000
        ELSE 0 END) % 90000) / 1000000.0 AS DECIMAL(18,6)) AS rate
        FROM (SELECT CAST(d AS DATE) AS day, date_diff('day', DATE '1970-01-01', CAST(d AS DATE)) AS n
        FROM generate_series(DATE '1994-12-01', DATE '2001-12-31', INTERVAL 1 DAY) g(d)),
            (VALUES ('USD'), ('EUR')) c(from_ccy) WHERE isodow(day) < 6 AND n % 10 <> 0""",
    "hints": f"""SELECT 'v' || p_partkey AS vendor_id, {_case('p_partkey', *S.CATEGORIES)} AS category, p_partkey % 6 AS confirmed_count
        FROM part WHERE p_size > 10""",
    "recon": f"""SELECT 'r' || k AS row_id, {fiscal_sql('invoice_date')} AS fiscal_year, invoice_id, CASE
        WHEN k % 3 <> 0 THEN 't' || k END AS txn_id,
        {_case('k // 12', 'auto_matched', 'suggested', 'unmatched', 'user_verified', 'user_personal', 'user_ignore', 'voided')} AS state,
        CAST((k % 10000) / 10000.0 AS DECIMAL(10,4)) AS match_score,
        'score ' || (k % 100) AS match_reason, invoice_date + CAST(k % 50 AS INTEGER) AS updated_at FROM invoices
        WHERE category <> 'other'""",
    "emails": """SELECT 'm' || event_id AS msg_id, event_id AS k, ts AS received_at,
        'U' || user_id || '@D' || (user_id % 17) || '.Example.com' AS from_addr, 'subject ' || (event_id % 50) AS subject,
        CASE WHEN event_type <> 'view' THEN ts END AS processed_at, CASE WHEN event_type = 'purchase' THEN 'invoice'
        WHEN event_type = 'signup' THEN 'receipt' WHEN event_type = 'error' THEN 'error'
            WHEN event_type = 'click' AND event_id % 3 = 0 THEN 'no_attachment' WHEN event_type = 'click'
        AND event_id % 3 = 1 THEN 'needs_manual_download' WHEN event_type = 'click' THEN 'neither' END AS outcome,
        CASE WHEN event_type = 'error' THEN 'E42' END AS error_code, CASE WHEN event_id % 19 = 0 THEN ts END AS dismissed_at,
        CAST(value AS DECIMAL(18,2)) AS value FROM events""",
    "runs": f"""SELECT 'run-' || event_id AS run_id, {_case('event_id // 20', 'ingest_email', 'ingest_invoice', 'other')} AS operation,
        ts AS started_at, CASE WHEN event_id % 100 <> 0 THEN ts + INTERVAL 90 SECOND END AS ended_at,
        {_case('event_id // 20', 'running', 'ok', 'partial', 'failed', 'ok')} AS status FROM events
        WHERE event_type IN ('signup', 'error')""",
    "feedback": """SELECT msg_id, CASE WHEN k % 2 = 0 THEN 'positive' ELSE 'negative' END AS value, received_at AS created_at,
        lower(split_part(from_addr, '@', 2)) AS domain FROM emails WHERE outcome = 'neither'""",
    "blocked": "SELECT * FROM (VALUES ('d3.example.com'), ('d7.example.com'), ('d11.example.com')) b(domain)",
    "statements": """SELECT 's' || k AS msg_id, abs(amount) AS billed, booking_date - CAST(k % 40 AS INTEGER) AS close_date
        FROM transactions WHERE txn_type = 'transfer' AND account <> 'amex'""",
    "auths": """SELECT 'a' || (k // 3) AS auth_id, txn_id, k, CASE WHEN k % 4 = 0 THEN 'settled' ELSE 'pending' END AS kind,
        booking_date AS seen FROM transactions""",
}


def with_views(body: str, more: str = "") -> str:
    """SQL whose body may read the derived views that it names, and those that these read."""
    import re

    used: list[str] = []

    def need(sql: str) -> None:
        for name in CTES:
            if name not in used and re.search(rf"\b{name}\b", sql):
                need(CTES[name])
                used.append(name)

    need(body + more)
    ctes = [f"{n} AS ({CTES[n]})" for n in CTES if n in used]
    parts = ctes + ([more] if more else [])
    return ("WITH RECURSIVE " + ", ".join(parts) + " " if parts else "") + body
