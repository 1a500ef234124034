"""Range joins, fuzzy scores, decisions, splits, clearing, pending rows and merges over the derived views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.functions import scalars as S
from tallyweave.functions.fuzzy import token_set_ratio
from tallyweave.operators import clearing, fx, ledger, match, names, pending, split, state
from tallyweave.operators.rangejoin import interval_join
from tallyweave.plans.fixtures import Views
from tallyweave.plans.registry import query

# Token-set ratio in SQL. names: pairs (a, b) of upper-case strings. The longest common subsequence runs over a recursive
# table that carries a row of lengths; a running maximum completes each new row.
FUZZY = """
    sets AS (SELECT a, b, list_sort(list_distinct(list_filter(string_split(a, ' '), lambda w: w <> ''))) AS la,
    list_sort(list_distinct(list_filter(string_split(b, ' '), lambda w: w <> ''))) AS lb FROM names),
    parts AS (SELECT a, b, len(la) AS na, len(lb) AS nb, array_to_string(list_filter(la, lambda w: list_contains(lb, w)), ' ') AS s,
    array_to_string(list_filter(la, lambda w: NOT list_contains(lb, w)), ' ') AS x,
        array_to_string(list_filter(lb, lambda w: NOT list_contains(la, w)), ' ') AS y FROM sets),
    todo AS (SELECT DISTINCT x, y FROM parts WHERE x <> '' AND y <> ''),
    steps AS (
        SELECT x, y, 0 AS i, list_transform(range(length(y) + 1), lambda z: 0) AS r FROM todo
        UNION ALL
        SELECT x, y, i + 1, [0] || list_transform(range(1, length(y) + 1), lambda j: list_max(c[1:j])) FROM (
            SELECT x, y, i, list_transform(range(1, length(y) + 1), lambda j: CASE WHEN y[j:j] = x[i + 1:i + 1] THEN r[j] + 1
    ELSE r[j + 1] END) AS c FROM steps WHERE i < length(x))),
    common AS (SELECT x, y, r[len(r)] AS n FROM steps WHERE i = length(x)),
    lengths AS (SELECT a, b, na, nb, length(s) AS ns, length(x) AS nx, length(y) AS ny, CASE WHEN s = '' THEN 0 ELSE 1 END AS gap,
    coalesce(n, 0) AS n FROM parts LEFT JOIN common USING (x, y)),
    ratios AS (SELECT a, b, CASE WHEN na = 0 OR nb = 0 THEN 0.0 WHEN ns > 0 AND (nx = 0 OR ny = 0) THEN 100.0
        WHEN ns > 0 THEN greatest(100 - 100 * CAST(nx + ny - 2 * n AS DOUBLE) / (2 * (ns + gap) + nx + ny),
    100 - 100 * CAST(1 + nx AS DOUBLE) / (2 * ns + 1 + nx), 100 - 100 * CAST(1 + ny AS DOUBLE) / (2 * ns + 1 + ny))
        ELSE 100 - 100 * CAST(nx + ny - 2 * n AS DOUBLE) / (nx + ny) END AS ratio FROM lengths),
    vendor_scores AS (SELECT a, b, CAST(round_even(CAST(ratio AS DECIMAL(20,12)) / 100, 4) AS DECIMAL(10,4)) AS vendor_score FROM ratios)"""

PAIRS = """
    billed AS (SELECT i.*, canonical_name AS supplier FROM invoices i JOIN vendors v ON v.vendor_id = i.vendor_id
    WHERE deleted_reason IS NULL),
    pairs AS (SELECT invoice_id, supplier, invoice_date, i.currency AS invoice_ccy, amount_gross, amount_gross_gbp, txn_id,
    description_canonical AS description, booking_date, t.currency AS txn_ccy, abs(amount) AS amount, abs(amount_gbp) AS amount_gbp
        FROM billed i JOIN transactions t ON booking_date BETWEEN invoice_date - 14 AND invoice_date + 14
    WHERE txn_type <> 'transfer' AND status <> 'reversed'),
    names AS (SELECT DISTINCT upper(supplier) AS a, upper(description) AS b FROM pairs),"""

SCORES = (
    PAIRS
    + FUZZY
    + """,
    rated AS (SELECT *, abs(date_diff('day', invoice_date, booking_date)) AS days,
        CASE WHEN invoice_ccy = txn_ccy THEN CASE WHEN abs(amount - amount_gross) <= 0.01 THEN 1.0 WHEN amount_gross = 0 THEN 0.0
        ELSE greatest(0.0, least(1.0, 1 - CAST(abs(amount - amount_gross) AS DOUBLE) / amount_gross * 10)) END
            WHEN amount_gross_gbp IS NULL OR amount_gbp = 0 THEN 0.0 ELSE greatest(0.0, least(1.0,
        1 - (CAST(abs(amount_gbp - amount_gross_gbp) AS DOUBLE) / amount_gbp - 0.03) / 0.07)) END AS amount_score,
        CASE WHEN invoice_ccy = txn_ccy THEN 1.0 ELSE 0.5 END AS currency_score
        FROM pairs JOIN vendor_scores ON a = upper(supplier) AND b = upper(description)),
    summed AS (SELECT *,
        10000 * (0.50 * vendor_score + 0.35 * CAST(amount_score AS DECIMAL(18,16)) + 0.10 * CAST(currency_score AS DECIMAL(2,1))
        + 0.05 * CAST(CASE WHEN days < 14 THEN round_even(1 - days / 14.0, 4) ELSE 0 END AS DECIMAL(5,4))) AS s FROM rated),
    totals AS (SELECT *, CAST((floor(s) + CASE WHEN s - floor(s) > 0.5 OR s - floor(s) = 0.5 AND CAST(floor(s) AS BIGINT) % 2 = 1 THEN 1
        ELSE 0 END) / 10000.0 AS DECIMAL(10,4)) AS total,
        CASE WHEN invoice_ccy = txn_ccy AND abs(amount - amount_gross) <= 0.01 THEN CASE WHEN vendor_score >= 0.85 AND days <= 3 THEN 1.0
        WHEN vendor_score >= 0.80 AND days <= 7 THEN 0.96 END END AS quick FROM summed),
    best AS (SELECT invoice_id, arg_min(txn_id, (booking_date, txn_id)) FILTER (WHERE quick IS NOT NULL) AS qt, arg_min(quick,
        (booking_date, txn_id)) FILTER (WHERE quick IS NOT NULL) AS qs,
        arg_min(txn_id, (-total, booking_date, txn_id)) AS bt, max(total) AS bs FROM totals GROUP BY invoice_id),
    decided AS (SELECT invoice_id, coalesce(qt, bt) AS txn_id, CAST(coalesce(qs, bs, 0) AS DECIMAL(10,4)) AS score, coalesce(confirmed,
        0) AS confirmed, qs IS NOT NULL AS quick
        FROM billed LEFT JOIN best USING (invoice_id) LEFT JOIN (SELECT vendor_id, sum(confirmed_count) AS confirmed FROM hints
        GROUP BY 1) h ON h.vendor_id = billed.vendor_id),
    decisions AS (SELECT invoice_id, txn_id, score, confirmed < 3 AND score >= 0.93 AS demoted, CASE WHEN score >= 0.93
        AND confirmed >= 3 THEN 'auto_matched' WHEN score >= 0.70 THEN 'suggested' ELSE 'unmatched' END AS state,
        CASE WHEN txn_id IS NULL THEN 'no candidates' WHEN quick THEN 'short circuit' ELSE 'best total' END AS reason FROM decided)"""
)


def billed(v: Views) -> DataFrame:
    return v.invoices.where("deleted_reason IS NULL").join(
        v.vendors.select("vendor_id", F.col("canonical_name").alias("supplier")), "vendor_id",
    )


def decisions(v: Views) -> DataFrame:
    invoices = billed(v)
    names = match.likest_names(invoices, v.transactions)
    return match.decide(invoices, match.contenders(invoices, v.transactions, names), v.hints)


@query("SELECT invoice_id, txn_id FROM pairs", more=PAIRS.rstrip(",").rpartition("names AS")[0].rstrip().rstrip(","))
def jn_interval(v: Views):
    return match.candidates(billed(v), v.transactions).select("invoice_id", "txn_id")


MET = """rated AS (SELECT canonical_name AS s, date_diff('day', DATE '1970-01-01', invoice_date) AS n FROM invoices JOIN vendors USING (vendor_id)
        WHERE deleted_reason IS NULL),
    asked AS (SELECT DISTINCT s, unnest(range(CAST(floor((n - 14) / 113.0) AS BIGINT), CAST(floor((n + 14) / 113.0) AS BIGINT) + 1)) AS bucket FROM rated),
    there AS (SELECT DISTINCT description_canonical AS t, CAST(floor(date_diff('day', DATE '1970-01-01', booking_date) / 113.0) AS BIGINT) AS bucket
        FROM transactions WHERE txn_type <> 'transfer' AND status <> 'reversed'),
    names AS (SELECT DISTINCT upper(s) AS a, upper(t) AS b FROM asked JOIN there USING (bucket)), """


@query("SELECT a, b, vendor_score FROM vendor_scores", more=MET + FUZZY)
def sc_vendor(v: Views):
    """Scores of the names that come near one another in time."""
    names = match.name_scores(billed(v), v.transactions)
    return names.select(F.upper("supplier").alias("a"), F.upper("description").alias("b"), "vendor_score").distinct()


@query("""SELECT a, b, vendor_score FROM (SELECT a, b, vendor_score, max(vendor_score) OVER (PARTITION BY a) AS top FROM vendor_scores)
    WHERE top >= 0.95 AND vendor_score >= top - 0.2""", more=MET + FUZZY)
def sc_vendor_likest(v: Views):
    """Each supplier's likest names, through the index of words and letters; suppliers with no name of 0.95 are left out."""
    return match.likest_names(billed(v), v.transactions).select(
        F.upper("supplier").alias("a"), F.upper("description").alias("b"), "vendor_score",
    ).distinct()


@query(
    """SELECT state, count(*) AS n, CAST(sum(CASE WHEN demoted THEN 1 ELSE 0 END) AS BIGINT) AS demoted FROM decisions GROUP BY state""",
    more=SCORES,
)
def mt_threshold(v: Views):
    return decisions(v).groupBy("state").agg(F.count("*").alias("n"), F.sum(F.col("demoted").cast("bigint")).alias("demoted"))


@query("""SELECT invoice_id, txn_id, total, currency_score = 1 AS same_currency, CAST(days AS BIGINT) AS days FROM totals
    WHERE total >= 0.70""", more=SCORES)
def sc_total(v: Views):
    rows = match.matches(billed(v), v.transactions, "0.70")
    return rows.select(
        "invoice_id", "txn_id", "total", (F.col("currency_score") == 1).alias("same_currency"), F.col("days").cast("bigint").alias("days"),
    )


@query("SELECT invoice_id, txn_id, state, score, demoted, reason FROM decisions", more=SCORES)
def recon_run(v: Views):
    """The whole reconciliation: candidates within 14 days, scores, one decision an invoice."""
    return decisions(v)


#: Another policy: weights, thresholds and the number of confirmations that a vendor needs.
STRICT = match.Policy(vendor_weight="0.40", amount_weight="0.40", currency_weight="0.15", auto="0.95", suggested="0.60", confirmations=5)
STRICT_SCORES = SCORES.replace("0.50 * vendor_score + 0.35 *", "0.40 * vendor_score + 0.40 *").replace("+ 0.10 * CAST(currency", "+ 0.15 * CAST(currency").replace(
    "confirmed < 3 AND score >= 0.93", "confirmed < 5 AND score >= 0.95").replace("score >= 0.93", "score >= 0.95").replace("confirmed >= 3", "confirmed >= 5").replace(
    "score >= 0.70 THEN", "score >= 0.60 THEN")


@query("SELECT state, reason, count(*) AS n, sum(score) AS score FROM decisions GROUP BY state, reason", more=STRICT_SCORES)
def mt_policy(v: Views):
    """A run under another policy."""
    invoices = billed(v)
    pairs = match.contenders(invoices, v.transactions, match.likest_names(invoices, v.transactions, STRICT), STRICT)
    decided = match.decide(invoices, pairs, v.hints, STRICT)
    return decided.groupBy("state", "reason").agg(F.count("*").alias("n"), F.sum("score").alias("score"))


ROW = "substr(sha256(fiscal_year || chr(0) || coalesce(invoice_id, '-') || chr(0) || coalesce(txn_id, '-') || chr(0) || 'full'), 1, 16)"
SCRIPT_ROWS = f"""script AS (SELECT {ROW} AS row_id, *
    FROM (SELECT fiscal_year, invoice_id, txn_id, CASE WHEN match_score >= 0.6 THEN 'auto_matched'
    WHEN match_score >= 0.3 THEN 'suggested' ELSE 'unmatched' END AS state, match_score, 'rescored' AS match_reason FROM recon)),
    held AS (SELECT CASE WHEN match_score >= 0.1 THEN {ROW} ELSE row_id END AS row_id, fiscal_year, invoice_id, txn_id, state,
    match_score, match_reason FROM recon)"""


def _script_rows(v: Views) -> tuple[DataFrame, DataFrame]:
    rid = state.row_id(F.col("fiscal_year"), F.col("invoice_id"), F.col("txn_id"), F.lit("full"))
    new = F.when(F.col("match_score") >= 0.6, "auto_matched").when(F.col("match_score") >= 0.3, "suggested").otherwise("unmatched")
    script = v.recon.select(
        rid.alias("row_id"), "fiscal_year", "invoice_id", "txn_id", new.alias("state"), "match_score",
        F.lit("rescored").alias("match_reason"),
    )
    held = v.recon.select(
        F.when(F.col("match_score") >= 0.1, rid).otherwise(F.col("row_id")).alias("row_id"), "fiscal_year", "invoice_id", "txn_id",
        "state", "match_score", "match_reason",
    )
    return held, script


@query("""SELECT row_id, coalesce(h.fiscal_year, s.fiscal_year) AS fiscal_year, coalesce(h.invoice_id, s.invoice_id) AS invoice_id,
    coalesce(h.txn_id, s.txn_id) AS txn_id, CASE WHEN h.state LIKE 'user%' OR h.state = 'voided' OR s.state IS NULL THEN h.state
    ELSE s.state END AS state, coalesce(s.match_score, h.match_score) AS match_score, coalesce(s.match_reason,
    h.match_reason) AS match_reason FROM held h FULL JOIN script s USING (row_id)""", more=SCRIPT_ROWS)
def recon_upsert(v: Views):
    return state.upsert_rows(*_script_rows(v))


@query("""SELECT row_id, state, CASE WHEN state IN ('user_verified', 'user_personal', 'user_ignore',
    'voided') OR state = 'suggested' THEN 0 ELSE 1 END AS n_records FROM recon""")
def recon_history(v: Views):
    """Records of proposing 'suggested' for every row."""
    after = state.preserved(F.col("state"), F.lit("suggested"))
    return v.recon.select(
        "row_id", "state", F.size(state.history(F.lit(None), F.col("state"), after, F.lit("rescored"))).alias("n_records"),
    )


@query("""SELECT 'new' AS from_state, state AS to_state, CASE WHEN match_score > 0.5 THEN 'script' ELSE 'user' END AS trigger,
    count(*) AS n FROM recon
    WHERE NOT (CASE WHEN match_score > 0.5 THEN state IN ('auto_matched', 'suggested', 'unmatched') ELSE state LIKE 'user%' END)
    GROUP BY ALL""")
def recon_transition(v: Views):
    """Illegal moves among those of new rows to their states."""
    moves = v.recon.select(
        F.lit("new").alias("from_state"), F.col("state").alias("to_state"),
        F.when(F.col("match_score") > 0.5, "script").otherwise("user").alias("trigger"),
    )
    return state.violations(moves).groupBy("from_state", "to_state", "trigger").agg(F.count("*").alias("n"))


@query("""SELECT row_id, CASE WHEN txn_id IN (SELECT txn_id FROM transactions
    WHERE status = 'reversed') THEN 'voided' ELSE state END AS state FROM recon""")
def recon_void(v: Views):
    return state.void(v.recon, v.transactions.where("status = 'reversed'"), "txn_id").select("row_id", "state")


@query("SELECT row_id, " + ROW + " AS key FROM recon")
def recon_rowid(v: Views):
    return v.recon.select("row_id", state.row_id(F.col("fiscal_year"), F.col("invoice_id"), F.col("txn_id"), F.lit("full")).alias("key"))


ASOF = """dated AS (SELECT txn_id, booking_date, currency, amount, (SELECT arg_max(rate, day) FROM fx_rates f
    WHERE f.from_ccy = t.currency AND f.day <= t.booking_date AND f.day >= t.booking_date - 5) AS fx_rate FROM transactions t)"""


@query("""SELECT txn_id, fx_rate, CAST(CASE WHEN fx_rate IS NULL THEN amount
    ELSE CAST(amount * fx_rate AS DECIMAL(38,8)) END AS DECIMAL(18,2)) AS amount_gbp, currency <> 'GBP'
    AND fx_rate IS NULL AS fx_missing FROM dated""", more=ASOF)
def jn_asof_fx(v: Views):
    return fx.convert(v.transactions.drop("amount_gbp"), v.fx_rates, "booking_date").select("txn_id", "fx_rate", "amount_gbp", "fx_missing")


@query("SELECT from_ccy AS currency, day, rate FROM fx_rates WHERE rate > 0")
def src_fx(v: Views):
    return v.fx_rates.select(
        F.col("from_ccy").alias("currency"), "day", S.rate(F.col("rate").cast("string")).alias("rate"),
    ).where("rate IS NOT NULL")


@query("""SELECT invoice_id, CASE WHEN todo THEN CASE WHEN currency = 'GBP' THEN amount_gross
    ELSE CAST(CAST(amount_gross * r AS DECIMAL(38,8)) AS DECIMAL(18,2)) END ELSE amount_gross_gbp END AS amount_gross_gbp,
    CASE WHEN todo THEN CASE WHEN r IS NULL AND currency <> 'GBP' THEN 'no rate for ' || currency || ' near ' || invoice_date END
    ELSE fx_error END AS fx_error
    FROM (SELECT *, amount_gross_gbp IS NULL AND deleted_reason IS NULL AS todo, (SELECT arg_max(rate, day) FROM fx_rates f
    WHERE f.from_ccy = i.currency AND f.day <= i.invoice_date AND f.day >= i.invoice_date - 5) AS r FROM invoices i)""")
def sink_fx_backfill(v: Views):
    return fx.backfill(v.invoices, v.fx_rates, force=True).select("invoice_id", "amount_gross_gbp", "fx_error")


@query("""SELECT txn_id, purchase_id, CASE WHEN purchase_id IS NULL THEN 'orphan_refund' ELSE coalesce(category,
    'refund_matched') END AS category FROM (
    SELECT txn_id, category, (SELECT arg_max(p.txn_id, (p.booking_date, -p.r)) FROM (SELECT *, row_number() OVER (ORDER BY txn_id) AS r
    FROM transactions) p
    WHERE p.account = t.account AND p.description_canonical = t.description_canonical AND p.amount > 0
    AND p.booking_date BETWEEN t.booking_date - 180 AND t.booking_date) AS purchase_id
    FROM transactions t WHERE txn_type = 'refund')""")
def jn_refund(v: Views):
    return ledger.link_refunds(v.transactions)


@query("""SELECT msg_id, CASE WHEN n = 1 THEN 'matched' WHEN n = 0 THEN 'no_candidate' ELSE 'multiple_candidates' END AS outcome, CASE
    WHEN n = 1 THEN txn END AS debit_txn_id, CASE WHEN n = 1 THEN CAST(d AS DECIMAL(18,2)) END AS delta, n AS n_candidates
    FROM (SELECT msg_id, count(txn_id) AS n, min(txn_id) AS txn, arg_min(abs(amount) - billed, txn_id) AS d FROM statements s LEFT
    JOIN transactions t
        ON txn_type = 'transfer' AND (account LIKE 'wise%' OR account LIKE 'monzo%') AND booking_date BETWEEN close_date + 1
    AND close_date + 35 AND abs(abs(amount) - billed) <= 0.50 GROUP BY msg_id)""")
def jn_clearing(v: Views):
    return clearing.clear(v.statements, v.transactions)


RESOLVED = """resolved AS (SELECT auth_id, arg_min(txn_id, (seen, txn_id)) FILTER (WHERE kind = 'pending') AS pending_txn_id,
    arg_min(txn_id, (seen, txn_id)) FILTER (WHERE kind = 'settled') AS settled_txn_id,
    count(DISTINCT CASE WHEN kind = 'pending' THEN txn_id END) > 1 AS ambiguous, min(seen) FILTER (WHERE kind = 'pending') AS first_seen
    FROM auths GROUP BY auth_id)"""


@query("""SELECT *, CASE WHEN pending_txn_id IS NULL THEN 'no_pending' WHEN settled_txn_id IS NULL THEN 'pending'
    ELSE 'merged' END AS outcome FROM resolved""", more=RESOLVED)
def jn_pending(v: Views):
    return pending.resolve(v.auths)


@query("SELECT pending_txn_id AS txn_id FROM resolved WHERE settled_txn_id <> pending_txn_id", more=RESOLVED)
def pend_settle(v: Views):
    return pending.superseded(pending.resolve(v.auths))


SPLIT = """anchors AS (SELECT invoice_id AS anchor_id, CAST(x.value AS DECIMAL(18,2)) AS target, invoice_date AS day FROM invoices
        JOIN (SELECT 'm' || event_id AS msg_id, value FROM events) x ON x.msg_id = source_msg_id),
    parts AS (SELECT msg_id AS row_id, value AS v, CAST(DATE '1995-01-01' + CAST(k % 2400 AS INTEGER) AS DATE) AS d FROM emails
    WHERE value > 0),
    pool AS (SELECT anchor_id, target, row_id, v, d, (-v, d, row_id) AS p FROM anchors JOIN parts ON d BETWEEN day - 7 AND day + 7
    WHERE v <= target + 0.50),
    subsets AS (SELECT a.anchor_id, a.target, [a.row_id, b.row_id] AS ids, a.v + b.v AS total FROM pool a
            JOIN pool b ON a.anchor_id = b.anchor_id AND a.p < b.p WHERE abs(a.target - a.v - b.v) <= 0.50
        UNION ALL SELECT a.anchor_id, a.target, [a.row_id, b.row_id, c.row_id], a.v + b.v + c.v FROM pool a
            JOIN pool b ON a.anchor_id = b.anchor_id AND a.p < b.p JOIN pool c ON c.anchor_id = a.anchor_id AND b.p < c.p
            WHERE abs(a.target - a.v - b.v - c.v) <= 0.50)"""


@query("""SELECT anchor_id, ids, CAST(total AS DECIMAL(18,2)) AS total, CAST(target - total AS DECIMAL(18,2)) AS residual,
    abs(target - total) <= 0.01 AS auto
    FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id
    ORDER BY abs(target - total) <= 0.01 DESC, abs(target - total), len(ids), ids) AS n FROM subsets)
    WHERE n = 1""", more=SPLIT)
def jn_split(v: Views):
    """Invoices paid in two or three parts; amounts come from the events, which are of like size, spread over all years."""
    # the events' file is small enough to be broadcast, but its rows, as a table of hashes, would fill a driver
    anchors = v.invoices.join(v.emails.select("msg_id", "value").hint("merge"), F.col("source_msg_id") == F.col("msg_id"))
    anchors = anchors.select(F.col("invoice_id").alias("anchor_id"), F.col("value").alias("amount"), F.col("invoice_date").alias("day"))
    day = F.date_add(F.lit("1995-01-01").cast("date"), (F.col("k") % 2400).cast("int"))
    return split.find(
        anchors, v.emails.where("value > 0").select(F.col("msg_id").alias("row_id"), F.col("value").alias("amount"), day.alias("day")),
    )


@query("""SELECT txn_id, 'settled' AS status, amount + CASE WHEN account = 'amex' THEN 1 ELSE 0 END AS amount, coalesce(category, CASE
    WHEN account = 'amex' THEN 'late' END) AS category, booking_date FROM transactions""")
def sink_txn_upsert(v: Views):
    """A batch that settles every row, corrects the card's amounts and proposes categories and later booking dates."""
    amex = F.col("account") == "amex"
    batch = v.transactions.withColumns(
        {
            "status": F.lit("settled"), "amount": (F.col("amount") + F.when(amex, 1).otherwise(0)).cast("decimal(18,2)"),
            "category": F.when(amex, "late"), "booking_date": F.date_add("booking_date", 1),
        }
    )
    return ledger.upsert_transactions(v.transactions, batch, [F.asc("k")]).select("txn_id", "status", "amount", "category", "booking_date")


@query("SELECT day, from_ccy, count(*) OVER (PARTITION BY from_ccy) AS n FROM fx_rates")
def wn_partition_count(v: Views):
    n = v.fx_rates.groupBy("from_ccy").agg(F.count("*").alias("n"))
    return v.fx_rates.join(n, "from_ccy").select("day", "from_ccy", "n")


@query("""SELECT txn_id, other_id FROM (SELECT t.txn_id, o.txn_id AS other_id FROM transactions t
    JOIN transactions o ON o.account = t.account AND o.vendor_id = t.vendor_id AND o.booking_date BETWEEN t.booking_date - 3
    AND t.booking_date + 3 AND o.txn_id < t.txn_id)""")
def jn_near_twins(v: Views):
    """Rows of one vendor and account within three days of one another."""
    t = v.transactions.select("txn_id", "account", "vendor_id", "booking_date")
    o = t.select(F.col("txn_id").alias("other_id"), "account", "vendor_id", F.col("booking_date").alias("other_day"))
    return interval_join(
        t, o, "booking_date", "other_day", 3, 3, on=("account", "vendor_id"),
    ).where("other_id < txn_id").select("txn_id", "other_id")


@query("""SELECT CAST(ratio >= 70 AS BIGINT) AS close, count(*) AS n FROM ratios GROUP BY 1""", more="""names AS (SELECT DISTINCT upper(x.canonical_name) AS a,
    upper(y.canonical_name) AS b FROM (SELECT DISTINCT canonical_name FROM vendors) x, (SELECT DISTINCT canonical_name FROM vendors) y
    WHERE x.canonical_name < y.canonical_name), """ + FUZZY)
def fn_token_set_ratio(v: Views):
    """How many pairs of names are close: the index finds those that can be, and only these are worked out."""
    every = v.vendors.select(F.upper("canonical_name").alias("name")).distinct()
    one = lambda c: every.select(F.col("name").alias(c), F.lit(0).alias("_bucket"))
    pairs = names.pairs_at(one("supplier"), one("description"), 0.70).where("supplier < description")
    close = pairs.where(token_set_ratio(F.col("supplier"), F.col("description")) >= 70).agg(F.count("*").alias("close"))
    total = every.agg((F.count("name") * (F.count("name") - 1) / 2).cast("bigint").alias("total"))
    both = close.crossJoin(total)  # of one row each
    return both.selectExpr("stack(2, 1L, close, 0L, total - close) AS (close, n)").where("n > 0")
