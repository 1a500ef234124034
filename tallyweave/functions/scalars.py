"""Scalar rules as Column expressions: canonical text, keys, money, dates, fiscal years, classes.

All stay inside Catalyst. Casts that may fail are try_casts, so a malformed value becomes null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: vocabularies and patterns that results depend on
CATEGORIES = (
    "software_saas", "travel", "meals_entertainment", "hardware_office", "professional_services", "advertising", "utilities", "other",
)
CURRENCIES = (
    "GBP", "USD", "EUR", "AUD", "CAD", "CHF", "JPY", "SEK", "NOK", "DKK", "PLN", "SGD", "HKD", "NZD", "ZAR", "AED", "CNY", "INR", "BRL",
    "MXN", "THB", "KRW",
)
#: The narrow list that money is held to.
STRICT_CURRENCIES = ("GBP", "USD", "EUR", "CAD", "AUD", "CHF", "JPY", "NZD", "SEK", "NOK", "DKK", "PLN")
CITIES = (
    "LONDON", "MANCHESTER", "BRISTOL", "EDINBURGH", "GLASGOW", "BIRMINGHAM", "LEEDS", "LIVERPOOL", "CARDIFF", "BELFAST", "OXFORD",
    "CAMBRIDGE", "BRIGHTON", "READING", "YORK",
)
FEES = r"\b(CONVERSION\s+FEE|FOREIGN\s+TRANSACTION\s+FEE|FX\s+FEE|WIRE\s+FEE|SWIFT\s+FEE|MEMBERSHIP\s+FEE)\b"
TRANSFERS = r"\b(AMEX\s+PAYMENT|AMERICAN\s+EXPRESS|CARD\s+(PMT|REPAYMENT)|DD\s+AMEX|CARD\s+PAYMENT\s+TO\s+AMEX|STRIPE\s+PAYOUT|WISE\s+TRANSFER|MONZO\s+TRANSFER|INTERNAL\s+TRANSFER)\b"
SECRETS = (
    (r"Bearer\s+[A-Za-z0-9._\-+/=]+", "Bearer <redacted>"),
    (r"(invoice|pay)\.stripe\.com/i/[A-Za-z0-9_]+", "$1.stripe.com/i/<token>"),
    (r"(?i)([?&])(token|signature|sig|access_token|refresh_token|key|auth|api_key)=[^&\s]+", "$1$2=<redacted>"),
    (r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}", "<email>"),
)
ERROR_CAP = 2000
STRIPE_HOSTS = ("pay.stripe.com", "invoice.stripe.com", "files.stripe.com")
PADDLE_HOSTS = ("paddle.com", "paddle.net", "vendors.paddle.com", "checkout.paddle.com")
GATED_HOSTS = (
    "zoom.us", "us02web.zoom.us", "notion.so", "www.notion.so", "console.aws.amazon.com", "github.com", "portal.azure.com", "platform.openai.com", "openai.com", "billing.google.com", "console.cloud.google.com",
    "dashboard.heroku.com", "vercel.com", "railway.app", "easyjet.com", "www.easyjet.com", "thetrainline.com", "www.thetrainline.com", "booking.thetrainline.com", "webflow.com", "www.webflow.com",
)
GATED_SUFFIX = ".webflow.com"
URL_PATTERNS = (
    r"https?://[^\s<>\"']+\.pdf\b",
    r"https?://pay\.stripe\.com/[^\s<>\"']+",
    r"https?://invoice\.stripe\.com/[^\s<>\"']+",
    r"https?://[^\s<>\"']*paddle[^\s<>\"']+/invoice[^\s<>\"']*",
    r"https?://platform\.openai\.com/[^\s<>\"']*billing[^\s<>\"']*",
    r"https?://[^\s<>\"']*\.zoom\.us/[^\s<>\"']*invoice[^\s<>\"']*",
    r"https?://[^\s<>\"']*\.zoom\.us/[^\s<>\"']*billing[^\s<>\"']*",
    r"https?://dashboard\.heroku\.com/[^\s<>\"']*invoice[^\s<>\"']*",
    r"https?://vercel\.com/[^\s<>\"']*billing[^\s<>\"']*",
    r"https?://railway\.app/[^\s<>\"']*billing[^\s<>\"']*",
)
FISCAL_FIRST_MONTH = 3
VENDOR_SLUG, NUMBER_SLUG = 60, 64
LOW_NUMBER_CONFIDENCE = 0.70


def clean_text(c: Column) -> Column:
    """Without control characters, runs of white space as one space, trimmed; null counts as ''."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\x00-\x1f\x7f]", ""), r"\s+", " "))


def canonical_description(c: Column) -> Column:
    """A merchant's stable name: upper case, without country, reference and city endings, in this order."""
    text = F.regexp_replace(F.trim(F.upper(F.regexp_replace(c, r"[\x00-\x1f\x7f]", ""))), r"\s+", " ")
    for ending in (r"\s+GB\s*\d*$", r"\s+[A-Z0-9]{8,12}$", rf"\s+({'|'.join(CITIES)})(\s.*)?$"):
        text = F.regexp_replace(text, ending, "")
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def key16(*parts: Column) -> Column:
    """First 16 hex digits of SHA-256 over the parts, joined by NUL; null if a part is null."""
    joined = parts[0]
    for p in parts[1:]:
        joined = F.concat(joined, F.lit("\0"), p)
    return F.substring(F.sha2(joined, 256), 1, 16)


def card_txn_id(reference: Column, account: Column, day: Column, description: Column, amount: Column, ordinal: Column) -> Column:
    """The provider's reference wins; else date, description, raw amount and the ordinal within file and date."""
    return F.when(F.coalesce(reference, F.lit("")) != "", key16(account, reference)).otherwise(
        key16(account, F.date_format(day, "yyyy-MM-dd"), description, amount.cast("string"), ordinal.cast("string"))
    )


def bank_txn_id(auth_id: Column, account: Column, day: Column, description: Column, amount: Column) -> Column:
    return F.when(F.coalesce(auth_id, F.lit("")) != "", key16(account, auth_id)).otherwise(
        key16(account, F.date_format(day, "yyyy-MM-dd"), description, amount.cast("string"))
    )


def vendor_id(name: Column, domain: Column) -> Column:
    blank = lambda c: F.when(c != "", c)
    return F.substring(F.sha2(F.lower(F.trim(F.coalesce(blank(name), blank(domain), F.lit("unknown")))), 256), 1, 16)


def effective_number(number: Column, confidence: Column, vendor: Column, day: Column, gross: Column, attachment: Column) -> Column:
    """The extracted number, or SYN- and eight digits of a digest where it is missing or doubtful."""
    blank = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    seed = F.concat_ws("\0", vendor, blank(day), blank(gross), attachment.cast("string"))
    made = F.concat(F.lit("SYN-"), F.upper(F.substring(F.sha2(seed, 256), 1, 8)))
    return F.when(number.isNotNull() & (confidence >= LOW_NUMBER_CONFIDENCE), number).otherwise(made)


def slug(c: Column, longest: int, fallback: Column) -> Column:
    """Lower case, runs of other than a-z and 0-9 as one hyphen, cut to length; 'syn-' and a digest where nothing is left."""
    edges = r"(^-+|-+$)"
    text = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9]+", "-"), edges, "")
    cut = F.regexp_replace(F.substring(text, 1, longest), edges, "")
    return F.when(cut == "", F.concat(F.lit("syn-"), F.substring(F.sha2(fallback, 256), 1, 8))).otherwise(cut)


def drive_name(day: Column, supplier: Column, gross: Column, currency: Column, number: Column, fallback: Column) -> Column:
    return F.concat(
        F.coalesce(day.cast("string"), F.lit("unknown-date")), F.lit("_"), slug(supplier, VENDOR_SLUG, fallback), F.lit("_"),
        F.coalesce(gross.cast("string"), F.lit("unknown")), F.lit("-"), F.coalesce(currency, F.lit("XXX")), F.lit("_"),
        slug(number, NUMBER_SLUG, F.concat(fallback, F.lit(":"), number)), F.lit(".pdf"),
    )


def year_month(day: Column) -> Column:
    return F.coalesce(F.date_format(day, "yyyy-MM"), F.lit("unknown-month"))


def fiscal_start_year(day: Column) -> Column:
    return F.year(day) - F.when(F.month(day) < FISCAL_FIRST_MONTH, 1).otherwise(0)


def fiscal_year(day: Column) -> Column:
    """FY-2026-27 for 1 March 2026 to the last day of February 2027."""
    y = fiscal_start_year(day)
    return F.format_string("FY-%04d-%02d", y, F.pmod(y + 1, F.lit(100)))


def fiscal_bounds(day: Column) -> tuple[Column, Column]:
    y = fiscal_start_year(day)
    return F.make_date(y, F.lit(FISCAL_FIRST_MONTH), F.lit(1)), F.date_sub(F.make_date(y + 1, F.lit(FISCAL_FIRST_MONTH), F.lit(1)), 1)


def label_bounds(label: str) -> tuple[str, str]:
    """ISO dates of a label's first and last day; ValueError for a label whose years don't follow one another."""
    import re
    from datetime import date, timedelta

    m = re.fullmatch(r"FY-(\d{4})-(\d{2})", label)
    if not m or (int(m[1]) + 1) % 100 != int(m[2]):
        raise ValueError(f"no fiscal year: {label!r}")
    y = int(m[1])
    return date(y, FISCAL_FIRST_MONTH, 1).isoformat(), (date(y + 1, FISCAL_FIRST_MONTH, 1) - timedelta(days=1)).isoformat()


def fiscal_years(spark: SparkSession, first: str, last: str) -> DataFrame:
    """(label, days) of the fiscal years from one label to another; raises where the first is after the last."""
    starts = [label_bounds(x)[0] for x in (first, last)]
    if starts[0] > starts[1]:
        raise ValueError(f"{first} is after {last}")
    years = F.sequence(*(F.lit(x).cast("date") for x in starts), F.expr("INTERVAL 1 YEAR"))
    rows = spark.range(1).select(F.explode(years).alias("day"))
    return rows.select(fiscal_year(F.col("day")).alias("label"), F.datediff(F.add_months("day", 12), "day").alias("days"))


def london_to_utc(local: Column) -> Column:
    """London time without a zone as UTC time without a zone."""
    return F.convert_timezone(F.lit("Europe/London"), F.lit("UTC"), local)


def london_date(ts: Column) -> Column:
    return F.to_date(F.from_utc_timestamp(ts, "Europe/London"))


def money(c: Column) -> Column:
    """Two decimals, half up; null for what is no number."""
    return F.round(c.try_cast("decimal(20,4)"), 2).cast("decimal(18,2)")


def money_text(c: Column) -> Column:
    """The canonical text of an amount: two decimals half up, no separators; null where it is no number."""
    return money(c).cast("string")


def rate(c: Column) -> Column:
    """Six decimals, half up; null unless above zero."""
    r = F.round(c.try_cast("decimal(20,8)"), 6).cast("decimal(18,6)")
    return F.when(r > 0, r)


def parse_amount(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, "[,£]", "")).try_cast("decimal(18,2)")


def parse_date(c: Column) -> Column:
    """Day/month/year, then ISO, then day-month-year."""
    text = F.trim(c)
    day = lambda p: F.try_to_date(text, p)
    return F.coalesce(day("d/M/yyyy"), day("yyyy-M-d"), day("d-M-yyyy"))


def body_date(c: Column) -> Column:
    """The first ISO date in a text, else its first 'D Mon YYYY'."""
    iso = F.try_to_date(F.regexp_extract(c, r"\b(20\d{2}-\d{2}-\d{2})\b", 1), "yyyy-MM-dd")
    pattern = r"(?i)\b(\d{1,2})\s+(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+(20\d{2})\b"
    part = lambda k: F.regexp_extract(c, pattern, k)
    return F.coalesce(iso, F.try_to_date(F.concat_ws(" ", part(1), F.initcap(part(2)), part(3)), "d MMM yyyy"))


def txn_type(amount: Column, description: Column, account: Column) -> Column:
    """Fees are purchases, known phrases transfers, negative rows refunds, other credits outside the card income."""
    text = F.upper(description)
    return (
        F.when(text.rlike(FEES), "purchase").when(text.rlike(TRANSFERS), "transfer").when(amount < 0, "refund")
        .when((amount > 0) & (account != "amex"), "income").otherwise("purchase")
    )


def fee_hint(description: Column) -> Column:
    return F.when(F.upper(description).rlike(FEES), F.lit("bank_fee"))


def domain(address: Column) -> Column:
    """What follows the last @, in lower case; null without one."""
    return F.when(address.contains("@"), F.trim(F.lower(F.element_at(F.split(address, "@"), -1))))


def domain_first(address: Column) -> Column:
    """What follows the first @, in lower case; null without one."""
    at = F.instr(address, "@")
    return F.when(at > 0, F.lower(address.substr(at + 1, F.length(address))))


def redact(c: Column) -> Column:
    for pattern, replacement in SECRETS:
        c = F.regexp_replace(c, pattern, replacement)
    return F.substring(c, 1, ERROR_CAP)


def sheet_cell(c: Column) -> Column:
    """Null as '', without control characters but tab and line ends, with an apostrophe before what a sheet would compute."""
    text = F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    return F.when(text.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), text)).otherwise(text)


def flag_cell(c: Column) -> Column:
    return F.when(c, "TRUE").otherwise("FALSE")


def html_text(c: Column) -> Column:
    """Markup replaced by spaces, the pieces joined by one space."""
    return F.trim(
        F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?s)<!--.*?-->", " "), "<[^>]*>", " "), r"\s+", " ")
    )


def invoice_urls(html: Column, text: Column, most: int = 5) -> Column:
    """Links that may lead to an invoice: by body, then by pattern, then in order; the first `most` different ones."""
    found = [
        F.regexp_extract_all(F.coalesce(body, F.lit("")), F.lit(f"(?i)({p})"), F.lit(1)) for body in (html, text) for p in URL_PATTERNS
    ]
    return F.slice(F.array_distinct(F.transform(F.flatten(F.array(*found)), lambda u: F.regexp_replace(u, r"[.,;:)]+$", ""))), 1, most)


def provider(url: Column) -> Column:
    host = F.regexp_replace(F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit(""))), r"\.+$", "")
    gated = host.isin(*GATED_HOSTS) | host.endswith(GATED_SUFFIX)
    return F.when(host == "", "unknown").when(host.isin(*STRIPE_HOSTS), "stripe").when(host.isin(*PADDLE_HOSTS), "paddle").when(gated, "login_gated").otherwise("generic")


def unfence(c: Column) -> Column:
    """Without a Markdown fence around it."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(c), r"^```[A-Za-z]*\s*", ""), r"\s*```$", ""))


def truncated(c: Column, longest: int, marker: str = "\n[truncated]") -> Column:
    return F.when(F.length(c) > longest, F.concat(F.substring(c, 1, longest), F.lit(marker))).otherwise(c)


def token_estimate(c: Column) -> Column:
    return F.ceil(F.length(c) / 4).cast("long")


def like_prefix(c: Column, prefix: str) -> Column:
    """Literal prefix, in any case."""
    return F.lower(c).startswith(prefix.lower())


def like_infix(c: Column, part: str) -> Column:
    return F.lower(c).contains(part.lower())


def escape_like(text: Column) -> Column:
    """text as a LIKE pattern that stands for itself: backslashes, percent signs and underscores are escaped."""
    return F.regexp_replace(text, r"([\\%_])", r"\\$1")
