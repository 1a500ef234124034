"""Keyed updates of mail, vendors, feedback, exports and runs: a table and a change give the table after it.

Nothing is written in place. A null key never matches, and rows that a change doesn't name stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyweave.functions import scalars as S
from tallyweave.operators.ledger import merge
from tallyweave.operators.store import written

RETRIED = ("error", "no_attachment")
STALE = "INTERVAL 1 HOUR"


def _when(rows: DataFrame, chosen: Column, changes: dict[str, Column]) -> DataFrame:
    """rows with the changes where chosen; a null choice is none."""
    hit = F.coalesce(chosen, F.lit(False))
    return rows.withColumns({c: F.when(hit, v).otherwise(F.col(c)) if c in rows.columns else F.when(hit, v) for c, v in changes.items()})


def _named(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """rows with the column _hit: whether ids (its first column) has the key."""
    chosen = ids.select(F.col(ids.columns[0]).alias("_id")).where("_id IS NOT NULL").distinct()
    return rows.join(chosen, F.col(key) == F.col("_id"), "left").withColumn("_hit", F.col("_id").isNotNull()).drop("_id")


# --- mail ---


def retry_errors(emails: DataFrame) -> DataFrame:
    """Failed mail that isn't dismissed becomes unprocessed again: no outcome, error or date."""
    again = F.col("outcome").isin(*RETRIED) & F.col("dismissed_at").isNull()
    return _when(emails, again, {c: F.lit(None) for c in ("outcome", "error_code", "processed_at") if c in emails.columns})


def insert_new(emails: DataFrame, incoming: DataFrame) -> DataFrame:
    """emails (msg_id, outcome) and, as pending, the messages of incoming (msg_id) that aren't known."""
    fresh = incoming.select("msg_id").distinct().join(emails, "msg_id", "left_anti")
    return emails.unionByName(fresh.withColumn("outcome", F.lit("pending")))


def rescan(emails: DataFrame, seen: DataFrame) -> DataFrame:
    """emails (msg_id, outcome, processed_at, ...) after a second look at a mailbox, with `what` has been done.

    seen: (msg_id, ...) with some of the columns. Known processed mail is updated: its columns are taken from seen and it
    becomes unprocessed; known unprocessed mail is skipped; unknown mail is new. Mail that isn't seen has no `what`.
    """
    done = F.col("old.processed_at").isNotNull()
    marked = emails.withColumn("what", F.lit(None).cast("string"))
    fresh = seen.withColumn("what", F.lit("new"))
    rules: dict[str, Column | str] = {
        c: F.when(done, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")) for c in seen.columns if c != "msg_id"
    }
    rules |= {c: F.when(~done, F.col(f"old.{c}")) for c in ("outcome", "processed_at")}
    rules["what"] = F.when(done, "updated").otherwise("skipped")
    order = [F.asc(c) for c in seen.columns if c != "msg_id"] or [F.asc("msg_id")]
    return merge(marked, fresh, ["msg_id"], rules, order)


def reset(invoices: DataFrame, emails: DataFrame, marks: DataFrame, source: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(invoices, emails, marks) without any invoice, and without the mail and the mark of a source."""
    other = ~F.coalesce(F.col("source") == source, F.lit(False))
    return invoices.limit(0), emails.where(other), marks.where(other)


def set_outcomes(emails: DataFrame, outcomes: DataFrame, at: Column) -> DataFrame:
    """emails with outcomes (msg_id, outcome, error_code, error_message), processed at a time. Messages are redacted."""
    rules = {c: "new" for c in ("outcome", "error_code", "processed_at")} | {"error_message": S.redact(F.col("new.error_message"))}
    order = [F.desc("outcome"), F.asc("error_code"), F.asc("error_message")]
    known = outcomes.join(emails.select("msg_id"), "msg_id", "left_semi").withColumn("processed_at", at)
    return merge(emails, known, ["msg_id"], rules, order)


def dismiss(emails: DataFrame, ids: DataFrame, reason: str, at: Column) -> DataFrame:
    """emails with the named ones dismissed for a reason; a later dismissal replaces an earlier one."""
    marked = _named(emails, "msg_id", ids)
    return _when(marked, F.col("_hit"), {"dismissed_at": at, "dismissed_reason": F.lit(reason)}).drop("_hit")


def dismissal_feedback(emails: DataFrame, ids: DataFrame, reason: str) -> DataFrame:
    """The feedback rows (msg_id, feedback_type, feedback_value, from_addr, subject, sender_domain) of a dismissal."""
    chosen = _named(emails, "msg_id", ids).where("_hit")
    kind = F.lit("dismiss").alias("feedback_type")
    return chosen.select(
        "msg_id", kind, F.lit(reason).alias("feedback_value"), "from_addr", "subject", S.domain(F.col("from_addr")).alias("sender_domain"),
    )


def block(blocked: DataFrame, senders: DataFrame) -> DataFrame:
    """blocked (domain) and the lower-case domains of senders (from_addr); senders without a domain are left out."""
    new = senders.select(S.domain(F.col("from_addr")).alias("domain")).where("domain IS NOT NULL AND domain <> ''")
    return blocked.select("domain").union(new).distinct()


# --- vendors, invoices, rates ---


def get_or_create(vendors: DataFrame, seen: DataFrame) -> DataFrame:
    """vendors (vendor_id, canonical_name) and those of seen whose id is new; of several names the least counts."""
    first = seen.groupBy("vendor_id").agg(F.min("canonical_name").alias("canonical_name"))
    return vendors.unionByName(first.join(vendors, "vendor_id", "left_anti"))


def mark_exported(invoices: DataFrame, ids: DataFrame, day: Column) -> DataFrame:
    """invoices with the date of export on the named live ones."""
    marked = _named(invoices, "invoice_id", ids)
    return _when(marked, F.col("_hit") & F.col("deleted_reason").isNull(), {"last_exported_at": day}).drop("_hit")


def append_filed(invoices: DataFrame, emails: DataFrame, filed: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """(invoices with the filed ones, emails whose message brought one).

    filed: rows of invoices' columns and `decision`. A resend brings no row, but its message is done as well; an id that
    is known brings none either.
    """
    new = filed.where("decision <> 'duplicate_resend'").join(invoices.select("invoice_id"), "invoice_id", "left_anti")
    marked = _named(emails, "msg_id", filed.select("source_msg_id"))
    done = _when(marked, F.col("_hit"), {"outcome": F.lit("invoice"), "processed_at": at}).drop("_hit")
    return invoices.unionByName(new.select(*invoices.columns)), done


def store_rates(rates: DataFrame, fetched: DataFrame) -> DataFrame:
    """rates (day, from_ccy, to_ccy, rate) with fetched ones in place of those of their key; of several the largest stays."""
    return merge(rates, fetched, ["day", "from_ccy", "to_ccy"], {"rate": "new"}, [F.desc("rate")])


# --- sources and runs ---


def advance_marks(marks: DataFrame, new: DataFrame) -> DataFrame:
    """marks (source, mark) with new ones; a null mark keeps the old one."""
    return merge(marks, new, ["source"], {"mark": F.coalesce("new.mark", "old.mark")}, [F.desc("mark")])


def count_reauth(waiting: DataFrame, failed: DataFrame) -> DataFrame:
    """waiting (source, retry_count) with one more try of each failed source; a new source starts at one."""
    first = failed.select("source").distinct().withColumn("retry_count", F.lit(1).cast("bigint"))
    return merge(waiting, first, ["source"], {"retry_count": F.col("old.retry_count") + 1}, [F.asc("source")])


def resolve_reauth(waiting: DataFrame, recovered: DataFrame) -> DataFrame:
    """waiting without the sources that work again."""
    return waiting.join(recovered.select("source").distinct(), "source", "left_anti")


def interrupt_stale(runs: DataFrame, now: Column, operation: str | None = None) -> DataFrame:
    """runs with those interrupted, of one operation or of all, that have been running for more than an hour."""
    old = (F.col("status") == "running") & (F.col("started_at") < now - F.expr(STALE))
    return _when(runs, old & (F.col("operation") == operation) if operation else old, {"status": F.lit("interrupted")})


def cancel(runs: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """runs with the running ones, all or the named, cancelled."""
    running = F.col("status") == "running"
    if ids is None:
        return _when(runs, running, {"status": F.lit("cancelled")})
    return _when(_named(runs, "run_id", ids), running & F.col("_hit"), {"status": F.lit("cancelled")}).drop("_hit")


def begin_run(runs: DataFrame, run_id: str, operation: str, now: Column) -> DataFrame:
    """runs and a new one; stale runs of the same operation are interrupted first. A known id is left alone."""
    new = runs.sparkSession.range(1).select(
        F.lit(run_id).alias("run_id"), F.lit(operation).alias("operation"), now.alias("started_at"), F.lit("running").alias("status"),
        F.lit("{}").alias("stats_json"),
    )
    return interrupt_stale(runs, now, operation).unionByName(
        new.join(runs.select("run_id"), "run_id", "left_anti"), allowMissingColumns=True,
    )


def update_stats(runs: DataFrame, stats: DataFrame) -> DataFrame:
    """runs with the statistics of stats (run_id, stats_json); their states stay."""
    known = stats.join(runs.select("run_id"), "run_id", "left_semi")
    return merge(runs, known, ["run_id"], {"stats_json": "new"}, [F.desc("stats_json")])


def complete_runs(runs: DataFrame, done: DataFrame, now: Column) -> DataFrame:
    """runs with the state and statistics of done (run_id, status, stats_json), ended now."""
    known = done.join(runs.select("run_id"), "run_id", "left_semi").withColumn("ended_at", now)
    return merge(
        runs, known, ["run_id"], {"status": "new", "stats_json": "new", "ended_at": "new"}, [F.desc("status"), F.desc("stats_json")],
    )


def running_sum(rows: DataFrame, key: str, order: list[str], value: str, to: str, kind: str = "decimal(38,2)") -> DataFrame:
    """rows with the running sum of `value` along `order` within `key`, rows of equal order by what comes.

    Rows are dealt out in ranges of (key, order), so a key with very many rows is in many tasks. The sum of a key's rows
    in each range is one row; summed up over the ranges before, that is what each range starts from. There are no more
    of these rows than ranges and keys, so they meet in windows by key.
    """
    dealt = written(
        rows.repartitionByRange(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key, *order).withColumn("_range", F.spark_partition_id())
    )
    sums = dealt.groupBy(F.col(key).alias("_key"), F.col("_range").alias("_of")).agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy("_key").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_key", "_of", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start"))
    within = Window.partitionBy(key, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = dealt.withColumn("_own", F.coalesce(F.sum(value).over(within), F.lit(0)))
    both = own.join(starts, own[key].eqNullSafe(F.col("_key")) & (F.col("_range") == F.col("_of")))
    return both.withColumn(to, (F.col("_start") + F.col("_own")).cast(kind)).select(*rows.columns, to)


def spending(calls: DataFrame, run: str, order: list[str], cost: str, ceiling: str) -> DataFrame:
    """calls with `spent`, what their run has asked for up to each, and `granted`, whether that is within the ceiling.

    A run stops at the first call that no longer fits, so those after it aren't granted either. A call without a cost asks
    for nothing.
    """
    if not float(ceiling) > 0:
        raise ValueError("the ceiling must be positive")
    summed = running_sum(calls, run, order, cost, "spent")
    return summed.withColumn("granted", F.col("spent") <= F.lit(ceiling).cast("decimal(18,2)"))
