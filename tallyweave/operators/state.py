"""States of reconciliation rows: which transitions are legal, what a rerun may overwrite, and their history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.functions.scalars import key16
from tallyweave.operators.ledger import merge

SCRIPT = ("auto_matched", "suggested", "unmatched")
USER = ("user_verified", "user_overridden", "user_personal", "user_ignore")
LINKED = ("auto_matched", "suggested", "user_verified", "user_overridden")
NOTE_CHARS, REASON_CHARS = 120, 512
RECORD = "struct<`from`:string,`to`:string,trigger:string,note:string>"


def legal() -> list[tuple[str, str, str]]:
    """(from, to, trigger): scripts move rows among script states, users on to user states and back to new, the system voids."""
    out = [(a, b, "script") for a in ("new", *SCRIPT) for b in SCRIPT]
    out += [(a, b, "user") for a in ("new", *SCRIPT) for b in USER]
    out += [(a, b, "user") for a in USER for b in ("new", *USER) if a != b]
    return out + [(a, "voided", "system") for a in ("new", *SCRIPT, *USER)]


def transitions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(legal(), "from_state string, to_state string, trigger string")


def violations(moves: DataFrame) -> DataFrame:
    """The rows of moves (from_state, to_state, trigger) that aren't legal."""
    return moves.join(F.broadcast(transitions(moves.sparkSession)), ["from_state", "to_state", "trigger"], "left_anti")  # 52 rows


def preserved(current: Column, proposed: Column) -> Column:
    """Users' states and voided ones stay; else the script's proposal counts."""
    return F.when(current.isin(*USER, "voided"), current).otherwise(proposed)


def row_id(fiscal_year: Column, invoice: Column, txn: Column, kind: Column) -> Column:
    return key16(fiscal_year, F.coalesce(invoice, F.lit("-")), F.coalesce(txn, F.lit("-")), kind)


def history(before: Column, current: Column, after: Column, note: Column) -> Column:
    """before with a record of the change, if there is one."""
    record = F.struct(
        current.alias("from"), after.alias("to"), F.lit("script").alias("trigger"), F.substring(note, 1, NOTE_CHARS).alias("note"),
    )
    old = F.coalesce(before, F.array().cast(f"array<{RECORD}>"))
    return F.when(current == after, old).otherwise(F.concat(old, F.array(record)))


def upsert_rows(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """rows (row_id, fiscal_year, invoice_id, txn_id, state, match_score, match_reason) with decisions of the same columns merged in."""
    state = preserved(F.col("old.state"), F.col("new.state"))
    kept = F.col("old.state").isin(*USER)
    return merge(
        rows, decisions, ["row_id"],
        {
            "state": state, "txn_id": F.when(kept, F.col("old.txn_id")).otherwise(F.col("new.txn_id")), "match_score": "new",
            "match_reason": F.substring("new.match_reason", 1, REASON_CHARS),
        },
        [F.desc("match_score"), F.asc("txn_id")],
    )


def void(rows: DataFrame, dead: DataFrame, key: str) -> DataFrame:
    """rows with those voided whose key is among dead's."""
    gone = dead.select(F.col(key).alias("_k"), F.lit(True).alias("_dead")).distinct()
    found = rows.join(gone, F.col(key) == F.col("_k"), "left")
    return found.withColumn("state", F.when(F.col("_dead"), "voided").otherwise(F.col("state"))).select(*rows.columns)
