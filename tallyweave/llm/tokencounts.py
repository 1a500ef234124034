"""Token counts as delta-maintained rollups.

A batch of changes (insert, revise, delete of a document's count under one tokenizer version) becomes signed rows: the
document's former count with a minus, its new one with a plus. Signed rows add up: over all committed batches they
give each document's current count, and grouped by source, language and tokenizer version the current totals. A batch
thus costs one join of its own changes with the documents' rows, and totals need no second look at the documents.

Layout under one folder: attempts/ID/ledger (signed rows) and attempts/ID/delta (their sums by group), written by one
attempt each under a name of its own, and commits/NUMBER, small files that name a batch and its attempt. A commit is the
renaming of such a file to the number after the one that the attempt has read, which only one of several writers can do;
the others read again and try anew. Readers see attempts that a commit names. So an attempt that dies leaves nothing
behind that counts, a batch that is committed is left alone, and batches that are written together don't take the same
former count away twice. Every SNAPSHOT_EVERY commits the current counts are written once as attempts/ID/ledger, and the
commit file says that readers may begin there.
"""

from __future__ import annotations

import json
import re
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SPACE = r"[\x20\x09-\x0D]+"
GROUP = ("source", "lang", "tokenizer")
LEDGER = "doc_id bigint, source string, lang string, tokenizer string, n_docs bigint, n_tokens bigint"
DELTA = "source string, lang string, tokenizer string, n_docs bigint, n_tokens bigint"
#: Commits after which the ledger begins anew with the current counts.
SNAPSHOT_EVERY = 16
MOST_TRIES = 100


def words(text: Column) -> Column:
    """Runs of other than the six ASCII white-space characters; 0 for null and empty texts."""
    return F.coalesce(F.size(F.filter(F.split(text, SPACE), lambda w: w != "")), F.lit(0)).cast("long")


def octets(text: Column) -> Column:
    """UTF-8 bytes: the tokens of a byte-level model without merges."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def clean_words(text: Column) -> Column:
    """Words, without those that hold no letter and no digit."""
    return F.coalesce(F.size(F.filter(F.split(text, SPACE), lambda w: w.rlike(r"[\p{L}\p{N}]"))), F.lit(0)).cast("long")


class Rollup:
    """Totals of token counts under one folder that driver and executors share. Several writers may commit at a time."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _hadoop(self, path: str):
        found = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return found.getFileSystem(self.spark._jsc.hadoopConfiguration()), found

    def log(self) -> list[dict]:
        """The commits in order: number, batch, attempt, and start, the number of the first commit that readers need."""
        fs, folder = self._hadoop(f"{self.path}/commits")
        if not fs.exists(folder):
            return []
        paths = [x.getPath() for x in fs.listStatus(folder) if re.fullmatch(r"\d{8}", x.getPath().getName())]
        lines = self.spark.read.text([p.toString() for p in paths]).collect() if paths else []  # a line a commit
        return sorted((json.loads(x["value"]) for x in lines), key=lambda c: c["number"])

    def committed(self) -> list[str]:
        """Names of the committed batches, in order."""
        return [c["batch"] for c in self.log() if c["batch"]]

    def _publish(self, number: int, entry: dict) -> bool:
        """Make commits/number, unless there is one: a file under another name that is renamed, which never replaces."""
        jvm, folder = self.spark._jvm, f"{self.path}/commits"
        fs, draft = self._hadoop(f"{folder}/draft-{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(entry | {"number": number}).encode()))
        out.close()
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
            draft.getFileSystem(self.spark._jsc.hadoopConfiguration()).getUri(), self.spark._jsc.hadoopConfiguration(),
        )
        options = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            files.rename(draft, jvm.org.apache.hadoop.fs.Path(f"{folder}/{number:08d}"), options)
        except Py4JJavaError as error:
            fs.delete(draft, False)
            if "FileAlreadyExistsException" in str(error.java_exception):
                return False
            raise
        return True

    def _rows(self, kind: str, schema: str, log: list[dict]) -> DataFrame:
        """Rows of the committed attempts only; folders of others aren't even listed."""
        if kind == "ledger" and log:
            log = [c for c in log if c["number"] >= log[-1]["start"]]
        if not log:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(
            *(f"{self.path}/attempts/{c['attempt']}/{kind}" for c in log if kind == "ledger" or c["batch"])
        )

    def current(self, log: list[dict] | None = None, of: DataFrame | None = None) -> DataFrame:
        """(doc_id, source, lang, tokenizer, n_tokens) of every counted document, or of those that `of` has."""
        rows = self._rows("ledger", LEDGER, self.log() if log is None else log)
        if of is not None:
            rows = rows.join(of.select("doc_id", "tokenizer"), ["doc_id", "tokenizer"], "left_semi")
        sums = rows.groupBy("doc_id", *GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.where("n_docs > 0").drop("n_docs")

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, n_docs, n_tokens) of every group that has documents."""
        sums = self._rows("delta", DELTA, self.log()).groupBy(*GROUP).agg(
            F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"),
        )
        return sums.where("n_docs <> 0")

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Apply changes (op, seq, doc_id, source, lang, tokenizer, n_tokens); False if the batch is committed already.

        op is 'upsert' (an insert, or a revised count, source or language) or 'delete'. Of several changes to one
        document and tokenizer the one with the largest seq counts (ties: a delete, then the larger count). Deletes of
        uncounted documents and changes with a null doc_id, tokenizer or, for upserts, n_tokens are left out; null
        sources and languages are groups of their own. Other columns are ignored. Where another writer commits first,
        the batch is worked out again on what that one has left.
        """
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]*", batch):
            raise ValueError("a batch name has letters, digits, dots, dashes and underscores")
        for _ in range(MOST_TRIES):
            log = self.log()
            if any(c["batch"] == batch for c in log):
                return False
            attempt = self._attempt(changes, log)
            last = log[-1] if log else {"number": 0, "start": 1}
            if self._publish(last["number"] + 1, {"batch": batch, "attempt": attempt, "start": last["start"]}):
                if last["number"] + 2 - last["start"] >= SNAPSHOT_EVERY:
                    self.snapshot()
                return True
        raise RuntimeError(f"other writers were faster {MOST_TRIES} times")

    def snapshot(self) -> bool:
        """Write the current counts once, so that readers needn't look at what came before; False if a commit came between."""
        log = self.log()
        if not log:
            return False
        attempt, number = uuid.uuid4().hex, log[-1]["number"] + 1
        rows = self.current(log).select("doc_id", *GROUP, F.lit(1).cast("long").alias("n_docs"), "n_tokens")
        rows.write.parquet(f"{self.path}/attempts/{attempt}/ledger")
        return self._publish(number, {"batch": None, "attempt": attempt, "start": number})

    def _attempt(self, changes: DataFrame, log: list[dict]) -> str:
        """Write the signed rows of changes against the counts of a log, and their sums; the attempt's name."""
        last = Window.partitionBy("doc_id", "tokenizer").orderBy(
            F.desc("seq"), F.asc("op"), F.desc("n_tokens"), F.desc("source"), F.desc("lang"),
        )
        new = (
            changes.where("doc_id IS NOT NULL AND tokenizer IS NOT NULL AND (op = 'delete' OR op = 'upsert' AND n_tokens IS NOT NULL)")
            .select(
                "op", F.col("doc_id").cast("long"), "source", "lang", "tokenizer", F.col("n_tokens").cast("long"),
                F.row_number().over(last).alias("_nth"),
            )
            .where("_nth = 1")
        )
        attempt = uuid.uuid4().hex
        new.write.parquet(f"{self.path}/attempts/{attempt}/changes")  # counted once, read twice
        new = self.spark.read.schema(new.schema).parquet(f"{self.path}/attempts/{attempt}/changes")
        old = self.current(log, of=new).select("doc_id", "tokenizer", F.struct("source", "lang", "n_tokens").alias("was"))
        both = new.join(old, ["doc_id", "tokenizer"], "left")

        def signed(sign: int, source: str, lang: str, n: str) -> Column:
            return F.struct(
                F.col(source).alias("source"), F.col(lang).alias("lang"), F.lit(sign).cast("long").alias("n_docs"),
                (F.col(n) * sign).cast("long").alias("n_tokens"),
            )

        minus = F.when(F.col("was").isNotNull(), signed(-1, "was.source", "was.lang", "was.n_tokens"))
        plus = F.when(F.col("op") == "upsert", signed(1, "source", "lang", "n_tokens"))
        rows = both.select(
            "doc_id", "tokenizer", F.inline(F.array_compact(F.array(minus, plus))),
        ).select("doc_id", *GROUP, "n_docs", "n_tokens")
        rows.write.parquet(f"{self.path}/attempts/{attempt}/ledger")
        kept = self.spark.read.schema(LEDGER).parquet(f"{self.path}/attempts/{attempt}/ledger")
        sums = kept.groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        sums.write.parquet(f"{self.path}/attempts/{attempt}/delta")
        return attempt


def counts(docs: DataFrame, tokenizers: dict[str, Column], op: str = "upsert", seq: int = 0) -> DataFrame:
    """Changes that give every row of docs its count under each tokenizer version."""
    each = F.explode(
        F.array(*(F.struct(F.lit(name).alias("tokenizer"), n.alias("n_tokens")) for name, n in tokenizers.items()))
    ).alias("_t")
    return docs.select(
        F.lit(op).alias("op"), F.lit(seq).alias("seq"), "doc_id", "source", "lang", each,
    ).select("op", "seq", "doc_id", "source", "lang", "_t.tokenizer", "_t.n_tokens")
