"""A table in slices that batches merge into: only touched slices are written anew.

The rows of a slice (of one value of a column, such as a month) lie in a folder of their own. A manifest, one numbered
file for each commit, says which folder holds each slice and which batch made it. A commit writes the slices that its
batch touches to new folders and then takes the next number: a file under another name that is renamed, which never
replaces, so of several writers one gets the number and the others start again. Readers see whole commits. A batch that
comes again finds its name in the manifest and does nothing.

Renaming without replacing is what HDFS gives; on object stores without it, and for several processes on a plain local
file system, the number isn't safe, and writers must take turns.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from urllib.parse import unquote

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.operators.store import written

#: Names of this many batches are kept in a manifest: a stream only ever sends its last one again.
REMEMBERED = 100


def _value(folder: str) -> str:
    """The slice that Spark's folder stands for: signs are written as hex, and '' under a name of its own."""
    value = unquote(folder.removeprefix("_slice="))
    return "" if value == "__HIVE_DEFAULT_PARTITION__" else value


class Slices:
    def __init__(self, spark: SparkSession, path: str, schema: str, by: str) -> None:
        self.spark, self.path, self.schema, self.by = spark, path.rstrip("/"), schema, by

    def _file_system(self, path: str) -> tuple:
        found = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return found.getFileSystem(self.spark._jsc.hadoopConfiguration()), found

    def manifest(self) -> dict:
        """Of the last commit: number, slices (name to folder), batches. Number 0 has none."""
        fs, folder = self._file_system(f"{self.path}/manifests")
        numbers = [int(n) for x in fs.listStatus(folder) if (n := x.getPath().getName()).isdigit()] if fs.exists(folder) else []
        if not numbers:
            return {"number": 0, "slices": {}, "batches": []}
        return json.loads(self.spark.read.text(f"{folder}/{max(numbers):08d}", wholetext=True).first()[0])

    def _publish(self, entry: dict) -> bool:
        """Take the entry's number, unless it is taken. The number before it is kept for readers, older ones go."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        fs, draft = self._file_system(f"{self.path}/manifests/draft-{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf)
        options = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        place = lambda n: jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifests/{n:08d}")
        try:
            files.rename(draft, place(entry["number"]), options)
        except Py4JJavaError as error:
            fs.delete(draft, False)
            if "FileAlreadyExistsException" in str(error.java_exception):
                return False
            raise
        fs.delete(place(entry["number"] - 2), False)
        return True

    def rows(self, manifest: dict | None = None, only: set[str] | None = None) -> DataFrame:
        """The table's rows, or those of some slices."""
        slices = (manifest or self.manifest())["slices"]
        paths = [f"{self.path}/{p}" for name, p in slices.items() if only is None or name in only]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def merge(self, batch: str, rows: DataFrame, merged: Callable[[DataFrame, DataFrame], DataFrame]) -> bool:
        """Commit merged(what the touched slices hold, rows) under the batch's name; False if that is committed already.

        merged must leave rows in their slice. Slices are named by the text of the column; the names that a batch touches
        are gathered by the driver, so slices must be coarse, such as months.
        """
        touched = None
        while True:
            held = self.manifest()
            if batch in held["batches"]:
                return False
            if touched is None:
                rows = written(rows)
                touched = {r[0] for r in rows.select(F.col(self.by).cast("string")).distinct().collect()}
            attempt = f"data/{uuid.uuid4().hex}"
            out = merged(self.rows(held, {str(t) for t in touched}), rows).select(*(f.split(" ")[0] for f in self.schema.split(", ")))
            # rows of a slice go to one task each; a large slice is split by adaptive execution when it is read
            out.withColumn("_slice", F.coalesce(F.col(self.by).cast("string"), F.lit("None"))).repartition("_slice").write.partitionBy("_slice").parquet(
                f"{self.path}/{attempt}"
            )
            fs, folder = self._file_system(f"{self.path}/{attempt}")
            made = [x.getPath().getName() for x in fs.listStatus(folder) if x.getPath().getName().startswith("_slice=")]
            slices = {name: p for name, p in held["slices"].items() if name not in {str(t) for t in touched}}
            slices |= {_value(name): f"{attempt}/{name}" for name in made}
            entry = {"number": held["number"] + 1, "slices": slices, "batches": (held["batches"] + [batch])[-REMEMBERED:]}
            if self._publish(entry):
                return True
            fs.delete(folder, True)

    def batches(self, name: str, merged: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
        """A function for foreachBatch; name tells the streams that write here apart."""

        def run(rows: DataFrame, batch_id: int) -> None:
            self.merge(f"{name}-{batch_id}", rows, merged)

        return run
