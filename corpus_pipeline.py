"""A training corpus from raw documents, in five stages; each is written as Parquet and read again by the next.

1. language_id keeps documents whose text has a language, and fills in `lang` where it is null (operator 10).
2. line_dedup takes lines out that an earlier document holds (operator 8); n_chars follows the text.
3. near_dedup keeps the first document of each group of near copies: five-word shingles of similarity 0.8 or more, found
   by SimHash fingerprints (operator 7) and by least shingle hashes, which reach where four bits don't.
4. decontaminate takes documents out that hold a copy of a benchmark item (operator 2).
5. sentencepiece encodes what is left and decodes it again (operator 3): the ids, and a digest of both.

All stages take null and empty texts, null ids, repeated rows and extra columns, and give an empty table for an empty
one; what each makes of them its docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm import decontam, langid, linededup, nearcopies, sentencepieces
from tallyweave.llm.common import shared_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose text is in one of the learned languages. Null, empty and letterless texts go; rows of one id and
    equal texts are judged alike, each for itself. Of two equally likely languages the first in order counts."""
    return langid.keep_identified(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without the lines of ten characters or more that a smaller doc_id holds. Null texts become empty; rows of
    one id are one document, so they keep each other's lines; a null id is larger than all others."""
    names = docs.columns
    found = linededup.dedup_lines(docs)
    return found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*names)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of the smallest doc_id of each group of near copies. Null and wordless texts are copies of one another;
    rows of the smallest id all stay; a null id stays where no other id is in its group."""
    return nearcopies.keep_first(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows without a copy of a benchmark item. Null and empty texts stay; rows of one id go together, those with a
    null id as well."""
    return decontam.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row of each row: doc_id, the ids of its pieces, and what decoding them gives. Null texts count as empty."""
    return sentencepieces.digests(docs, sentencepieces.Pieces.load())


STAGES = [(f.__name__, f) for f in (language_id, line_dedup, near_dedup, decontaminate, sentencepiece)]

#: No SQL: a fitted classifier, XXH64 fingerprints and alignments are beyond it. tests/llm/test_pipeline.py holds the
#: stages and the run against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
