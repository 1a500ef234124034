"""What filters take away, in every order in which they may be applied.

The orders of n filters form a trie of prefixes. What survives a prefix doesn't depend on its order, so the trie folds
into 2^n states. They are visited depth first: a state's survivors are a persisted DataFrame, made from its parent's by
one filter, and one pass over them counts what each remaining filter removes, which gives all edges that leave the
state. A state that another order has reached before is taken from memory. Survivors are released on the way back, so
that at most n + 1 of these narrow frames are held, and only counts outlive the walk.
"""

from __future__ import annotations

import itertools
import math
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyweave.llm.common import cut

SPACE = r"[\x20\x09-\x0D]+"
LEAST_WORDS, DISTINCT_PERCENT, UPPER_PERCENT = 100, 80, 10
#: Files of a state's counts.
FILES = 4


def repeated(rows: DataFrame, digest: str = "digest", doc_id: str = "doc_id") -> DataFrame:
    """rows with `_again`: whether a smaller doc_id has the same digest. A null id is neither small nor large.

    The least id of each digest is combined before the shuffle, and rows look for their own (id, digest) among those
    first ones: a text with very many copies is no hot key.
    """
    first = rows.where(F.col(doc_id).isNotNull()).groupBy(F.col(digest).alias("_d")).agg(F.min(doc_id).alias("_first"))
    found = rows.join(first, (F.col(doc_id) == F.col("_first")) & (F.col(digest) == F.col("_d")), "left")
    return found.withColumn("_again", F.col("_first").isNull() & F.col(doc_id).isNotNull()).drop("_d", "_first")


def marks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, A, B, C, D, E, good, toxic): of every row of docs its language ('' for null), whether each filter fails it,
    and its labels. Of several labels of an id one is enough to make it good or toxic. A null text counts as empty.
    """
    text = F.coalesce("text", F.lit(""))
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    upper = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    narrow = docs.select(
        "doc_id", F.coalesce("lang", F.lit("")).alias("part"), text.alias("text"),
        F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("distinct")))[0].alias("w"),
        upper.alias("upper"),
    )
    told = narrow.select(
        "doc_id", "part", F.sha2("text", 256).alias("digest"), (F.col("w.n") < LEAST_WORDS).alias("A"),
        (F.col("w.distinct").cast("long") * 100 < F.col("w.n").cast("long") * DISTINCT_PERCENT).alias("B"),
        (F.col("upper").cast("long") * 100 > F.length("text").cast("long") * UPPER_PERCENT).alias("C"),
        F.col("text").rlike("[#$%&*|]").alias("D"),
    )
    again = repeated(told).withColumnRenamed("_again", "E")
    known = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"),
    )
    both = again.join(known, "doc_id", "left")
    return both.select("part", *"ABCDE", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")))


def edges(marked: DataFrame, filters: tuple[str, ...]) -> DataFrame:
    """(part, state, filter, n, removed, good_lost, toxic_lost): what a filter removes from the survivors of a state.

    marked: (part, a boolean column for each filter, good, toxic). A state names the filters applied so far, in order of
    their names; n is the number of its survivors. Parts that have none left have no row.
    """
    base = cut(marked.select("part", *filters, "good", "toxic"))
    counted: dict[str, DataFrame] = {}

    def visit(state: str, survivors: DataFrame) -> None:
        rest = [f for f in filters if f not in state]
        survivors = survivors.persist(StorageLevel.MEMORY_AND_DISK)
        one = lambda c: F.count_if(c)
        sums = [
            F.struct(
                F.lit(state).alias("state"), F.lit(f).alias("filter"), F.count("*").alias("n"), one(F.col(f)).alias("removed"),
                one(F.col(f) & F.col("good")).alias("good_lost"), one(F.col(f) & F.col("toxic")).alias("toxic_lost"),
            )
            for f in rest
        ]
        counted[state] = cut(survivors.groupBy("part").agg(F.array(*sums).alias("_edges")).select("part", F.inline("_edges")).coalesce(FILES))
        for f in rest:
            child = "".join(sorted(state + f))
            if child not in counted and len(child) < len(filters):
                visit(child, survivors.where(~F.col(f)))
        survivors.unpersist()

    visit("", base)
    return reduce(DataFrame.union, counted.values())


def interactions(marked: DataFrame, filters: tuple[str, ...] = tuple("ABCDE")) -> DataFrame:
    """A row for each part, order of the filters and step (from 1), as the counts of `edges` give it.

    (part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): rows of the part
    that are left after the step, that its filter removes here, that fail it but went before, that fail it alone, that
    are good or toxic among those removed here, and its removals summed over all orders.
    """
    found = edges(marked, filters)
    n = len(filters)
    states = ["".join(s) for k in range(n) for s in itertools.combinations(filters, k)]
    steps = F.array(*(F.struct(F.lit(s).alias("state"), F.lit(f).alias("filter")) for s in states for f in filters if f not in s))
    whole = found.where("state = ''").select("part").distinct().select("part", F.inline(steps))
    counts = ("n", "removed", "good_lost", "toxic_lost")
    full = whole.join(found, ["part", "state", "filter"], "left").select(
        "part", "state", "filter", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts),
    )
    of = Window.partitionBy("part", "filter")
    weight = F.element_at(F.array(*(F.lit(math.factorial(k) * math.factorial(n - 1 - k)) for k in range(n))), F.length("state") + 1)
    full = full.withColumns({
        "fails": F.sum(F.when(F.col("state") == "", F.col("removed"))).over(of),
        "unique_fails": F.sum(F.when(F.length("state") == n - 1, F.col("removed"))).over(of),
        "shapley": F.sum(F.col("removed") * weight).over(of),
    })
    orders = [
        ("".join(order), k + 1, "".join(sorted(order[:k])), order[k]) for order in itertools.permutations(filters) for k in range(n)
    ]
    table = marked.sparkSession.createDataFrame(orders, "filter_order string, step int, state string, filter string")
    return full.join(F.broadcast(table), ["state", "filter"]).select(
        "part", "filter_order", "step", (F.col("n") - F.col("removed")).alias("kept"), "removed", (F.col("fails") - F.col("removed")).alias("redundant"),
        "unique_fails", "good_lost", "toxic_lost", "shapley",
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """interactions() of five filters over docs, a part for each language.

    A: under 100 words; B: under 80 per cent of them different; C: over 10 per cent of the characters in A-Z; D: one of
    #$%&*|; E: the same text at a smaller doc_id, whether that one stays or not. Null texts are empty; a null language is
    ''; rows of one id are separate rows; a null id never fails E. An empty table has no parts, so no rows.
    """
    return interactions(marks(docs, labels))
