from __future__ import annotations

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside, or return: extra columns of a user's table may well have them.
CLASHING = "score double, predicted int, n_lines long, n_dropped long, node long, root long, fp long, u long, v long, shard int, slot long, hash long, owner long, _kept long, lang_pred string, piece_ids array<int>, decoded string"
LONG = "the quick brown fox jumps over a lazy dog\n" * 5000


def odd_documents(spark):
    """Nulls, empty and very long texts, repeated rows and ids, white space alone."""
    rows = [
        (
            1, "Hello world, this is a line of text", "en", "a", 1,
        ), (2, None, "en", None, None), (3, "", None, "a", 0), (4, LONG, "en", "a", len(LONG)), (4, LONG, "en", "a", len(LONG)),
        (5, " \t\n ", "de", "b", 4), (6, "Hello world, this is a line of text", "en", "a", 1), (7, "\x00 ▁ 日本語 😀 é", "fr", "c", 9), (
            None, "Hello world, this is a line of text", "en", "a", 1,
        ), (8, "x" * 100_000, "en", "d", 1),
    ]
    df = spark.createDataFrame(rows, DOCUMENTS)
    extra = [f.strip().rsplit(" ", 1) for f in CLASHING.split(", ")]
    return df.selectExpr("*", *(f"cast(null as {kind}) as `{name}`" for name, kind in extra))


def no_documents(spark):
    return spark.createDataFrame([], DOCUMENTS)
