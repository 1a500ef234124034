"""The opN_ queries: each operator over its whole table, cut to the columns of its contract."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm import (
    collisions, decontam, filteraudit, htmltext, langid, linededup, mpegaudio, rendezvous, sentencepieces, simhash, tokencounts, toxicity,
    turns,
)
from tallyweave.llm.common import shared_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.digests(_table(spark, sf_dir, "documents"), sentencepieces.Pieces.load())


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(_table(spark, sf_dir, "pages"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendezvous.shard(_table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after four commits: all documents are counted; words without letter and digit cease to count, which
    revises the documents that have some; further copies of a text go; and the revision is sent once more."""
    docs = _table(spark, sf_dir, "documents")
    rollup = tokencounts.Rollup(spark, shared_path(spark, "token-counts"))
    text = F.col("text")
    rollup.commit("1-load", tokencounts.counts(docs, {"words-1": tokencounts.words(text), "bytes-1": tokencounts.octets(text)}))
    changed = docs.where(tokencounts.words(text) != tokencounts.clean_words(text))
    revision = tokencounts.counts(changed, {"words-1": tokencounts.clean_words(text)}, seq=1)
    rollup.commit("2-revise", revision)
    # texts are told apart by a digest: narrow rows, and the least id of each digest is combined before the shuffle
    keyed = docs.select("doc_id", "source", "lang", F.sha2(F.coalesce(text, F.lit("")), 256).alias("digest"))
    first = keyed.groupBy("digest").agg(F.min("doc_id").alias("first_id"))
    # by id and not by digest: a text with very many copies is no hot key
    copies = keyed.join(first, F.col("doc_id") == F.col("first_id"), "left_anti")
    rollup.commit(
        "3-dedup", tokencounts.counts(copies, {"words-1": F.lit(None).cast("long"), "bytes-1": F.lit(None).cast("long")}, "delete", 2),
    )
    rollup.commit("2-revise", revision)
    return rollup.totals()


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(_table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


def op9_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpegaudio.digests(mpegaudio.to_media(_table(spark, sf_dir, "documents")))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predictions(_table(spark, sf_dir, "documents"))


def op11_collision_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collisions.neighbours(_table(spark, sf_dir, "embeddings"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.repaired(_table(spark, sf_dir, "conversations"))


QUERIES = {
    f.__name__: f for f in (
        op1_toxicity, op2_decontamination, op3_sentencepiece, op4_html_text, op5_sharding, op6_token_counts, op7_simhash, op8_line_dedup,
        op9_mpeg_audio, op10_language_id, op11_collision_search, op12_filter_audit, op13_turn_repair,
    )
}

ORACLES = {
    "op13_turn_repair": r"""
        WITH RECURSIVE bits AS (
            SELECT i, i AS c, 0 AS k FROM range(256) r(i)
            UNION ALL
            SELECT i, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8
        ), crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8), dealt AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(
                    hex(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')), '..'), lambda x: CAST('0x' || x AS BIGINT))),
                    lambda a, b: xor(a >> 8, t[xor(a % 256, b) + 1])), 4294967295) % 20 AS kind FROM conversations, crc
        ), damaged AS (
            SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE WHEN kind = 1 THEN ''
                WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END))
            FROM dealt WHERE kind <> 0
        ), placed AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, left(role, 1) AS c FROM damaged
        ), judged AS (
            SELECT *, lag(c) OVER (PARTITION BY conv_id ORDER BY i) || c AS pair, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
                WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault FROM placed
        ), told AS (
            SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
                count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
                count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv_id
        ), costed AS (
            SELECT *, fault IN ('blank', 'duplicate') AS must_go, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS e FROM judged
        ), to_go AS (
            SELECT conv_id, n AS j, [0, 10, 5, 0] AS v FROM told
            UNION ALL
            SELECT conv_id, j, [least(w[1], 5 + least(w[3], 5 + w[4])), least(w[2], 5 + least(w[3], 5 + w[4])), least(w[3], 5 + w[4]), least(w[4], 5 + w[3])]
            FROM (SELECT g.conv_id, j - 1 AS j, CASE WHEN must_go THEN list_transform(v, lambda x: x + 2) ELSE [
                    least(2 + v[1], e + 1 + v[3], CASE c WHEN 's' THEN e + v[2] WHEN 'u' THEN e + v[3] END),
                    least(2 + v[2], e + 1 + v[3], CASE c WHEN 'u' THEN e + v[3] END), least(2 + v[3], e + 1 + v[4], CASE c WHEN 'a' THEN e + v[4] END),
                    least(2 + v[4], e + 1 + v[3], CASE c WHEN 'u' THEN e + v[3] END)] END AS w
                FROM to_go g JOIN costed r ON r.conv_id IS NOT DISTINCT FROM g.conv_id AND r.i = g.j)
        ), walk AS (
            SELECT conv_id, CAST(0 AS BIGINT) AS j, 1 AS s, '' AS audit, CAST([] AS VARCHAR[]) AS turns FROM told
            UNION ALL
            SELECT conv_id, CASE WHEN letter = 'I' THEN j ELSE j + 1 END, CASE letter WHEN 'D' THEN s WHEN 'K' THEN kept ELSE wanted END, audit || letter,
                CASE letter WHEN 'D' THEN turns WHEN 'I' THEN list_append(turns, name || ':') WHEN 'K' THEN list_append(turns, role || ':' || text)
                ELSE list_append(turns, name || ':' || text) END
            FROM (SELECT *, CASE WHEN now[s] = 2 + after[s] THEN 'D' WHEN now[s] = 5 + now[wanted] THEN 'I' WHEN now[s] = e + after[kept] THEN 'K' ELSE 'R' END AS letter
                FROM (SELECT k.*, g.v AS now, h.v AS after, role, text, e, CASE WHEN k.s = 3 THEN 4 ELSE 3 END AS wanted,
                        CASE WHEN k.s = 3 THEN 'assistant' ELSE 'user' END AS name, CASE WHEN must_go THEN NULL WHEN c = 's' AND k.s = 1 THEN 2
                        WHEN c = 'u' AND k.s <> 3 THEN 3 WHEN c = 'a' AND k.s = 3 THEN 4 END AS kept
                    FROM walk k JOIN told m ON m.conv_id IS NOT DISTINCT FROM k.conv_id
                    JOIN to_go g ON g.conv_id IS NOT DISTINCT FROM k.conv_id AND g.j = k.j
                    LEFT JOIN to_go h ON h.conv_id IS NOT DISTINCT FROM k.conv_id AND h.j = k.j + 1
                    LEFT JOIN costed r ON r.conv_id IS NOT DISTINCT FROM k.conv_id AND r.i = k.j + 1
                    WHERE k.j < m.n OR g.v[k.s] > 0))
        ), ended AS (
            SELECT w.conv_id, g.v[1] AS cost, audit, sha256(array_to_string(turns, chr(10))) AS repaired_sha256
            FROM walk w JOIN told m ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND w.j = m.n AND w.s IN (1, 4)
            JOIN to_go g ON g.conv_id IS NOT DISTINCT FROM w.conv_id AND g.j = 0
        )
        SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
            coalesce(illegal, 0) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit,
            coalesce(repaired_sha256, sha256('')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN told m ON m.conv_id IS NOT DISTINCT FROM a.conv_id
        LEFT JOIN ended f ON f.conv_id IS NOT DISTINCT FROM a.conv_id""",
    "op12_filter_audit": r"""
        WITH texts AS (
            SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
                regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
        ), known AS (
            SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS bad
            FROM labels GROUP BY doc_id
        ), failed AS (
            SELECT part, len(words) < 100 AS a, 100 * len(list_distinct(words)) < 80 * len(words) AS b,
                100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d,
                coalesce(min(doc_id) OVER (PARTITION BY text) < doc_id, false) AS e, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad
            FROM texts LEFT JOIN known USING (doc_id)
        ), counted AS (
            SELECT part, concat(CASE WHEN a THEN 'A' ELSE '' END, CASE WHEN b THEN 'B' ELSE '' END, CASE WHEN c THEN 'C' ELSE '' END,
                CASE WHEN d THEN 'D' ELSE '' END, CASE WHEN e THEN 'E' ELSE '' END) AS fails, good, bad, count(*) AS n
            FROM failed GROUP BY ALL
        ), letters(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')), orders AS (
            SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
            WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
        ), steps AS (
            SELECT filter_order, CAST(step AS INTEGER) AS step, filter_order[step:step] AS f, filter_order[1:step - 1] AS before
            FROM orders, range(1, 6) r(step)
        ), told AS (
            SELECT part, filter_order, step, f,
                sum(CASE WHEN translate(fails, before, '') = fails AND NOT contains(fails, f) THEN n ELSE 0 END) AS kept,
                sum(CASE WHEN translate(fails, before, '') = fails AND contains(fails, f) THEN n ELSE 0 END) AS removed,
                sum(CASE WHEN translate(fails, before, '') <> fails AND contains(fails, f) THEN n ELSE 0 END) AS redundant,
                sum(CASE WHEN fails = f THEN n ELSE 0 END) AS unique_fails,
                sum(CASE WHEN translate(fails, before, '') = fails AND contains(fails, f) AND good = 1 THEN n ELSE 0 END) AS good_lost,
                sum(CASE WHEN translate(fails, before, '') = fails AND contains(fails, f) AND bad = 1 THEN n ELSE 0 END) AS toxic_lost
            FROM counted, steps GROUP BY ALL
        )
        SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
            CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
            CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM told""",
    "op5_sharding": """
        WITH RECURSIVE steps AS (
            SELECT i, i AS c, 0 AS k FROM range(256) r(i)
            UNION ALL
            SELECT i, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8
        ), crc AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8), sized AS (
            SELECT doc_id, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size,
                xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(coalesce(text, '')), '..'),
        lambda x: CAST('0x' || x AS BIGINT))),
                    lambda a, b: xor(a >> 8, t[xor(a % 256, b) + 1])), 4294967295) AS text_crc32
            FROM documents, crc
        ), placed AS (
            SELECT *, CAST((SELECT arg_max(s, (substr(md5(doc_id || ':' || s), 1, 13), -s)) FROM range(16) r(s)) AS INTEGER) AS shard,
                CAST((SELECT arg_max(s, (substr(md5(doc_id || ':' || s), 1, 13), -s)) FROM range(17) r(s)) AS INTEGER) AS grown_shard,
                CAST('0x' || substr(md5(doc_id || ':' || text_crc32 || ':' || size), 1, 8) AS BIGINT) % 1024 AS piece
            FROM sized
        )
        SELECT doc_id, size, text_crc32, 'key' AS law, shard,
            row_number() OVER (PARTITION BY shard ORDER BY piece, doc_id, text_crc32, size) - 1 AS slot, grown_shard FROM placed""",
    "op6_token_counts": r"""
        WITH kept AS (
            SELECT *, row_number() OVER (PARTITION BY sha256(coalesce(text, '')) ORDER BY doc_id) AS nth FROM documents
        ), counted AS (
            SELECT source, lang, 'bytes-1' AS tokenizer, coalesce(strlen(text), 0) AS n FROM kept WHERE nth = 1
            UNION ALL
            SELECT source, lang, 'words-1',
                len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: regexp_matches(w, '[\p{L}\p{N}]')))
            FROM kept WHERE nth = 1
        )
        SELECT source, lang, tokenizer, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_tokens FROM counted GROUP BY ALL""",
    "op8_line_dedup": """
        WITH lines AS (
            SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS ord
            FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
        ), keyed AS (
            SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
        ), owners AS (
            SELECT key, min(doc_id) AS owner FROM keyed WHERE length(key) >= 10
            GROUP BY key HAVING count(DISTINCT doc_id) >= 2
        )
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE owner < doc_id) AS n_dropped,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY ord) FILTER (WHERE owner IS NULL OR owner >= doc_id), '')) AS kept_sha256
        FROM keyed LEFT JOIN owners USING (key) GROUP BY doc_id""",
}
