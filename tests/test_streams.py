"""Streams give the rows of their batch twins, also over several runs."""

from __future__ import annotations

import datetime as dt
import hashlib
import itertools
import json
import os

import pytest
from pyspark.sql import functions as F

from tallyweave.operators import pending
from tallyweave.operators.ledger import merge
from tallyweave.sources import feeds
from tallyweave.streaming import authorisations, ingest
from tallyweave.streaming.slices import Slices

AUTHS = "auth_id string, txn_id string, kind string, seen date"


def auths(spark, rows):
    return spark.createDataFrame([(a, t, k, dt.date.fromisoformat(d)) for a, t, k, d in rows], AUTHS)


ROWS = [
    ("a", "p1", "pending", "2026-01-02"), ("b", "p2", "pending", "2026-01-01"), ("b", "p3", "pending", "2026-01-03"),
    ("a", "s1", "settled", "2026-03-01"), ("c", "s2", "settled", "2026-01-01"), ("a", "p0", "pending", "2026-01-01"),
    ("d", "p4", "pending", "2026-02-14"), ("e", "p5", "pending", "2026-02-15"), ("e", "p5", "pending", "2026-02-15"),
]


@pytest.mark.parametrize("order", list(itertools.permutations(range(3)))[::2])
def test_pending_state_over_runs_in_any_order_equals_the_batch(spark, tmp_path, order):
    """Settlements far behind the watermark meet the state that was kept, and a tag of the timer goes again."""
    inbox, out, at = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "checkpoint")
    parts = [ROWS[:3], ROWS[3:6], ROWS[6:]]
    for k in order:
        ingest.landed(auths(spark, parts[k]), 1, inbox)
        stream = ingest.folder_stream(spark, inbox, AUTHS)
        changed = ingest.drain(authorisations.changes(stream), checkpoint=at, out=out)
    found = {r["auth_id"]: tuple(r)[1:] for r in authorisations.latest(changed).collect()}
    names = ["pending_txn_id", "settled_txn_id", "ambiguous", "first_seen", "outcome"]
    whole = pending.resolve(auths(spark, ROWS))
    old = {r["auth_id"] for r in pending.stale(whole, "2026-03-01").collect()}
    assert old == {"b", "d"}
    assert found == {r["auth_id"]: (*(r[c] for c in names), r["auth_id"] in old) for r in whole.collect()}


def test_a_run_without_news_changes_nothing(spark, tmp_path):
    inbox, out, at = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "checkpoint")
    ingest.landed(auths(spark, ROWS), 1, inbox)
    n = [ingest.drain(authorisations.changes(ingest.folder_stream(spark, inbox, AUTHS)), checkpoint=at, out=out).count() for _ in range(2)]
    assert n[0] == n[1] > 0
    ingest.landed(auths(spark, ROWS[:2]), 1, inbox)  # the same rows once more
    assert ingest.drain(authorisations.changes(ingest.folder_stream(spark, inbox, AUTHS)), checkpoint=at, out=out).count() == n[0]


TABLE = "k int, v string, slice string"
newest = lambda old, new: merge(old, new, ["k"], {"v": "new"}, [F.asc("v")])


def files(root: str) -> dict[str, str]:
    return {
        os.path.join(d, n): hashlib.sha256(open(os.path.join(d, n), "rb").read()).hexdigest()
        for d, _, names in os.walk(root) for n in names if n.startswith("part-")
    }


def held(table) -> set[tuple]:
    rows = [tuple(r) for r in table.rows().collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_only_touched_slices_are_written(spark, tmp_path):
    table = Slices(spark, str(tmp_path / "table"), TABLE, "slice")
    assert table.rows().count() == 0
    frame = lambda rows: spark.createDataFrame(rows, TABLE)
    assert table.merge("one", frame([(1, "a", "x"), (2, "a", "y"), (3, "a", "z"), (4, "a", None)]), newest)
    before, first = files(str(tmp_path)), table.manifest()
    assert table.merge("two", frame([(2, "b", "y"), (5, "b", "z")]), newest)
    after, second = files(str(tmp_path)), table.manifest()
    assert all(after[p] == digest for p, digest in before.items())  # what was there is there byte for byte
    same = [s for s in first["slices"] if first["slices"][s] == second["slices"][s]]
    assert sorted(same) == ["None", "x"] and all("slice=y" in p or "slice=z" in p for p in set(after) - set(before))
    assert held(table) == {(1, "a", "x"), (2, "b", "y"), (3, "a", "z"), (5, "b", "z"), (4, "a", None)}
    assert not table.merge("two", frame([(9, "c", "x")]), newest)  # sent again
    assert table.merge("three", frame([(4, "c", None)]), newest) and (4, "c", None) in held(table) and len(held(table)) == 5


def test_odd_names_of_slices(spark, tmp_path):
    table = Slices(spark, str(tmp_path / "table"), TABLE, "slice")
    odd = ["a/b", "", "50%", "x=1", "é ü", "None", None, "a:b"]
    for letter in "pq":
        table.merge(letter, spark.createDataFrame([(k, letter, s) for k, s in enumerate(odd)], TABLE), newest)
    assert held(table) == {(k, "q", s) for k, s in enumerate(odd)}


def test_of_two_writers_one_starts_again(spark, tmp_path):
    mine, other = (Slices(spark, str(tmp_path / "table"), TABLE, "slice") for _ in range(2))
    frame = lambda rows: spark.createDataFrame(rows, TABLE)
    mine.merge("one", frame([(1, "a", "x")]), newest)
    calls = []

    def slow(old, new):
        if not calls:
            other.merge("theirs", frame([(2, "b", "x")]), newest)
        calls.append(1)
        return newest(old, new)

    assert mine.merge("mine", frame([(1, "c", "x")]), slow) and len(calls) == 2
    assert held(mine) == {(1, "c", "x"), (2, "b", "x")} and mine.manifest()["number"] == 3


def test_batches_of_a_stream_merge_once(spark, tmp_path):
    table, inbox = Slices(spark, str(tmp_path / "table"), TABLE, "slice"), str(tmp_path / "in")
    added = lambda old, new: old.unionByName(new)
    for part in ([(1, "a", "x"), (2, "a", "x")], [(2, "c", "x"), (3, "d", "y")]):
        ingest.landed(spark.createDataFrame(part, TABLE), 1, inbox)
        ingest.drain(ingest.folder_stream(spark, inbox, TABLE), batch=table.batches("s", added), checkpoint=str(tmp_path / "checkpoint"))
    assert len(held(table)) == 4
    table.batches("s", added)(spark.createDataFrame([(7, "q", "x")], TABLE), 1)  # the last batch once more, by a restart
    assert len(held(table)) == 4


def test_sources_fail_by_themselves(spark, tmp_path):
    fine = ingest.landed(spark.createDataFrame([(k,) for k in range(7)], "k long"), 3, str(tmp_path / "fine"))
    bad = lambda: ingest.folder_stream(spark, fine).select(F.raise_error(F.lit("broken")).cast("long").alias("k"))
    sources = {"fine": lambda: ingest.folder_stream(spark, fine), "bad": bad, "lost": lambda: ingest.folder_stream(spark, str(tmp_path / "no"))}
    at = str(tmp_path / "checkpoints")
    outcomes, rows = ingest.each_source(spark, sources, at)
    found = dict(map(tuple, outcomes.collect()))
    assert found == {"fine": "ok:7", "bad": "error:StreamingQueryException", "lost": "error:AnalysisException"}
    assert rows.keys() == {"fine"} and sorted(r["k"] for r in rows["fine"].collect()) == list(range(7))
    ingest.landed(spark.createDataFrame([(9,)], "k long"), 1, fine)
    outcomes, rows = ingest.each_source(spark, {"fine": sources["fine"]}, at)
    assert [tuple(r) for r in outcomes.collect()] == [("fine", "ok:1")] and [r["k"] for r in rows["fine"].collect()] == [9]
    assert [tuple(r) for r in ingest.each_source(spark, {"fine": sources["fine"]}, at)[0].collect()] == [("fine", "ok:0")]


def test_mail_over_two_runs(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    page = lambda n, day, subject="s": json.dumps({"id": f"m{n}", "subject": subject, "receivedDateTime": f"2026-01-0{day}T00:00:00Z"})
    (inbox / "1.txt").write_text("\n".join([page(1, 1), page(2, 1), "{broken", "", '["no", "object"]', page(1, 2, "new")]))
    mail = feeds.MailStream(str(tmp_path / "mail"))
    mail.take(spark, str(inbox))
    (inbox / "2.txt").write_text("\n".join([page(2, 1), page(3, 3), "cut off {", '{"id": "m4", "@removed": {"reason": "deleted"}}']))
    mail.take(spark, str(inbox))
    mail.take(spark, str(inbox))
    assert {(r["msg_id"], r["subject"], r["received_at"].day) for r in mail.messages(spark).collect()} == {("m1", "new", 2), ("m2", "s", 1), ("m3", "s", 3)}
    assert mail.messages(spark).count() == 3
    lines = sorted(r["line"] for r in mail.corrupt(spark).collect())
    assert "{broken" in lines and "cut off {" in lines and len(lines) <= 3


def test_discovery_refuses_by_size_and_rows(spark, tmp_path):
    folder = str(tmp_path / "cards")
    base = spark.createDataFrame([(f"t{k}", "amex", "SHOP, 'A' \"B\"", dt.date(2026, 1, 1 + k), 1.5) for k in range(4)],
                                 "txn_id string, account string, description_raw string, booking_date date, amount double")
    rows = feeds.as_card_rows(base)
    feeds.land_csv(rows, folder, "b.csv")
    feeds.land_csv(rows.limit(2), folder, "a.csv")
    feeds.land_csv(rows.withColumn("Address", F.repeat(F.lit("x"), 5000)), folder, "c.csv")
    (tmp_path / "cards" / "notes.txt").write_text("no feed")
    (tmp_path / "cards" / "d.csv").write_text("not,a,card,feed\n" + "1,2,3,4\n" * 5000)  # too large, so its header isn't looked at
    found = [(r["name"], r["n_rows"], r["refused"]) for r in feeds.discover(spark, folder, 4000, 3).collect()]
    assert found == [("a.csv", 2, None), ("b.csv", 4, "too many rows"), ("c.csv", None, "too large"), ("d.csv", None, "too large")]
    accepted = feeds.read_accepted(spark, folder, 4000, 3)
    assert accepted.count() == 2 and feeds.parse_card(accepted).where("amount = 1.50").count() == 2


def test_discovery_can_count_the_rows_of_large_files(spark, tmp_path):
    folder = str(tmp_path / "cards")
    base = spark.createDataFrame([(f"t{k}", "amex", "SHOP\nNEXT \"B\"", dt.date(2026, 1, 1 + k), 1.5) for k in range(4)],
                                 "txn_id string, account string, description_raw string, booking_date date, amount double")
    rows = feeds.as_card_rows(base)
    feeds.land_csv(rows.limit(2), folder, "a.csv")
    feeds.land_csv(rows.limit(3).withColumn("Address", F.repeat(F.lit("x"), 5000)), folder, "b.csv")
    feeds.land_csv(rows.withColumn("Address", F.repeat(F.lit("x"), 5000)), folder, "c.csv")
    (tmp_path / "cards" / "d.csv").write_text("not,a,card,feed\n" + "1,2,3,4\n" * 5000)
    found = [(r["name"], r["n_rows"], r["refused"]) for r in feeds.discover(spark, folder, 4000, 3, count_large=True).collect()]
    assert found == [("a.csv", 2, None), ("b.csv", None, "too large"), ("c.csv", 4, "too many rows"), ("d.csv", 5000, "too many rows")]
    accepted = feeds.read_accepted(spark, folder, 4000, 3)
    assert accepted.count() == 2
