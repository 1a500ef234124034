"""The paged source gives the rows of all pages, a partition a balance."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tallyweave.sources import feeds
from tallyweave.sources.paged import PagedStatements


def land(folder, balances: dict[tuple[str, str], list[dict]], size: int = 3) -> str:
    profiles: dict = {}
    for profile, balance in balances:
        profiles.setdefault(profile, []).append(balance)
    (folder / "profiles").write_text(json.dumps({"profiles": [{"id": p, "balances": b} for p, b in profiles.items()]}))
    for (profile, balance), rows in balances.items():
        for at in range(0, max(1, len(rows)), size):
            more = at + size if at + size < len(rows) else None
            (folder / f"statement-{profile}-{balance}-{at}").write_text(json.dumps({"transactions": rows[at : at + size], "next": more}))
    return folder.as_uri()


def line(k: int) -> dict:
    return {"referenceNumber": f"r{k}", "date": f"2026-01-{k % 28 + 1:02}T10:00:00Z", "amount": {"value": f"{k}.50", "currency": "GBP"},
            "details": {"description": f"Shop {k}"}}


def test_pages_in_partitions_as_the_plain_lines(spark, tmp_path):
    balances = {("p1", "gbp"): [line(k) for k in range(10)], ("p1", "usd"): [], ("p2", "gbp"): [line(k) for k in range(20, 24)]}
    spark.dataSource.register(PagedStatements)
    read = spark.read.format("paged_statements").option("root", land(tmp_path, balances))
    df = read.load()
    assert df.rdd.getNumPartitions() == 3
    plain = spark.createDataFrame([(json.dumps(x),) for rows in balances.values() for x in rows], "value string")
    rows = lambda x: sorted(map(tuple, feeds.parse_wise(x).collect()), key=str)
    assert rows(df) == rows(plain) and df.count() == 14
    assert {(r["profile"], r["balance"], r["start"]) for r in df.collect()} == {("p1", "gbp", s) for s in (0, 3, 6, 9)} | {("p2", "gbp", 0), ("p2", "gbp", 3)}
    since = read.option("since", "2026-01-09").load()
    assert rows(since) == rows(plain.where(F.get_json_object("value", "$.date") >= "2026-01-09")) and 0 < since.count() < 14


def test_pages_that_come_again_are_an_error(spark, tmp_path):
    root = land(tmp_path, {("p", "b"): [line(k) for k in range(5)]})
    (tmp_path / "statement-p-b-3").write_text(json.dumps({"transactions": [], "next": 0}))
    spark.dataSource.register(PagedStatements)
    with pytest.raises(Exception, match="comes again"):
        spark.read.format("paged_statements").option("root", root).load().collect()
