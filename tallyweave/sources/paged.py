"""A bank's paged interface as a Spark data source: a partition for each profile and balance, pages read by offset.

The driver asks for the list of profiles and their balances only. Each of these is a partition, so Spark plans the
fan-out, runs it on the executors and repeats a partition that is lost. A partition holds one page at a time.

    spark.dataSource.register(PagedStatements)
    spark.read.format("paged_statements").option("root", address).option("since", "2024-01-01").load()

The interface: `root/profiles` gives {"profiles": [{"id", "balances": [..]}]}, and `root/statement-<profile>-<balance>-<offset>`
one page, {"transactions": [{..}, ..], "next": offset or null}. Addresses may be http, https or file; `since` goes along
as a query where the protocol has any, and later rows are filtered in any case.
"""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PAGES = "profile string, balance string, start int, value string"
SECONDS = 30


def fetch(address: str, query: str = "") -> dict:
    """One JSON object of the interface."""
    full = address + (f"?{query}" if query and address.startswith("http") else "")
    with urllib.request.urlopen(full, timeout=SECONDS) as answer:  # noqa: S310  the caller's own address
        return json.loads(answer.read())


@dataclass
class Balance(InputPartition):
    profile: str
    balance: str


class StatementReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root = options["root"].rstrip("/")
        self.since = options.get("since", "")

    def partitions(self) -> list[Balance]:
        profiles = fetch(f"{self.root}/profiles")["profiles"]
        return [Balance(str(p["id"]), str(b)) for p in profiles for b in p["balances"]]

    def read(self, partition: Balance) -> Iterator[tuple]:
        at, seen = 0, set()
        while at is not None:
            if at in seen:
                raise ValueError(f"page {at} of {partition.profile}/{partition.balance} comes again")
            seen.add(at)
            page = fetch(f"{self.root}/statement-{partition.profile}-{partition.balance}-{at}", f"since={self.since}" if self.since else "")
            for row in page["transactions"]:
                if str(row.get("date", "")) >= self.since:
                    yield partition.profile, partition.balance, at, json.dumps(row)
            at = page.get("next")


class PagedStatements(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_statements"

    def schema(self) -> str:
        return PAGES

    def reader(self, schema: object) -> StatementReader:
        return StatementReader(dict(self.options))
