"""Search platforms as a Python data source: one partition for each query, paging inside it, transport injectable.

``transport`` is the dotted name of a function (query, cursor) -> (items, next cursor or None); tests and offline runs use
recorded pages. Ranks count from 1 over all pages; an item that repeats a key within a run is left out.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "platform string, query_id string, rank int, title string, doi string, url string, raw_id string, extra string"


def item_key(item: dict) -> str:
    """What tells items of a run apart: id, else DOI, else title."""
    return str(item.get("id") or item.get("doi") or item.get("title") or "")


class SearchReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.platform, self.most = options["platform"], int(options.get("k", 25))
        self.queries = json.loads(options["queries"])
        self.transport = options["transport"]

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(q) for q in self.queries]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        module, _, name = self.transport.rpartition(".")
        fetch = getattr(importlib.import_module(module), name)
        query, cursor, seen, rank = partition.value, None, set(), 0
        while rank < self.most:
            items, cursor = fetch(query, cursor)
            fresh = [i for i in items if item_key(i) not in seen]
            for item in fresh[: self.most - rank]:
                seen.add(item_key(item))
                rank += 1
                yield (self.platform, query["query_id"], rank, item.get("title"), item.get("doi"), item.get("url"), None if item.get("id") is None else str(item["id"]), json.dumps({self.platform: item}))
            if cursor is None or not fresh:
                return


class SearchSource(DataSource):
    """``spark.read.format("search")`` with options platform, queries (JSON), transport and k."""

    @classmethod
    def name(cls) -> str:
        return "search"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> SearchReader:
        return SearchReader(self.options)
