"""A Python data source over paged JSON, one partition for every range of pages."""

from __future__ import annotations

import json
import re
import time
from pathlib import Path

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Pages(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.pages, self.split, self.tries = options["path"], int(options["pages"]), int(options.get("pagesPerPartition", "50")), int(options.get("tries", "3"))

    def partitions(self):
        return [Pages(i, min(i + self.split, self.pages)) for i in range(0, self.pages, self.split)]

    def read(self, partition):
        for n in range(partition.first, partition.last):
            for item in page(Path(self.root) / f"{n}.json", self.tries).get("items", []):
                yield str(item.get("id", "")), json.dumps(item, ensure_ascii=False)


def page(file: Path, tries: int) -> dict:
    """A stored page; an empty one where there is no file. A page that cannot be read is tried again, waiting twice as long each time, as it may be half written."""
    for i in range(tries):
        try:
            return json.loads(file.read_text(encoding="utf-8")) if file.exists() else {}
        except (OSError, ValueError):
            if i + 1 == tries:
                raise
            time.sleep(0.1 * 2**i)
    return {}


class LinkedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.first, self.tries = options["path"], options["first"], int(options.get("tries", "3"))

    def read(self, partition):
        name, seen = self.first, set()
        while name and name not in seen:
            seen.add(name)
            body = page(Path(self.root) / name, self.tries)
            for item in body.get("items", []):
                yield str(item.get("id", "")), json.dumps(item, ensure_ascii=False)
            found = re.search(r'<([^>]+)>;\s*rel="next"', body.get("link", ""))
            name = found.group(1) if found else None


class PagedJson(DataSource):
    """``spark.dataSource.register(PagedJson)``, then ``format("pagedjson")`` with path, pages and pagesPerPartition.

    Pages are files ``N.json`` with a list under ``items`` in a shared folder, as a crawler leaves
    them; fetching from a network is not part of this library.
    """

    @classmethod
    def name(cls):
        return "pagedjson"

    def schema(self):
        return "id string, item string"

    def reader(self, schema):
        return PagedReader(self.options)


class LinkedJson(DataSource):
    """``format("linkedjson")`` with path and first: stored pages that each name the next in a Link header under ``link``.

    A cursor is known only from the page before it, so one task follows the chain; a loop ends it.
    """

    @classmethod
    def name(cls):
        return "linkedjson"

    def schema(self):
        return "id string, item string"

    def reader(self, schema):
        return LinkedReader(self.options)
