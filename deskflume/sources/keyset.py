"""Crawls of outside databases by key: pages of rows behind the last key that was read.

A Spark data source over any DB-API module. Batch and stream plan pages on the driver, which asks for the
last key of each page only; tasks read the pages, each with a connection of its own, in key order. A
stream's offset is a key: a batch that failed is read again with the same bounds, and a stopped stream goes on behind the
last whole batch, so no row is lost or read twice, as long as new rows get higher keys.

Options: target (what the module connects to), table, key, page (rows a page, 1000), most (rows that
one crawl may have; more is an error, as a cut crawl would look complete), module (sqlite3), mark (?).
The schema names the columns. Rows whose key is null are never read; an empty table gives no rows.
"""

from __future__ import annotations

import importlib
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition


class OverCap(ValueError):
    """The table has more rows than a crawl may take."""


class Page(InputPartition):
    def __init__(self, after, upto):
        self.after, self.upto = after, upto


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class _Crawl:
    def __init__(self, options: dict, schema):
        self.options, self.columns = dict(options), list(schema.fieldNames())
        self.page, self.most = int(options.get("page", 1000)), int(options.get("most", 20_000))

    def rows(self, statement: str, values: tuple) -> list[tuple]:
        connection = importlib.import_module(self.options.get("module", "sqlite3")).connect(self.options["target"])
        try:
            cursor = connection.cursor()
            cursor.execute(statement.replace("?", self.options.get("mark", "?")), values)
            return cursor.fetchall()
        finally:
            connection.close()

    def _select(self, what: str, after, upto=None) -> tuple[str, tuple]:
        key = _quoted(self.options["key"])
        bounds = [(f"{key} > ?", after), (f"{key} <= ?", upto)]
        where = [f"{key} IS NOT NULL", *[text for text, v in bounds if v is not None]]
        return f"SELECT {what} FROM {_quoted(self.options['table'])} WHERE {' AND '.join(where)}", tuple(v for _, v in bounds if v is not None)

    def last(self):
        statement, values = self._select(f"max({_quoted(self.options['key'])})", None)
        return self.rows(statement, values)[0][0]

    def pages(self, after, upto) -> list[Page]:
        """Pages from behind ``after`` to ``upto``."""
        if upto is None:
            return []
        statement, values = self._select("count(*)", after, upto)
        n = self.rows(statement, values)[0][0]
        if n > self.most:
            raise OverCap(f"{n} rows where {self.most} are allowed")
        key, pages = _quoted(self.options["key"]), []
        while True:
            statement, values = self._select(key, after, upto)
            end = self.rows(f"{statement} ORDER BY {key} LIMIT 1 OFFSET {self.page - 1}", values)
            if not end:
                return [*pages, Page(after, upto)]
            pages.append(Page(after, end[0][0]))
            after = end[0][0]
            if after == upto:
                return pages

    def read(self, page: Page) -> Iterator[tuple]:
        statement, values = self._select(", ".join(map(_quoted, self.columns)), page.after, page.upto)
        yield from self.rows(f"{statement} ORDER BY {_quoted(self.options['key'])}", values)


class _Batch(DataSourceReader):
    def __init__(self, crawl: _Crawl):
        self.crawl = crawl

    def partitions(self):
        return self.crawl.pages(None, self.crawl.last()) or [Page(None, None)]

    def read(self, partition):
        if partition.upto is not None:
            yield from self.crawl.read(partition)


class _Stream(DataSourceStreamReader):
    def __init__(self, crawl: _Crawl):
        self.crawl = crawl

    def initialOffset(self):
        return {"key": None}

    def latestOffset(self):
        return {"key": self.crawl.last()}

    def partitions(self, start, end):
        return self.crawl.pages(start["key"], end["key"])

    def read(self, partition):
        yield from self.crawl.read(partition)

    def commit(self, end):
        pass


class KeysetSource(DataSource):
    """Format ``keyset``."""

    @classmethod
    def name(cls):
        return "keyset"

    def reader(self, schema):
        return _Batch(_Crawl(self.options, schema))

    def streamReader(self, schema):
        return _Stream(_Crawl(self.options, schema))
