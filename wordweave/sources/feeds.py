"""Saved feeds as a data source, for batches and for streams.

`spark.dataSource.register(SavedFeeds)`, then `spark.read.format("saved_feeds").load(path)` or
`spark.readStream.format("saved_feeds")`: rows (feed, pos, title) of a folder of saved bodies,
one file a feed, named after it. The first title is the feed's own and is left out; a body that
can't be read or has no titles has no rows. Files are dealt over `partitions`, and each is read
by the task that has it, so the folder has to be one that all workers see. A stream takes the
files whose names come after the last one it took, so names should grow, as those do that begin
with a time.
"""

from __future__ import annotations

import html
import os
import re
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

TITLE = re.compile("<title>(.*?)</title>", re.S)
TAG = re.compile("<[^>]+>")
ENTITY = re.compile(r"&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});")


def titles(body: str) -> list[str]:
    """Texts of the titles after the first one, without tags, entities once each as characters."""
    return [ENTITY.sub(lambda m: html.unescape(m.group()), TAG.sub("", t)) for t in TITLE.findall(body)[1:]]


class Files(InputPartition):
    """Some files of a folder."""

    def __init__(self, path: str, names: list[str]) -> None:
        super().__init__(tuple(names))
        self.path, self.names = path, names

    def rows(self) -> Iterator[tuple[str, int, str]]:
        for name in self.names:
            try:
                with open(os.path.join(self.path, name), encoding="utf-8", errors="replace") as f:
                    body = f.read()
            except OSError:
                continue
            for pos, title in enumerate(titles(body), 1):
                yield name.rsplit(".", 1)[0], pos, title


def _listed(path: str) -> list[str]:
    try:
        return sorted(n for n in os.listdir(path) if not n.startswith((".", "_")))
    except OSError:
        return []


def _dealt(path: str, names: list[str], n: int) -> list[InputPartition]:
    return [Files(path, names[i::n]) for i in range(min(n, len(names)))] or [Files(path, [])]


class _Batch(DataSourceReader):
    def __init__(self, path: str, n: int) -> None:
        self.path, self.n = path, n

    def partitions(self) -> list[InputPartition]:
        return _dealt(self.path, _listed(self.path), self.n)

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return partition.rows()


class _Stream(DataSourceStreamReader):
    """An offset is the name of the last file taken."""

    def __init__(self, path: str, n: int) -> None:
        self.path, self.n = path, n

    def initialOffset(self) -> dict:
        return {"last": ""}

    def latestOffset(self) -> dict:
        return {"last": max(_listed(self.path), default="")}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return _dealt(self.path, [n for n in _listed(self.path) if start["last"] < n <= end["last"]], self.n)

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return partition.rows()

    def commit(self, end: dict) -> None:
        pass


class SavedFeeds(DataSource):
    """Options: path, partitions (8)."""

    @classmethod
    def name(cls) -> str:
        return "saved_feeds"

    def schema(self) -> str:
        return "feed string, pos int, title string"

    def _of(self) -> tuple[str, int]:
        path = re.sub("^file:/+", "/", self.options["path"])
        return path, int(self.options.get("partitions", "8"))

    def reader(self, schema) -> DataSourceReader:
        return _Batch(*self._of())

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(*self._of())
