"""``format("folio")``: reads a folder of PDF files as their records, writes a column of file bytes as files.

Reading makes a partition of every file group and takes filters on ``rec`` and ``doc_id`` (where Spark's setting
``spark.sql.python.filterPushdown.enabled`` is on). Paths are those of a file system that every node mounts; for
stores that only Spark reads, use ``sources.pdf.read_files`` with ``parse``. Writing renames finished files into place.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, EqualTo, In, InputPartition, WriterCommitMessage

from ..cos.objects import FolioError
from . import pdf


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class Written(WriterCommitMessage):
    def __init__(self, files: list[tuple[str, str]]):
        self.files = files


def _local(path: str) -> str:
    return path.removeprefix("file://")


def _listed(path: str) -> list[str]:
    p = Path(_local(path))
    return sorted(str(x) for x in p.rglob("*.pdf")) if p.is_dir() else [str(p)]


class FolioDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "folio"

    def schema(self) -> str:
        return pdf.RECORD

    def reader(self, schema) -> DataSourceReader:
        return Reader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return StreamReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return Writer(self.options, overwrite)


def _rows(paths: list[str], options: dict, only: set[str] | None) -> Iterator:
    keep = tuple(x for x in options.get("keep", "value").split(",") if x)
    for path in paths:
        try:
            content = Path(path).read_bytes()
            rows = pdf.read_document(content, lambda d: list(pdf.records(path, d, options.get("streams") == "true", keep)), options.get("password"), path)  # noqa: B023
        except OSError as x:
            rows = [pdf.failed(path, FolioError("io", str(x)))]
        except FolioError as x:
            if options.get("mode") == "strict":
                raise
            rows = [pdf.failed(path, x)]
        rows = [r for r in rows if only is None or r["rec"] in only]
        for at in range(0, len(rows), 10_000):
            yield pdf.to_batch(rows[at : at + 10_000])


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = dict(options)
        self.only: set[str] | None = None
        self.ids: set[str] | None = None

    def pushFilters(self, filters):
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is None or f.attribute not in (("rec",), ("doc_id",)):
                yield f
            elif f.attribute == ("rec",):
                self.only = values if self.only is None else self.only & values
            else:
                self.ids = values if self.ids is None else self.ids & values

    def partitions(self) -> list[Files]:
        paths = [p for p in _listed(self.options["path"]) if self.ids is None or p in self.ids]
        step = max(1, int(self.options.get("filesperpartition", 16)))
        return [Files(paths[i : i + step]) for i in range(0, len(paths), step)]

    def read(self, partition: Files) -> Iterator:
        return _rows(partition.paths, self.options, self.only)


class StreamReader(DataSourceStreamReader):
    """New files in a folder; the offset is the time at which the last one read came to be there (not its date, which a copy may keep), and its name."""

    def __init__(self, options: dict):
        self.options = dict(options)

    def initialOffset(self) -> dict:
        return {"upto": ""}

    def _keys(self) -> list[tuple[str, str]]:
        return sorted((f"{os.stat(p).st_ctime_ns:020d}|{p}", p) for p in _listed(self.options["path"]))

    def latestOffset(self) -> dict:
        keys = self._keys()
        return {"upto": keys[-1][0] if keys else ""}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        paths = [p for k, p in self._keys() if start["upto"] < k <= end["upto"]]
        return [Files(paths[i : i + 16]) for i in range(0, len(paths), 16)]

    def read(self, partition: Files) -> Iterator:
        return _rows(partition.paths, self.options, None)

    def commit(self, end: dict) -> None:
        pass


class Writer(DataSourceWriter):
    """Rows of ``path`` (relative) and ``content``: one file each."""

    def __init__(self, options: dict, overwrite: bool):
        self.options, self.overwrite = dict(options), overwrite

    def write(self, rows: Iterator) -> Written:
        top, done = Path(_local(self.options["path"])), []
        for r in rows:
            target = top / r["path"]
            target.parent.mkdir(parents=True, exist_ok=True)
            temp = target.with_name(f".{target.name}.{os.getpid()}.part")
            temp.write_bytes(bytes(r["content"]))
            done.append((str(temp), str(target)))
        return Written(done)

    def commit(self, messages: list) -> None:
        files = [f for m in messages if m is not None for f in m.files]
        targets = [t for _, t in files]
        if len(set(targets)) != len(targets):
            self.abort(messages)
            raise FolioError("io", "two rows have the same output path")
        for temp, target in files:
            os.replace(temp, target)

    def abort(self, messages: list) -> None:
        for m in messages:
            for temp, _ in m.files if m is not None else []:
                Path(temp).unlink(missing_ok=True)
