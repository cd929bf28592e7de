"""Files as a sink: rows of (name, content) become files of a folder that is there whole or not at all."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


class Reports(DataSource):
    """Rows (name, content) as files below ``path``, a folder in any store that pyarrow opens and all executors share.

    Tasks write into a folder beside it, each file under a name of its own attempt, and tell the driver which they
    finished; the driver then renames the files of the attempts that count and moves the folder into place in one step.
    A job that fails leaves nothing. Repeated names are an error, and so is a folder that exists, unless it is overwritten.
    """

    @classmethod
    def name(cls) -> str:
        return "reports"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _ReportWriter(self.options["path"], overwrite)


@dataclass
class _Written(WriterCommitMessage):
    files: dict[str, str]  # name -> where it is for now


class _ReportWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite = path.rstrip("/"), overwrite
        self.staging = f"{self.path}.writing-{uuid.uuid4().hex}"
        # made here, by the driver: a task that still runs when the job is given up finds it gone, and doesn't make it again
        store, staging = _store(self.staging)
        store.create_dir(staging, recursive=True)

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        store, staging = _store(self.staging)
        attempt, files = uuid.uuid4().hex, {}
        for k, row in enumerate(iterator):
            if row["name"] in files:
                raise ValueError(f"two files of the name {row['name']}")
            place = f"{staging}/{attempt}-{k}"
            with store.open_output_stream(place) as out:
                out.write(bytes(row["content"]))
            files[row["name"]] = place
        return _Written(files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, staging = _store(self.staging)
        _, final = _store(self.path)
        try:
            if store.get_file_info(final).type != fs.FileType.NotFound and not self.overwrite:
                raise FileExistsError(f"{self.path} exists")
            ready, seen = f"{staging}/ready", set()
            store.create_dir(ready, recursive=True)
            for message in messages:
                for name, place in (message.files if message else {}).items():
                    if name in seen:
                        raise ValueError(f"two files of the name {name}")
                    seen.add(name)
                    store.create_dir(f"{ready}/{name}".rsplit("/", 1)[0], recursive=True)
                    store.move(place, f"{ready}/{name}")
            if store.get_file_info(final).type != fs.FileType.NotFound:
                store.delete_dir(final)
            store.move(ready, final)
        finally:
            self.abort(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, staging = _store(self.staging)
        if store.get_file_info(staging).type != fs.FileType.NotFound:
            store.delete_dir(staging)


def files_of(rows: DataFrame, name: Column, parts: dict[str, Column]) -> DataFrame:
    """(name, content): for each row a file for each ending of ``parts`` whose content (text or bytes) is not null."""
    each = F.array(*[F.struct(F.concat(name, F.lit(ending)).alias("name"), content.cast("binary").alias("content")) for ending, content in parts.items()])
    return rows.select(F.inline(each)).where("content IS NOT NULL")


def write_files(files: DataFrame, path: str, overwrite: bool = False) -> None:
    files.sparkSession.dataSource.register(Reports)
    files.select("name", "content").write.format(Reports.name()).mode("overwrite" if overwrite else "append").option("path", path).save()
