"""Checkpoint headers and configurations as tables."""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

HEADER_BYTES = 8 << 20


def local_headers(spark: SparkSession, root: str) -> DataFrame:
    """(model, file, content): the headers, and no more, of every *.safetensors file below ``root``."""
    return checkpoint(spark, path=root).where("kind = 'header'").select("model", "file", "content")


def local_configs(spark: SparkSession, root: str) -> DataFrame:
    """(model, config): configuration texts; what doesn't parse is an empty object."""
    return configs(checkpoint(spark, path=root))


def checkpoint(spark: SparkSession, **options: str) -> DataFrame:
    """(model, file, kind, content) of a folder (``path``) or a repository (``index``, ``files``, ``model``); see Checkpoints."""
    spark.dataSource.register(Checkpoints)
    return spark.read.format(Checkpoints.name()).options(**options).load()


def configs(found: DataFrame) -> DataFrame:
    """(model, config) of a checkpoint's rows: configuration texts; what doesn't parse is an empty object."""
    body = F.decode("content", "UTF-8")
    return found.where("kind = 'config'").select("model", F.when(F.try_parse_json(body).isNotNull(), body).otherwise("{}").alias("config"))


def scanned_headers(spark: SparkSession, root: str) -> DataFrame:
    """As local_headers(), in a store that only Spark's readers open: whole files are read and cut after the scan."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.safetensors").option("recursiveFileLookup", "true").load(root)
    path = F.col("path")
    return files.select(F.regexp_extract(path, r"([^/]+)/[^/]+$", 1).alias("model"), F.regexp_extract(path, r"([^/]+)$", 1).alias("file"), F.substring("content", 1, HEADER_BYTES).alias("content"))


def latest_bench(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of the newest bench-*.json, by name."""
    rows = spark.read.option("multiLine", True).option("pathGlobFilter", "bench-*.json").json(folder).withColumn("_file", F.input_file_name())
    newest = rows.agg(F.max("_file").alias("_file"))
    return rows.join(F.broadcast(newest), "_file").drop("_file")  # one row is broadcast


def images(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, content, w, h, tf): encoded pictures; sizes come from PNG headers, other formats have none."""
    files = spark.read.format("binaryFile").load(path)
    is_png = F.hex(F.substring("content", 1, 8)) == "89504E470D0A1A0A"

    def side(start: int) -> Column:
        return F.when(is_png, F.conv(F.hex(F.substring("content", start, 4)), 16, 10).cast("int"))

    return files.select("path", "length", "content", side(17).alias("w"), side(21).alias("h"), F.struct(F.lit(0.0).alias("ox"), F.lit(0.0).alias("oy"), F.lit(1.0).alias("sx"), F.lit(1.0).alias("sy")).alias("tf"))


def load(spark: SparkSession, path: str) -> DataFrame:
    """Pictures by path; a live screen is no table, and a path that doesn't exist is an error of the reader."""
    if path in ("-", "screen"):
        raise ValueError("a live screen cannot be read as a table")
    return images(spark, path)


class Checkpoints(DataSource):
    """Headers and configurations of checkpoints: one partition for each file, each reading what it needs alone.

    Options: ``path``, a folder in any store that pyarrow opens; or ``index``, an address that lists a repository's files
    as JSON ({"siblings": [{"rfilename": ...}]}), with ``files``, the address below which they lie, and ``model``.
    ``urls`` names files one by one instead, separated by commas. ``retries`` is how often a read that fails is tried again.
    Of a *.safetensors file its first 8 bytes are read, and then as many as they say; more than ``most`` bytes (100 MB)
    are not believed, and the row then has the 8 bytes, which the parser refuses. A file that cannot be read is an error.
    """

    @classmethod
    def name(cls) -> str:
        return "checkpoints"

    def schema(self) -> str:
        return "model string, file string, kind string, content binary"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _CheckpointReader(dict(self.options))


@dataclass
class _File(InputPartition):
    model: str
    place: str
    kind: str


class _CheckpointReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = options
        self.retries = int(options.get("retries", 3))
        self.most = int(options.get("most", 100 << 20))

    def partitions(self) -> list[InputPartition]:
        o = self.options
        if "path" in o:
            system, root = fs.FileSystem.from_uri(o["path"]) if "://" in o["path"] else (fs.LocalFileSystem(), o["path"].removeprefix("file:"))
            names = sorted(i.path for i in system.get_file_info(fs.FileSelector(root, recursive=True)) if i.is_file)
            found = [(n.split("/")[-2], n) for n in names]
        elif "urls" in o:
            found = [(o.get("model", ""), u) for u in o["urls"].split(",") if u]
        else:
            listed = json.loads(self.again(lambda: _get(o["index"])))
            found = [(o.get("model", ""), f"{o['files'].rstrip('/')}/{x['rfilename']}") for x in listed.get("siblings", [])]
        kinds = {"config.json": "config"}
        files = [_File(m, p, "header" if p.endswith(".safetensors") else kinds.get(p.rsplit("/", 1)[-1], "")) for m, p in found]
        return [f for f in files if f.kind] or [_File("", "", "")]  # Spark wants a partition

    def again(self, read: Callable[[], bytes]) -> bytes:
        for left in range(self.retries, -1, -1):
            try:
                return read()
            except OSError:
                if not left:
                    raise
                time.sleep(0.1 * 2 ** (self.retries - left))
        raise AssertionError("not reached")

    def bytes_at(self, place: str, start: int, size: int) -> bytes:
        """``size`` bytes from ``start``, or what there is of them."""
        if place.startswith(("http://", "https://")):
            return self.again(lambda: _get(place, start, size))
        system, path = fs.FileSystem.from_uri(self.options["path"]) if "://" in self.options["path"] else (fs.LocalFileSystem(), "")

        def read() -> bytes:
            with system.open_input_file(place) as f:
                return f.read_at(max(0, min(size, f.size() - start)), start)

        return self.again(read)

    def read(self, partition: _File) -> Iterator[tuple[str, str, str, bytes]]:
        if not partition.kind:
            return
        if partition.kind == "config":
            content = self.bytes_at(partition.place, 0, HEADER_BYTES)
        else:
            content = self.bytes_at(partition.place, 0, 8)
            size = int.from_bytes(content, "little")
            if len(content) == 8 and 0 < size <= self.most:
                content += self.bytes_at(partition.place, 8, size)
        yield partition.model, partition.place.rsplit("/", 1)[-1], partition.kind, content


def _get(address: str, start: int = 0, size: int | None = None) -> bytes:
    """Bytes of an address; a server that knows no ranges is read up to the end of the range and no further."""
    ranged = {} if size is None else {"Range": f"bytes={start}-{start + size - 1}"}
    with urllib.request.urlopen(urllib.request.Request(address, headers=ranged), timeout=60) as answer:
        if size is None:
            return answer.read()
        return answer.read(size) if answer.status == 206 else answer.read(start + size)[start:]
