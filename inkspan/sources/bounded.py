"""Text files read up to a limit: a file, or a collection of files, that is longer is told so without being held."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.workers import importable
from .texts import MOST_CHARS

SCHEMA = "collection string, path string, text string, n_chars long, reason string"


class Collection(InputPartition):
    """The files of one collection, in order, which one task reads."""

    def __init__(self, name: str, paths: tuple[str, ...]):
        self.name, self.paths = name, paths


class BoundedReader(DataSourceReader):
    def __init__(self, options):
        self.collections = [tuple(line.split("\t")) for line in options["collections"].split("\n") if line]
        self.most = int(options.get("most_chars", MOST_CHARS))

    def partitions(self) -> list[Collection]:
        return [Collection(name, tuple(paths)) for name, *paths in self.collections]

    def read(self, partition: Collection) -> Iterator[tuple]:
        from pyarrow import fs

        left = self.most
        for path in partition.paths:
            if left < 0:
                yield partition.name, path, None, None, "collection too long"
                continue
            where = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
            try:
                # A character has four bytes at most, so no more bytes than that are held
                with where[0].open_input_stream(where[1]) as stream:
                    data = stream.read(4 * (self.most + 1))
                    whole = len(data) < 4 * (self.most + 1)
                text = data.decode() if whole else data.decode(errors="ignore")
            except FileNotFoundError:
                yield partition.name, path, None, None, "missing"
                continue
            except UnicodeDecodeError:
                yield partition.name, path, None, None, "not UTF-8"
                continue
            if not whole or len(text) > self.most:
                yield partition.name, path, None, None, "too long"
                left = -1
                continue
            left -= len(text)
            yield (partition.name, path, None, len(text), "collection too long") if left < 0 else (partition.name, path, text, len(text), None)


class BoundedText(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bounded_text"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BoundedReader:
        return BoundedReader(self.options)


def bounded_texts(spark: SparkSession, collections: dict[str, list[str]], most_chars: int = MOST_CHARS) -> DataFrame:
    """(collection, path, text, n_chars, reason) of the files of each collection, read by one task each and in order.

    A file of more characters than ``most_chars`` is read to the limit and refused (too long), and so are the files from which on a
    collection's characters sum up to more, before the next is opened. Files that are missing or no UTF-8 are told so. Refused files have
    no text. File names may hold no tab and no line end.
    """
    if any("\t" in x or "\n" in x for name, paths in collections.items() for x in (name, *paths)):
        raise ValueError("names of collections and files may hold no tab and no line end")
    importable(spark)
    spark.dataSource.register(BoundedText)
    listed = "\n".join("\t".join((name, *paths)) for name, paths in collections.items())
    return spark.read.format("bounded_text").option("collections", listed).option("most_chars", most_chars).load()
