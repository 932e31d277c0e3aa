"""A streaming source that follows CSV files which grow.

Spark's file source reads a file once, when it first sees it; rows appended later are lost. Here the offset of
a stream is the byte reached in each file, so a trigger reads what was appended since the last one, and ends
after the last whole line: a line that is still being written waits for the next trigger.

Each file begins with a header line, which may order the columns differently from file to file. Fields may be
quoted, but hold no line breaks. Files only grow: one that became shorter than what was read of it, or went
away, ends the stream with an error.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.csv as pcsv
import pyarrow.fs as pfs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

FORMAT = "growing_csv"
#: Bytes of a file that one task reads; lines belong to the task in whose bytes they begin.
SPLIT = 64 << 20
_BLOCK = 1 << 20


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    spark.dataSource.register(GrowingCsv)


class Piece(InputPartition):
    """Bytes start to end of a file, of which a trigger reads low to high."""

    def __init__(self, path: str, start: int, end: int, low: int, high: int):
        super().__init__(None)
        self.path, self.start, self.end, self.low, self.high = path, start, end, low, high


def last_line_end(fs: pfs.FileSystem, path: str, low: int, size: int) -> int:
    """The place after the last line feed in bytes low to size; low where there is none."""
    with fs.open_input_file(path) as file:
        high = size
        while high > low:
            at = max(low, high - _BLOCK)
            found = file.read_at(high - at, at).rfind(b"\n")
            if found >= 0:
                return at + found + 1
            high = at
    return low


class GrowingCsv(DataSource):
    """Options: path (a folder, or a file), ending (of file names in the folder, .csv), splitBytes."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        raise ValueError("give the schema of the files with .schema(...)")

    def streamReader(self, schema: StructType) -> "GrowingReader":
        return GrowingReader(schema, dict(self.options))


class GrowingReader(DataSourceStreamReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.uri = to_arrow_schema(schema), options["path"]
        self.ending = options.get("ending", ".csv")
        self.split = int(options.get("splitBytes") or SPLIT)

    def _place(self) -> tuple[pfs.FileSystem, str]:
        return pfs.FileSystem.from_uri(self.uri) if "://" in self.uri or self.uri.startswith("file:") else (pfs.LocalFileSystem(), self.uri)

    def _files(self, fs: pfs.FileSystem, path: str) -> list[pfs.FileInfo]:
        found = fs.get_file_info(path)
        if found.type == pfs.FileType.File:
            return [found]
        listed = fs.get_file_info(pfs.FileSelector(path, allow_not_found=True, recursive=True))
        return [f for f in listed if f.type == pfs.FileType.File and f.path.endswith(self.ending)]

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        fs, path = self._place()
        known = getattr(self, "_known", {})
        ends = {f.path: last_line_end(fs, f.path, min(known.get(f.path, 0), f.size), f.size) for f in self._files(fs, path)}
        self._known = {p: n for p, n in ends.items() if n}
        return {"files": json.dumps(self._known, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        before, after = json.loads(start["files"]), json.loads(end["files"])
        out = []
        for path, low in before.items():
            if after.get(path, 0) < low:
                raise ValueError(f"{path} has become shorter than the {low} bytes that were read of it")
        for path, high in after.items():
            low = before.get(path, 0)
            out += [Piece(path, at, min(at + self.split, high), low, high) for at in range(low, high, self.split)]
        return out

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        fs, _ = self._place()
        with fs.open_input_file(partition.path) as file:
            header, at = b"", 0
            while b"\n" not in header:
                block = file.read_at(_BLOCK, at)
                if not block:
                    return
                header, at = header + block, at + len(block)
            body = header.index(b"\n") + 1
            names = [str(c[0].as_py()) for c in _parsed(header[:body], None).columns]
            start = self._line_from(file, partition.start, partition.low, partition.high)
            end = self._line_from(file, partition.end, partition.low, partition.high)
            data = file.read_at(end - max(start, body), max(start, body)) if end > max(start, body) else b""
        if not data:
            return
        table = _parsed(data, names)
        have = {n.lower(): i for i, n in enumerate(table.column_names)}
        columns = []
        for field in self.schema:
            text = table.column(have[field.name.lower()]) if field.name.lower() in have else pa.nulls(len(table), pa.string())
            columns.append(text.cast(field.type))
        yield from pa.table(columns, schema=self.schema).to_batches()

    def _line_from(self, file, at: int, low: int, high: int) -> int:
        """Where the first line at or after a place begins."""
        if at in (low, high):
            return at
        while at < high:
            found = file.read_at(min(_BLOCK, high - at + 1), at - 1).find(b"\n")
            if found >= 0:
                return at + found
            at += _BLOCK
        return high

    def commit(self, end: dict) -> None:
        """Nothing to keep: Spark stores the offsets."""


def _parsed(data: bytes, names: list[str] | None) -> pa.Table:
    """Lines as text columns, empty fields as nulls; without names, under names of its own."""
    read = pcsv.ReadOptions(column_names=names, autogenerate_column_names=names is None, block_size=max(len(data) + 1, 1024))
    kinds = {n: pa.string() for n in names} if names else None
    convert = pcsv.ConvertOptions(column_types=kinds, strings_can_be_null=True, null_values=[""])
    return pcsv.read_csv(pa.BufferReader(data), read_options=read, parse_options=pcsv.ParseOptions(newlines_in_values=False), convert_options=convert)
