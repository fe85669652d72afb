"""A Spark data source over folders of PDF files: ``spark.read.format("vellumine_pdf")``.

Options: ``path`` (a folder or file, any file system of pyarrow's), ``relation`` (see
``vellumine.operators.pdf.SCHEMAS``), ``password``, ``firstPage``, ``lastPage``, ``filesPerPartition``,
and options of the relation (``mode``, ``policy``). With ``spark.sql.python.filterPushdown.enabled`` on,
comparisons of ``page_no`` with a number become the range of pages that is read, and equal
paths the files that are opened.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import to_arrow_schema

from vellumine.operators.pdf import ROWS, SCHEMAS, file_rows


def open_path(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return (pafs.LocalFileSystem(), path) if path.startswith("/") else pafs.FileSystem.from_uri(path)


class Files(InputPartition):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths


class PdfReader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType) -> None:
        self.options, self.schema = options, schema
        self.first, self.last = int(options.get("firstpage", 1)), int(options.get("lastpage", 0))
        self.path: str | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802 (Spark's name)
        for f in filters:
            column, value = f.attribute, f.value if hasattr(f, "value") else None
            if column == ("page_no",) and isinstance(value, int):
                if isinstance(f, EqualTo):
                    self.narrow(value, value)
                elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.narrow(value + isinstance(f, GreaterThan), 0)
                elif isinstance(f, (LessThan, LessThanOrEqual)):
                    self.narrow(1, max(0, value - isinstance(f, LessThan)) or -1)
            elif column == ("path",) and isinstance(f, EqualTo):
                self.path = value
            yield f  # Spark applies each again: a range that is too wide does no harm

    def narrow(self, first: int, last: int) -> None:
        self.first = max(self.first, first)
        if last:
            self.last = last if self.last == 0 else min(self.last, last)

    def partitions(self) -> list[Files]:
        fs, base = open_path(self.options["path"])
        info = fs.get_file_info(base)
        if info.type == pafs.FileType.File:
            found = [base]
        else:
            found = sorted(i.path for i in fs.get_file_info(pafs.FileSelector(base, recursive=True)) if i.type == pafs.FileType.File and i.path.lower().endswith(".pdf"))
        found = [p for p in found if self.path is None or p == open_path(self.path)[1]]
        n = int(self.options.get("filesperpartition", 64))
        return [Files(found[k:k + n]) for k in range(0, len(found), n)] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, _ = open_path(self.options["path"])
        arrow, held = to_arrow_schema(self.schema), []
        relation = self.options.get("relation", "text")

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in held], type=f.type) for f in arrow], schema=arrow)
            held.clear()
            return batch

        for path in partition.paths:
            with fs.open_input_file(path) as f:
                data = f.read()
            for rows in file_rows(data, relation, self.options, self.first, self.last) if self.last >= 0 else ():
                held += [{**r, "path": path} for r in rows]
                if len(held) >= ROWS:
                    yield out()
        if held:
            yield out()


class PdfSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vellumine_pdf"

    def schema(self) -> str:
        options = {k.lower(): v for k, v in self.options.items()}
        return f"path string, {SCHEMAS[options.get('relation', 'text')]}"

    def reader(self, schema: T.StructType) -> PdfReader:
        return PdfReader({k.lower(): v for k, v in self.options.items()}, schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PdfSource)
