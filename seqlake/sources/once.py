"""A sink whose batches are written whole or not at all, and once (``format("once")``).

Tasks write files of their own into a scratch folder and say in their commit
messages which. Only when all have ended does the driver move those files to
their places and write the batch's ledger row, as its last step. Readers go by
the ledger. So a task that fails, or is run twice, leaves nothing behind, and
writing a batch that the ledger has changes nothing.
"""

from __future__ import annotations

import csv
import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from .files import opened


@dataclass
class Written(WriterCommitMessage):
    """What a task wrote: pairs of scratch and final path (below the sink's), and its number of rows."""

    files: list[tuple[str, str]]
    rows: int


def _plain(x):
    """A value as JSON has it: rows as objects, arrays as lists, the rest of what JSON doesn't know as text."""
    if hasattr(x, "asDict"):
        return {k: _plain(v) for k, v in x.asDict().items()}
    if isinstance(x, (list, tuple)):
        return [_plain(v) for v in x]
    if isinstance(x, dict):
        return {str(k): _plain(v) for k, v in x.items()}
    return x if x is None or isinstance(x, (bool, int, float, str)) else str(x)


class OnceSink(DataSource):
    """Options: ``path``; ``batch``, the name under which a write stands in the ledger; ``kind``.

    ``kind`` is ``json`` (lines) or ``csv`` (with a header), one file a task
    that has rows, or ``files``: rows of ``name`` and ``content``, each a file
    of that name, sub-folders and all (names must differ; a later batch
    replaces a file of the same name).
    """

    @classmethod
    def name(cls) -> str:
        return "once"

    def schema(self) -> str:
        return "name string"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return OnceWriter(self.options["path"], self.options["batch"], self.options.get("kind", "json"), schema.fieldNames())


def _ledger(path: str, batch: str) -> str:
    return f"{path}/_ledger/{batch}.json"


class OnceWriter(DataSourceWriter):
    def __init__(self, path: str, batch: str, kind: str, columns: list[str]):
        if kind not in ("json", "csv", "files") or not batch or "/" in batch:
            raise ValueError("kind is json, csv or files, and batch a name without slashes")
        if kind == "files" and not {"name", "content"} <= set(columns):
            raise ValueError("files need the columns name and content")
        self.path, self.batch, self.kind, self.columns = path.rstrip("/"), batch, kind, columns
        self.scratch = f"_scratch/{batch}-{uuid.uuid4().hex}"
        system, base = opened(self.path)
        self.done = system.get_file_info(_ledger(base, batch)).type == fs.FileType.File

    def write(self, iterator: Iterator) -> Written:
        if self.done:
            return Written([], 0)
        system, base = opened(self.path)
        own = f"{self.scratch}/{uuid.uuid4().hex}"
        system.create_dir(f"{base}/{own}", recursive=True)
        files, rows = [], 0
        if self.kind == "files":
            for row in iterator:
                with system.open_output_stream(f"{base}/{own}/{rows}") as f:
                    f.write(bytes(row["content"]))
                files.append((f"{own}/{rows}", row["name"].lstrip("/")))
                rows += 1
            return Written(files, rows)
        out = None
        for row in iterator:
            if out is None:
                name = f"{uuid.uuid4().hex}.{self.kind}"
                out = system.open_output_stream(f"{base}/{own}/{name}")
                files.append((f"{own}/{name}", f"{self.batch}/{name}"))
                if self.kind == "csv":
                    out.write(self._csv(self.columns))
            out.write(self._csv([row[c] for c in self.columns]) if self.kind == "csv" else (json.dumps({c: _plain(row[c]) for c in self.columns}, ensure_ascii=False) + "\n").encode())
            rows += 1
        if out is not None:
            out.close()
        return Written(files, rows)

    @staticmethod
    def _csv(cells: list) -> bytes:
        line = io.StringIO()
        csv.writer(line, lineterminator="\n").writerow(cells)
        return line.getvalue().encode()

    def commit(self, messages: list[Written | None]) -> None:
        if self.done:
            return
        system, base = opened(self.path)
        moves = [m for x in messages if x is not None for m in x.files]
        names = [to for _, to in moves]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("two rows of a batch have the same file name")
        if self.kind != "files" and system.get_file_info(f"{base}/{self.batch}").type == fs.FileType.Directory:
            system.delete_dir(f"{base}/{self.batch}")  # of an earlier try that ended before its ledger row
        for folder in {to.rpartition("/")[0] for to in names}:
            system.create_dir(f"{base}/{folder}" if folder else base, recursive=True)
        for at, to in moves:
            system.move(f"{base}/{at}", f"{base}/{to}")
        entry = {"batch": self.batch, "kind": self.kind, "rows": sum(x.rows for x in messages if x is not None), "files": sorted(names)}
        system.create_dir(f"{base}/_ledger", recursive=True)
        with system.open_output_stream(f"{base}/_ledger/.{self.batch}.part") as f:
            f.write(json.dumps(entry).encode())
        system.move(f"{base}/_ledger/.{self.batch}.part", _ledger(base, self.batch))
        self._clear(system, base)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*opened(self.path))

    def _clear(self, system: fs.FileSystem, base: str) -> None:
        """Delete what tries of this batch have left in the scratch folder; a task that outlived its aborted try may have written after it."""
        top = f"{base}/_scratch"
        if system.get_file_info(top).type != fs.FileType.Directory:
            return
        for x in system.get_file_info(fs.FileSelector(top)):
            if x.base_name.startswith(f"{self.batch}-"):
                system.delete_dir(x.path)


def write_once(df: DataFrame, path: str, batch: str, kind: str = "json") -> None:
    """Write ``df`` as the batch of that name; nothing happens if the ledger has it."""
    df.sparkSession.dataSource.register(OnceSink)
    df.write.format("once").mode("append").option("path", path).option("batch", batch).option("kind", kind).save()


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """batch, kind, rows, files of all batches that were written whole."""
    system, base = opened(path)
    schema = "batch string, kind string, rows long, files array<string>"
    if system.get_file_info(f"{base}/_ledger").type != fs.FileType.Directory:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("pathGlobFilter", "*.json").json(f"{path}/_ledger")


def read_once(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all whole batches of kind json or csv; files that the ledger doesn't name are not looked at."""
    done = [(r["kind"], f) for r in ledger(spark, path).where("kind <> 'files'").collect() for f in r["files"]]
    out = spark.createDataFrame([], schema)
    for kind in ("json", "csv"):
        files = [f"{path.rstrip('/')}/{f}" for k, f in done if k == kind]
        if files:
            r = spark.read.schema(schema)
            out = out.unionByName(r.json(files) if kind == "json" else r.option("header", True).option("escape", '"').option("multiLine", True).csv(files))
    return out
