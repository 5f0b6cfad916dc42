"""One file of a chosen name per source, written by the tasks and named when all of them are done.

The rows have ``file`` (the name without its suffix) and ``value`` (one text), and come
sorted by file.  A task writes each file under a name of its own in ``path/_staged-<id>``;
the driver moves the staged files to their final names after the last task has ended.  A
task that fails removes what it staged, a job that fails its whole staging folder, and of
several attempts of a task only the committed one is named in the end.

The rows of one file may span tasks, as a source may hold a third of all rows.  Such a file
becomes numbered pieces, ``<file>.0001<suffix>`` and on, each a valid file, in the order of
the rows: no task has to hold or write a whole source.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from clauseloom.functions.steps import STEP_ROWS

STAGED = "_staged-"
# What stands before the first, between and after the last value of a file.
LAYOUTS = {"array": ("[\n", ",\n", "\n]\n"), "text": ("", "\n", "\n")}


@dataclass
class Staged(WriterCommitMessage):
    """The files of one committed task in the order of its rows: (file, staged path)."""

    files: list[tuple[str, str]]


class NamedFilesWriter(DataSourceArrowWriter):
    def __init__(self, path: str, suffix: str, layout: str, overwrite: bool):
        self.path, self.suffix, self.overwrite = path.rstrip("/"), suffix, overwrite
        self.opening, self.between, self.closing = (mark.encode() for mark in LAYOUTS[layout])
        self.job = uuid.uuid4().hex

    def _located(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        system, root = self._located()
        folder = f"{root}/{STAGED}{self.job}"
        system.create_dir(folder, recursive=True)
        files: list[tuple[str, str]] = []
        out = None
        try:
            for batch in iterator:
                # A few rows become objects at a time, whatever their texts hold.
                steps = (batch.slice(at, STEP_ROWS) for at in range(0, batch.num_rows, STEP_ROWS))
                rows = (row for step in steps for row in zip(step.column("file").to_pylist(), step.column("value").to_pylist()))
                for name, value in rows:
                    if out is None or files[-1][0] != name:
                        if out is not None:
                            out.write(self.closing)
                            out.close()
                        files.append((name, f"{folder}/{uuid.uuid4().hex}"))
                        out = system.open_output_stream(files[-1][1])
                        out.write(self.opening)
                    else:
                        out.write(self.between)
                    out.write(value.encode())
            if out is not None:
                out.write(self.closing)
                out.close()
        except BaseException:
            if out is not None and not out.closed:
                out.close()
            for _, staged in files:
                system.delete_file(staged)
            raise
        return Staged(files)

    def commit(self, messages: list[Staged | None]) -> None:
        system, root = self._located()
        system.create_dir(root, recursive=True)
        pieces: dict[str, list[str]] = {}
        for message in messages:
            for name, staged in message.files if message else ():
                pieces.setdefault(name, []).append(staged)
        moves = {}
        for name, staged in pieces.items():
            for number, source in enumerate(staged, 1):
                part = "" if len(staged) == 1 else f".{number:04d}"
                moves[f"{root}/{name}{part}{self.suffix}"] = source
        held = {
            info.path
            for info in system.get_file_info(fs.FileSelector(root))
            if info.type == fs.FileType.File and info.path.endswith(self.suffix)
        }
        if held and not self.overwrite and held & moves.keys():
            self._clear()
            raise FileExistsError(f"written before: {sorted(held & moves.keys())[:3]}")
        for target, source in moves.items():
            system.move(source, target)
        if self.overwrite:
            for path in held - moves.keys():
                system.delete_file(path)
        self._clear()

    def abort(self, messages: list[Staged | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        system, root = self._located()
        folder = f"{root}/{STAGED}{self.job}"
        if system.get_file_info(folder).type == fs.FileType.Directory:
            system.delete_dir(folder)


class NamedFiles(DataSource):
    """``path``, ``suffix`` (default ``.json``) and ``layout`` (``array`` of JSON values, or ``text``)."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def writer(self, schema: StructType, overwrite: bool) -> NamedFilesWriter:
        options = self.options
        layout = options.get("layout", "array")
        if layout not in LAYOUTS:
            raise ValueError(f"unknown layout: {layout}")
        return NamedFilesWriter(options["path"], options.get("suffix", ".json"), layout, overwrite)


def write_named(
    rows: DataFrame, path: str, order: list[str], suffix: str = ".json", layout: str = "array", mode: str = "overwrite"
) -> None:
    """Write ``file`` and ``value`` as one file per name, its values in the order of the columns ``order``.

    ``overwrite`` replaces the files of ``suffix`` in the folder, ``append`` adds files and refuses
    names that are taken.  Rows without a name or value are left out; a name's slashes and
    backslashes become underscores.  Range partitioning by file and order splits a large source
    into pieces.  No rows give no file.
    """
    named = rows.where(F.col("file").isNotNull() & F.col("value").isNotNull()).withColumn(
        "file", F.regexp_replace(F.col("file").cast("string"), r"[/\\]", "_")
    )
    keys = ["file", *order]
    ordered = named.repartitionByRange(*keys).sortWithinPartitions(*keys).select("file", "value")
    rows.sparkSession.dataSource.register(NamedFiles)
    ordered.write.format("named_files").options(suffix=suffix, layout=layout).mode(mode).save(path)
