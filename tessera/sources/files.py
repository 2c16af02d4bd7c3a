"""One file a project, written by the tasks (X4-X7): a Spark data source for `df.write.format("project_files")`.

Rows are (project_id, name, content): the rows of a project that follow each other are one file, so a report of many lines streams
through. A task writes into a folder of its own under `_pending`; when all tasks are done the driver moves the folders of those that
counted to their place, one rename a task, and removes `_pending`. A task that failed, or was tried twice, leaves nothing.
Paths are those that pyarrow knows: a shared folder, file:, hdfs:, s3:.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..functions import units as U

FORMAT = "project_files"
PENDING = "_pending"


@dataclass
class Written(WriterCommitMessage):
    """A task's folder under PENDING, or none if it had no rows."""

    folder: str | None
    files: int


class ProjectFiles(DataSource):
    """Options: path, suffix (behind every name), overwrite is the save mode."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "project_id bigint, name string, content binary"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], self.options.get("suffix", ""), overwrite)


class _Writer(DataSourceWriter):
    def __init__(self, path: str, suffix: str, overwrite: bool):
        self.path, self.suffix, self.overwrite, self.job = path, suffix, overwrite, uuid.uuid4().hex

    def _place(self):
        from pyarrow import fs

        if "://" in self.path or self.path.startswith("file:"):
            return fs.FileSystem.from_uri(self.path)
        return fs.LocalFileSystem(), self.path

    def write(self, rows: Iterator[Row]) -> Written:
        store, base = self._place()
        task = uuid.uuid4().hex
        folder = f"{base}/{PENDING}-{self.job}/{task}"
        now, out, files, taken = None, None, 0, set()
        try:
            for row in rows:
                if out is None or row["project_id"] != now:
                    if out is not None:
                        out.close()
                    else:
                        store.create_dir(folder, recursive=True)
                    now = row["project_id"]
                    plain = row["name"].replace("/", "_")
                    name = plain if plain not in taken else f"{plain}-{now}"
                    if name in taken:
                        raise ValueError(f"the rows of project {now} do not follow each other")
                    taken.add(name)
                    out = store.open_output_stream(f"{folder}/{name}{self.suffix}")
                    files += 1
                out.write(bytes(row["content"]))
        finally:
            if out is not None:
                out.close()
        return Written(task if files else None, files)

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        store, base = self._place()
        if self.overwrite and store.get_file_info(base).type == fs.FileType.Directory:
            for old in store.get_file_info(fs.FileSelector(base)):
                if not old.base_name.startswith(PENDING):
                    (store.delete_dir if old.type == fs.FileType.Directory else store.delete_file)(old.path)
        store.create_dir(base, recursive=True)
        for k, m in enumerate(m for m in messages if m and m.folder):
            store.move(f"{base}/{PENDING}-{self.job}/{m.folder}", f"{base}/part-{k:05d}-{self.job}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        store, base = self._place()
        if store.get_file_info(f"{base}/{PENDING}-{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{base}/{PENDING}-{self.job}")


def write(rows: DataFrame, projects: DataFrame, path: str, suffix: str, content: str, order: tuple[str, ...] = (), mode: str = "append") -> None:
    """One file for each project of `rows`, named by X6 from the project's name; `content` is SQL for a row's bytes, rows stand by `order`.

    A project's rows go to one task, which streams them; a project bounds that, not the table.
    """
    rows.sparkSession.dataSource.register(ProjectFiles)
    named = rows.join(projects.select("project_id", F.expr(U.file_name("name")).alias("__file")), "project_id")
    placed = named.repartition("project_id").sortWithinPartitions("project_id", *order)
    placed.select("project_id", F.coalesce("__file", F.lit("project")).alias("name"), F.expr(f"CAST({content} AS BINARY)").alias("content")).write.format(FORMAT).option("path", path).option("suffix", suffix).mode(mode).save()
