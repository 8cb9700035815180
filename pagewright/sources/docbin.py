"""``docbin``: a Python data source for folders of documents.

Reading gives (name, page_ix, num, width, height, rotation, text) rows, a
partition for each run of files; writing takes (name, data) rows and puts a file
for each into the folder. Folders are URIs that Arrow's file systems open.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from . import documents

PER_PARTITION = 64


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


class DocumentSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "docbin"

    def schema(self) -> str:
        return documents.PAGES

    def reader(self, schema):
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool):
        return _Writer(self.options)


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.password = options["path"], options.get("password", "")
        self.failfast = options.get("mode", "FAILFAST").upper() == "FAILFAST"
        self.suffix = options.get("suffix", ".pdf")

    def partitions(self):
        from pyarrow import fs

        files, root = _open(self.path)
        found = sorted(f.path for f in files.get_file_info(fs.FileSelector(root, recursive=True)) if f.is_file and f.path.endswith(self.suffix))
        return [_Files(found[k : k + PER_PARTITION]) for k in range(0, len(found), PER_PARTITION)] or [_Files([])]

    def read(self, partition):
        from .codec import container

        files, _ = _open(self.path)
        names = [c.strip().split(" ")[0] for c in documents.PAGES.split(",")]
        for path in partition.paths:
            with files.open_input_stream(path, compression=None) as f:
                data = f.read()
            name = path.rsplit("/", 1)[-1]
            try:
                rows = list(documents._page_rows(name, container.load(data, self.password)))
            except Exception as e:
                if self.failfast:
                    raise ValueError(f"{name}: {e}") from e
                continue
            for row in rows:
                yield tuple(row[n] for n in names)


@dataclass
class _Written(WriterCommitMessage):
    files: list


class _Writer(DataSourceWriter):
    """Files are written under a temporary name and renamed on commit, so a retried task leaves no second copy."""

    def __init__(self, options):
        self.path = options["path"]

    def write(self, rows):
        files, root = _open(self.path)
        files.create_dir(root, recursive=True)
        done = []
        for row in rows:
            name = row["name"].rsplit("/", 1)[-1]
            held = f"{root}/.{uuid.uuid4().hex}.part"
            with files.open_output_stream(held, compression=None) as f:
                f.write(bytes(row["data"]))
            done.append((held, f"{root}/{name}"))
        return _Written(done)

    def commit(self, messages):
        files, _ = _open(self.path)
        for message in messages:
            for held, name in message.files if message else ():
                files.move(held, name)

    def abort(self, messages):
        files, _ = _open(self.path)
        for message in messages:
            for held, _ in message.files if message else ():
                files.delete_file(held)


def register(spark) -> None:
    spark.dataSource.register(DocumentSource)
