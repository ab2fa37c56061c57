"""A Spark data source of model files of any size: names, lengths, first bytes and streamed checksums."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from auricle import schemas

#: Bytes read of a file at a time; files of a task until their sizes pass the limit, where files are read whole.
READ_BYTES = 1 << 23
TASK_BYTES = 1 << 28
#: Files of a task where they are not read whole.
TASK_FILES = 1000
HEAD_BYTES = 2


def checksum(stream, read_bytes: int = READ_BYTES) -> str:
    """SHA-256 of a stream, which is held a range at a time."""
    found = hashlib.sha256()
    while part := stream.read(read_bytes):
        found.update(part)
    return found.hexdigest()


@dataclass
class Files(InputPartition):
    """Paths and lengths of the files that one task looks at."""

    files: list[tuple[str, int]]


class ArtifactReader(DataSourceReader):
    def __init__(self, root: str, heads: bool, checksums: bool) -> None:
        self.root, self.heads, self.checksums = root, heads, checksums

    def _system(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.root) if ":/" in self.root else (fs.LocalFileSystem(), self.root)

    def partitions(self) -> list[Files]:
        """All files under the root, hidden ones left out, dealt out by size if they are read."""
        system, path = self._system()
        found = [f for f in system.get_file_info(fs.FileSelector(path, recursive=True)) if f.type == fs.FileType.File]
        listed = sorted((f.path, f.size) for f in found if not f.base_name.startswith(("_", ".")))
        tasks, size = [], 0
        for file in listed:
            if not tasks or len(tasks[-1].files) >= TASK_FILES or (self.checksums and size + file[1] > TASK_BYTES):
                tasks.append(Files([]))
                size = 0
            tasks[-1].files.append(file)
            size += file[1]
        return tasks or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        system, _ = self._system()
        for path, length in partition.files:
            head = digest = None
            if self.checksums or self.heads:
                with system.open_input_file(path) as f:
                    head = f.read(HEAD_BYTES)
                    f.seek(0)
                    digest = checksum(f) if self.checksums else None
            folder, _, name = path.rpartition("/")
            yield folder.rpartition("/")[2], name, length, head, digest


class ArtifactSource(DataSource):
    """``spark.read.format("model_artifacts").load(root)``: (model_dir, file, length, head, sha256), a row a file.

    Option ``checksums`` ("true") streams every file; without it two bytes of each are read, and with ``heads`` set to "false" none.
    The root is a local path or an URI that Arrow's file systems know.
    """

    @classmethod
    def name(cls) -> str:
        return "model_artifacts"

    def schema(self) -> str:
        return schemas.MODEL_INVENTORY

    def reader(self, schema) -> ArtifactReader:
        on = lambda key, default: self.options.get(key, default).lower() == "true"
        return ArtifactReader(self.options["path"], on("heads", "true"), on("checksums", "false"))
