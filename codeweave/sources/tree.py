"""Source trees as a data source of Spark: `spark.read.format("source_tree")`.

The driver goes down a tree until it has enough folders to spread, never into an ignored one; these are dealt to partitions, whose
tasks go down the rest, so neither the paths nor the texts of a large tree pass the driver. Files that it meets on the way
are dealt to partitions of their own. Folders and files that cannot be read are passed over; bytes that are no UTF-8
become U+FFFD. Names that begin with `_` or `.` are names like any other.

Options: `path`; `names` (JSON of `Names`); `partitions`, about how many there are to be; `prune`, which must be set to "true" to let Spark hand filters down (the session's
`spark.sql.python.filterPushdown.enabled` must be set, too): a start of the path then cuts folders, extensions cut files before
they are opened.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith

SCHEMA = "rel_path string, extension string, content string"
#: Folders for each partition that the driver finds before it stops going down, files of a partition, and bytes of a batch.
SPREAD, FILES, BYTES = 4, 500, 8 << 20


def extension(name: str) -> str:
    """From the last dot, in lower case; none where the name has only leading dots."""
    core = name.lstrip(".")
    at = core.rfind(".")
    return core[at:].lower() if at > 0 else ""


@dataclass
class Names:
    """Which names are read: none that is ignored, no end of a test's name, and one of the extensions or of the file names."""

    ignore: list[str] = field(default_factory=list)
    test_ends: list[str] = field(default_factory=list)
    extensions: list[str] | None = None
    files: list[str] = field(default_factory=list)

    def enters(self, folder: str) -> bool:
        return folder not in self.ignore

    def reads(self, name: str) -> bool:
        lower = name.lower()
        if name in self.ignore or lower.endswith(tuple(self.test_ends)):
            return False
        return self.extensions is None or extension(name) in self.extensions or lower in self.files


class Files:
    """A file system as this source needs it: the local one, or one that Arrow knows by its URI."""

    def __init__(self, root: str) -> None:
        self.local = "://" not in root or root.startswith("file:")
        self.top = (root.removeprefix("file://") if self.local else root).rstrip("/") or "/"
        if not self.local:
            from pyarrow import fs

            self.system, self.top = fs.FileSystem.from_uri(self.top)

    def entries(self, folder: str) -> list[tuple[str, bool]]:
        """(name, whether it is a folder) of what lies in a folder, in order; nothing where it cannot be read."""
        at = f"{self.top}/{folder}" if folder else self.top
        try:
            if self.local:
                with os.scandir(at) as found:
                    return sorted((e.name, e.is_dir(follow_symlinks=False)) for e in found)
            from pyarrow import fs

            return sorted((i.base_name, i.type == fs.FileType.Directory) for i in self.system.get_file_info(fs.FileSelector(at)))
        except OSError:
            return []

    def text(self, path: str) -> str | None:
        """A file's text; None where it cannot be read."""
        try:
            if self.local:
                with open(f"{self.top}/{path}", "rb") as f:
                    raw = f.read()
            else:
                with self.system.open_input_stream(f"{self.top}/{path}") as f:
                    raw = f.read()
        except OSError:
            return None
        return raw.decode("utf-8", "replace")


@dataclass
class Part(InputPartition):
    """Folders to go down, and files."""

    folders: list[str] = field(default_factory=list)
    files: list[str] = field(default_factory=list)


class SourceTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> TreeReader:
        names = Names(**json.loads(self.options.get("names", "{}")))
        kind = PruningReader if self.options.get("prune") == "true" else TreeReader
        return kind(self.options["path"], names, int(self.options.get("partitions", "64")))


class TreeReader(DataSourceReader):
    def __init__(self, root: str, names: Names, spread: int) -> None:
        self.root, self.names, self.spread = root, names, max(1, spread)
        self.starts: list[str] = []
        self.kinds: set[str] | None = None

    def _enters(self, folder: str, name: str) -> bool:
        path = f"{folder}{name}/"
        return self.names.enters(name) and all(s.startswith(path) or path.startswith(s) for s in self.starts)

    def _reads(self, folder: str, name: str) -> bool:
        return self.names.reads(name) and (self.kinds is None or extension(name) in self.kinds) and all(f"{folder}{name}".startswith(s) for s in self.starts)

    def _listed(self, files: Files, folder: str) -> tuple[list[str], list[str]]:
        """Folders below a folder ('' or ending in '/'), and its files, as paths."""
        found = files.entries(folder.rstrip("/"))
        return [f"{folder}{n}/" for n, is_dir in found if is_dir and self._enters(folder, n)], [f"{folder}{n}" for n, is_dir in found if not is_dir and self._reads(folder, n)]

    def partitions(self) -> list[Part]:
        files, level, met = Files(self.root), [""], []
        while level and len(level) < SPREAD * self.spread:
            below: list[str] = []
            for folder in level:
                folders, own = self._listed(files, folder)
                below += folders
                met += own
            level = below
        parts = [Part(level[i :: self.spread]) for i in range(min(self.spread, len(level)))]
        return parts + [Part(files=met[i : i + FILES]) for i in range(0, len(met), FILES)] or [Part()]

    def _paths(self, files: Files, part: Part) -> Iterator[str]:
        yield from part.files
        stack = part.folders[::-1]
        while stack:
            folders, own = self._listed(files, stack.pop())
            yield from own
            stack += reversed(folders)

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        files, held, size = Files(self.root), [], 0

        def batch() -> pa.RecordBatch:
            return pa.record_batch([pa.array([h[i] for h in held], pa.string()) for i in range(3)], names=["rel_path", "extension", "content"])

        for path in self._paths(files, partition):
            text = files.text(path)
            if text is None:
                continue
            held.append((path.replace("\\", "/") if os.sep == "\\" else path, extension(path.rpartition("/")[2]), text))
            size += len(text)
            if size >= BYTES:
                yield batch()
                held, size = [], 0
        if held:
            yield batch()


class PruningReader(TreeReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802  Spark's name
        """Takes what cuts folders and files; Spark still applies all of it."""
        for f in filters:
            kinds = None
            if isinstance(f, StringStartsWith) and f.attribute == ("rel_path",):
                self.starts.append(f.value)
            elif isinstance(f, EqualTo) and f.attribute == ("extension",):
                kinds = {f.value}
            elif isinstance(f, In) and f.attribute == ("extension",):
                kinds = set(f.value)
            if kinds is not None:
                self.kinds = kinds if self.kinds is None else self.kinds & kinds
            yield f


def options(names: Names) -> str:
    return json.dumps(asdict(names))
