"""A batch source over zip archives holding one CSV each, small files packed into tasks by size, on any Arrow file system."""
from __future__ import annotations

import operator
import re
import zlib

from pyspark.sql import datasource as D
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .archive import FILE_STAMP, FILE_SYMBOL


# A task reads files of about so many bytes in all, or one larger file; a record batch holds the lines of so many bytes of text.
TASK_BYTES, BATCH_BYTES = 64 << 20, 4 << 20


class _Share(InputPartition):
    """Files to read: (folder, k, n) stands for those of the folder whose names hash to share k of n."""

    def __init__(self, shares: list[tuple[str, int, int]]):
        super().__init__(shares)
        self.shares = shares


def _open(uri: str):
    from pyarrow import fs
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://", 1))


TESTS = {D.EqualTo: operator.eq, D.EqualNullSafe: operator.eq, D.GreaterThan: operator.gt, D.GreaterThanOrEqual: operator.ge, D.LessThan: operator.lt,
         D.LessThanOrEqual: operator.le, D.In: lambda x, values: x in values, D.StringStartsWith: str.startswith}


def _named(path: str) -> dict[str, str]:
    """symbol and stamp as the file's name has them, empty where it has none."""
    found = {"symbol": re.search(FILE_SYMBOL, path), "stamp": re.search(FILE_STAMP, path)}
    return {k: m[1] if m else "" for k, m in found.items()}


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.uri, self.tests = options["path"], []
        for name, test in (("first", operator.ge), ("last", operator.le)):
            if options.get(name):
                self.tests.append(("stamp", test, options[name]))

    def pushFilters(self, filters):
        """Takes what names can answer, on symbol and stamp; Spark answers the rest."""
        for f in filters:
            column = getattr(f, "attribute", ("",))
            if column not in (("symbol",), ("stamp",)) or not (isinstance(f, D.IsNotNull) or type(f) in TESTS):
                yield f
            elif not isinstance(f, D.IsNotNull):
                self.tests.append((column[0], TESTS[type(f)], f.value))

    def wanted(self, path: str) -> bool:
        name = _named(path)
        return all(value is not None and test(name[column], value) for column, test, value in self.tests)

    def _zips(self, files, folder: str):
        """Entries of one folder, and its folders."""
        from pyarrow import fs
        found = files.get_file_info(fs.FileSelector(folder))
        return ([i for i in found if i.type == fs.FileType.File and i.path.endswith(".zip") and self.wanted(i.path)],
                sorted(i.path for i in found if i.type == fs.FileType.Directory))

    def partitions(self):
        """Folders and shares of folders; one folder's entries at a time are seen here, and tasks list their own again."""
        from pyarrow import fs
        files, root = _open(self.uri)
        if files.get_file_info(root).type != fs.FileType.Directory:
            return [_Share([(root, 0, 0)])]
        packs, size, folders = [], TASK_BYTES, [root]
        while folders:
            folder = folders.pop()
            zips, inner = self._zips(files, folder)
            folders += reversed(inner)
            total = sum(i.size or 0 for i in zips)
            if total > TASK_BYTES:
                n = min(-(-total // TASK_BYTES), len(zips))
                packs += [[(folder, k, n)] for k in range(n)]
                size = TASK_BYTES
            elif zips:
                if size + total > TASK_BYTES:
                    packs.append([])
                    size = 0
                packs[-1].append((folder, 0, 1))
                size += total
        return [_Share(p) for p in packs]

    def paths(self, partition):
        """The files of a partition that are wanted, by name."""
        files, _ = _open(self.uri)
        for folder, k, n in getattr(partition, "shares", []):
            if n == 0:
                yield from [folder] * self.wanted(folder)
            else:
                yield from sorted(i.path for i in self._zips(files, folder)[0] if zlib.crc32(i.base_name.encode()) % n == k)

    def read(self, partition):
        files, _ = _open(self.uri)
        for path in self.paths(partition):
            yield from self._lines(files, path)

    def _lines(self, files, path):
        """Record batches of one file's lines, as they are unpacked; where it cannot be read on, a row without a line."""
        import zipfile

        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        name = _named(path)
        made = lambda at, lines: pa.RecordBatch.from_arrays([pa.array([path] * len(lines)), pa.array(np.arange(at, at + len(lines))), lines,
                                                             *[pa.array([name[c]] * len(lines)) for c in ("symbol", "stamp")]], names=["file", "n", "line", "symbol", "stamp"])
        at = 0
        try:
            with files.open_input_file(path) as raw, zipfile.ZipFile(raw) as z:
                entry = next(n for n in z.namelist() if n.endswith(".csv"))
                with z.open(entry) as f:
                    rest, more = b"", True
                    while more:
                        block = f.read(BATCH_BYTES)
                        more = bool(block)
                        rest += block
                        # Whole lines go on; the last of the file may end without a break.
                        cut = rest.rfind(b"\n") + 1 if more else len(rest)
                        text, rest = rest[:cut], rest[cut:]
                        if text:
                            lines = pc.split_pattern(pa.array([text.removesuffix(b"\n")], pa.binary()).cast(pa.string()), "\n").flatten()
                            yield made(at, pc.replace_substring_regex(lines, r"\r\z", ""))
                            at += len(lines)
        except (zipfile.BadZipFile, zlib.error, EOFError, StopIteration, UnicodeDecodeError, pa.ArrowInvalid):
            yield made(at, pa.nulls(1, pa.string()))


class ZippedCsv(DataSource):
    """format("zipped_csv").load(path); options first and last, and filters on symbol and stamp, choose files by their names; the others are not opened. A file that is no zip, holds no CSV or breaks off
    has one row without a line, after the lines that could be read."""

    @classmethod
    def name(cls):
        return "zipped_csv"

    def schema(self):
        return "file string, n bigint, line string, symbol string, stamp string"

    def reader(self, schema):
        return _Reader(self.options)
