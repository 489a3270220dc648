"""A streaming source that tails text files in place, from their ends, through rotation.

Spark's file source takes each file once, as it is then; a log grows. This source's offset is, per
file, how far it has been read, so every complete line is handed out once: a batch is the byte ranges
between two offsets, cut into parts that tasks read by themselves. An offset also holds a digest of
the file's first line. If that changes, or the file is shorter than what was read of it, the file has
been replaced, and the new one is read from its start.
"""

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes of one part of a file, and bytes in which ends of lines are looked for.
PART, STEP = 64 << 20, 1 << 16
SCHEMA = "value string, src_file string, src_block long, line_no long"


class Part(InputPartition):
    """Lines of a file of the file system of ``root`` that begin inside [start, stop)."""

    def __init__(self, root: str, path: str, start: int, stop: int):
        self.root, self.path, self.start, self.stop = root, path, start, stop


def _filesystem(path: str):
    """The file system of a path and the path in it; a plain path is a shared local folder."""
    from pyarrow import fs

    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path.removeprefix("file:")


def _files(pattern: str):
    """The file system and (path, size) of the files of a folder, or of one file.

    A last part with ``*`` picks files of the folder by their names.
    """
    import fnmatch

    from pyarrow import fs

    folder, _, name = pattern.rpartition("/")
    system, path = _filesystem(folder if "*" in name else pattern)
    info = system.get_file_info(path)
    if info.type == fs.FileType.File:
        return system, [(path, info.size)]
    if info.type == fs.FileType.NotFound:
        return system, []
    found = system.get_file_info(fs.FileSelector(path))
    wanted = name if "*" in name else "*"
    return system, sorted(
        (f.path, f.size) for f in found if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name, wanted) and f.base_name[0] not in "._"
    )


def _last_line_end(file, size: int) -> int:
    """Where the last complete line of the first ``size`` bytes ends; 0 without one."""
    at = size
    while at > 0:
        start = max(0, at - STEP)
        file.seek(start)
        found = file.read(at - start).rfind(b"\n")
        if found >= 0:
            return start + found + 1
        at = start
    return 0


def _head(file) -> str:
    """A digest of the first line, or of its first bytes if it is long."""
    file.seek(0)
    line = file.read(1024).partition(b"\n")[0]
    return hashlib.sha256(line).hexdigest()[:16]


class TailReader(DataSourceStreamReader):
    def __init__(self, options):
        self.path = options["path"]
        self.from_end = options.get("start", "end") != "begin"
        self.part = int(options.get("partbytes", PART))

    def _ends(self) -> dict:
        """{file: [digest of its first line, end of its last complete line]}, files with lines only."""
        system, files = _files(self.path)
        found = {}
        for path, size in files:
            with system.open_input_file(path) as file:
                end = _last_line_end(file, size)
                if end:
                    found[path] = [_head(file), end]
        return found

    def initialOffset(self) -> dict:
        """Nothing is known yet. The first batch writes down where the files end, so that a stream
        that is stopped before any line came goes on from there."""
        return {"files": ""}

    def latestOffset(self) -> dict:
        return {"files": json.dumps(self._ends(), sort_keys=True)}

    def partitions(self, start: dict, end: dict):
        if not start["files"] and self.from_end:
            return []
        before, parts = json.loads(start["files"] or "{}"), []
        for path, (head, stop) in json.loads(end["files"]).items():
            known, at = before.get(path, (None, 0))
            if known != head or at > stop:
                at = 0
            while at < stop:
                parts.append(Part(self.path, path, at, min(stop, at + self.part)))
                at += self.part
        return parts

    def read(self, partition: Part):
        """Batches of lines; a line belongs to the part it begins in, and is read to its end."""
        import pyarrow as pa

        system, _ = _filesystem(partition.root)
        schema = pa.schema([("value", pa.string()), ("src_file", pa.string()), ("src_block", pa.int64()), ("line_no", pa.int64())])
        with system.open_input_file(partition.path) as file:
            at, rest = partition.start, b""
            if at:
                # the byte before tells whether a line begins here
                file.seek(at - 1)
                while (found := (chunk := file.read(STEP)).find(b"\n")) < 0 and chunk:
                    at += len(chunk)
                at = at - 1 + found + 1
            while at < partition.stop:
                file.seek(at + len(rest))
                chunk = file.read(STEP)
                rest += chunk
                whole = rest.rfind(b"\n") + 1
                if not whole:
                    if not chunk:
                        return
                    continue
                values, places = [], []
                for line in rest[: whole - 1].split(b"\n"):
                    if at >= partition.stop:
                        break
                    values.append(line.removesuffix(b"\r").decode(errors="replace"))
                    places.append(at)
                    at += len(line) + 1
                rest = rest[whole:]
                n = len(values)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(values), pa.array([partition.path] * n), pa.array([0] * n, pa.int64()), pa.array(places, pa.int64())], schema=schema
                )

    def commit(self, end: dict) -> None:
        pass


class TailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tailed_lines"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema):
        return TailReader(self.options)


def tail_log_lines(spark: SparkSession, path: str, start="end", part_bytes=PART) -> DataFrame:
    """New complete lines of files that grow: a file, a folder, or a folder and a pattern of names.

    ``start``: ``end`` passes over what the files hold when the stream first starts, ``begin`` reads
    it. ``line_no`` is the line's first byte in its file. Bytes that are no UTF-8 become signs.
    """
    spark.dataSource.register(TailSource)
    reader = spark.readStream.format("tailed_lines").option("path", path)
    return reader.option("start", start).option("partbytes", part_bytes).load()
