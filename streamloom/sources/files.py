"""Tables as folders of Parquet files: numbered appends that happen once, swaps of files, and what readers must not see.

A numbered batch of a sink is written beside the table first. A note then names its files and their places, they move
in, and the sink's mark takes the batch's number; the note goes last. A retry goes on from whatever it finds: a marked
number is done, a note is worked off, anything else is written anew. Numbers of different sinks have nothing to do with
each other. Readers leave out the files of an open note, so they see all of a batch or nothing of it.

A swap puts new files in the place of old ones in the same way: a note, the new files move in, the old ones go.
"""

from __future__ import annotations

import json
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Renames and deletes that run at once; each is a call to the file system.
AT_ONCE = 16


class Files:
    """The table's file system; what it reports as failed raises."""

    def __init__(self, spark: SparkSession, path: str):
        self.path_of = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path_of(path).getFileSystem(spark._jsc.hadoopConfiguration())
        self.jvm = spark._jvm

    def exists(self, path: str) -> bool:
        return self.fs.exists(self.path_of(path))

    def below(self, path: str) -> list[str]:
        """All files below a folder."""
        if not self.exists(path):
            return []
        out, listed = [], self.fs.listFiles(self.path_of(path), True)
        while listed.hasNext():
            out.append(listed.next().getPath().toString())
        return out

    def folders(self, path: str) -> list[str]:
        """Names of the folders in a folder."""
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path_of(path)) if s.isDirectory()) if self.exists(path) else []

    def move(self, source: str, target: str) -> None:
        self.fs.mkdirs(self.path_of(target).getParent())
        if not self.fs.rename(self.path_of(source), self.path_of(target)):
            raise OSError(f"not moved: {source} to {target}")

    def delete(self, path: str) -> None:
        if not self.fs.delete(self.path_of(path), True) and self.exists(path):
            raise OSError(f"not deleted: {path}")

    def write(self, path: str, text: str) -> None:
        out = self.fs.create(self.path_of(path), True)
        out.write(bytearray(text.encode()))
        out.close()

    def create(self, path: str, text: str) -> bool:
        """Write a file that must be new: of several callers one succeeds. Distributed file systems see to that themselves, a local one by its own call."""
        target = self.path_of(path)
        if self.fs.getScheme() == "file":
            self.fs.mkdirs(target.getParent())
            try:
                with open(target.toUri().getPath(), "x") as out:
                    out.write(text)
                return True
            except FileExistsError:
                return False
        try:
            out = self.fs.create(target, False)
        except Exception:  # in whatever class this file system reports it
            if self.exists(path):
                return False
            raise
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def text(self, path: str) -> str:
        source = self.jvm.java.io.BufferedReader(self.jvm.java.io.InputStreamReader(self.fs.open(self.path_of(path)), "UTF-8"))
        out = source.readLine()
        source.close()
        return out or ""

    def each(self, do, *columns: list) -> None:
        """do for every row of columns, several at once; the first failure raises after all have ended."""
        with ThreadPoolExecutor(AT_ONCE) as pool:
            for done in [pool.submit(do, *row) for row in zip(*columns)]:
                done.result()


def name_of(path: str) -> str:
    return path.rsplit("/", 1)[-1]


def _note(files: Files, path: str) -> dict | None:
    """A note's contents; one that was cut off while it was written names nothing that has moved."""
    try:
        return json.loads(files.text(path))
    except ValueError:
        return None


def marked(files: Files, path: str, sink: str) -> int:
    """Number of the sink's last batch that is all in, -1 before the first."""
    mark = f"{path}/_sinks/{sink}"
    text = files.text(mark) if files.exists(mark) else ""
    return int(text) if text else -1


def prefix(sink: str, number: int) -> str:
    return f"batch-{sink}-{number}-"


def append_numbered(rows: DataFrame, path: str, number: int, sink: str, partitions: tuple[str, ...] = (), compression: str = "snappy") -> bool:
    """Append a sink's batch once, its numbers ascending; returns whether there was anything to do."""
    files = Files(rows.sparkSession, path)
    note, staged = f"{path}/_pending/{sink}", f"{path}/_staged/{sink}"
    if marked(files, path, sink) >= number:
        return False
    plan = _note(files, note) if files.exists(note) else None
    if plan is None or plan["number"] != number:
        rows.write.mode("overwrite").partitionBy(*partitions).option("compression", compression).parquet(staged)
        found = [p for p in files.below(staged) if p.endswith(".parquet")]
        inside = [p.split(f"/_staged/{sink}/", 1)[1] for p in found]
        targets = [f"{path}/{x[: -len(name_of(x))]}{prefix(sink, number)}{name_of(x)}" for x in inside]
        plan = {"number": number, "files": list(zip(found, targets))}
        files.write(note, json.dumps(plan))
    left = [(a, b) for a, b in plan["files"] if files.exists(a)]
    files.each(files.move, [a for a, _ in left], [b for _, b in left])
    files.write(f"{path}/_sinks/{sink}", str(number))
    files.delete(note)
    files.delete(staged)
    return True


def pending(files: Files, path: str) -> list[str]:
    """Prefixes of the names of files whose batch is not all in."""
    out = []
    for p in files.below(f"{path}/_pending"):
        plan = _note(files, p)
        if plan and marked(files, path, name_of(p)) < plan["number"]:
            out.append(prefix(name_of(p), plan["number"]))
    return out


def swaps(files: Files, path: str) -> list[tuple[str, dict]]:
    """Swaps that did not end: path of the note and its contents, the names of new and old files."""
    found = [(p, _note(files, p)) for p in files.below(f"{path}/_swaps")]
    return [(p, x) for p, x in found if x]


def hidden(files: Files, swap: dict) -> list[str]:
    """Paths that a reader must not see while a swap is open: the old files once all new ones are there, else the new."""
    return swap["old"] if all(files.exists(p) for p in swap["new"]) else swap["new"]


def swap(files: Files, path: str, new: dict[str, str], old: list[str]) -> None:
    """Move new files (where they are -> their places) in and old ones out."""
    note = f"{path}/_swaps/{uuid.uuid4().hex}"
    files.write(note, json.dumps({"new": sorted(new.values()), "old": old}))
    files.each(files.move, list(new), list(new.values()))
    files.each(files.delete, old)
    files.delete(note)


def recover(spark: SparkSession, path: str) -> None:
    """End or undo the swaps that broke off."""
    files = Files(spark, path)
    for note, open_ in swaps(files, path):
        files.each(files.delete, hidden(files, open_))
        files.delete(note)


def place(path: str, depth: int) -> str:
    """A data file's partition folders and name: one write gives many partitions files of one name."""
    return "/".join(path.rsplit("/", depth + 1)[1:])


def place_column(depth: int) -> Column:
    """The same of the file that a row comes from; file_path is a URI."""
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return F.array_join(F.slice(F.split(path, "/"), -(depth + 1), depth + 1), "/")


def read_table(spark: SparkSession, path: str, schema: T.StructType, depth: int, folders: list[str] | None = None) -> DataFrame:
    """The table's rows, each once even where a batch or a swap broke off; depth: its number of partition columns. folders: only what lies in these, nothing else is listed."""
    files = Files(spark, path)
    gone = [place(p, depth) for _, x in swaps(files, path) for p in hidden(files, x)]
    if not files.exists(path) or folders == []:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).option("basePath", path).parquet(*([path] if folders is None else folders))
    if gone:
        rows = rows.where(~place_column(depth).isin(gone))
    for start in pending(files, path):
        rows = rows.where(~F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).startswith(start))
    return rows
