"""A JSON lines sink whose files appear at once or not at all, with counters of what they hold.

    spark.dataSource.register(JsonLines)
    rows.write.format("jsonl").mode("append").option("counters", "source,lang").save(folder)

Each task writes one file under a name that readers skip. When all are done the driver renames them, then replaces
stats.json by a new file of the same folder: rows, rows by value of each counter column, and the files it speaks of. A
task or job that fails leaves no row; files of an attempt that lost are removed.
"""

from __future__ import annotations

import json
import os
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark import TaskContext
from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from .matrices import opened

STATS = "stats.json"


@dataclass
class Written(WriterCommitMessage):
    name: str
    rows: int
    counts: dict[str, dict[str, int]] = field(default_factory=dict)


def stats_of(folder: str) -> dict:
    """What the last committed write said of the folder."""
    files, inner = opened(folder)
    path = f"{inner}/{STATS}"
    if not files.get_file_info(path).is_file:
        return {"rows": 0, "counts": {}, "files": []}
    with files.open_input_file(path) as f:
        return json.loads(f.read())


def replaced(folder: str, name: str, text: str) -> None:
    """A file of the folder written under another name and renamed: readers see the old or the new one, whole."""
    files, inner = opened(folder)
    files.create_dir(inner, recursive=True)
    other = f"{inner}/_{name}-{uuid.uuid4().hex}"
    with files.open_output_stream(other) as out:
        out.write(text.encode())
    files.move(other, f"{inner}/{name}")


class JsonLinesWriter(DataSourceWriter):
    def __init__(self, folder: str, counters: list[str], overwrite: bool):
        self.folder, self.counters, self.overwrite, self.job = folder, counters, overwrite, uuid.uuid4().hex[:12]

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        context = TaskContext.get()
        files, inner = opened(self.folder)
        files.create_dir(inner, recursive=True)
        name = f"part-{self.job}-{context.partitionId():05}-{context.taskAttemptId()}.jsonl"
        rows, counts = 0, {c: Counter() for c in self.counters}
        try:
            with files.open_output_stream(f"{inner}/_{name}") as out:
                for row in iterator:
                    record = row.asDict(recursive=True)
                    out.write((json.dumps(record, ensure_ascii=False, default=str) + "\n").encode())
                    rows += 1
                    for c in self.counters:
                        counts[c][str(record[c])] += 1
        except BaseException:
            if files.get_file_info(f"{inner}/_{name}").is_file:
                files.delete_file(f"{inner}/_{name}")
            raise
        return Written(name, rows, {c: dict(n) for c, n in counts.items()})

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files, inner = opened(self.folder)
        files.create_dir(inner, recursive=True)
        done = [m for m in messages if m is not None]
        before = {"rows": 0, "counts": {}, "files": []} if self.overwrite else stats_of(self.folder)
        old = stats_of(self.folder)["files"] if self.overwrite else []
        sums = {c: Counter(before["counts"].get(c, {})) for c in self.counters}
        for m in done:
            files.move(f"{inner}/_{m.name}", f"{inner}/{m.name}")
            for c in self.counters:
                sums[c].update(m.counts[c])
        stats = {"rows": before["rows"] + sum(m.rows for m in done), "counts": before["counts"] | {c: dict(sorted(n.items())) for c, n in sums.items()}, "files": before["files"] + [m.name for m in done]}
        replaced(self.folder, STATS, json.dumps(stats, sort_keys=True))
        for name in old:
            files.delete_file(f"{inner}/{name}")
        self.swept()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self.swept()

    def swept(self) -> None:
        """Removes what attempts of this job left behind."""
        files, inner = opened(self.folder)
        if os.path.basename(inner) and files.get_file_info(inner).type.name == "Directory":
            from pyarrow.fs import FileSelector

            for x in files.get_file_info(FileSelector(inner)):
                if x.base_name.startswith(f"_part-{self.job}-"):
                    files.delete_file(x.path)


class JsonLines(DataSource):
    """Options: path, counters (columns, separated by commas)."""

    @classmethod
    def name(cls) -> str:
        return "jsonl"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        counters = [c for c in (self.options.get("counters") or "").split(",") if c]
        unknown = [c for c in counters if c not in schema.fieldNames()]
        if unknown:
            raise ValueError(f"no columns {unknown}")
        return JsonLinesWriter(self.options["path"], counters, overwrite)
