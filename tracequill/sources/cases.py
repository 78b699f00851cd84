"""An archive of source files by case, as a Spark data source with a two-phase commit.

A batch is a folder of parts; a part holds many files one after another, and beside it stands its list: case, name,
format, offset, length and SHA-256 of each. ``df.write.format("cases")`` lets every task write a
part below a hidden staging folder, read it back and hold it against its hashes; the driver gets one line a task.
The commit drops what lost attempts left, writes the batch's manifest and renames the folder, so readers see
a batch whole or not at all. ``spark.read.format("cases")`` plans parts by ranges of bytes and holds each file against its hash again.

Paths are local ones or URIs of file systems that Arrow knows; the folder must be shared by driver and executors.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "case_id string, name string, format string, sha256 string, n_bytes long, content binary"
_ARROW = pa.schema([("case_id", pa.string()), ("name", pa.string()), ("format", pa.string()), ("sha256", pa.string()), ("n_bytes", pa.int64()), ("content", pa.binary())])
#: Bytes that one task reads, and that one batch of rows holds, about.
SPLIT, ROWS = 64 << 20, 4 << 20


def _open(path: str) -> tuple[arrow_fs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return arrow_fs.FileSystem.from_uri(path) if "://" in path else (arrow_fs.LocalFileSystem(), path)


def safe_name(name: str | None) -> bool:
    """A plain file name: no folder, no drive, not hidden."""
    return bool(name) and not name.startswith(".") and not any(c in name for c in "/\\:\0")


@dataclass
class Part(WriterCommitMessage):
    name: str
    files: int
    n_bytes: int
    sha256: str


@dataclass
class Slice(InputPartition):
    batch: str
    part: str
    start: int
    stop: int


def batches(path: str) -> list[tuple[str, list[dict]]]:
    """Committed batches in the order of their names, and the parts of each; hidden folders and files are none."""
    fs, root = _open(path)
    if fs.get_file_info(root).type == arrow_fs.FileType.NotFound:
        return []
    found = []
    for info in sorted(fs.get_file_info(arrow_fs.FileSelector(root)), key=lambda x: x.base_name):
        if info.type == arrow_fs.FileType.Directory and not info.base_name.startswith("."):
            with fs.open_input_stream(f"{root}/{info.base_name}/_manifest.json") as own:
                found.append((info.base_name, json.loads(own.read())["parts"]))
    return found


class CaseWriter(DataSourceWriter):
    def __init__(self, path: str, batch: str) -> None:
        self.path, self.batch = path, batch

    def write(self, iterator: Iterator) -> Part:
        fs, root = _open(self.path)
        staging, part = f"{root}/.staging-{self.batch}", f"part-{uuid.uuid4().hex}"
        fs.create_dir(staging, recursive=True)
        entries: list[dict] = []
        at = 0
        with fs.open_output_stream(f"{staging}/{part}.bin") as out:
            for row in iterator:
                if not row.case_id or not safe_name(row.name):
                    raise ValueError(f"unsafe case or file name: {row.case_id!r} {row.name!r}")
                content = bytes(row.content or b"")
                own = hashlib.sha256(content).hexdigest()
                if row.sha256 is not None and row.sha256 != own:
                    raise ValueError(f"{row.name} is not what was hashed")
                out.write(content)
                entries.append({"case_id": row.case_id, "name": row.name, "format": row.format, "offset": at, "n_bytes": len(content), "sha256": own})
                at += len(content)
        with fs.open_input_file(f"{staging}/{part}.bin") as back:
            for entry in entries:
                if hashlib.sha256(back.read_at(entry["n_bytes"], entry["offset"])).hexdigest() != entry["sha256"]:
                    raise OSError(f"{entry['name']} was not copied as it is")
        listed = "".join(json.dumps(x, ensure_ascii=False) + "\n" for x in entries).encode()
        with fs.open_output_stream(f"{staging}/{part}.jsonl") as out:
            out.write(listed)
        return Part(part, len(entries), at, hashlib.sha256(listed).hexdigest())

    def commit(self, messages: list) -> None:
        fs, root = _open(self.path)
        staging, parts = f"{root}/.staging-{self.batch}", sorted((m for m in messages if m is not None and m.files), key=lambda m: m.name)
        fs.create_dir(staging, recursive=True)
        kept = {f"{m.name}{end}" for m in parts for end in (".bin", ".jsonl")}
        for info in fs.get_file_info(arrow_fs.FileSelector(staging)):
            if info.base_name not in kept:
                fs.delete_file(info.path)
        for m in parts:
            if fs.get_file_info(f"{staging}/{m.name}.bin").size != m.n_bytes:
                raise OSError(f"{m.name} has another size than was written")
        with fs.open_output_stream(f"{staging}/_manifest.json") as out:
            out.write(json.dumps({"batch": self.batch, "parts": [vars(m) for m in parts]}, sort_keys=True).encode())
        fs.move(staging, f"{root}/{self.batch}")

    def abort(self, messages: list) -> None:
        fs, root = _open(self.path)
        if fs.get_file_info(f"{root}/.staging-{self.batch}").type != arrow_fs.FileType.NotFound:
            fs.delete_dir(f"{root}/.staging-{self.batch}")


class CaseReader(DataSourceReader):
    def __init__(self, path: str, split: int, content: bool) -> None:
        self.path, self.split, self.content = path, split, content

    def partitions(self) -> list[Slice]:
        """Ranges of bytes of all parts; a file belongs to the range in which it starts."""
        found = [Slice(batch, part["name"], at, at + self.split) for batch, parts in batches(self.path) for part in parts for at in range(0, max(1, part["n_bytes"] + 1), self.split)]
        return found or [Slice("", "", 0, 0)]

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        if not partition.part:
            return
        fs, root = _open(self.path)
        folder, rows, size = f"{root}/{partition.batch}", [], 0
        with fs.open_input_stream(f"{folder}/{partition.part}.jsonl") as listed:
            entries = [x for x in map(json.loads, listed.read().decode().splitlines()) if partition.start <= x["offset"] < partition.stop]
        with fs.open_input_file(f"{folder}/{partition.part}.bin") as data:
            for x in entries:
                own = data.read_at(x["n_bytes"], x["offset"]) if self.content else None
                if own is not None and hashlib.sha256(own).hexdigest() != x["sha256"]:
                    raise OSError(f"{x['name']} of {x['case_id']} has changed")
                rows.append({k: x[k] for k in ("case_id", "name", "format", "sha256", "n_bytes")} | {"content": own})
                size += x["n_bytes"] if self.content else 100
                if size >= ROWS:
                    yield pa.RecordBatch.from_pylist(rows, _ARROW)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _ARROW)


class CaseSource(DataSource):
    """Options: ``path``; ``content`` (false: a listing without contents); ``split`` (bytes a task)."""

    @classmethod
    def name(cls) -> str:
        return "cases"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> CaseReader:
        return CaseReader(self.options["path"], int(self.options.get("split", SPLIT)), self.options.get("content", "true") == "true")

    def writer(self, schema, overwrite: bool) -> CaseWriter:
        if overwrite:
            raise ValueError("an archive is only added to: use mode append")
        found = batches(self.options["path"])
        return CaseWriter(self.options["path"], f"batch-{len(found) + 1:06d}-{uuid.uuid4().hex[:12]}")
