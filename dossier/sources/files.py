"""Folders of document files as a table, as a stream, and as a sink, on any file system that pyarrow knows."""

from __future__ import annotations

import io
import json
import re
import uuid
import zipfile
from collections.abc import Iterator
from datetime import datetime
from xml.etree import ElementTree

import pyarrow as pa
import pyarrow.fs as pfs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage

SCHEMA = "path string, kind string, length long, modified timestamp, content binary, text string, error string"
BATCH = pa.schema([("path", pa.string()), ("kind", pa.string()), ("length", pa.int64()), ("modified", pa.timestamp("us", "UTC")), ("content", pa.binary()), ("text", pa.string()), ("error", pa.string())])
# The namespace and the marks of a word-processing document.
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def opened(path: str) -> tuple[pfs.FileSystem, str]:
    """The file system of a path or uri, and the path there."""
    bare = re.sub(r"^file:/*", "/", path)
    return (pfs.LocalFileSystem(), bare) if bare.startswith("/") else pfs.FileSystem.from_uri(path)


def kind_of(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    return name.rsplit(".", 1)[1].lower() if "." in name else ""


def docx_text(content: bytes) -> str:
    """Paragraphs of a docx file, one a line; a table's row is one line of its cells, set off by bars."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{WORD}body")

    def said(node) -> str:
        marks = {f"{WORD}tab": "\t", f"{WORD}br": "\n"}
        return "".join(e.text or "" if e.tag == f"{WORD}t" else marks.get(e.tag, "") for e in node.iter())

    def lines(node) -> Iterator[str]:
        for e in node:
            if e.tag == f"{WORD}p":
                yield said(e)
            elif e.tag == f"{WORD}tbl":
                yield from (" | ".join("\n".join(lines(c)) for c in r.findall(f"{WORD}tc")) for r in e.findall(f"{WORD}tr"))

    return "\n".join(lines(body))


def decoded(kind: str, content: bytes) -> str | None:
    """The text of a file, null for a kind that is only checked; raises what is wrong with it."""
    if kind == "docx":
        return docx_text(content)
    if kind == "pdf":
        if b"%PDF-" not in content[:1024]:
            raise ValueError("no pdf header")
        return None
    return content.decode("utf-8-sig")


class Part(InputPartition):
    def __init__(self, files: list[tuple[str, int, str]]) -> None:
        self.files = files  # path, length, time of change


class _Folder:
    """What the batch and the stream reader share: listing, packing into partitions by bytes, reading."""

    def __init__(self, options) -> None:
        self.root = options["path"]
        self.supported = [k.strip() for k in options.get("supported", "pdf,docx,txt,md").split(",")]
        self.most = int(options.get("maxBytes", 1 << 30))
        self.bytes, self.files = int(options.get("partitionBytes", 64 << 20)), int(options.get("partitionFiles", 4096))
        self.content = options.get("content", "true").lower() == "true"

    def listed(self) -> list[tuple[str, int, str]]:
        fs, at = opened(self.root)
        found = fs.get_file_info(pfs.FileSelector(at, recursive=True))
        hidden = [f for f in found if f.is_file and not any(p.startswith(("_", ".")) for p in f.path[len(at) :].strip("/").split("/"))]
        return sorted((f.path, f.size, f.mtime.isoformat()) for f in hidden)

    def packed(self, files: list[tuple[str, int, str]]) -> list[Part]:
        parts, held = [[]], 0
        for f in files:
            if parts[-1] and (held + f[1] > self.bytes or len(parts[-1]) >= self.files):
                parts.append([])
                held = 0
            parts[-1].append(f)
            held += f[1]
        return [Part(p) for p in parts]

    def row(self, fs: pfs.FileSystem, path: str, length: int, modified: str) -> tuple:
        kind, content, text, error = kind_of(path), None, None, None
        if kind not in self.supported:
            error = f"unsupported type: {kind}"
        elif length > self.most:
            error = f"too large: {length} bytes"
        else:
            try:
                with fs.open_input_stream(path) as f:
                    content = f.read()
                text = decoded(kind, content)
            except Exception as e:  # whatever a broken file raises is said of that file alone
                error = f"unreadable: {type(e).__name__}"
        return path, kind, length, datetime.fromisoformat(modified), content if self.content else None, text, error

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        fs, _ = opened(self.root)
        rows, held = [], 0
        for f in part.files:
            rows.append(self.row(fs, *f))
            held += f[1]
            if held > 16 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), BATCH)], schema=BATCH)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), BATCH)], schema=BATCH)


class FolderReader(_Folder, DataSourceReader):
    def partitions(self) -> list[Part]:
        return self.packed(self.listed())


class FolderStreamReader(_Folder, DataSourceStreamReader):
    """New and changed files. An offset is the number of an entry in a log of files beside the checkpoint, so a batch that is
    run again reads the same files, and a file that arrives with an old time of change is still new."""

    def __init__(self, options) -> None:
        super().__init__(options)
        self.fs, self.log = opened(options["log"])
        self.fs.create_dir(self.log, recursive=True)
        names = [f.base_name for f in self.fs.get_file_info(pfs.FileSelector(self.log)) if f.is_file]
        self.last = max((int(n) for n in names if n.isdigit()), default=0)
        self.seen = {(path, modified) for n in range(1, self.last + 1) for path, _, modified in self.entry(n)}

    def entry(self, number: int) -> list[tuple[str, int, str]]:
        with self.fs.open_input_stream(f"{self.log}/{number:010d}") as f:
            return [tuple(x) for x in json.loads(f.read())]

    def initialOffset(self) -> dict:
        return {"entry": 0}

    def latestOffset(self) -> dict:
        new = [f for f in self.listed() if (f[0], f[2]) not in self.seen]
        if new:
            draft = f"{self.log}/.{uuid.uuid4().hex}"
            with self.fs.open_output_stream(draft) as f:
                f.write(json.dumps(new).encode())
            self.fs.move(draft, f"{self.log}/{self.last + 1:010d}")  # an entry is there at once or not at all
            self.last += 1
            self.seen.update((path, modified) for path, _, modified in new)
        return {"entry": self.last}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        # A file that changed between two entries is read once, as it is now.
        files = {f[0]: f for n in range(start["entry"] + 1, end["entry"] + 1) for f in self.entry(n)}
        return self.packed(sorted(files.values()))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("fs", "seen")}  # tasks need neither


class FolderWriter(DataSourceArrowWriter):
    """Writes path (below the root) and content. A file appears whole, and a task that runs again puts the same in its place."""

    def __init__(self, root: str) -> None:
        self.root = root

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, at = opened(self.root)
        made = set()
        for batch in iterator:
            for path, content in zip(batch.column("path"), batch.column("content")):
                path = path.as_py()
                if not path or path.startswith("/") or ".." in path.split("/"):
                    raise ValueError(f"not a path below the folder: {path!r}")
                folder, _, name = f"{at}/{path}".rpartition("/")
                if folder not in made:
                    fs.create_dir(folder, recursive=True)
                    made.add(folder)
                draft = f"{folder}/.{uuid.uuid4().hex}"
                with fs.open_output_stream(draft) as f:
                    f.write(content.as_buffer() if content.is_valid else b"")
                fs.move(draft, f"{folder}/{name}")
        return WriterCommitMessage()


class DocumentFiles(DataSource):
    """Format `document_files`: path, kind, length, modified, content, text, error of the files below `path`.

    `supported` kinds get content, and text if they are plain or docx; all other files, those over `maxBytes`, and those
    that cannot be read as what their name says get an error instead of text. Names that begin with _ or . are
    hidden. The driver lists the folder, as Spark's own file sources do, and packs files into partitions of
    `partitionBytes`. Paths are those that pyarrow can open (local and mounted ones, hdfs, s3, gs), not all that Hadoop can. A stream needs `log`, a folder that it keeps its entries in. Without `content` bytes stay where they are read.
    """

    @classmethod
    def name(cls) -> str:
        return "document_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FolderReader:
        return FolderReader(self.options)

    def streamReader(self, schema) -> FolderStreamReader:
        return FolderStreamReader(self.options)

    def writer(self, schema, overwrite: bool) -> FolderWriter:
        if overwrite:
            raise ValueError("document files are added or put in place of files of the same path: use mode('append')")
        return FolderWriter(self.options["path"])


def document_files(spark: SparkSession, path: str, **options) -> DataFrame:
    """The files below a path; see DocumentFiles."""
    spark.dataSource.register(DocumentFiles)
    return spark.read.format("document_files").options(path=path, **options).load()


def document_stream(spark: SparkSession, path: str, log: str, **options) -> DataFrame:
    """New and changed files below a path as a stream; log is a folder of this stream alone, kept as long as its checkpoint."""
    spark.dataSource.register(DocumentFiles)
    return spark.readStream.format("document_files").options(path=path, log=log, **options).load()


def write_files(rows: DataFrame, path: str) -> None:
    """Write path (relative) and content of each row as a file below path, null contents as empty files."""
    rows.sparkSession.dataSource.register(DocumentFiles)
    rows.select("path", "content").write.format("document_files").mode("append").option("path", path).save()
