"""A sink that writes one file per document, whatever the number of its pages.

Rows are pieces of pages in order; a task appends them to the files of the document it is at and holds one batch of rows.
Files grow under a temporary name and get their own when the document ends, so a repeated task leaves the same files and
a reader sees whole ones only. A task that has written documents lists them in a file of its own; the commit of a job
adds the lists of the tasks that count, that of the last job a mark too, and an abort removes what has no name yet. The
files are read back by these lists in tasks, so nothing collects the names of all files.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

DONE = "_SUCCESS"
LISTS = "_documents"
LIST_SCHEMA = pa.schema([("unit_id", pa.int64()), ("rel_dir", pa.string()), ("stem", pa.string())])
#: Documents that a task lists at a time, and bytes of files that a reading task passes on at a time.
LIST_ROWS, READ_BYTES = 10_000, 1 << 22
#: Spark's setting that removes the shuffle files of a query when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
SCHEMA = "unit_id bigint, rel_dir string, stem string, page_idx int, fragment int, page_json string, raw_json string, page_text string"


def filesystem(out: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a folder named by a path or a URI."""
    if "://" not in out and not out.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), out
    return pyarrow.fs.FileSystem.from_uri(quote(out, safe=":/%"))


class Growing:
    """A file that is opened with its first text."""

    def __init__(self, fs: pyarrow.fs.FileSystem, folder: str, name: str, temporary: str):
        self.fs, self.folder, self.name = fs, folder, name
        self.temporary = f"{temporary}/{uuid.uuid4().hex}"
        self.stream = None

    def write(self, text: str) -> None:
        if self.stream is None:
            self.stream = self.fs.open_output_stream(self.temporary)
        self.stream.write(text.encode("utf-8"))

    def finish(self) -> None:
        if self.stream is not None:
            self.stream.close()
            self.fs.create_dir(self.folder, recursive=True)
            self.fs.move(self.temporary, f"{self.folder}/{self.name}")


class Lists:
    """A JSON list of pages, each a list that may come in several pieces; pages without a list count as empty.

    A file that may be left out begins with the first page that has one.
    """

    def __init__(self, file: Growing, optional: bool):
        self.file, self.optional = file, optional
        self.pages, self.filled, self.begun = 0, False, False

    def page(self) -> None:
        if self.begun:
            self.file.write("],[")
        self.pages += 1
        self.filled = False

    def add(self, piece: str | None) -> None:
        if not self.begun and (piece is not None or not self.optional):
            self.file.write("[" + "[]," * (self.pages - 1) + "[")
            self.begun = True
        inner = (piece or "[]").strip()[1:-1].strip()
        if inner:
            self.file.write("," * self.filled + inner)
            self.filled = True

    def finish(self) -> None:
        if self.begun:
            self.file.write("]]")
        self.file.finish()


class Text:
    """Page texts with blank lines between them; a text that is blank as a whole makes no file."""

    def __init__(self, file: Growing):
        self.file, self.waiting, self.seen, self.first, self.filled = file, [], False, True, False

    def page(self) -> None:
        if not self.first:
            self.put("\n\n")
        self.first = self.filled = False

    def add(self, piece: str | None) -> None:
        if piece:
            self.put("\n\n" * self.filled + piece)
            self.filled = True

    def put(self, text: str) -> None:
        self.seen = self.seen or bool(text.strip())
        if self.seen:
            for held in [*self.waiting, text]:
                self.file.write(held)
            self.waiting = []
        else:
            self.waiting.append(text)

    def finish(self) -> None:
        self.file.finish()


def folder_of(out: str, rel_dir: str | None, stem: str) -> str:
    return "/".join(p for p in (out.rstrip("/"), (rel_dir or "").strip("/"), stem) if p)


class Names:
    """The list of the documents of a task, written as it grows."""

    def __init__(self, fs: pyarrow.fs.FileSystem, path: str):
        self.writer = pyarrow.parquet.ParquetWriter(path, LIST_SCHEMA, filesystem=fs)
        self.rows: list[tuple] = []

    def add(self, key: tuple) -> None:
        self.rows.append(key)
        if len(self.rows) >= LIST_ROWS:
            self.flush()

    def flush(self) -> None:
        columns = [pa.array(c, k) for c, k in zip(zip(*self.rows), LIST_SCHEMA.types)]
        self.writer.write_batch(pa.RecordBatch.from_arrays(columns, schema=LIST_SCHEMA))
        self.rows = []

    def finish(self) -> None:
        if self.rows:
            self.flush()
        self.writer.close()


class Document:
    """The files of one document, to which its rows are appended in order."""

    def __init__(self, fs: pyarrow.fs.FileSystem, out: str, rel_dir: str | None, stem: str, temporary: str):
        folder = folder_of(out, rel_dir, stem)
        self.json = Lists(Growing(fs, folder, f"{stem}.json", temporary), optional=False)
        self.raw = Lists(Growing(fs, folder, f"{stem}_model.json", temporary), optional=True)
        self.text = Text(Growing(fs, folder, f"{stem}.md", temporary))
        self.page_idx: int | None = None

    def add(self, page_idx: int, page_json: str | None, raw_json: str | None, page_text: str | None) -> None:
        parts = ((self.json, page_json), (self.raw, raw_json), (self.text, page_text))
        for part, piece in parts:
            if page_idx != self.page_idx:
                part.page()
            part.add(piece)
        self.page_idx = page_idx

    def finish(self) -> None:
        for part in (self.json, self.raw, self.text):
            part.finish()


@dataclass
class Written(WriterCommitMessage):
    n_documents: int
    names: str | None


class FileWriter(DataSourceArrowWriter):
    def __init__(self, out: str, last: bool):
        self.out, self.last = out, last
        self.job = uuid.uuid4().hex

    def place(self) -> tuple[pyarrow.fs.FileSystem, str, str]:
        fs, root = filesystem(self.out)
        return fs, root, f"{root.rstrip('/')}/_temporary/{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, root, temporary = self.place()
        fs.create_dir(temporary, recursive=True)
        document, key, n, listed, path = None, None, 0, None, None
        columns = ("unit_id", "rel_dir", "stem", "page_idx", "page_json", "raw_json", "page_text")
        for batch in iterator:
            for unit, rel_dir, stem, page, *pieces in zip(*(batch.column(c).to_pylist() for c in columns)):
                if (unit, rel_dir, stem) != key:
                    if document:
                        document.finish()
                    if listed is None:
                        path = f"{temporary}/{uuid.uuid4().hex}.parquet"
                        listed = Names(fs, path)
                    document, key, n = Document(fs, root, rel_dir, stem, temporary), (unit, rel_dir, stem), n + 1
                    listed.add(key)
                document.add(page, *pieces)
        if document:
            document.finish()
            listed.finish()
        return Written(n, path)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root, temporary = self.place()
        lists = f"{root.rstrip('/')}/{LISTS}"
        fs.create_dir(lists, recursive=True)
        for k, message in enumerate(messages):
            if message is not None and message.names is not None:
                fs.move(message.names, f"{lists}/{self.job}-{k}.parquet")
        self.clear(fs, temporary)
        if self.last:
            fs.open_output_stream(f"{root.rstrip('/')}/{DONE}").close()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, _, temporary = self.place()
        self.clear(fs, temporary)

    def clear(self, fs: pyarrow.fs.FileSystem, temporary: str) -> None:
        if fs.get_file_info(temporary).type == pyarrow.fs.FileType.Directory:
            fs.delete_dir(temporary)


class DocumentFiles(DataSource):
    """``df.write.format("document_files").mode("append").save(folder)``; rows as in ``SCHEMA``, sorted by document and page."""

    @classmethod
    def name(cls) -> str:
        return "document_files"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> FileWriter:
        if overwrite:
            raise ValueError("files of documents are replaced one by one; use append")
        return FileWriter(self.options["path"], self.options.get("last", "true") == "true")


def write_document_pages(pages: DataFrame, out: str, slices: int = 1) -> None:
    """One folder per document with ``<stem>.json``, ``<stem>_model.json`` where there is raw JSON, ``<stem>.md`` where there is text.

    ``pages`` has the columns of ``SCHEMA``, a row per page or per piece of a page; no row or task ever holds a whole
    document. Documents must differ in ``(rel_dir, stem)``. ``out`` is a folder, path or URI, that all executors share.
    :func:`read_document_files` reads the files back.

    The documents are dealt by ``unit_id`` to ``slices`` jobs, one after the other. The shuffle files of a job go when it
    ends, so beside the documents the disk holds those of one slice only.
    """
    spark = pages.sparkSession
    spark.dataSource.register(DocumentFiles)
    names = [part.split()[0] for part in SCHEMA.split(", ")]
    document = ["rel_dir", "stem", "unit_id"]
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        for k in range(slices):
            # the optimizer takes the condition down to the scans
            part = pages.where(F.pmod(F.xxhash64("unit_id"), F.lit(slices)) == k) if slices > 1 else pages
            rows = part.select(*names).repartition(*document).sortWithinPartitions(*document, "page_idx", "fragment")
            rows.write.format("document_files").mode("append").option("last", k == slices - 1).save(out)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def read_document_files(spark: SparkSession, out: str) -> DataFrame:
    """The files of every document written to ``out``: ``unit_id, rel_dir, stem, json, md``; ``md`` is null where there is none.

    Tasks read the files that the lists of the writing tasks name, some MB of them at a time, and fail where a JSON file
    is missing. A document written again is read once.
    """
    schema = "unit_id bigint, rel_dir string, stem string, json string, md string"
    fields = pa.schema([*LIST_SCHEMA, ("json", pa.string()), ("md", pa.string())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(out)

        def content(path: str) -> str:
            with fs.open_input_stream(path, compression=None) as f:
                return f.read().decode("utf-8")

        def flush(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), fields.types)], schema=fields)

        rows, size = [], 0
        for batch in batches:
            for unit, rel_dir, stem in zip(*(c.to_pylist() for c in batch.columns)):
                path = f"{folder_of(root, rel_dir, stem)}/{stem}"
                text = fs.get_file_info(f"{path}.md").type == pyarrow.fs.FileType.File
                rows.append((unit, rel_dir, stem, content(f"{path}.json"), content(f"{path}.md") if text else None))
                size += len(rows[-1][3]) + len(rows[-1][4] or "")
                if size >= READ_BYTES:
                    yield flush(rows)
                    rows, size = [], 0
        if rows:
            yield flush(rows)

    names = [f.name for f in LIST_SCHEMA]
    kinds = "unit_id bigint, rel_dir string, stem string"
    listed = spark.read.schema(kinds).parquet(f"{out.rstrip('/')}/{LISTS}").select(*names).distinct()
    # the names are small beside the files, so Spark must not join their partitions
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return listed.repartition(parts, *names).mapInArrow(read, schema)
