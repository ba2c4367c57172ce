"""Reference sequences in FASTA files: a PySpark Python data source over the line index (``.fai``) beside each file.

Reading gives the chunks that :func:`lociframe.operators.snv.chunk_genome`
gives, without a row that holds a whole sequence.  A partition is a byte
range of a file; the index says which chunks begin in it and where their
bytes are.  Predicates on the sequence name, the chunk and its place are
pushed down: chunks that fail them are never read, and ranges without any
are not planned.  Writing makes files with their indexes in two phases, so
that a lost or repeated task leaves no trace.
"""

from __future__ import annotations

import operator
import re
import uuid
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage

NAME = "lociframe_fasta"
SCHEMA = "chr string, chunk long, chunk_start long, seq string, length long"
ENDINGS = (".fa", ".fasta", ".fna")
HELD = 4 << 20  # bytes of sequence held at a time
PLANNED_INDEX = 4 << 20  # bytes of the largest index that planning reads to leave out ranges; tasks read larger ones
COMPARE = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le}


def _files(path: str) -> tuple[pafs.FileSystem, list[pafs.FileInfo]]:
    """The FASTA files at ``path``, a file or a folder; hidden ones are left out."""
    fs, at = pafs.FileSystem.from_uri(path)
    info = fs.get_file_info(at)
    infos = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(at, recursive=True))
    return fs, sorted((i for i in infos if i.type == pafs.FileType.File and i.base_name.endswith(ENDINGS) and not i.base_name.startswith(("_", "."))), key=lambda i: i.path)


@dataclass(frozen=True)
class Entry:
    """One line of an index: a sequence of ``length`` bases from byte ``offset`` on, ``bases`` in each line of ``width`` bytes."""

    name: str
    length: int
    offset: int
    bases: int
    width: int

    def byte(self, base: int) -> int:
        """The byte of a base, counted from 0."""
        return self.offset + base // self.bases * self.width + base % self.bases


def read_index(fs: pafs.FileSystem, path: str) -> Iterator[Entry]:
    """Entries of an index file, a part of it at a time; sequences without bases are left out."""
    rest = b""
    with fs.open_input_stream(path, buffer_size=1 << 20) as f:
        while more := f.read(1 << 20):
            *lines, rest = (rest + more).split(b"\n")
            yield from _entries(lines)
    yield from _entries([rest])


def _entries(lines: list[bytes]) -> Iterator[Entry]:
    for line in lines:
        if line.strip():
            name, *numbers = line.decode("utf-8").rstrip("\r").split("\t")
            entry = Entry(name, *map(int, numbers[:4]))
            if entry.length:
                yield entry


class ByteWindow:
    """A file read forwards in stretches of a megabyte, so that small sequences don't cost a read each."""

    def __init__(self, f, size: int):
        self.f, self.size, self.at, self.data = f, size, 0, b""

    def get(self, lo: int, hi: int) -> bytes:
        if not self.at <= lo <= hi <= self.at + len(self.data):
            self.f.seek(lo)
            self.at, self.data = lo, self.f.read(min(max(hi - lo, 1 << 20), self.size - lo))
        return self.data[lo - self.at : hi - self.at]


@dataclass
class ByteRange(InputPartition):
    path: str
    size: int
    low: int
    high: int


class FastaSource(DataSource):
    """``spark.read.format("lociframe_fasta").load(path)``: (chr, chunk, chunk_start, seq, length).

    Options: ``path``, a file or folder; ``width`` (10000) and ``margin``
    (25) of the chunks; ``upper`` (true) turns soft-masked bases into plain
    ones; ``range_bytes`` (32 MB) of a partition; ``pushdown`` (false) takes
    predicates, see :func:`read_fasta`; ``line`` (write: 60 bases a
    line); ``file_bytes`` (write: a new file is begun beyond).
    """

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        options = dict(self.options)
        return (PruningReader if str(options.get("pushdown", "false")).lower() == "true" else FastaReader)(options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return FastaWriter(dict(self.options), overwrite)


class FastaReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        o = {k.lower(): v for k, v in options.items()}
        self.path, self.width, self.margin = o["path"], int(o.get("width", 10_000)), int(o.get("margin", 25))
        self.upper, self.range_bytes = o.get("upper", "true").lower() == "true", int(o.get("range_bytes", 32 << 20))
        if min(self.width, self.range_bytes) < 1 or self.margin < 0:
            raise ValueError("width and range_bytes are positive, margin is not negative")
        self.tests: list[tuple[str, object, object]] = []

    def _holds(self, **values) -> bool:
        return all(test(values[name], wanted) for name, test, wanted in self.tests if name in values)

    def _first(self, chunk: int) -> int:
        return max(0, chunk * self.width - self.margin)

    def _wanted(self, entry: Entry, low: int, high: int) -> Iterator[int]:
        """The chunks of a sequence whose own part begins in the byte range and that the predicates leave."""
        if self._holds(chr=entry.name, length=entry.length):
            chunks = range(-(-entry.length // self.width))
            own = lambda k: entry.byte(k * self.width)
            for k in chunks[bisect_left(chunks, low, key=own) : bisect_left(chunks, high, key=own)]:
                if self._holds(chunk=k, chunk_start=self._first(k) + 1):
                    yield k

    def partitions(self):
        fs, files = _files(self.path)
        out: list[ByteRange] = []
        for i in files:
            index = fs.get_file_info(f"{i.path}.fai")
            if index.type != pafs.FileType.File:
                raise ValueError(f"no index beside {i.path}; make it with index_fasta")
            ranges = [ByteRange(i.path, i.size, low, low + self.range_bytes) for low in range(0, i.size, self.range_bytes)]
            if self.tests and index.size <= PLANNED_INDEX:
                entries = list(read_index(fs, index.path))
                ranges = [r for r in ranges if any(True for e in entries for _ in self._wanted(e, r.low, r.high))]
            out += ranges
        return out

    def read(self, partition: ByteRange | None):
        if partition is None:  # nothing to read
            return
        fs, _ = pafs.FileSystem.from_uri(self.path)
        schema = pa.schema([("chr", pa.string()), ("chunk", pa.int64()), ("chunk_start", pa.int64()), ("seq", pa.string()), ("length", pa.int64())])
        rows, held = [], 0
        with fs.open_input_file(partition.path) as raw:
            window = ByteWindow(raw, partition.size)
            for entry in read_index(fs, f"{partition.path}.fai"):
                if entry.offset >= partition.high or entry.byte(entry.length - 1) < partition.low:
                    continue
                for k in self._wanted(entry, partition.low, partition.high):
                    first, last = self._first(k), min(entry.length, (k + 1) * self.width + self.margin) - 1
                    text = window.get(entry.byte(first), entry.byte(last) + 1).translate(None, b"\r\n")
                    if len(text) != last - first + 1 or b">" in text:
                        raise ValueError(f"the index of {partition.path} does not fit it at {entry.name}")
                    rows.append((entry.name, k, first + 1, (text.upper() if self.upper else text).decode("ascii"), entry.length))
                    held += len(text) + 64
                    if held > HELD:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


class PruningReader(FastaReader):
    """With predicates; Spark accepts such a reader only in sessions that hand predicates to Python sources."""

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name not in ("chr", "chunk", "chunk_start", "length"):
                yield f
            elif isinstance(f, In):
                self.tests.append((name, lambda x, values: x in values, frozenset(f.value)))
            elif type(f) in COMPARE and f.value is not None:
                self.tests.append((name, COMPARE[type(f)], f.value))
            elif not isinstance(f, IsNotNull):  # none of these columns is ever null
                yield f


@dataclass
class Written(WriterCommitMessage):
    files: list


class FastaWriter(DataSourceArrowWriter):
    """Files of (chr, seq) rows and their indexes; hidden until the job commits."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        o = {k.lower(): v for k, v in options.items()}
        self.path, self.line, self.limit = o["path"], int(o.get("line", 60)), int(o.get("file_bytes", 1 << 30))
        self.overwrite, self.run = overwrite, uuid.uuid4().hex

    def write(self, iterator):
        fs, path = pafs.FileSystem.from_uri(self.path)
        fs.create_dir(path, recursive=True)
        task = TaskContext.get()
        stem = f"_{self.run}-{task.partitionId():06d}-{task.taskAttemptId()}" if task else f"_{self.run}-0-{uuid.uuid4().hex}"
        files, out, index, n = [], None, None, 0
        for batch in iterator:
            for name, text in zip(batch.column("chr").to_pylist(), batch.column("seq").to_pylist(), strict=True):
                if not re.fullmatch(r"\S+", name) or not re.fullmatch(r"[A-Za-z*.\-]+", text):
                    raise ValueError(f"a sequence needs a name without blanks and letters, '*', '-' or '.' only: {name!r}")
                if out is None or n > self.limit:
                    if out is not None:
                        out.close(), index.close()
                    files.append(f"{stem}-{len(files):04d}.fa")
                    out, index, n = (*(fs.open_output_stream(f"{path}/{files[-1]}{end}", compression=None, buffer_size=1 << 20) for end in ("", ".fai")), 0)
                head = f">{name}\n".encode()
                index.write(f"{name}\t{len(text)}\t{n + len(head)}\t{self.line}\t{self.line + 1}\n".encode())
                out.write(head)
                n += len(head)
                for at in range(0, len(text), self.line << 14):
                    part = text[at : at + (self.line << 14)]
                    lines = "".join(part[i : i + self.line] + "\n" for i in range(0, len(part), self.line)).encode("ascii")
                    out.write(lines)
                    n += len(lines)
        if out is not None:
            out.close(), index.close()
        return Written(files)

    def _delete(self, which) -> None:
        fs, path = pafs.FileSystem.from_uri(self.path)
        if fs.get_file_info(path).type == pafs.FileType.Directory:
            for i in fs.get_file_info(pafs.FileSelector(path)):
                if i.type == pafs.FileType.File and which(i.base_name):
                    fs.delete_file(i.path)

    def commit(self, messages) -> None:
        fs, path = pafs.FileSystem.from_uri(self.path)
        fs.create_dir(path, recursive=True)
        for f in (f for m in messages if m for f in m.files):
            for end in (".fai", ""):
                fs.move(f"{path}/{f}{end}", f"{path}/part-{f[1:]}{end}")
        self._delete(lambda name: name.startswith(f"_{self.run}") or self.overwrite and name.endswith((*ENDINGS, ".fai")) and not name.startswith(("_", f"part-{self.run}")))

    def abort(self, messages) -> None:
        self._delete(lambda name: name.startswith(f"_{self.run}"))


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    spark.dataSource.register(FastaSource)


def read_fasta(spark: SparkSession, path: str, width: int = 10_000, margin: int = 25, **options) -> DataFrame:
    """Chunks of all sequences under ``path``.

    Predicates reach the files in sessions that set
    ``spark.sql.python.filterPushdown.enabled`` (not changed here); results
    are the same without.
    """
    register(spark)
    pushed = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format(NAME).options(width=width, margin=margin, pushdown=pushed, **options).load(path)


def write_fasta(seq: DataFrame, path: str, mode: str = "append", **options) -> None:
    """Write (chr, seq) rows as FASTA with indexes.  Rows without a name or a base are left out; other columns are ignored."""
    register(seq.sparkSession)
    d = seq.select(F.col("chr").cast("string").alias("chr"), F.col("seq").cast("string").alias("seq")).where("chr <> '' and seq <> ''")
    d.write.format(NAME).options(**options).mode(mode).save(path)


def index_lines(f) -> Iterator[str]:
    """The index of one FASTA file, read as a stream: (name, length, offset, bases, width) lines.

    Lines of one sequence must be equally long but for the last; the file may
    end without a line break, and lines may end in CR LF.
    """
    name, at, length, offset, bases, width, short = None, 0, 0, 0, 0, 0, False

    def entry() -> str:
        return f"{name}\t{length}\t{offset}\t{bases or 1}\t{width or 2}\n"

    line, whole = 0, True  # bytes of the line so far; whether the last piece ended its line
    while piece := f.readline(1 << 20):
        if whole and piece[:1] == b">":
            if name is not None:
                yield entry()
            while not piece.endswith(b"\n") and (more := f.readline(1 << 20)):
                piece += more
            at += len(piece)
            name, length, offset, bases, width, short = (piece[1:].split() or [b""])[0].decode("utf-8"), 0, at, 0, 0, False
            continue
        at += len(piece)
        line += len(piece)
        whole = piece.endswith(b"\n")
        text = piece.rstrip(b"\r\n")
        if name is None and text:
            raise ValueError("text before the first name")
        if text and short:
            raise ValueError(f"lines of different lengths in {name}")
        length += len(text)
        if whole:
            own = line - (2 if piece.endswith(b"\r\n") else 1)
            if not width:
                bases, width = own, line
            if line > width:
                raise ValueError(f"lines of different lengths in {name}")
            short, line = short or line < width or own == 0, 0
    if line:
        if not width:
            bases, width = line, line + 1
        if line > bases:
            raise ValueError(f"lines of different lengths in {name}")
    if name is not None:
        yield entry()


def index_fasta(spark: SparkSession, path: str) -> int:
    """Make the indexes that are missing under ``path``; returns how many.  A file is streamed by one task and never held."""
    fs, files = _files(path)
    todo = [i.path for i in files if fs.get_file_info(f"{i.path}.fai").type == pafs.FileType.NotFound]
    if not todo:
        return 0

    def run(batches):
        import io

        fs, _ = pafs.FileSystem.from_uri(path)
        for b in batches:
            for at in b.column("path").to_pylist():
                hidden = f"{at.rpartition('/')[0]}/_{uuid.uuid4().hex}.fai"
                with fs.open_input_file(at) as raw, fs.open_output_stream(hidden, compression=None, buffer_size=1 << 20) as out:
                    for text in index_lines(io.BufferedReader(raw, 1 << 20)):
                        out.write(text.encode("utf-8"))
                fs.move(hidden, f"{at}.fai")
                yield pa.RecordBatch.from_arrays([pa.array([1], pa.int64())], ["n"])

    names = spark.createDataFrame([(p,) for p in todo], "path string").repartition(len(todo))
    return names.mapInArrow(run, "n long").agg(F.sum("n")).first()[0]
