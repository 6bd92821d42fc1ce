"""Model files as tables: listing, decoding, search of raw bytes, and overlapping chunks.

``model_files`` is a Python data source whose partitions are read on the executors by memory map, so that a file of any size costs
little memory, and files without a byte are listed too, which the built-in binary source leaves out. Its paths must be mounted on
all executors; for object stores ``from_binary`` decodes what ``spark.read.format("binaryFile")`` yields. Decoding and search give
small rows only: neither raw bytes nor pickle streams leave the worker that reads them.
"""

from __future__ import annotations

import mmap
import os
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from argil.functions import decode, search
from argil.functions.dims import CANDIDATE_EXTENSIONS, OVERLAP
from argil.functions.schema import CHUNKS, DECODED, PIECES

#: Bytes of a chunk that is given out, and of a share that is searched in place.
CHUNK, SHARE = 8 << 20, 256 << 20
#: Small files that one task decodes.
FILES_A_TASK = 64
#: Rows, and about the bytes, that a batch of decoded rows takes; a longer row has one of its own.
ROWS, BYTES = 256, 1 << 20
_LISTERS = 32


def list_targets(path: str, recursive: bool = False) -> list[str]:
    """A file is its own target, whatever its name; of a folder those with a model's extension, in the order of paths."""
    if os.path.isfile(path):
        return [path]
    found = []
    for folder, folders, files in os.walk(path):
        found += [os.path.join(folder, f) for f in files if decode.extension(f) in CANDIDATE_EXTENSIONS and os.path.isfile(os.path.join(folder, f))]
        if not recursive:
            folders.clear()
    return sorted(found)


class _Files(InputPartition):
    def __init__(self, files: list[tuple[str, int, int]]) -> None:
        self.files = files  # path, offset, length


class _Mapped:
    """A read-only map of a file; an empty file is empty bytes."""

    def __init__(self, path: str) -> None:
        self.path = path

    def __enter__(self) -> mmap.mmap | bytes:
        with open(self.path, "rb") as f:
            self.data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) if os.fstat(f.fileno()).st_size else b""
        return self.data

    def __exit__(self, *_: object) -> None:
        if isinstance(self.data, mmap.mmap):
            try:
                self.data.close()
            except BufferError:  # a reader that failed may hold a view until it is collected
                pass


_ARROW = to_arrow_schema(DECODED)
_NONE = dict.fromkeys(DECODED.names)


def _batch(rows: list[dict]) -> pa.RecordBatch:
    for row in rows:
        if row.get("tensor_count") is not None:
            row["tensor_count"] = Decimal(row["tensor_count"])
        if "metadata" in row:
            row["metadata"] = [{"key": k, "value": v} for k, v in row["metadata"]]
        for s in row.get("streams", ()):
            s["imports"] = [{"module": m, "name": n, "offset": o} for m, n, o in s["imports"]]
    return pa.RecordBatch.from_pylist([_NONE | row for row in rows], schema=_ARROW)


def _sized(row: dict) -> tuple[int, dict]:
    """A row and about the bytes that it takes. A text that can't be encoded raises here, while its file is read."""
    streams = row.get("streams", ())
    pairs = [*row.get("metadata", ()), *((m, n) for s in streams for m, n, _ in s["imports"]), *((s["name"], "") for s in streams), *((h["hit"], "") for h in row.get("hits", ()))]
    return 256 + 32 * len(pairs) + len("".join(x for pair in pairs for x in pair).encode()), row


def _batches(rows: Iterable[tuple[int, dict]]) -> Iterator[pa.RecordBatch]:
    """Sized rows put together to small batches, as one for each file would cost more than its decoding."""
    held: list[dict] = []
    size = 0
    for own, row in rows:
        if held and size + own > BYTES:
            yield _batch(held)
            held, size = [], 0
        held.append(row)
        size += own
        if len(held) == ROWS:
            yield _batch(held)
            held, size = [], 0
    if held:
        yield _batch(held)


def _found(path: str, data: mmap.mmap | bytes, begin: int, end: int) -> Iterator[tuple[int, dict]]:
    """Credentials of a share of raw bytes, some thousands a row."""
    held: list[dict] = []
    for rule, offset, hit in search.hits(data, begin, end):
        held.append({"rule": rule, "offset": offset, "hit": hit})
        if len(held) == 4096:
            yield _sized({"path": path, "hits": held})
            held = []
    if held:
        yield _sized({"path": path, "hits": held})


def _decoded(path: str, data: mmap.mmap | bytes) -> Iterator[tuple[int, dict]]:
    for row in decode.read_artifact(path, data):
        yield _sized(row | {"path": path} | ({"size": len(data)} if row.get("head") else {}))


def _failed(path: str | None, error: Exception) -> tuple[int, dict]:
    return _sized({"path": path, "error": f"opening {path}: {error}"})


def _size(path: str) -> int:
    try:
        return os.path.getsize(path)
    except OSError:  # reading it gives the error row
        return 0


def _grouped(spans: list[tuple[str, int, int]]) -> list[InputPartition]:
    """Spans put together to tasks of about ``SHARE`` bytes."""
    out, held, size = [], [], 0
    for s in spans:
        if held and size + s[2] > SHARE:
            out.append(_Files(held))
            held, size = [], 0
        held.append(s)
        size += s[2]
    return [*out, _Files(held)] if held else out


class _Reader(DataSourceReader):
    def __init__(self, path: str, recursive: bool, mode: str, size: int, raw: bool) -> None:
        self.path, self.recursive, self.mode, self.size, self.raw = path, recursive, mode, size, raw

    def partitions(self) -> list[InputPartition]:
        files = list_targets(self.path, self.recursive)
        whole = [_Files([(f, 0, -1) for f in files[k : k + FILES_A_TASK]]) for k in range(0, len(files), FILES_A_TASK)]
        if self.mode == "streams":
            return whole or [_Files([])]
        spans = []
        if self.mode == "chunks" or self.raw:
            with ThreadPoolExecutor(_LISTERS) as pool:
                sizes = list(pool.map(_size, files))
            spans = _grouped([(f, at, min(self.size, n - at)) for f, n in zip(files, sizes) for at in range(0, n, self.size)])
        return (spans if self.mode == "chunks" else whole + spans) or [_Files([])]

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        """Rows of each file or span."""
        found = self._rows(partition)
        yield from _batches(found) if self.mode == "decoded" else found

    def _rows(self, partition: _Files) -> Iterator:
        """Decoded rows, or batches of bytes. Whatever fails with one file, the others are read; only decoding reports it."""
        for path, at, length in partition.files:
            try:
                with _Mapped(path) as data:
                    if self.mode == "chunks":
                        yield _chunk(path, data, at, length)
                    elif self.mode == "streams":
                        yield from _pieces(path, data)
                    elif length >= 0:
                        yield from _found(path, data, *search.span(data, at, min(at + length, len(data))))
                    else:
                        yield from _decoded(path, data)
            except Exception as e:  # noqa: BLE001 - a file that can't be read must not end the job
                if self.mode == "decoded" and length < 0:
                    yield _failed(path, e)


def _chunk(path: str, data: mmap.mmap | bytes, at: int, length: int) -> pa.RecordBatch:
    # a byte before the overlap, for what a pattern asks of the byte before it
    since, last = max(0, at - OVERLAP - 1), at + length >= len(data)
    begin, end = max(0, at - OVERLAP), at + length - (0 if last else OVERLAP)
    return pa.RecordBatch.from_arrays([pa.array([path]), *(pa.array([x], pa.int64()) for x in (since, begin, end)), pa.array([data[since : at + length]], pa.binary())], names=CHUNKS.names)


def _pieces(path: str, data: mmap.mmap | bytes) -> Iterator[pa.RecordBatch]:
    for ord_, (name, open_) in enumerate(decode.streams_of(decode.detect(path, data), data)):
        with open_() as f:
            at = 0
            while piece := f.read(CHUNK):
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([ord_], pa.int32()), pa.array([name]), pa.array([at], pa.int64()), pa.array([piece], pa.binary())], names=PIECES.names)
                at += len(piece)


class ModelFiles(DataSource):
    """Options: ``path``, ``recursive`` (false), ``mode`` (``decoded``, ``chunks`` or ``streams``), ``raw`` (true: search raw bytes while
    decoding) and ``shareBytes``."""

    @classmethod
    def name(cls) -> str:
        return "model_files"

    def schema(self) -> StructType:
        return {"decoded": DECODED, "chunks": CHUNKS, "streams": PIECES}[self.options.get("mode", "decoded")]

    def reader(self, schema: StructType) -> DataSourceReader:
        o, mode = self.options, self.options.get("mode", "decoded")
        return _Reader(o["path"], o.get("recursive", "false").lower() == "true", mode, int(o.get("shareBytes", CHUNK if mode == "chunks" else SHARE)), o.get("raw", "true").lower() == "true")


def _load(spark: SparkSession, path: str, recursive: bool, **options: object) -> DataFrame:
    spark.dataSource.register(ModelFiles)
    return spark.read.format("model_files").options(path=path, recursive=str(recursive).lower(), **{k: str(v).lower() for k, v in options.items()}).load()


def decoded(spark: SparkSession, path: str, recursive: bool = False, raw: bool = True, share: int = SHARE) -> DataFrame:
    """What each target's container declares, what its raw bytes hold if ``raw``, or the error that kept it from being read."""
    return _load(spark, path, recursive, raw=raw, shareBytes=share)


def chunks(spark: SparkSession, path: str, recursive: bool = False, size: int = CHUNK) -> DataFrame:
    """Raw bytes of all targets in pieces that overlap, so that any number of tasks may read one file."""
    return _load(spark, path, recursive, mode="chunks", shareBytes=size)


def stream_pieces(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """Bytes of all pickle streams, a piece a row."""
    return _load(spark, path, recursive, mode="streams")


def decoding(raw: bool = True) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for ``mapInArrow`` that decodes batches of ``path`` and ``content`` to ``schema.DECODED``. A null content is a file
    without a byte. Where contents are made in Python it takes them in the same worker."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict]]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                path, data = path.as_py(), content.as_py() or b""
                try:
                    yield from _decoded(path or "", data)
                    if raw:
                        yield from _found(path or "", data, 0, len(data))
                except Exception as e:  # noqa: BLE001 - as in a folder
                    yield _failed(path, e)

    return lambda batches: _batches(rows(batches))


def from_binary(files: DataFrame, raw: bool = True) -> DataFrame:
    """Decode a table with ``path`` and ``content``, such as the binary source yields."""
    return files.select("path", F.col("content").cast("binary")).mapInArrow(decoding(raw), DECODED)


def pieces_of(files: DataFrame) -> DataFrame:
    """Bytes of the pickle streams of a table with ``path`` and ``content``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                yield from _pieces(path.as_py() or "", content.as_py() or b"")

    return files.select("path", F.col("content").cast("binary")).mapInArrow(run, PIECES)


def chunks_of(files: DataFrame) -> DataFrame:
    """Whole contents as chunks, for files that fit a row."""
    zero = F.lit(0).cast("long")
    return files.select("path", zero.alias("offset"), zero.alias("begin"), F.octet_length("content").cast("long").alias("end"), F.col("content").alias("bytes"))


def artifacts(found: DataFrame) -> DataFrame:
    """``(path, size, format, tensor_count, n_kv)`` of the files that could be read."""
    return found.filter("head").select("path", "size", "format", "tensor_count", "n_kv")


def metadata_kv(found: DataFrame) -> DataFrame:
    """``(path, ord, key, value)``, in the order of the file; keys may repeat."""
    return found.select("path", "first", F.posexplode("metadata").alias("n", "kv")).select("path", (F.col("first") + F.col("n")).alias("ord"), "kv.key", "kv.value")


def pickle_streams(found: DataFrame) -> DataFrame:
    """What the pickle streams hold, see ``schema.STREAM``."""
    return found.select("path", F.explode("streams").alias("s")).select("path", "s.*")


def raw_hits(found: DataFrame) -> DataFrame:
    """``(path, rule, offset, hit)`` of the credentials in raw bytes."""
    return found.select("path", F.explode("hits").alias("h")).select("path", "h.*")


def errors(found: DataFrame) -> DataFrame:
    return found.filter("error IS NOT NULL").select("path", "error")
