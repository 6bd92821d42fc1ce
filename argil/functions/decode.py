"""Decoders of model containers, free of Spark: bytes in, plain values out. Nothing is ever executed or unpickled.

``data`` may be bytes, a memory map or a memoryview. Hostile input ends a decoder early and never raises.
"""

from __future__ import annotations

import io
import json
import struct
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cache
from itertools import islice
from typing import Any

import numpy as np

from argil.functions.dims import ENTROPY_THRESHOLD, ENTROPY_WINDOW, MAX_HEADER

MAX_KV, MAX_ARRAY, MAX_STRING = 100_000, 1_000_000, 64 << 20
#: Bytes read at once; of a string or line that a pickle pushes, the bytes that are kept as a name.
PIECE, NAME = 1 << 20, 4096
#: Imports and bytes of metadata that one row takes; what is beyond goes to further rows.
IMPORTS_A_ROW, BYTES_A_ROW = 100_000, 64 << 20
STACK, STACK_DROP = 4096, 2048
LEGACY_STREAM = "archive:legacy.pkl"

_SCALARS = {0: 1, 1: 1, 7: 1, 2: 2, 3: 2, 4: 4, 5: 4, 6: 4, 10: 8, 11: 8, 12: 8}
_STRING, _ARRAY = 8, 9


Read = Callable[[int], bytes]


@dataclass
class Artifact:
    """What a container declares. ``metadata`` is an ordered list, as keys may repeat."""

    format: str
    tensor_count: int | None = None
    metadata: list[tuple[str, str]] = field(default_factory=list)


class _End(Exception):
    """The data ends or makes no sense from here on."""


class Cursor:
    def __init__(self, data: Any, at: int = 0) -> None:
        self.data, self.at, self.size = data, at, len(data)

    def take(self, n: int) -> bytes:
        if n > self.size - self.at:
            raise _End
        self.at += n
        return bytes(self.data[self.at - n : self.at])

    def skip(self, n: int) -> None:
        if n > self.size - self.at:
            raise _End
        self.at += n

    def u32(self) -> int:
        return struct.unpack("<I", self.take(4))[0]

    def u64(self) -> int:
        return struct.unpack("<Q", self.take(8))[0]

    def string(self) -> str:
        n = self.u64()
        if n > MAX_STRING:
            raise _End
        return self.take(n).decode("utf-8", "replace")

    def value(self) -> str:
        """A typed value as text: strings, and arrays of strings joined by a space; other scalars are passed over as empty."""
        kind = self.u32()
        if kind == _STRING:
            return self.string()
        if kind == _ARRAY:
            inner, n = self.u32(), self.u64()
            if n > MAX_ARRAY:
                raise _End
            if inner == _STRING:
                return " ".join([self.string() for _ in range(n)])
            kind, n = inner, n
        else:
            n = 1
        if kind not in _SCALARS:
            raise _End
        self.skip(_SCALARS[kind] * n)
        return ""


def gguf_pairs(data: Any, out: Artifact) -> Iterator[tuple[str, str]]:
    """Metadata of a GGUF file, pair by pair, up to the first that can't be read; empty values are left out."""
    c = Cursor(data)
    try:
        if c.take(4) != b"GGUF":
            return
        count = c.u64 if c.u32() >= 2 else c.u32
        out.tensor_count, pairs = count(), count()
        for _ in range(min(pairs, MAX_KV)):
            key = c.string()
            if value := c.value():
                yield key, value
    except _End:
        pass


def read_gguf(data: Any) -> Artifact:
    """Header of a GGUF file."""
    out = Artifact("gguf")
    out.metadata = list(gguf_pairs(data, out))
    return out


def _no_constant(name: str) -> None:
    raise ValueError(name)


def read_safetensors(data: Any) -> Artifact:
    """JSON header of a safetensors file: string members of ``__metadata__`` by key, and the number of other members."""
    out = Artifact("safetensors")
    if len(data) < 8:
        return out
    (n,) = struct.unpack("<Q", bytes(data[:8]))
    if n > len(data) - 8:
        return out
    try:
        header = json.loads(bytes(data[8 : 8 + n]).decode("utf-8"), parse_constant=_no_constant)
    except (ValueError, RecursionError):
        return out
    if isinstance(header, dict):
        out.tensor_count = sum(k != "__metadata__" for k in header)
        own = header.get("__metadata__")
        if isinstance(own, dict):
            out.metadata = sorted((k, v) for k, v in own.items() if isinstance(v, str))
    return out


def zip_streams(data: Any) -> Iterator[tuple[str, Callable[[], Any]]]:
    """Pickle streams of a ZIP: stored or deflated members that end in ``.pkl`` or begin with a protocol mark, each as a name and a
    function that opens it. A member that can't be read is passed over."""
    try:
        archive = zipfile.ZipFile(_View(data))
        members = archive.infolist()
    except (zipfile.BadZipFile, ValueError, NotImplementedError, OSError, struct.error, OverflowError):
        return
    for member in members:
        if member.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED) or member.flag_bits & 1 or member.is_dir():
            continue
        try:
            with archive.open(member) as f:
                if not member.filename.endswith(".pkl") and f.read(1) != b"\x80":
                    continue
        except Exception:  # noqa: BLE001 - whatever a hostile member makes the reader raise, the others are still read
            continue
        yield f"archive:{member.filename}", lambda member=member: archive.open(member)


class _View(io.RawIOBase):
    """A file over a buffer that isn't copied."""

    def __init__(self, data: Any) -> None:
        self.data, self.at = memoryview(data), 0

    def seekable(self) -> bool:
        return True

    def readable(self) -> bool:
        return True

    def seek(self, at: int, whence: int = 0) -> int:
        to = at + (0, self.at, len(self.data))[whence]
        if to < 0:
            raise ValueError(to)
        self.at = to
        return self.at

    def tell(self) -> int:
        return self.at

    def read(self, n: int = -1) -> bytes:
        end = len(self.data) if n is None or n < 0 else self.at + n
        out = bytes(self.data[self.at : end])
        self.at += len(out)
        return out


def looks_like_pickle(data: Any) -> bool:
    first = bytes(data[:1])
    return first == b"\x80" or (first in (b"(", b"c", b"}", b"]") and len(data) > 2)


def extension(path: str) -> str:
    stem, dot, ext = path.rsplit("/", 1)[-1].rpartition(".")
    return ext if dot and stem else ""


def detect(path: str, data: Any) -> str:
    """Format of a file from its name and first 64 bytes."""
    head = bytes(data[:64])
    if head[:4] == b"GGUF":
        return "gguf"
    if head[:4] == b"GGML":
        return "ggml"
    if head[:4] == b"PK\x03\x04":
        return "pytorch-zip"
    if extension(path).lower() == "onnx":
        return "onnx"
    pickled = looks_like_pickle(head)
    # of a pickle the ninth byte may be a brace by chance, or by design; its first eight are then no length that a header may have
    if len(head) >= 9 and head[:8] != bytes(8) and head[8:9] == b"{" and not (pickled and int.from_bytes(head[:8], "little") > MAX_HEADER):
        return "safetensors"
    return "pytorch-legacy-pickle" if pickled else "unknown"


def streams_of(kind: str, data: Any) -> Iterator[tuple[str, Callable[[], Any]]]:
    """Pickle streams of a file of a format, each as a name and a function that opens it."""
    if kind == "pytorch-zip":
        yield from zip_streams(data)
    elif kind == "pytorch-legacy-pickle":
        yield LEGACY_STREAM, lambda: _View(data)


def read_artifact(path: str, data: Any) -> Iterator[dict]:
    """Detect the format and decode what the container declares, as one row, or several of a long one; the last has ``head``, and
    all figures of the container. No stream is ever held whole."""
    kind = detect(path, data)
    out, pairs, n_kv = Artifact(kind), iter(()), 0
    if kind == "gguf":
        pairs = gguf_pairs(data, out)
    elif kind == "safetensors":
        out = read_safetensors(data)
        pairs = iter(out.metadata)
    held: list[tuple[str, str]] = []
    size = 0
    for pair in pairs:
        held.append(pair)
        n_kv += 1
        size += len(pair[0]) + len(pair[1])
        if size > BYTES_A_ROW:
            yield {"first": n_kv - len(held), "metadata": held}
            held, size = [], 0
    found: list[dict] = []
    for name, open_ in streams_of(kind, data):
        try:
            for row in examine(len(found), name, open_):
                if row["last"]:
                    found.append(row)
                else:
                    yield {"streams": [row]}
        except Exception:  # noqa: BLE001 - as above
            continue
    yield {"head": True, "format": kind, "tensor_count": out.tensor_count, "n_kv": n_kv, "first": n_kv - len(held), "metadata": held, "streams": found}


def examine(ord_: int, name: str, open_: Callable[[], Any]) -> Iterator[dict]:
    """What is to be known of a stream: imports, flags, opcodes and the first window of high entropy, from one pass. Of a stream with
    very many imports a second pass gives those beyond the first ``IMPORTS_A_ROW``, the part with ``last`` coming at the end."""
    out = Disassembly()
    with open_() as f:
        tee = Entropy(f.read)
        each = walk(tee.read, out)
        imports = list(islice(each, IMPORTS_A_ROW))
        n = len(imports) + sum(1 for _ in each)
        while tee.read(PIECE):
            pass
    row = {"ord": ord_, "name": name, "size": tee.size, "has_reduce": out.has_reduce, "truncated": out.truncated, "stop_offset": out.stop_offset, "opcodes": sorted(out.opcodes), "entropy_offset": tee.offset, "entropy": tee.value}
    yield row | {"first": 0, "imports": imports, "last": n <= IMPORTS_A_ROW}
    if n > IMPORTS_A_ROW:
        with open_() as f:
            each = islice(walk(f.read, Disassembly()), IMPORTS_A_ROW, None)
            for at in range(IMPORTS_A_ROW, n, IMPORTS_A_ROW):
                yield row | {"first": at, "imports": list(islice(each, IMPORTS_A_ROW)), "last": at + IMPORTS_A_ROW >= n}


@cache
def _terms(window: int) -> np.ndarray:
    """What a byte value adds to a window's entropy, by how often it occurs."""
    p = np.arange(1, window + 1) / window
    return np.concatenate(([0.0], -p * np.log2(p)))


def entropies(data: np.ndarray, window: int) -> np.ndarray:
    """Entropy of each row of a byte matrix."""
    terms = _terms(window)
    return np.array([terms[np.bincount(row, minlength=256)].sum() for row in data])


class Entropy:
    """Passes a stream on and notes its size and the first full window whose entropy reaches the threshold."""

    def __init__(self, read: Read, window: int = ENTROPY_WINDOW, threshold: float = ENTROPY_THRESHOLD) -> None:
        self._read, self.window, self.threshold = read, window, threshold
        self.size, self.offset, self.value, self._rest = 0, None, None, b""

    def read(self, n: int) -> bytes:
        piece = self._read(n)
        self.size += len(piece)
        if self.offset is None:
            data = self._rest + piece
            full = len(data) // self.window * self.window
            h = entropies(np.frombuffer(data[:full], np.uint8).reshape(-1, self.window), self.window)
            hit = np.flatnonzero(h >= self.threshold)[:1].tolist()
            for k in hit:
                self.offset, self.value = self.size - len(data) + k * self.window, float(h[k])
            self._rest = data[full:]
        return piece


@dataclass
class Disassembly:
    """Imports as (module, name, offset); whether anything is called; whether and where decoding broke off."""

    imports: list[tuple[str, str, int]] = field(default_factory=list)
    has_reduce: bool = False
    opcodes: set[int] = field(default_factory=set)
    truncated: bool = False
    stop_offset: int | None = None


_TWO_LINES, _LINE_PUSH, _LINE = frozenset(b"ci"), frozenset(b"SV"), frozenset(b"pgPFIL")
_TEXT = {0x8C: 1, ord("X"): 4, 0x8D: 8, ord("U"): 1, ord("T"): 4}
_SKIP = {ord("B"): 4, ord("C"): 1, 0x8E: 8, 0x96: 8, 0x8A: 1, 0x8B: 4}
_FIXED = {0x80: 1, 0x95: 8, ord("J"): 4, ord("r"): 4, ord("j"): 4, ord("K"): 1, ord("q"): 1, ord("h"): 1, ord("M"): 2, ord("G"): 8, 0x82: 1, 0x83: 2, 0x84: 4}
_PLAIN = frozenset(b"(.012Ntld}])aesubo") | {ord("Q"), *range(0x85, 0x8A), 0x8F, 0x90, 0x91, 0x94, 0x97, 0x98, 0x81}


def walk(read: Read, out: Disassembly) -> Iterator[tuple[str, str, int]]:
    """Walk a pickle stream opcode by opcode, without running it: imports as they come, and the flags of ``out``.

    STOP is passed like any opcode, so that what follows a pickle is read too. Only STACK_GLOBAL takes strings from the shadow
    stack, on which memo reads push nothing: a memoised operand shows as the strings pushed last. What was found before the stream
    breaks off is kept; ``stop_offset`` is then the opcode's place for lines and unknown opcodes, else the cursor's. The stream is
    read forward a piece at a time; of a string of over ``NAME`` bytes, which names nothing, the beginning is kept and a mark.
    """
    buf, base, i = b"", 0, 0  # base is the place of buf[0] in the stream
    stack: list[str] = []

    def fill(n: int) -> bool:
        """Whether ``n`` bytes follow."""
        nonlocal buf, base, i
        while len(buf) - i < n:
            piece = read(PIECE)
            if not piece:
                return False
            buf, base, i = buf[i:] + piece, base + i, 0
        return True

    def skip(n: int) -> bytes | None:
        """Pass ``n`` bytes and give the first of them; None if the stream ends before."""
        nonlocal buf, base, i
        if n <= NAME or n <= len(buf) - i:
            if not fill(n):
                return None
            i += n
            return buf[i - n : i - n + min(n, NAME)]
        fill(NAME)
        head, n = buf[i : i + NAME], n - (len(buf) - i)
        while True:
            base, buf, i = base + len(buf), read(PIECE), 0
            if not buf:
                return None
            if len(buf) >= n:
                i = n
                return head
            n -= len(buf)

    def line() -> tuple[bytes, int] | None:
        """Pass a line and give its beginning and its length."""
        nonlocal buf, base, i
        end = buf.find(b"\n", i)
        head, n = buf[i : i + NAME] if end < 0 else b"", 0
        while end < 0:
            n += len(buf) - i
            base, buf, i = base + len(buf), read(PIECE), 0
            if not buf:
                return None
            end = buf.find(b"\n")
            head += buf[: min(NAME - len(head), len(buf) if end < 0 else end)]
        if not n:
            head = buf[i : min(end, i + NAME)]
        n, i = n + end - i, end + 1
        return head, n

    def named(head: bytes, n: int) -> str:
        return head.decode("utf-8", "replace") + ("…" if n > NAME else "")

    def stop(at: int) -> None:
        out.opcodes.intersection_update(_KNOWN)
        out.truncated, out.stop_offset = True, at

    while i < len(buf) or fill(1):
        op, start = buf[i], base + i
        i += 1
        out.opcodes.add(op)
        if op in _PLAIN:
            continue
        if op in _TEXT or op in _SKIP:
            width = _TEXT.get(op) or _SKIP[op]
            if len(buf) - i < width and not fill(width):
                return stop(base + i)
            n = int.from_bytes(buf[i : i + width], "little")
            i += width
            at = base + i
            if (head := skip(n)) is None:
                return stop(at)
            if op in _TEXT:
                stack.append(named(head, n))
        elif op in _FIXED:
            if len(buf) - i < _FIXED[op] and not fill(_FIXED[op]):
                return stop(base + i)
            i += _FIXED[op]
        elif op == 0x93:
            name = stack.pop() if stack else ""
            yield stack.pop() if stack else "", name, start
        elif op in (ord("R"), 0x92):
            out.has_reduce = True
        elif op in _TWO_LINES or op in _LINE_PUSH or op in _LINE:
            lines = []
            for _ in range(2 if op in _TWO_LINES else 1):
                if (own := line()) is None:
                    return stop(start)
                lines.append(own)
            if op in _TWO_LINES:
                module, name = (named(*x) for x in lines)
                yield module, name, start
            elif op in _LINE_PUSH:
                stack.append(named(*lines[0]))
        else:
            return stop(start)
        if len(stack) > STACK:
            del stack[:STACK_DROP]


def disassemble(data: Any) -> Disassembly:
    """The whole of ``walk`` over bytes that are at hand."""
    out = Disassembly()
    out.imports = list(walk(_View(data).read, out))
    return out


_KNOWN = _PLAIN | _TWO_LINES | _LINE_PUSH | _LINE | {*_TEXT, *_SKIP, *_FIXED, 0x92, 0x93, ord("R")}
