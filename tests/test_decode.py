"""Decoders: byte vectors, truncation anywhere, and agreement with the standard library's opcode reader."""

import io
import json
import pickle
import pickletools
import random
import struct
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from argil.functions import decode
from argil.functions.decode import disassemble

CALL = b"\x80\x04\x95" + struct.pack("<Q", 37) + b"\x8c\x05posix\x94\x8c\x06system\x94\x93\x94\x8c\x0aid # pwned\x94\x85\x94R\x94."


def string(t, n=None):
    b = t.encode() if isinstance(t, str) else t
    return struct.pack("<Q", len(b) if n is None else n) + b


def gguf(*pairs, version=3, tensors=0, count=None):
    kind = "<IQQ" if version >= 2 else "<III"
    return b"GGUF" + struct.pack(kind, version, tensors, len(pairs) if count is None else count) + b"".join(string(k) + v for k, v in pairs)


def read(path, data):
    """The rows of an artifact, put together."""
    rows = list(decode.read_artifact(path, data))
    assert [r.get("head", False) for r in rows] == [False] * (len(rows) - 1) + [True]
    pairs = [p for r in rows for p in r.get("metadata", ())]
    assert len(pairs) == rows[-1]["n_kv"]
    return rows[-1] | {"metadata": pairs, "streams": [s for r in rows for s in r.get("streams", ())]}


def text(v):
    return struct.pack("<I", 8) + string(v)


def array(kind, n, body):
    return struct.pack("<IIQ", 9, kind, n) + body


def safetensors(header):
    body = header if isinstance(header, bytes) else json.dumps(header).encode()
    return struct.pack("<Q", len(body)) + body


@pytest.mark.parametrize(
    "data,imports,reduce",
    [
        (CALL, [("posix", "system", 28)], True),
        (b"\x80\x04\x8c\x02os\x8c\x06system\x93\x8c\x02id\x85R.", [("os", "system", 14)], True),
        (b"cos\nsystem\n(S'id'\ntR.", [("os", "system", 0)], True),
        (b"\x80\x04ctorch\nFloatStorage\nq\x00.", [("torch", "FloatStorage", 2)], False),
        (b"(ios\nsystem\n.", [("os", "system", 1)], False),
        (b"\x93.", [("", "", 0)], False),
        (b"V\xc3\xa9\n\x8c\x01x\x93.", [("é", "x", 7)], False),
        (b"S'a'\nS'b'\n\x93.", [("'a'", "'b'", 10)], False),
        (b"\x8c\x02os\x94\x8c\x06system\x94\x8c\x01a\x94h\x00h\x01\x93.", [("system", "a", 22)], False),
        (b"N.cos\nsystem\n.", [("os", "system", 2)], False),
        (b"\x92\x81o.", [], True),
        (b"", [], False),
    ],
)
def test_streams(data, imports, reduce):
    d = disassemble(data)
    assert (d.imports, d.has_reduce, d.truncated, d.stop_offset) == (imports, reduce, False, None)


@pytest.mark.parametrize(
    "data,stop",
    [(b"cos\nsys", 0), (b"N\xff", 1), (b"\x8c", 1), (b"\x8c\x05ab", 2), (b"X\x01\x00", 1), (b"X\x05\x00\x00\x00ab", 5), (b"B\x02\x00\x00\x00a", 5), (b"\x8d" + b"\xff" * 8, 9), (b"K", 1), (b"\x95\x01", 1), (b"Iabc", 0), (b"NG\x00", 2), (b"cos\nsystem\nR\x00", 12)],
)
def test_breaks(data, stop):
    d = disassemble(data)
    assert d.truncated and d.stop_offset == stop


def test_kept_before_break():
    d = disassemble(b"cos\nsystem\nR\x00")
    assert d.imports == [("os", "system", 0)] and d.has_reduce


def test_shadow_stack_is_trimmed():
    d = disassemble(b"\x8c\x01m" * 5000 + b"\x93.")
    assert d.imports == [("m", "m", 15000)]


VALUES = st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False) | st.text(max_size=20) | st.binary(max_size=300), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(max_size=5), x, max_size=4) | st.tuples(x, x) | st.frozensets(st.integers(), max_size=3), max_leaves=12)


@settings(max_examples=200, deadline=None)
@given(VALUES, st.integers(0, 5), st.data())
def test_agrees_with_pickletools(value, protocol, data):
    stream = pickle.dumps((value, io.BytesIO, random.Random, complex(1, 2)), protocol)
    d = disassemble(stream)
    assert not d.truncated
    wanted = [(*arg.split(" ", 1), at) for op, arg, at in pickletools.genops(stream) if op.name in ("GLOBAL", "INST")]
    places = [at for op, _, at in pickletools.genops(stream) if op.name in ("GLOBAL", "INST", "STACK_GLOBAL")]
    assert [i[2] for i in d.imports] == places and [i for i in d.imports if i in wanted] == wanted
    assert d.has_reduce == any(op.name in ("REDUCE", "NEWOBJ_EX") for op, _, _ in pickletools.genops(stream))
    cut = disassemble(stream[: data.draw(st.integers(0, len(stream)))])
    assert d.imports[: len(cut.imports)] == cut.imports


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=200))
def test_any_bytes(data):
    disassemble(data)
    for head in (b"", b"GGUF\x03\0\0\0", b"PK\x03\x04", struct.pack("<Q", 20) + b"{"):
        read("x", head + data)


def test_every_prefix_of_containers():
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w", zipfile.ZIP_DEFLATED) as f:
        f.writestr("data.pkl", CALL * 20)
    for data in (gguf(("a", text("b")), ("c", array(8, 2, string("d") + string("e")))), safetensors({"__metadata__": {"a": "b"}, "w": {}}), z.getvalue(), CALL):
        for n in range(len(data) + 1):
            read("x", data[:n])


def test_gguf():
    a = read("m.gguf", gguf(("k", text("v")), ("k", text("again")), ("n", struct.pack("<II", 4, 7)), ("l", array(8, 2, string("x") + string(b"\xff"))), ("f", array(6, 3, bytes(12))), ("e", text("")), tensors=2**63))
    assert a["format"] == "gguf" and a["tensor_count"] == 2**63
    assert a["metadata"] == [("k", "v"), ("k", "again"), ("l", "x \ufffd")]
    assert decode.read_gguf(gguf(("a", text("b")), version=1, tensors=4)).metadata == [("a", "b")]
    for bad in (array(9, 1, bytes(20)), array(8, 2_000_000, b""), struct.pack("<I", 99), struct.pack("<I", 8) + string("x", 1 << 40)):
        assert decode.read_gguf(gguf(("a", text("b")), ("bad", bad), ("c", text("d")), count=50)).metadata == [("a", "b")]
    assert decode.read_gguf(b"GGUF").tensor_count is None


def test_safetensors():
    a = read("m", safetensors({"__metadata__": {"z": "1", "a": "2", "n": 3, "l": ["x"]}, "w": {}, "v": {}}))
    assert (a["format"], a["tensor_count"], a["metadata"]) == ("safetensors", 2, [("a", "2"), ("z", "1")])
    assert decode.read_safetensors(safetensors(b'{"__metadata__":{"a":"1","a":"2"}}')).metadata == [("a", "2")]
    for bad in (b"{", b"[1]", b'{"a":NaN}', b"\xff\xfe{}", b'"x"', b"{" * 100000):
        assert decode.read_safetensors(safetensors(bad)).tensor_count is None
    assert decode.read_safetensors(struct.pack("<Q", 99) + b"{}").tensor_count is None
    assert decode.read_safetensors(b"{}").tensor_count is None


def test_long_artifacts_take_several_rows(monkeypatch):
    data = gguf(*((f"k{i}", text("v" * 30)) for i in range(20)))
    whole = read("m.gguf", data)["metadata"]
    monkeypatch.setattr(decode, "BYTES_A_ROW", 100)
    assert read("m.gguf", data)["metadata"] == whole
    rows = list(decode.read_artifact("m.gguf", data))
    assert len(rows) > 4 and all(whole[r["first"] : r["first"] + len(r["metadata"])] == r["metadata"] for r in rows)
    monkeypatch.setattr(decode, "IMPORTS_A_ROW", 10)
    stream = b"".join(b"cos\nf%d\n" % i for i in range(35)) + b"R."
    for data in (stream, zipped({"a.pkl": stream})):
        parts = read("m.pt", data)["streams"]
        assert [len(p["imports"]) for p in parts] == [10, 10, 10, 5] and [p["last"] for p in parts] == [False] * 3 + [True]
        assert [n for p in parts for _, n, _ in p["imports"]] == [f"f{i}" for i in range(35)] and all(p["has_reduce"] for p in parts)


def zipped(members, kind=zipfile.ZIP_DEFLATED):
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w", kind) as f:
        for name, data in members.items():
            f.writestr(name, data)
    return z.getvalue()


def test_zip():
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("a/data.pkl", b"N.")
        f.writestr("marked", b"\x80\x04N.")
        f.writestr("other", b"text")
        f.writestr("deflated.pkl", b"N." * 500, zipfile.ZIP_DEFLATED)
        f.writestr("packed.pkl", b"N." * 500, zipfile.ZIP_BZIP2)
        f.writestr("empty.pkl", b"")
    data = z.getvalue()
    a = read("m.pt", data)
    assert a["format"] == "pytorch-zip" and a["tensor_count"] is None
    assert [(s["ord"], s["name"], s["size"]) for s in a["streams"]] == [(0, "archive:a/data.pkl", 2), (1, "archive:marked", 4), (2, "archive:deflated.pkl", 1000), (3, "archive:empty.pkl", 0)]
    assert read("x", b"PK\x03\x04junk")["streams"] == []
    at = data.index(b"N.")
    spoiled = data[:at] + b"M." + data[at + 2 :]
    assert "archive:a/data.pkl" not in [s["name"] for s in read("x", spoiled)["streams"]]


def test_long_names_and_lines():
    for pad in (b"X\x40\x42\x0f\x00" + b"a" * 1_000_000, b"S" + b"a" * 3_000_000 + b"\n", b"T\x05\x00\x00\x00abcde" * 300_000):
        d = disassemble(pad + b"0cos\nsystem\n\x8c\x03nt\x8c\x8c\x01x\x93.")
        assert d.imports[0] == ("os", "system", len(pad) + 1)
    d = disassemble(b"c" + b"o" * 9000 + b"\nx\n.")
    assert d.imports == [("o" * decode.NAME + "…", "x", 0)]


def test_entropy_of_a_stream(monkeypatch):
    noise = random.Random(3).randbytes(4096)
    for piece in (100, 5000, 1 << 20):
        monkeypatch.setattr(decode, "PIECE", piece)
        for data, at in ((noise, 0), (bytes(4096) + noise * 2, 4096), (noise[:-1], None), (bytes(4000) + noise, None), (b"\xff" + bytes(8191) + noise, 8192)):
            (row,) = decode.examine(0, "s", lambda data=data: io.BytesIO(data))
            assert row["entropy_offset"] == at and row["size"] == len(data)
            assert at is None or row["entropy"] == pytest.approx(float(decode.entropies(__import__("numpy").frombuffer(data, "u1")[at : at + 4096][None], 4096)[0]))


@pytest.mark.parametrize(
    "path,data,kind",
    [("x", b"GGUF", "gguf"), ("x", b"GGML", "ggml"), ("x", b"PK\x03\x04", "pytorch-zip"), ("x", b"PK\x05\x06", "unknown"), ("a.ONNX", b"\x08", "onnx"), ("a.onnx", b"GGUF", "gguf"), (".onnx", b"\x08", "unknown"), ("x", b"\x80", "pytorch-legacy-pickle"), ("x", b"c\n", "unknown"), ("x", b"cos", "pytorch-legacy-pickle"), ("x", b"", "unknown"), ("x", bytes(8) + b"{", "unknown"), ("x", b"\1" + bytes(7) + b"{", "safetensors")],
)
def test_detect(path, data, kind):
    assert decode.detect(path, data) == kind
