"""Removal of repeated passages: a count-min prefilter over word windows, then exact groups of the windows it lets through.

Documents are dealt to groups by a hash of id and text. The text is shuffled once to its group and read there three times (the
exchange is reused); everything else that moves is packed into one binary row per group and block, a block being a share of the
hash space:

1. ``sketch``: each group counts its windows in ``DEPTH`` rows of counters per block, and sends the occupied counters;
2. ``merge``: each block adds up the counters of all groups, and answers each group, one bit per counter sent, which of them
   reach two. A window whose counters all reach two is *estimated repeated*; a repeated window always is;
3. ``propose``: each group sends the windows estimated repeated, as 96-bit hashes with the smallest id that has them there;
4. ``settle``: each block groups those exactly and answers, one bit per window, whether a smaller id has it elsewhere;
5. ``strike``: each group removes the words that such windows cover.

A group and a block hold bounded shares of the corpus whatever repeats: a window found in a third of all documents is one
counter and one hash per group.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from argil.llm._text import covered, hash_spans, hash_windows, key, mix64, raw, read, slices, window_starts, words

WINDOW = 50
DEPTH = 2
#: Counters of a sketch row per window of its block; a stranger passes all rows for about one window in fifty.
WIDTH = 8
#: Bytes of text in a group, at least; it grows with the root of the corpus, as groups times blocks are the rows of a shuffle.
GROUP_BYTES, GROUP_ROOT = 8 << 20, 40
_WORD_BYTES = 6

_ASKED = T.StructType([T.StructField("__b", T.IntegerType()), T.StructField("__g", T.IntegerType()), T.StructField("__n", T.LongType()), T.StructField("__blob", T.BinaryType())])
_TOLD = T.StructType([T.StructField("__g", T.IntegerType()), T.StructField("__kind", T.IntegerType()), T.StructField("__b", T.IntegerType()), T.StructField("__blob", T.BinaryType())])


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays split into byte planes, so that the high bytes of small or sorted numbers cost next to nothing."""
    planes = [np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def _unpack(blob: bytes, n: int, *kinds: str) -> list[np.ndarray]:
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.uint8)
    out, at = [], 0
    for kind in map(np.dtype, kinds):
        size = n * kind.itemsize
        out.append(np.ascontiguousarray(data[at : at + size].reshape(kind.itemsize, n).T).reshape(-1).view(kind))
        at += size
    return out


class _Windows:
    """The windows of a group's documents: hashes, and the document of each as a row number."""

    def __init__(self, docs: pa.Table, second: bool) -> None:
        h1, h2, rows, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint32)], [np.zeros(0, np.int32)], 0
        for part in slices(docs, "text"):
            data, offsets = raw(part.column(part.schema.get_field_index("text")))
            starts, ends, first = words(data, offsets)
            places, row = window_starts(first, WINDOW)
            if len(places):
                h = hash_spans(data, starts, ends)
                h1.append(hash_windows(h, WINDOW)[places])
                if second:
                    h2.append(hash_windows(hash_spans(data, starts, ends, 1), WINDOW, 1)[places].astype(np.uint32))
                rows.append((row + at).astype(np.int32))
            at += len(part)
        self.h1, self.h2, self.row = map(np.concatenate, (h1, h2, rows))


def _counters(h: np.ndarray, blocks: int, width: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Block of each window, and its counter in each row of the block's sketch."""
    block = ((h >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int32)
    cells = [((mix64(h + np.uint64(r)) >> np.uint64(32)) * np.uint64(width) >> np.uint64(32)).astype(np.uint32) for r in range(DEPTH)]
    return block, cells


def _by_block(block: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(block, kind="stable")
    return order, np.searchsorted(block[order], np.arange(blocks + 1))


def _sent(h: np.ndarray, blocks: int, width: int) -> tuple[np.ndarray, list[np.ndarray], list[tuple[np.ndarray, np.ndarray]]]:
    """For each sketch row the occupied counters as ``block << 32 | counter``, sorted, and whether each counts two or more."""
    block, cells = _counters(h, blocks, width)
    flat = [block.astype(np.uint64) << np.uint64(32) | c for c in cells]
    found = []
    for f in flat:
        unique, n = np.unique(f, return_counts=True)
        found.append((unique, n > 1))
    return block, flat, found


def _spans(unique: np.ndarray, blocks: int) -> np.ndarray:
    return np.searchsorted(unique, np.arange(blocks + 1, dtype=np.uint64) << np.uint64(32))


def _table(schema: T.StructType, rows: list[tuple]) -> pa.Table:
    kinds = {T.IntegerType(): pa.int32(), T.LongType(): pa.int64(), T.BinaryType(): pa.binary()}
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.table([pa.array(c, kinds[f.dataType]) for c, f in zip(columns, schema)], names=schema.names)


def _sketch(group: int, docs: pa.Table, blocks: int, width: int) -> pa.Table:
    _, _, found = _sent(_Windows(docs, False).h1, blocks, width)
    rows = []
    for r, (unique, many) in enumerate(found):
        at = _spans(unique, blocks)
        for b in np.flatnonzero(np.diff(at)).tolist():
            part = (unique[at[b] : at[b + 1]] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            rows.append((b * DEPTH + r, group, len(part), _pack(np.diff(part, prepend=np.uint32(0)), many[at[b] : at[b + 1]].view(np.uint8))))
    return _table(_ASKED, rows)


def _merge(asked: pa.Table, width: int) -> pa.Table:
    """Add up one row of one block's sketch. Counters stop at two."""
    total = np.zeros(width, dtype=np.uint8)
    rows = []
    for b, g, n, blob in zip(*(asked.column(c) for c in _ASKED.names)):
        step, many = _unpack(blob.as_py(), n.as_py(), "<u4", "u1")
        cells = np.cumsum(step, dtype=np.uint32)
        total[cells] = np.minimum(total[cells] + 1 + many, 2)
        rows.append((b.as_py(), g.as_py(), cells))
    return _table(_TOLD, [(g, 0, b, _pack(np.packbits(total[cells] > 1))) for b, g, cells in rows])


def _estimated(h: np.ndarray, told: dict[tuple[int, int], bytes], blocks: int, width: int) -> np.ndarray:
    """Which windows are estimated repeated, from the answers to the sketch."""
    block, flat, found = _sent(h, blocks, width)
    out = np.ones(len(h), dtype=bool)
    for r, (unique, _) in enumerate(found):
        at = _spans(unique, blocks)
        repeated = np.zeros(len(unique), dtype=bool)
        for b in np.flatnonzero(np.diff(at)).tolist():
            n = int(at[b + 1] - at[b])
            bits = _unpack(told[0, b * DEPTH + r], -(-n // 8), "u1")[0]
            repeated[at[b] : at[b + 1]] = np.unpackbits(bits, count=n).astype(bool)
        out &= repeated[np.searchsorted(unique, flat[r])]
    return out


class _Proposal:
    """The windows of a group that are estimated repeated, each distinct one once, in the order of block and hash."""

    def __init__(self, docs: pa.Table, told: dict[tuple[int, int], bytes], blocks: int, width: int) -> None:
        w = _Windows(docs, True)
        ids, self.null = key(docs.column("id"))
        at = np.flatnonzero(~self.null[w.row])
        # rows without an id are in the sketch, as it only may overestimate, but no further
        at = at[_estimated(w.h1, told, blocks, width)[at]] if len(w.h1) else at
        doc = ids[w.row[at]]
        order = np.lexsort((doc, w.h2[at], w.h1[at]))
        self.at, self.doc = at[order], doc[order]
        h1, h2 = w.h1[self.at], w.h2[self.at]
        fresh = np.ones(len(h1), dtype=bool)
        fresh[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        self.which = np.cumsum(fresh) - 1
        self.h1, self.h2, self.least = h1[fresh], h2[fresh], self.doc[fresh]
        self.spans = np.searchsorted(_counters(self.h1, blocks, 1)[0], np.arange(blocks + 1))
        self.row = w.row


def _propose(group: int, docs: pa.Table, told: dict, blocks: int, width: int) -> pa.Table:
    p = _Proposal(docs, told, blocks, width)
    rows = []
    for b in np.flatnonzero(np.diff(p.spans)).tolist():
        s = slice(p.spans[b], p.spans[b + 1])
        rows.append((b, group, s.stop - s.start, _pack(p.h1[s], p.h2[s], p.least[s])))
    return _table(_ASKED, rows)


def _settle(asked: pa.Table) -> pa.Table:
    """Whether a smaller id has a window: one bit for each window proposed to a block."""
    parts, groups, b = [], [], 0
    for b, g, n, blob in zip(*(asked.column(c).to_pylist() for c in _ASKED.names)):
        parts.append(_unpack(blob, n, "<u8", "<u4", "<i8"))
        groups.append((g, n))
    h1, h2, doc = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((doc, h2, h1))
    h1, h2 = h1[order], h2[order]
    fresh = np.ones(len(h1), dtype=bool)
    fresh[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    least = doc[order][fresh][np.cumsum(fresh) - 1]
    later = np.zeros(len(h1), dtype=bool)
    later[order] = least < doc[order]
    rows, at = [], 0
    for g, n in groups:
        rows.append((g, 1, b, _pack(np.packbits(later[at : at + n]))))
        at += n
    return _table(_TOLD, rows)


def _struck(docs: pa.Table, told: dict, blocks: int, width: int) -> np.ndarray:
    """Places, counted over the windows of the group, of the windows to remove."""
    p = _Proposal(docs, told, blocks, width)
    later = np.zeros(len(p.h1), dtype=bool)
    for b in np.flatnonzero(np.diff(p.spans)).tolist():
        n = int(p.spans[b + 1] - p.spans[b])
        later[p.spans[b] : p.spans[b + 1]] = np.unpackbits(_unpack(told[1, b], -(-n // 8), "u1")[0], count=n).astype(bool)
    out = np.zeros(len(p.row), dtype=bool)
    out[p.at] = later[p.which] | (p.doc > p.least[p.which]) if len(p.h1) else False
    return out


def _strike(docs: pa.Table, told: dict, blocks: int, width: int, digest: bool) -> pa.Table:
    struck, at = _struck(docs, told, blocks, width), 0
    parts = []
    for part in slices(docs, "text"):
        data, offsets = raw(part.column(part.schema.get_field_index("text")))
        starts, ends, first = words(data, offsets)
        places, _ = window_starts(first, WINDOW)
        gone = covered(len(starts), places[struck[at : at + len(places)]], WINDOW)
        at += len(places)
        before = np.concatenate(([0], np.cumsum(gone)))
        n_removed = before[first[1:]] - before[first[:-1]]
        view, texts = data.tobytes(), []
        for row, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
            if digest or n_removed[row]:
                if n_removed[row]:
                    live = np.flatnonzero(~gone[a:b]) + a
                    kept = b" ".join([view[x:y] for x, y in zip(starts[live].tolist(), ends[live].tolist())])
                else:
                    kept = b" ".join([w for w in view[offsets[row] : offsets[row + 1]].translate(_TO_SPACE).split(b" ") if w])
                texts.append(hashlib.sha256(kept).hexdigest() if digest else kept.decode())
            else:
                texts.append(None)
        parts.append(pa.table([pa.array(np.diff(first), pa.int64()), pa.array(n_removed, pa.int64()), pa.array(texts, pa.string())], names=["n", "gone", "kept"]))
    none = pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.string())], names=["n", "gone", "kept"])
    return pa.concat_tables([none, *parts])


_TO_SPACE = bytes.maketrans(b"\t\n\v\f\r", b"     ")


def _told(table: pa.Table) -> dict[tuple[int, int], bytes]:
    return {(k, b): blob for k, b, blob in zip(*(table.column(c).to_pylist() for c in ("__kind", "__b", "__blob")))}


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", digest: bool = False) -> DataFrame:
    """Remove each word covered by a window of ``WINDOW`` consecutive words that also starts in a document with a smaller id.

    Windows are judged on the input, not on what is left; words are compared unchanged. Returns every row with all its columns,
    and ``n_words``, ``n_removed`` (long) and ``kept``: the kept words joined by one space, null where nothing was removed; with
    ``digest`` their SHA-256 instead, for every row. Columns of those names are replaced. A null text has no words; a null id is
    not smaller or larger than another, so such a row neither loses words nor makes others lose any; rows of one id don't remove
    each other's words. An empty table gives no rows. Whole texts are read, however long; a group holds about ``GROUP_BYTES``.
    """
    size = docs.agg(F.sum(F.octet_length(text_column))).first()[0] or 0
    groups = max(1, math.ceil(size / max(GROUP_BYTES, GROUP_ROOT * math.isqrt(size))))
    blocks, width = groups, WIDTH * max(64, math.ceil(size / _WORD_BYTES / groups))
    extra = [] if digest else [c for c in docs.columns if c not in (id_column, text_column, "n_words", "n_removed", "kept")]
    # rows of one id, or of none, spread by their texts, and equal ones by the partition that reads them; groups compare ids, so any
    # group will do for a row
    deal = F.pmod(F.xxhash64(id_column, text_column, F.spark_partition_id()), F.lit(groups)).cast("int").alias("__g")
    carried = [F.struct(*extra).alias("row")] if extra else []
    dealt = docs.select(deal, F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"), *carried).repartition(groups, "__g")

    asked = dealt.groupBy("__g").applyInArrow(lambda k, t: _sketch(k[0].as_py(), t, blocks, width), _ASKED)
    told = asked.groupBy("__b").applyInArrow(lambda t: _merge(t, width), _TOLD)
    proposed = dealt.groupBy("__g").cogroup(told.groupBy("__g")).applyInArrow(lambda k, t, r: _propose(k[0].as_py(), t, _told(r), blocks, width), _ASKED)
    settled = proposed.groupBy("__b").applyInArrow(_settle, _TOLD)

    def strike(t: pa.Table, r: pa.Table) -> pa.Table:
        columns = [t.column("id"), *([] if digest else [t.column("text")])]
        columns += [pc.struct_field(t.column("row"), [i]) for i in range(len(extra))]
        return pa.table(columns + _strike(t, _told(r), blocks, width, digest).columns, names=schema.names)

    text = [] if digest else [T.StructField(text_column, T.StringType())]
    found = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())]
    schema = T.StructType([T.StructField(id_column, T.LongType()), *text, *(T.StructField(c, docs.schema[c].dataType) for c in extra), *found])
    return dealt.groupBy("__g").cogroup(told.union(settled).groupBy("__g")).applyInArrow(strike, schema)


def without_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents with repeated passages removed from their texts; a document of which no word is left goes. ``n_chars`` follows
    the text where it is a column; other columns stay as they are."""
    hidden = {c: f"__own_{c}" for c in ("n_words", "n_removed", "kept") if c in docs.columns}
    found = remove_repeats(docs.withColumnsRenamed(hidden), id_column, text_column).filter("n_removed = 0 OR n_removed < n_words")
    changed = {text_column: F.coalesce("kept", text_column)} | {c: F.col(h) for c, h in hidden.items()}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("kept").isNull(), F.col("n_chars")).otherwise(F.char_length("kept")).cast(docs.schema["n_chars"].dataType)
    return found.select(*(changed[c].alias(c) if c in changed else F.col(c) for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: words removed from every document, and a digest of what is kept."""
    return remove_repeats(read(spark, sf_dir, "documents"), digest=True).withColumnRenamed("kept", "kept_sha256")


#: DuckDB: the same over whole tables.
ORACLE = """
WITH w AS (SELECT doc_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
n AS (SELECT doc_id, coalesce(ws, []) AS ws FROM w),
win AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM n WHERE len(ws) >= 50)),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS least FROM win) WHERE least < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM late),
lost AS (SELECT doc_id, list(p) AS ps, count(*) AS n_removed FROM gone GROUP BY doc_id)
SELECT n.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  sha256(CASE WHEN n_removed IS NULL THEN array_to_string(ws, ' ') ELSE array_to_string(list_transform(list_filter(range(1, len(ws) + 1), lambda p: NOT list_contains(ps, p)), lambda p: ws[p]), ' ') END) AS kept_sha256
FROM n LEFT JOIN lost USING (doc_id)
"""
