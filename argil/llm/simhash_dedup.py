"""Near-duplicate documents: by SimHash, joined on Golay-code fuzzy keys; where a similarity is asked for, verified on the bags of
shingles, and with an exact join for what lies beyond the keys' radius."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from argil.llm import golay
from argil.llm._text import IS_WORD, cut, hash_spans, hash_windows, mix64, ranges, raw, read, slices, window_starts, words, xxh64_spans
from argil.llm.components import components

SHINGLE, SEED = 3, 42
#: The most bits in which linked fingerprints differ. The keys are exact for two.
RADIUS = 2
_LOWER = np.frombuffer(bytes(range(256)).lower(), dtype=np.uint8)
_SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Documents, by the hash of their id, whose shingles are counted to put the common ones last, and the most that are put there.
#: They only decide how many strangers are compared, never what is found.
COUNTED, COMMON = 10_000, 1 << 16
#: Keys beyond the fewest are one for so many shingles; the more, the more of them similar bags must share.
FURTHER = 20
#: Up to so many documents are picked out by id where they are read; more are joined.
PICKED = 1_000_000
_HASH_ROWS = 1 << 16
_BYTE_PLACE = np.arange(0, 2048, 256, dtype=np.int16)
#: The bits of each byte, lowest first.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def simhash(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """SimHash of each text of a slice: a bit is 1 if it is set in over half of the shingles' hashes; no word gives zero."""
    data = _LOWER[data]
    starts, ends, first = words(data, offsets)
    # one space after each word, so that a shingle is one span of bytes
    keep = IS_WORD[data[:-8]]
    gap = ends[ends < len(keep)]
    keep[gap] |= ~keep[gap]
    moved = np.concatenate(([0], np.cumsum(keep)))
    joined = np.concatenate((data[:-8][keep], np.zeros(8, dtype=np.uint8)))
    joined[:-8][~IS_WORD[joined[:-8]]] = 0x20
    n = np.diff(first)
    count = np.where(n > SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
    head = ranges(first[:-1], count)
    tail = head + np.repeat(np.minimum(n, SHINGLE), count) - 1
    return fold(xxh64_spans(joined, moved[starts[head]], moved[ends[tail]], SEED), count)


def fold(hashes: np.ndarray, count: np.ndarray) -> np.ndarray:
    """SimHash of each row of so many hashes: a bit is 1 if it is set in over half of them; none give zero."""
    hashes = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    out = np.zeros(len(count), dtype=np.uint64)
    at = 0
    for row, m in enumerate(count.tolist()):
        if m:
            counts = np.zeros((8, 256), dtype=np.int64)
            for lo in range(at, at + m, _HASH_ROWS):
                counts += np.bincount((hashes[lo : min(lo + _HASH_ROWS, at + m)] + _BYTE_PLACE).ravel(), minlength=2048).reshape(8, 256)
            out[row] = np.packbits(2 * (counts @ _BITS).ravel() > m, bitorder="little").view("<u8")[0]
        at += m
    return out


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(doc_id, fp)``: one row for each row, ``fp`` the 64-bit fingerprint as a signed integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                fps = simhash(*raw(part.column(1)))
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(run, "doc_id long, fp long")


def keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fuzzy keys of fingerprints: row, key, and whether the row looks the key up (else it is found under it).

    A fingerprint has three segments. If two fingerprints differ in two bits at most, then going round the segments there is one
    that is equal and whose successor differs in one bit at most. A key holds the number of the equal segment, its bits and a
    Golay codeword index of the successor: a fingerprint looks up the index nearest to itself and is found under the indices
    nearest to anything within one bit of itself. That is 34 bits to tell strangers apart, for 3 and about 16 rows.
    """
    parts = [(fp >> np.uint64(at) & np.uint64((1 << n) - 1)) for at, n in _SEGMENTS]
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for i in range(3):
        head = np.uint64(i) << np.uint64(40) | parts[i] << np.uint64(golay.MESSAGE)
        after = parts[(i + 1) % 3].astype(np.uint32)
        every = np.arange(len(fp))
        out.append((every, head | golay.decode(after).astype(np.uint64), np.ones(len(fp), dtype=bool)))
        row, index = golay.near(after)
        out.append((row, head[row] | index.astype(np.uint64), np.zeros(len(row), dtype=bool)))
    return tuple(np.concatenate(x) for x in zip(*out))


def links(classes: DataFrame) -> DataFrame:
    """All pairs of distinct fingerprints within ``RADIUS`` bits: ``(u, v)`` with their ids, ``u > v``.

    ``classes(fp, id)`` has one row for each distinct fingerprint, so that copies cost nothing here.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _HASH_ROWS // 4):
                part = batch.slice(at, _HASH_ROWS // 4)
                fp = part.column(0).to_numpy().view(np.uint64)
                row, k, asks = keys(fp)
                yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(asks), pa.array(fp[row].view(np.int64)), part.column(1).take(pa.array(row))], names=["k", "asks", "fp", "id"])

    keyed = classes.select("fp", "id").mapInArrow(run, "k long, asks boolean, fp long, id long")
    left = keyed.filter("asks").select("k", F.col("fp").alias("a"), F.col("id").alias("u"))
    right = keyed.filter("NOT asks").select("k", F.col("fp").alias("b"), F.col("id").alias("v"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS
    return left.join(right, "k").filter(near & (F.col("u") != F.col("v"))).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def bags(data: np.ndarray, offsets: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of each text of a slice, repeats included, and the first of each row. Fewer words are one shingle."""
    data = _LOWER[data]
    starts, ends, first = words(data, offsets)
    h = hash_spans(data, starts, ends)
    places, row = window_starts(first, shingle)
    found, rows = [hash_windows(h, shingle)[places]], [row]
    n = np.diff(first)
    for few in range(1, shingle):
        short = np.flatnonzero(n == few)
        found.append(mix64(hash_windows(h, few)[first[short]] + np.uint64(few)) if len(short) else np.zeros(0, dtype=np.uint64))
        rows.append(short)
    hashes, row = np.concatenate(found), np.concatenate(rows)
    order = np.argsort(row, kind="stable")
    return hashes[order], np.searchsorted(row[order], np.arange(len(n) + 1))


def digests(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each bag, whatever the order of its shingles."""
    total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(mix64(hashes ^ np.uint64(SEED)), dtype=np.uint64)))
    return mix64((total[first[1:]] - total[first[:-1]]) ^ mix64(np.diff(first).astype(np.uint64)))


def numbered(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bags as sets: the k-th of equal shingles gets a hash of its own. Hashes, in the order of their bags, and their rows."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    hashes = hashes[np.lexsort((hashes, row))]
    fresh = np.ones(len(hashes), dtype=bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    at = np.arange(len(hashes))
    k = at - np.maximum.accumulate(np.where(fresh, at, 0))
    again = k > 0
    hashes[again] = mix64(hashes[again] + k[again].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return hashes, row


def _bag_digests(docs: DataFrame, shingle: int) -> DataFrame:
    """``(doc_id, fp, mark)`` of ``docs(doc_id, text)``: the hash of a document's bag of shingles, and the SimHash of that bag."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, first = bags(*raw(part.column(1)), shingle)
                marks = fold(hashes, np.diff(first))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(digests(hashes, first).view(np.int64)), pa.array(marks.view(np.int64))], names=["doc_id", "fp", "mark"])

    return docs.mapInArrow(run, "doc_id long, fp long, mark long")


def _common(docs: DataFrame, shingle: int, n: int) -> np.ndarray:
    """Shingles that several of a bounded sample of documents have, sorted; at most ``COMMON``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([pa.array(numbered(*bags(*raw(part.column(1)), shingle))[0].view(np.int64))], names=["k"])

    share = min(1.0, COUNTED / max(n, 1))
    chosen = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    often = chosen.mapInArrow(run, "k long").groupBy("k").count().filter("count > 3").orderBy(F.desc("count"), "k").limit(COMMON)
    return np.sort(often.select("k").toArrow().column("k").to_numpy().view(np.uint64))


def close(classes: DataFrame) -> DataFrame:
    """Pairs of classes whose fingerprints are equal or differ in ``RADIUS`` bits at most: ``(a, b)``, bags. Not verified.

    ``classes(fp, id, mark)`` has one row for each distinct bag. Of those of one fingerprint each is paired with the first only, and
    that alone is looked for under other fingerprints, so that no group of bags is squared.
    """
    firsts = cut(classes.groupBy("mark").agg(F.min("fp").alias("first")))
    alike = classes.join(firsts, "mark").filter("fp <> first").select(F.col("first").alias("a"), F.col("fp").alias("b"))
    return alike.union(links(firsts.select(F.col("mark").alias("fp"), F.col("first").alias("id"))).select(F.col("v").alias("a"), F.col("u").alias("b")))


def verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Those of ``pairs(a, b)`` of classes whose bags of shingles have a weighted Jaccard similarity of ``similarity`` or more."""
    ratio = Fraction(str(similarity))
    up, down = ratio.numerator, ratio.denominator

    def picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, fps = few.value
        for batch in batches:
            doc_id = batch.column(0).to_numpy()
            lo, hi = np.searchsorted(ids, doc_id), np.searchsorted(ids, doc_id, side="right")
            row, at = np.repeat(np.arange(len(doc_id)), hi - lo), ranges(lo, hi - lo)
            yield from whole([pa.RecordBatch.from_arrays([*batch.take(pa.array(row)).columns, pa.array(fps[at])], names=["doc_id", "text", "wanted"])])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, first = bags(*raw(part.column(1)), shingle)
                own = digests(hashes, first).view(np.int64) == part.column(2).to_numpy()
                hashes, _ = numbered(hashes, first)
                kept = np.flatnonzero(own)
                bodies = [np.sort(hashes[first[i] : first[i + 1]]).tobytes() for i in kept.tolist()]
                yield pa.RecordBatch.from_arrays([part.column(2).take(pa.array(kept)), pa.array(bodies, pa.binary())], names=["fp", "bag"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(b.as_buffer(), dtype=np.uint64) for b in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append((up + down) * both >= up * (len(x) + len(y)))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    pairs = cut(pairs)
    wanted = cut(pairs.select(F.col("a").alias("fp")).union(pairs.select("b")).distinct().join(classes, "fp").select(F.col("id").alias("doc_id"), F.col("fp").alias("wanted")))
    if wanted.count() <= PICKED:
        table = wanted.orderBy("doc_id", "wanted").toArrow()
        few = docs.sparkSession.sparkContext.broadcast(tuple(table.column(c).to_numpy() for c in ("doc_id", "wanted")))
        bodies = docs.mapInArrow(picked, "fp long, bag binary")
    else:
        bodies = docs.join(wanted, "doc_id").select("doc_id", "text", "wanted").mapInArrow(whole, "fp long, bag binary")
    found = cut(bodies.dropDuplicates(["fp"]))
    first, second = (found.select(F.col("fp").alias(f), F.col("bag").alias(f"bag_{f}")) for f in ("a", "b"))
    return pairs.join(first, "a").join(second, "b").select("a", "b", "bag_a", "bag_b").mapInArrow(verify, "a long, b long")


def similar(docs: DataFrame, classes: DataFrame, shingle: int, similarity: float, n: int, groups: DataFrame) -> DataFrame:
    """All pairs of classes whose bags of shingles have a weighted Jaccard similarity of ``similarity`` or more: ``(a, b)``, bags; but
    for pairs in one of ``groups(node, root)``, whose members are known to be linked. ``PICKED`` members are passed over at most.

    ``docs(doc_id, text)`` has no null id; ``classes(fp, id)`` has one row for each distinct bag. Two such bags share ``similarity`` of
    the larger one's shingles. So, if all are sorted in one order, they share one of the first ``n - ceil(similarity * n) + 1`` of
    each, and with ``e`` more of each ``e`` more: these are the keys, of which a pair must share that many, and nothing is lost,
    whatever the order. It has the common shingles last, to meet few strangers. Pairs are then verified on all shingles.
    """
    ratio = Fraction(str(similarity))
    up, down = ratio.numerator, ratio.denominator
    members = groups.orderBy("root", "node").limit(PICKED).toArrow().sort_by("node")
    known = tuple(members.column(c).to_numpy() for c in ("node", "root"))
    shared = docs.sparkSession.sparkContext.broadcast((_common(docs, shingle, n), *known))  # of a bounded size

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, _, _ = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, first = bags(*raw(part.column(1)), shingle)
                fps = digests(hashes, first)
                hashes, row = numbered(hashes, first)
                late = np.zeros(len(hashes), dtype=bool)
                if len(common):
                    late = common[np.minimum(np.searchsorted(common, hashes), len(common) - 1)] == hashes
                hashes = hashes[np.lexsort((hashes, late, row))]
                size = np.diff(first)
                count = np.where(size > 0, size - -(-up * size // down) + 1 + size // FURTHER, 0)
                at, row = ranges(first[:-1], count), np.repeat(np.arange(len(size)), count)
                columns = [(hashes[at] >> np.uint64(16)).view(np.int64), fps[row].view(np.int64), size[row]]  # 48 bits tell keys apart
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["k", "fp", "size"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [tuple(batch.column(i).to_numpy() for i in range(3)) for batch in batches if batch.num_rows]
        if not parts:
            return
        k, fp, size = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((fp, size, k))
        k, fp, size = k[order], fp[order], size[order]
        fresh = np.ones(len(k), dtype=bool)  # documents of one bag have the same keys
        fresh[1:] = (k[1:] != k[:-1]) | (fp[1:] != fp[:-1])
        k, fp, size = k[fresh], fp[fresh], size[fresh]
        spare = -(-up * size // down) - size // FURTHER
        _, nodes, roots = shared.value
        group = fp
        if len(nodes):
            at = np.minimum(np.searchsorted(nodes, fp), len(nodes) - 1)
            group = np.where(nodes[at] == fp, roots[at], fp)
        left, lag = np.arange(len(k)), 0
        while len(left):
            lag += 1
            left = left[left + lag < len(k)]
            left = left[(k[left] == k[left + lag]) & (down * size[left] >= up * size[left + lag])]
            x = left[group[left] != group[left + lag]]
            y = x + lag
            need = -(-up * (size[x] + size[y]) // (up + down)) - np.maximum(spare[x], spare[y]) + 1
            a, b = fp[x], fp[y]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(need)], names=["a", "b", "need"])

    met = docs.mapInArrow(key, "k long, fp long, size long").repartition("k").mapInArrow(meet, "a long, b long, need long")
    return verified(docs, classes, met.groupBy("a", "b", "need").count().filter("count >= need").select("a", "b"), shingle, similarity)


def _linked(docs: DataFrame, classes: DataFrame, shingle: int, similarity: float, n: int) -> DataFrame:
    """All links between similar classes: ``(u, v)`` with their ids. The fuzzy keys find the nearest, which are then known to belong
    together, whatever their number; the exact join finds what links these groups and all others."""
    near = cut(verified(docs, classes, close(classes), shingle, similarity))
    groups = components(near.select(F.col("a").alias("u"), F.col("b").alias("v")))
    pairs = near.union(similar(docs, classes, shingle, similarity, n, groups))
    ids = [classes.select(F.col("fp").alias(f), F.col("id").alias(f"id_{f}")) for f in ("a", "b")]
    named = pairs.join(ids[0], "a").join(ids[1], "b").filter("id_a <> id_b")
    return named.select(F.greatest("id_a", "id_b").alias("u"), F.least("id_a", "id_b").alias("v")).distinct()


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = SHINGLE, similarity: float | None = None) -> DataFrame:
    """Group documents whose SimHash fingerprints differ in two bits or fewer, directly or through others; with ``similarity``, those
    whose bags of shingles have at least that weighted Jaccard similarity instead: the nearest are found by fingerprints too and then
    verified, see ``close``, the rest exactly, see ``similar``.

    A-Z are lower-cased; shingles are ``shingle`` words, joined by a space for fingerprints, repeats included; fewer words are one
    shingle, and a null or empty text has fingerprint zero, linked like any other. Returns one row per input row: ``doc_id``, ``fp``
    (long; with ``similarity`` the hash of the bag), ``component_id`` (smallest id reachable). A null id keeps its row, is in no group
    and has a null ``component_id``; rows that share an id are one document with several fingerprints, all linked. Other columns are
    neither read nor returned. An empty table gives no rows.

    Documents of one fingerprint become one class before anything is joined, so that a group of copies of any size is one row;
    its aggregation is combined before the shuffle. The table of fingerprints is checkpointed, 16 bytes a document, or 24.
    """
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    if similarity is None and shingle != SHINGLE:
        raise ValueError("fingerprints are of three words")
    fps = cut(fingerprints(docs, id_column, text_column) if similarity is None else _bag_digests(texts, shingle))
    named = fps.filter("doc_id IS NOT NULL")
    classes = cut(named.groupBy("fp").agg(F.min("doc_id").alias("id"), *([] if similarity is None else [F.min("mark").alias("mark")])))
    # one document, several rows: its classes are linked through its id
    several = named.groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).filter("a <> b").select("doc_id")
    shared = named.select("doc_id", "fp").join(several, "doc_id", "left_semi").distinct().join(classes, "fp")
    rows = shared.select(F.col("id").alias("u"), F.col("doc_id").alias("v")).filter("u <> v")
    near = links(classes) if similarity is None else _linked(texts.filter("doc_id IS NOT NULL"), classes, shingle, similarity, fps.count())
    found = components(near.union(rows))
    roots = classes.join(found, F.col("id") == F.col("node"), "left").select("fp", F.coalesce("root", "id").alias("component_id"))
    own = F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")
    return fps.join(roots, "fp", "left").select("doc_id", "fp", own)


def keep_one(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = SHINGLE, similarity: float | None = None) -> DataFrame:
    """Keep one row of each group of ``near_duplicates``: that of the group's smallest id, of its repeated rows the one with the
    smallest hash of all columns. Rows without an id stay.

    The ids that lost are broadcast if they are ``PICKED`` at most, so that no text moves; more are joined, for which the documents
    are shuffled once. Only if some id is repeated are those rows sought in a second pass.
    """
    groups = near_duplicates(docs, id_column, text_column, shingle, similarity).filter("doc_id IS NOT NULL")
    decided = groups.groupBy(F.col("doc_id").alias("__id")).agg(F.max(F.col("doc_id") != F.col("component_id")).alias("__lost"), F.count("*").alias("__n"))
    decided = cut(decided.filter("__lost OR __n > 1"))
    gone = decided.select("__id")
    if decided.count() <= PICKED:
        gone = F.broadcast(gone)
    same = docs[id_column].cast("long") == F.col("__id")
    kept = docs.join(gone, same, "left_anti")
    again = decided.filter("NOT __lost")
    if again.isEmpty():
        return kept
    rows = docs.join(again.select("__id"), same, "left_semi")
    one = rows.groupBy(F.col(id_column).alias("__id")).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("__row"))
    return kept.unionByName(one.select("__row.*"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: fingerprint and component of every document."""
    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
