"""Fixity of WARC replicas: Merkle trees over records and ordered offset ranges, compared from the root down.

An archive's records, in the order of their offsets, are cut into ranges at records whose hash says so, and never after more than
``STRIDE`` records. So where a record is lost, added or longer, the ranges around it differ and the rest of the archive, though moved,
has the same hashes. Records of ranges that differ are matched by record id and digest, not by offset.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from argil.llm._text import cut, read

#: Most records of a range, and most children of the nodes over ranges that follow each other without a cut between them.
STRIDE = 64
#: A record begins a range if its hash begins so, and a node of the level above if it begins so: one in 16, one in 256.
CUT, HIGH_CUT = "0", "00"
#: Records of an archive, on average, where pages are laid out.
RECORDS = 1000
#: Copies of one record that one task lays out.
BLOCK = 1 << 16
_PIECE = 1 << 16
_LENGTH = re.compile(rb"\r\nContent-Length:[ \t]*([0-9]{1,18})[ \t]*\r\n", re.I)
_ID = re.compile(rb"\r\nWARC-Record-ID:[ \t]*([^\r\n]{1,4096}?)[ \t]*\r\n", re.I)
#: A record's place among those of its archive (``at``), the last cuts of both levels before it, and the range counted from the cut.
_PLACED = "at long, low string, high string, range long"


def record(page_id: Column, url: Column, html: Column) -> Column:
    """A WARC response record as text; a null is empty."""
    html = F.coalesce(html, F.lit(""))
    head = [F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit(""))]
    rest = [F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n\r\n"), html, F.lit("\r\n\r\n")]
    return F.concat(*head, *rest)


def mark(record_id: Column, digest: Column) -> Column:
    """What decides whether a record begins a range."""
    return F.md5(F.concat_ws("/", F.coalesce(record_id, F.lit("")), F.coalesce(digest, F.lit(""))))


def lay_out(records: DataFrame, order: Sequence[str], block: int = BLOCK) -> DataFrame:
    """Give each record of ``records(archive, record_id, length, digest, ...)`` its ``offset`` in its archive, in the order of the
    columns ``order``, and the range that it is in (``at``, ``low``, ``high``, ``range``).

    Only sizes and digests move, never a record's bytes. Records equal in all columns are one entry until they have places, and are
    then laid out in blocks, so that no task has all copies of one.
    """
    own = records.columns
    groups = records.groupBy(*own).agg(F.count("*").alias("n"))
    along = Window.partitionBy("archive").orderBy(*order, *(c for c in own if c not in order))
    before, upto = along.rowsBetween(Window.unboundedPreceding, -1), along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own_mark = mark(F.col("record_id"), F.col("digest"))
    begun = groups.select("*", F.coalesce(F.sum(F.col("length") * F.col("n")).over(before), F.lit(0)).alias("offset"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("at"), own_mark.alias("mark"))

    def last(cut_at: str, value: Column) -> Column:
        return F.last(F.when(F.col("at") == 0, F.lit("") if value is None else F.col("at")).when(F.col("mark").startswith(cut_at), F.col("mark") if value is None else value), ignorenulls=True).over(upto)

    placed = begun.select(*own, "n", "offset", "at", last(CUT, None).alias("low"), last(HIGH_CUT, None).alias("high"), last(CUT, F.col("at")).alias("since"))
    few = placed.filter(F.col("n") <= block).withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    many = placed.filter(F.col("n") > block).withColumn("base", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(block).cast("long")))).repartition("archive", "at", "base")
    each = few.unionByName(many.withColumn("nth", F.explode(F.sequence("base", F.least(F.col("base") + block, F.col("n")) - 1))).drop("base"))
    at = F.col("at") + F.col("nth")
    return each.select(*own, (F.col("offset") + F.col("nth") * F.col("length")).alias("offset"), at.alias("at"), "low", "high", F.floor((at - F.col("since")) / STRIDE).alias("range"))


def split(data: bytes) -> list[tuple[int, int, str | None]]:
    """``(offset, length, record id)`` of all records of a WARC file, plain or compressed record by record.

    They cover every byte: what follows where no further record can be read, as in a file cut off or overwritten, is one more,
    without an id.
    """
    spans, at, view = [], 0, memoryview(data)
    while at < len(data):
        length, head = 0, b""
        if data[at : at + 2] == b"\x1f\x8b":
            member = zlib.decompressobj(wbits=31)
            to = at
            try:
                while not member.eof and to < len(data):
                    body = member.decompress(view[to : to + _PIECE])
                    head = head or body.partition(b"\r\n\r\n")[0] + b"\r\n"
                    to += _PIECE
                length = min(to, len(data)) - at - len(member.unused_data) if member.eof else 0
            except zlib.error:
                length = 0
        else:
            end = data.find(b"\r\n\r\n", at)
            size = _LENGTH.search(data, at, end + 2) if data.startswith(b"WARC/", at) and end >= 0 else None
            length = end + 8 + int(size[1]) - at if size else 0
            head = data[at : end + 2] if size else b""
        if length <= 0 or at + length > len(data):
            length, head = len(data) - at, b""
        name = _ID.search(head)
        spans.append((at, length, name[1].decode("latin-1") if name else None))
        at += length
    return spans


def archive_records(files: DataFrame) -> DataFrame:
    """``(archive, record_id, offset, length, digest, at, low, high, range)`` of the records of WARC files ``(path, content)``, as the
    binary source reads them; ``archive`` is the path, so replicas are compared file by file if the ends of their paths are given.

    A file is read by one task; only digests leave it. A null or empty file has no records. Files of one path are one archive, in
    whatever order. A record without an id goes by its digest.
    """
    schema = StructType.fromDDL(f"archive string, record_id string, offset long, length long, digest string, {_PLACED}")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                data, rows = content.as_py() or b"", []
                low = high = ""
                since = 0
                for at, (offset, length, name) in enumerate(split(data)):
                    digest = hashlib.sha256(memoryview(data)[offset : offset + length]).hexdigest()
                    own = hashlib.md5(f"{name or ''}/{digest}".encode()).hexdigest()
                    if at and own.startswith(CUT):
                        low, since = own, at
                        high = own if own.startswith(HIGH_CUT) else high
                    rows.append((path.as_py(), name or digest, offset, length, digest, at, low, high, (at - since) // STRIDE))
                yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, r)) for r in rows], schema=arrow)

    return files.select("path", "content").mapInArrow(run, schema)


def _fold(children: DataFrame, keys: list[str]) -> DataFrame:
    """Hash of each node: SHA-256 of its children's hashes in the order of their records. A node's children are few."""
    parts = F.array_sort(F.collect_list(F.struct("at", "hash")))
    return children.groupBy(*keys).agg(F.sha2(F.array_join(F.transform(parts, lambda x: x.hash), ""), 256).alias("hash"), F.min("at").alias("at"))


#: Keys of the nodes of each level, leaves first.
_KEYS = (["archive", "high", "low", "range"], ["archive", "high", "low", "range1"], ["archive", "high", "low", "range2"], ["archive", "high"], ["archive"])


def _keyed(df: DataFrame) -> DataFrame:
    return df.withColumn("range1", F.floor(F.col("range") / STRIDE)).withColumn("range2", F.floor(F.col("range") / STRIDE**2))


def _leaf() -> Column:
    return F.sha2(F.concat_ws(":", F.col("length").cast("string"), "digest"), 256).alias("hash")


def tree(records: DataFrame) -> list[DataFrame]:
    """Levels of the trees of all archives, leaves first; the last has one root per archive. Each has its keys, ``hash`` and ``at``.

    ``records`` has ``archive, length, digest`` and its ranges. The leaf level is checkpointed, so that records are folded once
    however often the tree is read. No hash depends on an offset.
    """
    levels = [cut(_keyed(_fold(records.select(*_KEYS[0], "at", _leaf()), _KEYS[0])))]
    for keys in _KEYS[1:]:
        up = _fold(levels[-1], keys)
        levels.append(up.withColumn("range2", F.floor(F.col("range1") / STRIDE)) if "range1" in keys else up)
    return levels


def root(levels: list[DataFrame]) -> DataFrame:
    """One hash for all archives: ``(hash)``; no archive, no row. Archives are folded by the MD5 of their names, in three steps."""
    now = levels[-1].select(F.md5(F.col("archive").cast("string")).alias("name"), "hash")
    for digits in (4, 2, 0):
        parts = F.array_sort(F.collect_list(F.struct("name", "hash")))
        now = now.groupBy(F.substring("name", 1, digits).alias("up")).agg(F.sha2(F.array_join(F.transform(parts, lambda x: x.hash), ""), 256).alias("hash")).withColumnRenamed("up", "name")
    return now.select("hash")


def _differ(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of nodes that only one has, or whose hashes differ."""
    other = right.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("hash").alias("_hash"))
    joined = left.select(*keys, "hash").join(other, [F.col(k) == F.col(f"_{k}") for k in keys], "full")
    return joined.filter(~F.col("hash").eqNullSafe(F.col("_hash"))).select(*(F.coalesce(k, f"_{k}").alias(k) for k in keys))


def compare(left: DataFrame, right: DataFrame, trees: tuple[list[DataFrame], list[DataFrame]] | None = None) -> DataFrame:
    """Records in which two replicas differ: ``archive, record_id, offset, status`` (``changed``, ``missing`` or ``extra`` in the right
    one); the offset is that of the replica which has the record, the left one if both have.

    Roots are compared first; below, only children of nodes that differ are, down to the records of ranges that differ. Where
    replicas agree, nothing under the root is joined but an empty table. In those ranges a record is intact if the other replica
    has its id and digest, wherever; what is left of one id is paired in the order of offsets as changed, and else is missing or
    extra. So records of one id, or repeated ones, give a row for each copy too few or too many. ``trees`` are those of the
    replicas, if at hand.
    """
    a, b = trees or (tree(left), tree(right))
    wrong = cut(_differ(a[-1], b[-1], _KEYS[-1]))
    for k in range(len(_KEYS) - 2, -1, -1):
        above = _KEYS[k + 1]
        parents = wrong.select(*(F.col(c).alias(f"p_{c}") for c in above))
        under = [x[k].join(parents, [F.col(c) == F.col(f"p_{c}") for c in above], "left_semi") for x in (a, b)]
        wrong = cut(_differ(*under, _KEYS[k]))
    ranges = wrong.select(*(F.col(c).alias(f"p_{c}") for c in _KEYS[0]))
    inside = [x.join(ranges, [F.col(c) == F.col(f"p_{c}") for c in _KEYS[0]], "left_semi").select("archive", "record_id", "offset", F.coalesce("digest", F.lit("")).alias("digest")) for x in (left, right)]
    sides = cut(inside[0].withColumn("side", F.lit(0)).unionByName(inside[1].withColumn("side", F.lit(1))))
    same = ["archive", "record_id", "digest"]
    counts = sides.groupBy(*same).agg(F.count_if(F.col("side") == 0).alias("l"), F.count_if(F.col("side") == 1).alias("r")).filter("l <> r")
    known = counts.select(*(F.col(c).alias(f"_{c}") for c in same), "l", "r")
    odd = sides.join(known, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in same]).select(*sides.columns, "l", "r")
    order = Window.partitionBy(*same, "side").orderBy("offset")
    # copies beyond those that the other side has
    over = odd.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") > F.least("l", "r"))
    numbered = over.withColumn("nth", F.row_number().over(Window.partitionBy("archive", "record_id", "side").orderBy("offset", "digest")))
    paired = numbered.groupBy("archive", "record_id", "nth").agg(F.min(F.when(F.col("side") == 0, F.col("offset"))).alias("left"), F.min(F.when(F.col("side") == 1, F.col("offset"))).alias("right"))
    status = F.when(F.col("left").isNull(), "extra").when(F.col("right").isNull(), "missing").otherwise("changed")
    return paired.select("archive", "record_id", F.coalesce("left", "right").alias("offset"), status.alias("status"))


def damaged(page_id: str = "page_id") -> tuple[Column, Column]:
    """Which records the demonstration's second replica has lost, and which it has with a wrong byte: by the MD5 of their id."""
    fate = F.substring(F.md5(F.concat(F.coalesce(F.col(page_id).cast("string"), F.lit("")), F.lit("/replica"))), 1, 2)
    return fate == "00", fate.isin("01", "02")


def replicas(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> tuple[DataFrame, DataFrame]:
    """Two replicas of the pages' records; the second has lost some records and has others altered, see ``damaged``, so that what
    follows them lies elsewhere. Each record is written and hashed where its page is read.

    Null columns are empty in a record; repeated rows are records of their own; no pages, no archives. Archives are dealt by id and
    digest, so that pages of one id, or of none, spread.
    """
    text = record(F.col(id_column), F.col(url_column), F.col(html_column))
    lost, altered = damaged(id_column)
    wrong = F.concat(F.substring(text, 1, F.char_length(text) - 1), F.lit("\x15"))
    rows = cut(
        pages.select(
            F.col(id_column).alias("page_id"),
            F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("record_id"),
            F.octet_length(text).cast("long").alias("length"),
            F.sha2(text, 256).alias("digest"),
            F.when(lost, None).when(altered, F.sha2(wrong, 256)).otherwise(F.sha2(text, 256)).alias("other"),
        )
    )
    archives = max(1, -(-rows.count() // RECORDS))
    archive = F.pmod(F.conv(F.substring(mark(F.col("record_id"), F.col("digest")), 9, 8), 16, 10).cast("long"), F.lit(archives))
    dealt = rows.withColumn("archive", archive).withColumn("first", F.col("digest"))
    second = dealt.filter("other IS NOT NULL").withColumn("digest", F.col("other"))
    return tuple(cut(lay_out(x.drop("other"), ["page_id", "first"]).drop("first")) for x in (dealt, second))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: place, digest and state in the second replica of every page's record, with the roots of its archive in both."""
    left, right = replicas(read(spark, sf_dir, "pages"))
    trees = tree(left), tree(right)
    found = cut(compare(left, right, trees)).filter("status <> 'extra'").select(F.col("archive").alias("f_archive"), F.col("offset").alias("f_offset"), "status")
    roots = [t[-1].select(F.col("archive").alias(f"{n}_archive"), F.col("hash").alias(f"{n}_root")) for t, n in zip(trees, ("left", "right"))]
    marked = left.join(found, (F.col("archive") == F.col("f_archive")) & (F.col("offset") == F.col("f_offset")), "left")
    rooted = reduce(lambda df, r: df.join(r, F.col("archive") == F.col(r.columns[0]), "left"), roots, marked)
    return rooted.select("page_id", "archive", "offset", "length", "digest", F.coalesce("status", F.lit("intact")).alias("status"), "left_root", "right_root")


#: DuckDB: every record compared directly; the roots by folding all levels.
ORACLE = r"""
WITH t AS (SELECT page_id, coalesce(CAST(page_id AS VARCHAR), '') AS key, 'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:'
  || coalesce(CAST(page_id AS VARCHAR), '') || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: '
  || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS body FROM pages),
h AS (SELECT page_id, key, CAST(strlen(body) AS BIGINT) AS length, sha256(body) AS digest, sha256(substr(body, 1, length(body) - 1) || chr(21)) AS wrong, substr(md5(key || '/replica'), 1, 2) AS fate FROM t),
p AS (SELECT *, CAST('0x' || substr(md5(key || '/' || digest), 9, 8) AS BIGINT) % (SELECT greatest(1, (count(*) + 999) // 1000) FROM h) AS archive FROM h),
q AS (SELECT 0 AS side, *, digest AS own FROM p UNION ALL SELECT 1, *, CASE WHEN fate IN ('01', '02') THEN wrong ELSE digest END FROM p WHERE fate <> '00'),
o AS (SELECT *, CAST(coalesce(sum(length) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off, row_number() OVER w - 1 AS pos,
  md5(key || '/' || own) AS mark FROM q WINDOW w AS (PARTITION BY side, archive ORDER BY page_id NULLS FIRST, digest)),
f AS (SELECT *, pos = min(pos) OVER (PARTITION BY side, archive, key, digest) AS leads FROM o),
c AS (SELECT *, last_value(CASE WHEN pos = 0 THEN '' WHEN leads AND mark LIKE '0%' THEN mark END IGNORE NULLS) OVER w AS low, last_value(CASE WHEN pos = 0 THEN '' WHEN leads AND mark LIKE '00%' THEN mark END IGNORE NULLS) OVER w AS high,
  last_value(CASE WHEN pos = 0 OR (leads AND mark LIKE '0%') THEN pos END IGNORE NULLS) OVER w AS since FROM f WINDOW w AS (PARTITION BY side, archive ORDER BY pos ROWS UNBOUNDED PRECEDING)),
l0 AS (SELECT side, archive, high, low, (pos - since) // 64 AS r, min(pos) AS pos, sha256(string_agg(sha256(length || ':' || own), '' ORDER BY c.pos)) AS hash FROM c GROUP BY side, archive, high, low, (pos - since) // 64),
l1 AS (SELECT side, archive, high, low, r // 64 AS r, min(pos) AS pos, sha256(string_agg(hash, '' ORDER BY l0.pos)) AS hash FROM l0 GROUP BY side, archive, high, low, l0.r // 64),
l2 AS (SELECT side, archive, high, low, r // 64 AS r, min(pos) AS pos, sha256(string_agg(hash, '' ORDER BY l1.pos)) AS hash FROM l1 GROUP BY side, archive, high, low, l1.r // 64),
l3 AS (SELECT side, archive, high, min(pos) AS pos, sha256(string_agg(hash, '' ORDER BY l2.pos)) AS hash FROM l2 GROUP BY side, archive, high),
l4 AS (SELECT side, archive, sha256(string_agg(hash, '' ORDER BY pos)) AS hash FROM l3 GROUP BY side, archive)
SELECT page_id, archive, off AS "offset", length, digest, CASE WHEN fate = '00' THEN 'missing' WHEN fate IN ('01', '02') THEN 'changed' ELSE 'intact' END AS status,
  (SELECT hash FROM l4 WHERE side = 0 AND l4.archive = o.archive) AS left_root, (SELECT hash FROM l4 WHERE side = 1 AND l4.archive = o.archive) AS right_root FROM o WHERE side = 0
"""
