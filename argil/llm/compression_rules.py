"""Quality rules: counts of words, symbols and repeats, and bands of zstandard compression ratios of whole texts and of chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from argil.llm._stats import SYMBOL, code_points, lines, repeated_words, repeats, sums
from argil.llm._text import hash_spans, raw, read, slices, words

LEVEL, WINDOW = 3, 8
#: From this many bytes on a whole text's ratio (compressed by plain size) must lie between these limits. Short texts hold little
#: to compress, and the frame itself weighs on them, so their limits are wide; prose lies at 0.4 to 0.5 from some kilobytes on,
#: repetition far below, and random letters at 0.7 and over.
BANDS = (
    (0, 0.0, np.inf),
    (128, 0.45, 1.15),
    (256, 0.44, 0.90),
    (512, 0.41, 0.80),
    (1024, 0.37, 0.70),
    (4096, 0.34, 0.62),
    (16384, 0.31, 0.58),
    (65536, 0.28, 0.56),
    (262144, 0.24, 0.55),
)
#: Size and limits of chunks; a text is cut into the largest that it fills, the last chunk ending where it ends. So much of a text's
#: chunks may lie outside.
CHUNKS, CHUNK_SHARE = ((512, 0.40, 0.82), (4096, 0.36, 0.64)), 1 / 3
LEAST_WORDS, MOST_REPEATED = 20, 30

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_FIELDS = [*((c, pa.int64()) for c in COUNTS), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("ratio", pa.float64()), ("n_chunks", pa.int64()), ("n_bad_chunks", pa.int64())]
_TYPES = {pa.int64(): T.LongType(), pa.bool_(): T.BooleanType(), pa.float64(): T.DoubleType()}


def counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The base counts of each row of a slice."""
    starts, ends, first = words(data, offsets)
    points = code_points(data)
    line_starts, line_ends, line_row = lines(data, offsets)
    _, later = repeats(line_row, hash_spans(data, line_starts, line_ends))
    return {
        "n_words": np.diff(first),
        "word_chars": sums(points[ends] - points[starts], first),
        "n_symbols": sums(SYMBOL[data[:-8]], offsets),
        "n_dup_lines": np.bincount(line_row[later], minlength=len(offsets) - 1),
        "n_repeat_words": repeated_words(hash_spans(data, starts, ends), first, WINDOW),
    }


def bands(text: memoryview, press: zstandard.ZstdCompressor) -> tuple[float | None, int, int, bool]:
    """Ratio of the whole text, number of chunks, how many of them lie outside their band, and whether all is within limits."""
    n = len(text)
    if not n:
        return None, 0, 0, True
    ratio = len(press.compress(text)) / n
    _, low, high = next(b for b in reversed(BANDS) if n >= b[0])
    size, least, most = next((c for c in reversed(CHUNKS) if n >= c[0]), (n + 1, 0.0, 0.0))
    starts = [*range(0, n - size + 1, size), *([n - size] if n > size and n % size else [])]
    bad = sum(not least <= len(press.compress(text[at : at + size])) / size <= most for at in starts)
    return ratio, len(starts), bad, low <= ratio <= high and bad <= CHUNK_SHARE * len(starts)


def judge(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """Add the base counts, ``base_failed``, ``kept`` and the compression figures to each row.

    A text fails the base rules with fewer than 20 words or with over 30 % of its words in 8-word windows that it has twice or
    more. Else it is kept if the ratio of the whole text lies in the band of its length and at most a third of its chunks, of 4096 bytes
    or of 512 in a shorter text, lie outside theirs. Null and empty texts have no words and fail. Columns of the added names are replaced; other columns, nulls in
    them and repeated rows pass through. Whole texts are read, one slice at a time; nothing is shuffled.
    """
    rest = [c for c in docs.columns if c not in {n for n, _ in _FIELDS} or c == text_column]
    place = rest.index(text_column)
    schema = docs.select(*rest).schema
    for name, kind in _FIELDS:
        schema = schema.add(name, _TYPES[kind])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            for part in slices(batch, text_column):
                data, offsets = raw(part.column(place))
                found: dict[str, object] = dict(counts(data, offsets))
                found["base_failed"] = (found["n_words"] < LEAST_WORDS) | (100 * found["n_repeat_words"] > MOST_REPEATED * found["n_words"])
                view = memoryview(data)
                figures = [bands(view[a:b], press) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                ratio, n, bad, within = zip(*figures)
                found |= {"kept": ~found["base_failed"] & np.array(within), "ratio": ratio, "n_chunks": n, "n_bad_chunks": bad}
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(found[c], kind) for c, kind in _FIELDS)], names=schema.names)

    return docs.select(*rest).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: base counts and verdict of every document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs).select("doc_id", *COUNTS, "base_failed", "kept", "ratio", "n_chunks", "n_bad_chunks")
