"""Statistics of whole documents, vectorised over a slice of a batch."""

from __future__ import annotations

import numpy as np

from argil.llm._text import IS_WORD, hash_spans, hash_windows, window_starts, words

_CHARS = {
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "symbol": b"#*$%&|<>",
    "sentence": b".!?",
    "punctuation": b",;:'\"()-",
    "bracket": b"{}[]=_/\\~^@+`",
    "line": b"\n",
    "space": b" \t\v\f\r",
}
_CLASS = np.full(256, len(_CHARS), dtype=np.int64)
for _k, _v in enumerate(_CHARS.values()):
    _CLASS[list(_v)] = _k
_NON_ASCII = len(_CHARS) + 1
_CLASS[0x80:] = _NON_ASCII
_CONTINUES = np.zeros(256, dtype=bool)
_CONTINUES[0x80:0xC0] = True
SYMBOL = np.zeros(256, dtype=bool)
SYMBOL[list(_CHARS["symbol"])] = True

FEATURES = (
    *(f"share_{k}" for k in (*_CHARS, "other", "non_ascii")),
    "log_words", "mean_word", "deviation_word", "longest_word", "share_short_words", "share_long_words", "share_symbol_ends", "share_symbol_words",
    "share_sentence_ends", "share_repeated_words", "share_distinct_words", "log_lines", "words_a_line", "share_repeated_lines", "share_repeated_windows",
)


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of each run ``values[first[i]:first[i + 1]]``."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64 if values.dtype.kind in "biu" else np.float64)))
    return total[first[1:]] - total[first[:-1]]


def code_points(data: np.ndarray) -> np.ndarray:
    """Code points that end before each byte, one more than there are bytes."""
    return np.concatenate(([0], np.cumsum(~_CONTINUES[data[:-8]])))


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all lines that hold a word, and the row of each."""
    n = len(data) - 8
    breaks = np.flatnonzero(data[:n] == 0x0A)
    starts = np.concatenate((offsets[:-1], breaks + 1))
    ends = np.concatenate((offsets[1:], breaks))
    starts.sort()
    ends.sort()
    inside = np.concatenate(([0], np.cumsum(IS_WORD[data[:n]])))
    live = inside[ends] > inside[starts]
    starts, ends = starts[live], ends[live]
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def repeats(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each item whether another of its row equals it, and whether an earlier one does."""
    order = np.lexsort((h, row))
    same = (row[order][1:] == row[order][:-1]) & (h[order][1:] == h[order][:-1])
    any_, later = np.zeros(len(h), dtype=bool), np.zeros(len(h), dtype=bool)
    any_[order[1:]] |= same
    any_[order[:-1]] |= same
    later[order[1:]] = same
    return any_, later


def repeated_words(h: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    """Words of each row that lie in windows of ``size`` words found twice or more in the row, the first one included."""
    places, row = window_starts(first, size)
    again, _ = repeats(row, hash_windows(h, size)[places]) if len(places) else (np.zeros(0, dtype=bool), None)
    edge = np.zeros(len(h) + 1, dtype=np.int64)
    np.add.at(edge, places[again], 1)
    np.add.at(edge, places[again] + size, -1)
    return sums(np.cumsum(edge[:-1]) > 0, first)


def features(data: np.ndarray, offsets: np.ndarray, window: int = 8) -> np.ndarray:
    """``FEATURES`` of each row, (rows, features); an empty text has zeros."""
    n_rows, size = len(offsets) - 1, np.diff(offsets)
    kinds = np.zeros((n_rows, _NON_ASCII + 1))
    row_of_byte = np.repeat(np.arange(n_rows), size)
    counts = np.bincount(row_of_byte * (_NON_ASCII + 1) + _CLASS[data[:-8]], minlength=n_rows * (_NON_ASCII + 1))
    kinds += counts.reshape(n_rows, -1)
    kinds /= np.maximum(size, 1)[:, None]
    starts, ends, first = words(data, offsets)
    n = np.diff(first)
    some = np.maximum(n, 1)
    points = code_points(data)
    length = points[ends] - points[starts]
    h = hash_spans(data, starts, ends)
    row = np.repeat(np.arange(n_rows), n)
    _, later = repeats(row, h)
    longest = np.zeros(n_rows)
    np.maximum.at(longest, row, length)
    marks = np.concatenate(([0], np.cumsum(SYMBOL[data[:-8]])))
    line_starts, line_ends, line_row = lines(data, offsets)
    n_lines = np.bincount(line_row, minlength=n_rows)
    _, line_later = repeats(line_row, hash_spans(data, line_starts, line_ends))
    mean = sums(length, first) / some
    neighbour = np.zeros(len(h), dtype=bool)
    neighbour[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    per_word = (length <= 3, length >= 12, SYMBOL[data[ends - 1]] if len(ends) else later, marks[ends] > marks[starts], _CLASS[data[ends - 1]] == 4 if len(ends) else later, neighbour)
    columns = [np.log1p(n), mean, np.sqrt(np.maximum(sums(length.astype(np.float64) ** 2, first) / some - mean**2, 0)), longest]
    columns += [sums(x, first) / some for x in per_word]
    columns += [1 - sums(later, first) / some, np.log1p(n_lines), n / np.maximum(n_lines, 1), np.bincount(line_row, line_later, minlength=n_rows) / np.maximum(n_lines, 1), repeated_words(h, first, window) / some]
    return np.concatenate((kinds, np.stack(columns, axis=1)), axis=1)
