"""Search of raw bytes for credentials, free of Spark."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import cache
from typing import Any

from argil.functions import dims

_BREAK = re.compile(rb"[\x00-\x1f]")


@cache
def compiled(rules: tuple[dims.Rule, ...]) -> list[tuple[re.Pattern[bytes], int, list[bytes]]]:
    """Pattern, group and needed bytes of each rule."""
    return [(re.compile((r.linear or r.pattern).encode()), int(r.linear is not None), [n.encode() for n in r.needs]) for r in rules]


def span(data: Any, begin: int, end: int) -> tuple[int, int]:
    """What of ``data`` belongs to the share ``begin..end``: it is moved to begin and end after a control character, as no match of a
    credential holds one. Shares that lie next to each other stay so, and one within a run without such characters is empty."""
    if begin:
        own = _BREAK.search(data, begin - 1, end)
        if not own:
            return end, end
        begin = own.end()
    if end < len(data):
        last = _BREAK.search(data, end - 1)
        end = last.end() if last else len(data)
    return begin, end


def hits(data: Any, begin: int, end: int, rules: Sequence[dims.Rule] = dims.SECRET_RULES) -> Iterator[tuple[int, int, str]]:
    """``(rule, offset, match)`` of all matches in ``data[begin:end]``, bytes or a memory map. A rule whose needed bytes are missing
    costs a byte search."""
    for i, (pattern, group, needs) in enumerate(compiled(tuple(rules))):
        if needs and all(data.find(n, begin, end) < 0 for n in needs):
            continue
        for m in pattern.finditer(data, begin, end):
            yield i, m.start(group), m[group].decode("latin-1")
