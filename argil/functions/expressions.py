"""Scalar functions as column expressions, all on the JVM side."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from argil.functions import dims


def _lookup(severity: Column, table: dict[str, object]) -> Column:
    return reduce(lambda c, kv: c.when(severity == kv[0], F.lit(kv[1])), list(table.items())[1:], F.when(severity == next(iter(table)), F.lit(next(iter(table.values())))))


def sev_ord(severity: Column) -> Column:
    """0 (info) to 4 (critical); null for anything else."""
    return _lookup(severity, {s: i for i, s in enumerate(dims.SEVERITIES)}).cast("tinyint")


def sev_weight(severity: Column) -> Column:
    return _lookup(severity, dims.WEIGHTS)


def sarif_level(severity: Column) -> Column:
    return _lookup(severity, dims.SARIF_LEVELS)


def severity_name(ordinal: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, dims.SEVERITIES)), ordinal.cast("int") + 1)


def redact(value: Column) -> Column:
    """Stars for up to eight characters, else the first and last four and the length."""
    n = F.char_length(value)
    return F.when(n <= 8, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.left(value, F.lit(4)), F.lit("…"), F.right(value, F.lit(4)), F.lit(" ("), n.cast("string"), F.lit(" chars)")))


def luhn_ok(value: Column) -> Column:
    """Whether the ASCII digits of a string, 13 at least, satisfy the Luhn sum; other characters don't count."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.length(digits)

    def step(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), step)
    return F.when(n < 13, F.lit(False)).otherwise(total % 10 == 0)


def matches(value: Column, pattern: str) -> Column:
    """All matches. The pattern is a literal, so that it is compiled once; digits, spaces and word borders are those of Unicode."""
    return F.regexp_extract_all(value, F.lit("(?U)" + pattern), F.lit(0))


def _if_needed(value: Column, needs: Sequence[str], found: Column, nothing: Column) -> Column:
    """A search, passed over at the cost of a byte search where a value holds none of what a match needs."""
    return F.when(reduce(Column.__or__, (F.contains(value, F.lit(n)) for n in needs)), found).otherwise(nothing) if needs else found


def found(value: Column, rule: dims.Rule) -> Column:
    """The first ``rule.most`` matches of a rule, in linear time where it has a form for that. A value that holds none of what a match
    needs is not searched."""
    pattern, group = (rule.linear, 1) if rule.linear else (rule.pattern, 0)
    out = F.regexp_extract_all(value, F.lit("(?U)" + pattern), F.lit(group))
    return F.slice(_if_needed(value, rule.needs, out, F.array().cast("array<string>")), 1, rule.most)


def first_match(value: Column, rule: dims.Rule) -> Column:
    """The first match or null."""
    found = F.regexp_extract(value, "(?U)" + rule.pattern, 0)
    return _if_needed(value, rule.needs, F.when(found != "", found), F.lit(None).cast("string"))


def has_digit(value: Column) -> Column:
    """Whether a text holds a decimal digit: a byte search for ours; one of another script takes a pattern, and a text that isn't ASCII."""
    ours = reduce(Column.__or__, (F.contains(value, F.lit(str(d))) for d in range(10)))
    return ours | ((F.octet_length(value) != F.char_length(value)) & F.rlike(value, F.lit(r"(?U)\d")))


def human_bytes(n: Column) -> Column:
    """Bytes with a binary unit, one decimal from KiB on, a tie going to the even one."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for power, unit in ((1, "KiB"), (2, "MiB"), (3, "GiB"), (4, "TiB")):
        out = F.when(n >= 1024**power, F.format_string(f"%.1f {unit}", F.bround(n / float(1024**power), 1))).otherwise(out)
    return out


def score_band(score: Column) -> Column:
    return F.when(score >= 60, "red").when(score >= 20, "yellow").otherwise("green")


def risk(raw: Column) -> Column:
    """0 to 100 from the sum of weight times confidence; no sum, no risk."""
    total = F.coalesce(raw.cast("double"), F.lit(0.0))
    return F.least(F.lit(100), F.round(100 * (1 - F.exp(-total / 16)))).cast("int")


def clamp(confidence: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence))


def is_benign(module: Column) -> Column:
    return (module == "torch") | module.startswith("torch.") | module.startswith("numpy") | module.isin("collections", "__builtin__", "builtins")


def classify_import(module: Column, name: Column, rules: Sequence[tuple[str, str, str]] = dims.IMPORT_RULES) -> Column:
    """The first import rule that matches, as ``struct(severity, why)``, or null.

    Two map lookups, one by module and one by full name, so that each import costs the same however many rules there are. Rules
    for nested modules are rare and tried in turn.
    """
    kind = "struct<ord:int,severity:string,why:string>"

    def entry(i: int, severity: str, why: str) -> Column:
        return F.struct(F.lit(i).alias("ord"), F.lit(severity).alias("severity"), F.lit(why).alias("why"))

    def table(chosen: dict[str, tuple[int, str, str]], key: Column) -> Column:
        if not chosen:
            return F.lit(None).cast(kind)
        return F.create_map(*(x for k, v in chosen.items() for x in (F.lit(k), entry(*v))))[key]

    tops: dict[str, tuple[int, str, str]] = {}
    names: dict[str, tuple[int, str, str]] = {}
    nested = []
    for i, (pattern, severity, why) in enumerate(rules):
        if not pattern.endswith("."):
            names.setdefault(pattern, (i, severity, why))
        elif "." not in pattern[:-1]:
            tops.setdefault(pattern[:-1], (i, severity, why))
        else:
            nested.append(F.when((module == pattern[:-1]) | module.startswith(pattern), entry(i, severity, why)))
    found = F.array_compact(F.array(table(tops, F.substring_index(module, ".", 1)), table(names, F.concat_ws(".", module, name)), *nested))
    best = F.get(F.array_sort(found), F.lit(0))
    return F.when(best.isNotNull(), F.struct(best.severity.alias("severity"), best.why.alias("why")))


def extension(path: Column) -> Column:
    """What follows the last dot of the file name; a name that only begins with a dot has none."""
    return F.regexp_extract(path, r"[^/]\.([^./]+)$", 1)


def is_candidate(path: Column) -> Column:
    """Whether a directory walk takes a file: by its extension, upper case being another."""
    return extension(path).isin(*dims.CANDIDATE_EXTENSIONS)


def looks_like_pickle(content: Column) -> Column:
    first = F.hex(F.substring(content, 1, 1))
    return (first == "80") | (first.isin("28", "63", "7D", "5D") & (F.octet_length(content) > 2))


def detect_format(path: Column, content: Column) -> Column:
    """Format by magic bytes, then extension, then shape, as ``decode.detect``. ``content`` may be the first 64 bytes."""
    magic = F.hex(F.substring(content, 1, 4))
    header = F.hex(F.substring(content, 1, 8))
    pickled = looks_like_pickle(content)
    low = F.conv(F.concat(*(F.substring(header, i, 2) for i in (7, 5, 3, 1))), 16, 10).cast("long")
    long = (F.substring(header, 9, 8) != "00000000") | (low > dims.MAX_HEADER)
    shaped = (F.octet_length(content) >= 9) & (header != "0000000000000000") & (F.hex(F.substring(content, 9, 1)) == "7B") & ~(pickled & long)
    return (
        F.when(magic == "47475546", "gguf")
        .when(magic == "47474D4C", "ggml")
        .when(magic == "504B0304", "pytorch-zip")
        .when(F.lower(extension(path)) == "onnx", "onnx")
        .when(shaped, "safetensors")
        .when(pickled, "pytorch-legacy-pickle")
        .otherwise("unknown")
    )
