"""Rule packs: detections that ship as data.

Two notations give the same ``PackRule``: TOML, one match per rule, and the ``MODEL_RULE`` language, whose conditions combine
strings, imports and opcodes::

    MODEL_RULE leaked_key {
        meta:
            id = "ORG-1"
            severity = critical
        target:
            metadata, raw
        strings:
            $k = /\\bKEY-[0-9]{8}\\b/
        condition:
            $k and not import("torch.*")
    }
"""

from __future__ import annotations

import re
import tomllib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from argil.functions.dims import SEVERITIES

TARGETS = frozenset(("metadata", "raw", "pickle"))


class RuleError(ValueError):
    """A rule pack that can't be read; says where."""


@dataclass(frozen=True)
class Node:
    """A condition. ``kind`` is ``and``, ``or``, ``not`` with ``parts``, else ``string``, ``import`` or ``opcode`` with ``value``."""

    kind: str
    value: str = ""
    parts: tuple[Node, ...] = ()

    def facts(self, rule: int) -> Iterator[tuple[str, str]]:
        """All (fact, value) that the condition asks about; a fact's name holds all that tells it from others."""
        for p in self.parts:
            yield from p.facts(rule)
        if self.kind in ("string", "import", "opcode"):
            yield self.fact(rule), self.value

    def fact(self, rule: int) -> str:
        return f"string:{rule}:{self.value}" if self.kind == "string" else f"{self.kind}:{self.value}"

    def column(self, rule: int, known: Column) -> Column:
        """The condition over an array of facts that hold."""
        if self.kind == "not":
            return ~self.parts[0].column(rule, known)
        if self.kind in ("and", "or"):
            columns = [p.column(rule, known) for p in self.parts]
            return reduce(lambda a, b: a & b if self.kind == "and" else a | b, columns)
        return F.array_contains(known, self.fact(rule))


@dataclass(frozen=True)
class PackRule:
    rule_id: str
    name: str
    severity: str
    confidence: float
    targets: frozenset[str]
    condition: Node
    strings: dict[str, str] = field(default_factory=dict)
    references: tuple[str, ...] = ()
    remediation: str | None = None
    scanner: str = "rules"

    def __post_init__(self) -> None:
        if self.severity not in SEVERITIES:
            raise RuleError(f"{self.rule_id}: no severity {self.severity!r}")
        if not self.targets or self.targets - TARGETS:
            raise RuleError(f"{self.rule_id}: no target {sorted(self.targets - TARGETS)}")
        for pattern in self.strings.values():
            try:
                re.compile(pattern)
            except re.error as e:
                raise RuleError(f"{self.rule_id}: {e}") from e
        for fact, value in self.condition.facts(0):
            if fact.startswith("string:") and value not in self.strings:
                raise RuleError(f"{self.rule_id}: no string {value}")


def load_toml(text: str) -> list[PackRule]:
    """Rules of a TOML pack."""
    try:
        rows = tomllib.loads(text).get("rule", [])
    except tomllib.TOMLDecodeError as e:
        raise RuleError(str(e)) from e
    out = []
    for row in rows:
        match = row.get("match", {})
        if "id" not in row or len(match) != 1 or not set(match) <= {"regex", "global"}:
            raise RuleError(f"a rule needs an id, and a match that is a regex or a global: {row.get('id', row)}")
        pattern = match.get("regex")
        condition = Node("import", match["global"]) if pattern is None else Node("string", "$m")
        targets = frozenset(t.strip() for t in row.get("target", "pickle" if pattern is None else "metadata|raw").split("|"))
        out.append(PackRule(row["id"], row.get("name", row["id"]), row.get("severity", "medium"), float(row.get("confidence", 0.8)), targets, condition, {} if pattern is None else {"$m": pattern}, tuple(row.get("references", ())), row.get("remediation"), row.get("scanner", "rules")))
    return out


_TOKEN = re.compile(
    r"""\s+|\#[^\n]*|//[^\n]*|(?P<regex>/(?:[^/\\\n]|\\.)+/[is]*)|(?P<text>"(?:[^"\\\n]|\\.)*")|(?P<number>\d+(?:\.\d+)?)|(?P<var>\$\w+)|(?P<word>[A-Za-z_][\w.\-]*)|(?P<sign>[{}():=,])""",
    re.X,
)


class _Parser:
    """Recursive descent; ``and`` binds tighter than ``or``."""

    def __init__(self, text: str) -> None:
        self.tokens: list[tuple[str, str, int]] = []
        at = 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise RuleError(f"line {text.count(chr(10), 0, at) + 1}: what is {text[at : at + 10]!r}?")
            if m.lastgroup:
                self.tokens.append((m.lastgroup, m[0], text.count("\n", 0, at) + 1))
            at = m.end()
        self.at = 0

    def peek(self, ahead: int = 0) -> str:
        return self.tokens[self.at + ahead][1] if self.at + ahead < len(self.tokens) else ""

    def take(self, *wanted: str, kind: str | None = None) -> str:
        if self.at >= len(self.tokens):
            raise RuleError(f"the pack ends where {kind or ' or '.join(wanted)} is due")
        own, value, line = self.tokens[self.at]
        if (wanted and value not in wanted) or (kind and own != kind):
            raise RuleError(f"line {line}: {value!r} where {kind or ' or '.join(wanted)} is due")
        self.at += 1
        return value

    def rules(self) -> list[PackRule]:
        out = []
        while self.at < len(self.tokens):
            self.take("MODEL_RULE")
            out.append(self.rule(self.take(kind="word")))
        return out

    def rule(self, name: str) -> PackRule:
        meta, strings, targets = {}, {}, []
        self.take("{")
        self.take("meta")
        self.take(":")
        while self.peek(1) == "=":
            key = self.take(kind="word")
            self.take("=")
            meta[key] = _literal(self.take())
        self.take("target")
        self.take(":")
        targets.append(self.take(kind="word"))
        while self.peek() == ",":
            self.take(",")
            targets.append(self.take(kind="word"))
        if self.peek() == "strings":
            self.take("strings")
            self.take(":")
            while self.peek().startswith("$"):
                var = self.take(kind="var")
                self.take("=")
                strings[var] = _pattern(self.take())
        self.take("condition")
        self.take(":")
        condition = self.either()
        self.take("}")
        listed = meta.get("references", meta.get("reference", ""))
        references = tuple(r.strip() for r in listed.split(",") if r.strip())
        return PackRule(meta.get("id", name), meta.get("title", name), meta.get("severity", "medium"), float(meta.get("confidence", 0.8)), frozenset(targets), condition, strings, references, meta.get("remediation"))

    def either(self) -> Node:
        parts = [self.both()]
        while self.peek() == "or":
            self.take("or")
            parts.append(self.both())
        return parts[0] if len(parts) == 1 else Node("or", parts=tuple(parts))

    def both(self) -> Node:
        parts = [self.term()]
        while self.peek() == "and":
            self.take("and")
            parts.append(self.term())
        return parts[0] if len(parts) == 1 else Node("and", parts=tuple(parts))

    def term(self) -> Node:
        if self.peek() == "not":
            self.take("not")
            return Node("not", parts=(self.term(),))
        if self.peek() == "(":
            self.take("(")
            inner = self.either()
            self.take(")")
            return inner
        if self.peek().startswith("$"):
            return Node("string", self.take(kind="var"))
        kind = self.take("import", "opcode")
        self.take("(")
        value = _literal(self.take(kind="text" if kind == "import" else "word"))
        self.take(")")
        return Node(kind, value)


def _literal(token: str) -> str:
    return re.sub(r"\\(.)", r"\1", token[1:-1]) if token.startswith('"') else token


def _pattern(token: str) -> str:
    if token.startswith("/"):
        body, _, flags = token[1:].rpartition("/")
        return (f"(?{flags})" if flags else "") + body.replace("\\/", "/")
    return re.escape(_literal(token))


def load(text: str) -> list[PackRule]:
    """Rules of a pack in either notation."""
    return _Parser(text).rules() if "MODEL_RULE" in text else load_toml(text)


def imports_of(rules: Sequence[PackRule]) -> list[str]:
    return sorted({v for i, r in enumerate(rules) for f, v in r.condition.facts(i) if f.startswith("import:")})


def opcodes_of(rules: Sequence[PackRule]) -> list[str]:
    return sorted({v for i, r in enumerate(rules) for f, v in r.condition.facts(i) if f.startswith("opcode:")})
