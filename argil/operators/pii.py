"""Personal data in metadata values."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from argil.functions import dims
from argil.functions import expressions as X
from argil.operators.findings import finding, seq


def numbered(rule: int) -> Callable[[Column, Column], Column]:
    """A lambda that turns a match and its number into ``struct(rule, n, hit)``."""
    return lambda hit, n: F.struct(F.lit(rule).alias("rule"), n.alias("n"), hit.alias("hit"))


def hits(value: Column, rules: Sequence[dims.Rule] = dims.PII_RULES) -> Column:
    """Array of ``struct(rule, n, hit)``, all rules in one pass over a value: the first matches of each, of cards those that
    satisfy Luhn among the first matches. A value without a digit is passed over by the rules that need one."""
    parts = []
    for i, rule in enumerate(rules):
        found = F.transform(X.found(value, rule), numbered(i))
        parts.append(F.filter(found, lambda s: X.luhn_ok(s.hit)) if rule.rule_id == dims.LUHN_RULE else found)
    rest = [p for p, rule in zip(parts, rules) if not rule.digits]
    if len(rest) == len(parts):
        return F.concat(*parts)
    return F.when(X.has_digit(value), F.concat(*parts)).otherwise(F.concat(*rest) if rest else F.lit(None))


def exploded(kv: DataFrame, rules: Sequence[dims.Rule] = dims.PII_RULES) -> DataFrame:
    """One row per hit: ``path, ord, key, rule, n, hit``."""
    return kv.select("path", "ord", "key", F.explode(hits(F.col("value"), rules)).alias("h")).select("path", "ord", "key", "h.*")


def scan(kv: DataFrame, rules: Sequence[dims.Rule] = dims.PII_RULES) -> DataFrame:
    """Findings of all values, evidence redacted. A null value has none."""

    def of(attribute: str) -> Column:
        return F.element_at(F.array(*(F.lit(getattr(r, attribute)) for r in rules)), F.col("rule") + 1)

    references = F.element_at(F.array(*(F.array(*map(F.lit, r.references)) for r in rules)), F.col("rule") + 1)
    return exploded(kv, rules).select(
        *finding(
            "pii",
            F.col("path"),
            seq("pii", F.col("ord"), F.shiftleft(F.col("rule"), 16) + F.col("n")),
            of("rule_id"),
            of("severity"),
            of("confidence"),
            F.concat(of("name"), F.lit(" in metadata field `"), "key", F.lit("`")),
            F.concat(F.lit("The value of `"), "key", F.lit("` looks like personal data: "), F.lower(of("name")), F.lit(".")),
            F.concat(F.lit("metadata:"), "key"),
            references=references,
            evidence=X.redact(F.col("hit")),
        )
    )
