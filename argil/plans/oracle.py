"""DuckDB twins of the expressions, from the same rules."""

from __future__ import annotations

from collections.abc import Sequence

from argil.functions import dims


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def quoted_list(texts: Sequence[str]) -> str:
    return "[" + ", ".join(map(quoted, texts)) + "]"


def redact(x: str) -> str:
    return f"CASE WHEN length({x}) <= 8 THEN repeat('*', length({x})) ELSE left({x}, 4) || '…' || right({x}, 4) || ' (' || length({x}) || ' chars)' END"


def case(x: str, table: dict[str, object]) -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{k}' THEN {quoted(v) if isinstance(v, str) else v}" for k, v in table.items()) + " END"


def sev_ord(x: str) -> str:
    return f"CAST({case(x, {s: i for i, s in enumerate(dims.SEVERITIES)})} AS TINYINT)"


def weight(x: str) -> str:
    return case(x, dims.WEIGHTS)


def luhn(x: str) -> str:
    digits = f"regexp_replace({x}, '[^0-9]', '', 'g')"
    d = f"CAST(substr({digits}, CAST(length({digits}) - i + 1 AS BIGINT), 1) AS INTEGER)"
    return f"(length({digits}) >= 13 AND list_sum(list_transform(range(1, length({digits}) + 1), lambda i: CASE WHEN i % 2 = 0 THEN CASE WHEN {d} > 4 THEN 2 * {d} - 9 ELSE 2 * {d} END ELSE {d} END)) % 10 = 0)"


def risk(x: str) -> str:
    return f"CAST(least(100, round(100 * (1 - exp(-CAST({x} AS DOUBLE) / 16)))) AS INTEGER)"


def human_bytes(n: str) -> str:
    units = " ".join(f"WHEN {n} >= {1024**p} THEN printf('%.1f {u}', {n} / {float(1024**p)}::DOUBLE)" for p, u in ((4, "TiB"), (3, "GiB"), (2, "MiB"), (1, "KiB")))
    return f"CASE {units} ELSE {n} || ' B' END"


def hits(kv: str, rule: dims.Rule) -> str:
    """Rows ``path, ord, key, n, hit``: the first matches of a rule in each value."""
    # a letter of any alphabet ends no word for Java; RE2 knows ASCII words only, so for digits letters become ASCII ones
    value = r"regexp_replace(value, '[\p{L}\p{M}]', 'x', 'g')" if rule.rule_id == dims.LUHN_RULE else "value"
    found = f"regexp_extract_all({value}, {quoted(rule.pattern)})"
    inner = f"SELECT path, ord, key, unnest({found}[1:{rule.most}]) AS hit, unnest(range(0, least({rule.most}, len({found})))) AS n FROM {kv}"
    return f"SELECT * FROM ({inner})" + (f" WHERE {luhn('hit')}" if rule.rule_id == dims.LUHN_RULE else "")


def path_hits(kv: str) -> str:
    unix, windows = (f"nullif(regexp_extract(value, {quoted(p)}), '')" for p in (dims.UNIX_PATH, dims.WINDOWS_PATH))
    return f"SELECT * FROM (SELECT path, ord, key, coalesce({unix}, {windows}) AS hit, 0 AS n FROM {kv}) WHERE hit IS NOT NULL"


def findings(kv: str, pii: Sequence[dims.Rule] = dims.PII_RULES, secrets: Sequence[dims.Rule] = dims.SECRET_RULES) -> str:
    """Rows ``path, rule_id, scanner, severity, confidence, key, n, hit`` of a metadata table without files."""
    parts = []
    for scanner, rules in (("secrets", secrets), ("pii", pii), ("metadata", dims.METADATA_RULES)):
        for r in rules:
            rows = path_hits(kv) if r.rule_id == "THK-MET-001" else hits(kv, r)
            parts.append(f"SELECT path, '{r.rule_id}' AS rule_id, '{scanner}' AS scanner, '{r.severity}' AS severity, CAST({r.confidence} AS DOUBLE) AS confidence, key, CAST(n AS INTEGER) AS n, hit FROM ({rows})")
    return "\nUNION ALL ".join(parts)


def texts(rule_id: str) -> str:
    """Columns ``title, detail, refs, remediation, evidence`` of findings in a metadata table, from their rule, key and hit."""
    from argil.operators.metadata import DETAILS

    table: dict[str, list[str]] = {n: [] for n in ("title", "detail", "refs", "remediation", "evidence")}
    for rules, kind in ((dims.SECRET_RULES, 0), (dims.PII_RULES, 1), (dims.METADATA_RULES, 2)):
        for i, r in enumerate(rules):
            title = (f"{quoted(r.name + ' embedded in artifact')}", f"{quoted(r.name + ' in metadata field `')} || key || '`'", quoted(r.name))[kind]
            detail = (quoted(f"The artifact holds what looks like a credential: {r.name}."), f"'The value of `' || key || {quoted('` looks like personal data: ' + r.name.lower() + '.')}", f"'Field `' || key || {quoted('`: ' + DETAILS[min(i, 2)] + '.')}")[kind]
            values = (title, detail, quoted("; ".join(r.references)), quoted(r.remediation or ""), "hit" if kind == 2 else redact("hit"))
            for name, value in zip(table, values):
                table[name].append(f"WHEN '{r.rule_id}' THEN {value}")
    return ", ".join(f"CASE {rule_id} {' '.join(whens)} END AS {name}" for name, whens in table.items())
