"""Rule packs: both notations, conditions, errors, and evaluation over files."""

import itertools

import pytest

from argil import __main__ as cli
from argil import api
from argil.functions import rules
from argil.operators import packs
from tests.test_decode import CALL, gguf, text

PACK = r"""
# strings in metadata and in raw bytes
MODEL_RULE key { meta: id = "ORG-1" severity = critical confidence = 0.9 references = "A-1, B-2" target: metadata, raw
  strings: $k = /\bKEY-[0-9]{4}\b/ condition: $k }
MODEL_RULE call { meta: id = "ORG-2" severity = high target: pickle
  condition: import("os.system") or import("posix.*") and opcode(REDUCE) }
MODEL_RULE quiet { meta: id = "ORG-3" severity = info target: metadata condition: not (import("posix.*") or opcode(STOP)) }
"""
TOML = r"""
[[rule]]
id = "T-1"
severity = "low"
confidence = 0.5
target = "metadata"
match = { regex = '\bJane\b' }
references = ["X"]
remediation = "Remove it."
[[rule]]
id = "T-2"
severity = "high"
target = "pickle"
match = { global = "posix.system" }
"""


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("packs")
    (root / "a.gguf").write_bytes(gguf(("author", text("Jane KEY-1234"))))
    (root / "b.pkl").write_bytes(CALL)
    (root / "c.bin").write_bytes(b"xx KEY-9999 yy")
    (root / "d.pkl").write_bytes(b"cposix\nsystem\n.")
    return root


def held(spark, folder, pack):
    found = packs.scan(_frames(spark, folder), rules.load(pack)).collect()
    return {(r.path.rsplit("/", 1)[-1], r.rule_id) for r in found}, found


def _frames(spark, folder):
    from argil.sources import files

    return api.frames(files.decoded(spark, str(folder)), files.chunks(spark, str(folder)), files.stream_pieces(spark, str(folder)))


def test_language(spark, folder):
    pairs, found = held(spark, folder, PACK)
    assert pairs == {("a.gguf", "ORG-1"), ("c.bin", "ORG-1"), ("b.pkl", "ORG-2"), ("a.gguf", "ORG-3"), ("c.bin", "ORG-3")}
    key = next(r for r in found if r.rule_id == "ORG-1")
    assert (key.severity, key.confidence, key.references, key.scanner) == ("critical", 0.9, ["A-1", "B-2"], "rules")


def test_toml(spark, folder):
    pairs, found = held(spark, folder, TOML)
    assert pairs == {("a.gguf", "T-1"), ("b.pkl", "T-2"), ("d.pkl", "T-2")}
    assert {r.remediation for r in found} == {"Remove it.", None}


def test_precedence():
    def value(node, env):
        if node.kind == "not":
            return not value(node.parts[0], env)
        if node.parts:
            return (all if node.kind == "and" else any)(value(p, env) for p in node.parts)
        return env[node.value]

    strings = "$a = \"a\" $b = \"b\" $c = \"c\" $d = \"d\""
    for words in ("$a or $b and not $c or $d", "not $a and $b or $c", "($a or $b) and ($c or not $d)", "not not $a or not ($b and $c)"):
        rule = rules.load("MODEL_RULE r { meta: id = \"x\" target: raw strings: " + strings + " condition: " + words + " }")[0]
        for bits in itertools.product((False, True), repeat=4):
            env = dict(zip(("$a", "$b", "$c", "$d"), bits))
            plain = words
            for k, v in env.items():
                plain = plain.replace(k, str(v))
            assert value(rule.condition, env) == eval(plain)


@pytest.mark.parametrize(
    "pack",
    [
        "MODEL_RULE r {",
        "MODEL_RULE r { meta: id = \"x\" severity = awful target: raw strings: $a = \"a\" condition: $a }",
        "MODEL_RULE r { meta: id = \"x\" target: moon condition: opcode(STOP) }",
        "MODEL_RULE r { meta: id = \"x\" target: raw condition: $a }",
        "MODEL_RULE r { meta: id = \"x\" target: raw strings: $a = /(/ condition: $a }",
        "MODEL_RULE r { meta: id = \"x\" target: raw condition: opcode(STOP) or }",
        "MODEL_RULE r ; {",
        "[[rule]]\nid = 'x'",
        "[[rule",
    ],
)
def test_errors(pack):
    with pytest.raises(rules.RuleError):
        rules.load(pack)


def test_command_line(spark, folder, tmp_path, capsys):
    pack = tmp_path / "pack.toml"
    pack.write_text(TOML)
    cli.main([str(folder / "a.gguf"), "--rules", str(pack), "--no-color"], spark)
    assert "T-1 · rules · artifact" in capsys.readouterr().out
