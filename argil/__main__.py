"""Command line: ``python -m argil PATH``. Exit code 0 if clean, 1 if the gate fails, 2 if there is nothing to scan."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from argil import api
from argil.functions import rules
from argil.functions.dims import SEVERITIES
from argil.operators import packs, report
from argil.sources.files import list_targets


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="argil", description="Scan model files for security and privacy risks.")
    p.add_argument("path")
    p.add_argument("-f", "--format", choices=("human", "json", "sarif"), default="human")
    p.add_argument("-o", "--output")
    p.add_argument("-r", "--recursive", action="store_true")
    p.add_argument("--min-severity", choices=SEVERITIES, default="info")
    p.add_argument("--fail-on", choices=SEVERITIES, default="high")
    p.add_argument("--no-color", action="store_true")
    p.add_argument("--merge-sarif", action="store_true", help="one SARIF run per file, where else only the first file's is written")
    p.add_argument("--rules", help="a rule pack, evaluated beside the built-in scanners")
    a = p.parse_args(arguments)
    if not list_targets(a.path, a.recursive):
        print(f"argil: nothing to scan at {a.path}", file=sys.stderr)
        return 2
    spark = spark or SparkSession.builder.appName("argil").getOrCreate()
    scanners = dict(api.SCANNERS)
    if a.rules:
        with open(a.rules, encoding="utf-8") as f:
            scanners["rules"] = packs.scanner(rules.load(f.read()))
    found = api.scan(spark, a.path, a.recursive, scanners)
    colour = not a.no_color and not a.output and sys.stdout.isatty()
    column = {"human": report.as_text(colour), "json": report.as_json(), "sarif": report.as_sarif()}[a.format]
    rows = found.reports(a.min_severity).select("path", "worst", column.alias("out")).orderBy("path").collect()
    for e in found.errors.orderBy("path").collect():
        print(f"argil: {e.error}", file=sys.stderr)
    texts = [r.out for r in rows]
    if a.format == "human":
        out = "\n".join(texts)
    elif a.format == "json":
        out = texts[0] if len(texts) == 1 else json.dumps([json.loads(t) for t in texts], indent=2, ensure_ascii=False)
    elif a.merge_sarif and texts:
        logs = [json.loads(t) for t in texts]
        out = json.dumps(logs[0] | {"runs": [r for x in logs for r in x["runs"]]}, indent=2, ensure_ascii=False)
    else:
        out = texts[0] if texts else ""
    if a.output:
        with open(a.output, "w", encoding="utf-8") as f:
            f.write(out)
        print(f"argil: wrote {a.output}", file=sys.stderr)
    else:
        print(out)
    worst = max((r.worst for r in rows if r.worst is not None), default=0)
    return int(worst >= SEVERITIES.index(a.fail_on))


if __name__ == "__main__":
    sys.exit(main())
