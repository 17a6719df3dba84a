"""``python -m sparrowlint [--config FILE] [--format F] [--output FILE] PATH...``: exit 0 clean, 1 findings, 2 error."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from sparrowlint.plans import config as cfg
from sparrowlint.plans import sinks
from sparrowlint.plans.lint import lint
from sparrowlint.sources.files import read_files


def main(argv: list[str]) -> int:
    p = argparse.ArgumentParser(prog="sparrowlint")
    p.add_argument("paths", nargs="*", default=["."])
    p.add_argument("--config")
    p.add_argument("--format", choices=cfg.FORMATS)
    p.add_argument("--output")
    p.add_argument("--output-folder", help="write rdjsonl or json entries as text files, a finding a line, without gathering them")
    try:
        args = p.parse_args(argv)
    except SystemExit as e:
        return 0 if not e.code else 2
    try:
        config = cfg.load(args.config)
        for rid in config.unknown_rules():
            print(f"warning: unknown rule {rid} in the configuration", file=sys.stderr)
        for path in args.paths:
            if not Path(path).exists():
                raise FileNotFoundError(path)
        spark = SparkSession.builder.appName("sparrowlint").getOrCreate()
        if not any(f.suffix.lower() in (".sql", ".go", ".py") for path in args.paths for f in ([Path(path)] if Path(path).is_file() else Path(path).rglob("*"))):
            print("no .sql, .go or .py files to scan", file=sys.stderr)
            return 0
        result = lint(read_files(spark, args.paths, config), config)
        for r in result.skipped.orderBy("file", "line").toLocalIterator():
            print(f"warning: {r.file}:{r.line}: skipped, {r.error}", file=sys.stderr)
        if args.output_folder:
            sinks.write_lines(result.findings, args.format if args.format in ("rdjsonl", "json") else "rdjsonl", args.output_folder)
            return sinks.exit_code(result.findings)
        text = sinks.report(result.findings, args.format or config.format or "terminal", tag=config.tag)
        if args.output:
            sinks.write_text(args.output, text)
        else:
            print(text, end="")
        return sinks.exit_code(result.findings)
    except (ValueError, OSError, RuntimeError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
