"""The command line.

    python -m tessera scan <folder> [--format md|mermaid|dbml|plantuml|json] [--out file]
    python -m tessera diff <folder> (--base <folder> | --ref <git revision>) [--out file]

``scan`` prints the model of a folder, ``diff`` the changelog from a base to it.
Status 0 is success, 1 a wrong call or an unreadable folder.
"""

from __future__ import annotations

import argparse
import os
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from tessera.operators import export, model_diff, scan
from tessera.session import session
from tessera.sources import files

FORMATS = {"md": "markdown", "mermaid": "mermaid", "dbml": "dbml", "plantuml": "plantuml", "json": "json"}


class _Arguments(argparse.ArgumentParser):
    def error(self, message: str) -> None:
        self.print_usage(sys.stderr)
        self.exit(1, f"tessera: {message}\n")


def arguments() -> argparse.ArgumentParser:
    parser = _Arguments(prog="tessera", description="Maps of the data stores that a source tree declares.")
    commands = parser.add_subparsers(dest="command", required=True, parser_class=_Arguments)
    one = commands.add_parser("scan", help="print the model of a folder")
    one.add_argument("folder")
    one.add_argument("--format", "-f", choices=FORMATS, default="md")
    two = commands.add_parser("diff", help="print what changed from a base")
    two.add_argument("folder")
    base = two.add_mutually_exclusive_group(required=True)
    base.add_argument("--base", help="folder of the base")
    base.add_argument("--ref", help="git revision of the base, in the folder's repository")
    for command in (one, two):
        command.add_argument("--out", "-o", help="write to a file instead of the standard output")
    return parser


def models_of(found: DataFrame) -> DataFrame:
    return scan.build_models(scan.parse_files(found))


def scan_folder(spark: SparkSession, folder: str, workspace: str | None = None) -> DataFrame:
    """Models of a folder's files, as ``scan.build_models`` gives them."""
    return models_of(files.read_tree(spark, folder, scan.include_regex(), workspace=workspace))


def scan_text(spark: SparkSession, folder: str, kind: str) -> str:
    name = os.path.basename(folder)
    row = export.export_models(scan_folder(spark, folder, name), FORMATS[kind]).first()
    text = row.document if row is not None else export.render({part: [] for part in export.PARTS}, FORMATS[kind], name)
    return text if text.endswith("\n") else text + "\n"


def diff_text(spark: SparkSession, folder: str, base: str | None, ref: str | None) -> str:
    name = os.path.basename(folder)
    head = scan_folder(spark, folder, name).cache()
    if ref is not None:
        before = models_of(files.git_files(spark, folder, ref, scan.include_regex(), name)).cache()
    else:
        before = scan_folder(spark, os.path.realpath(base or ""), name).cache()
    row = model_diff.to_markdown(model_diff.compare(before, head), ref or base or "base", folder).first()
    return (row.markdown if row is not None else "No changes.").rstrip("\n") + "\n"


def main(argv: Sequence[str] | None = None) -> int:
    try:
        given = arguments().parse_args(argv)
    except SystemExit as stop:
        return int(stop.code or 0)
    folder = os.path.realpath(given.folder)
    for path in (folder, *([given.base] if getattr(given, "base", None) else [])):
        if not files.is_tree(path):
            print(f"tessera: cannot read folder '{path}'", file=sys.stderr)
            return 1
    spark = session("tessera")
    text = scan_text(spark, folder, given.format) if given.command == "scan" else diff_text(spark, folder, given.base, given.ref)
    if given.out:
        os.makedirs(os.path.dirname(os.path.abspath(given.out)), exist_ok=True)
        with open(given.out, "w", encoding="utf-8") as file:
            file.write(text)
        print(f"tessera: wrote {given.out}", file=sys.stderr)
    else:
        sys.stdout.write(text)
    return 0


if __name__ == "__main__":
    sys.exit(main())
