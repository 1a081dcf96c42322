"""Commands: python -m spanline.cli labs|visits DATA_DIR TERM [--from A --to B], status, inventory."""

from __future__ import annotations

import argparse
import sys

from .errors import EngineError
from .operators import history, inventory
from .render import table
from .session import load, local_session
from .sources.files import inventory as list_inventory

KINDS = {"labs": ("lab_facts", "raw_label", "analyte"), "visits": ("event_facts", "raw_specialty", "specialty")}


def main(argv: list[str] | None = None) -> int:
    """Runs one command; 0 done, 1 nothing found, 2 refused."""
    parser = argparse.ArgumentParser(prog="spanline")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in KINDS:
        p = commands.add_parser(name)
        p.add_argument("data")
        p.add_argument("term")
        p.add_argument("--from", dest="frm")
        p.add_argument("--to")
    commands.add_parser("status").add_argument("data")
    commands.add_parser("inventory").add_argument("folder")
    args = parser.parse_args(argv)
    spark = local_session("*")
    try:
        if args.command in KINDS:
            facts, label, kind = KINDS[args.command]
            result = history.run_query(load(spark, args.data, facts), label, load(spark, args.data, "spans"), load(spark, args.data, "concept_terms"), kind, args.term, args.frm, args.to)
            value = ["raw_value", "unit"] if args.command == "labs" else ["event_type", "wording"]
            print(table(result.rows, ["section", "date_text", label, *value, "fact_id"]))
            print(table(result.mentions, ["content_hash", "unit_number", "mentions", "example"]))
            return 0 if result.rows.limit(1).count() else 1
        if args.command == "status":
            print(table(inventory.summary(load(spark, args.data, "inventory")), ["generation_id", "supported", "unsupported", "ready", "contents"]))
        else:
            print(table(list_inventory(spark, args.folder, "now"), ["relative_path", "kind", "file_format", "status", "content_hash"]))
        return 0
    except EngineError as e:
        print(e.code, file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
