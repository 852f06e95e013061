"""Command line for team dictionaries: create, update, merge, stats, compare, export."""

from __future__ import annotations

import argparse
import json
import sys

from corpusmith.dictionaries import TeamConfig


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="corpusmith-team")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("create", "update"):
        c = sub.add_parser(name)
        c.add_argument("path")
        c.add_argument("--name", default="team")
        c.add_argument("--acronyms", help="JSON file")
        c.add_argument("--corrections", help="JSON file")
        c.add_argument("--replace", action="store_true")
    for name, args in (("merge", ("first", "second", "to")), ("stats", ("path",)), ("compare", ("first", "second")), ("export-acronyms", ("path", "to")), ("export-corrections", ("path", "to"))):
        c = sub.add_parser(name)
        for a in args:
            c.add_argument(a)
    a = p.parse_args(argv)

    def read(path: str | None) -> dict | None:
        if path is None:
            return None
        with open(path, encoding="utf-8") as f:
            return json.load(f)

    try:
        if a.command in ("create", "update"):
            start = TeamConfig(a.name) if a.command == "create" else TeamConfig.load(a.path)
            start.update(read(a.acronyms), read(a.corrections), replace=a.replace).save(a.path)
        elif a.command == "merge":
            TeamConfig.load(a.first).merged(TeamConfig.load(a.second)).save(a.to)
        elif a.command == "stats":
            print(json.dumps(TeamConfig.load(a.path).stats()))
        elif a.command == "compare":
            print(json.dumps(TeamConfig.load(a.first).differences(TeamConfig.load(a.second)), default=list))
        else:
            TeamConfig.load(a.path).export(a.to, a.command.removeprefix("export-"))
    except (OSError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
