"""``python -m tabularium SHELF [NAME]``: look a name up in a shelf; without a name, read names line by line.

With ``--harvest`` what the name needs is fetched into the shelf first.
"""

from __future__ import annotations

import argparse
import cmd
import os
import sys
import webbrowser
from collections.abc import Callable

from tabularium.plans import report
from tabularium.plans.lookup import PUBLISHERS, chosen, lookup, open_shelf


def source_names(listed: str) -> list[str]:
    """Names of a comma-separated list; none named: all."""
    return chosen([name for name in map(str.strip, listed.split(",")) if name])


class Names(cmd.Cmd):
    """A line is a name to be looked up; an empty line, an end of input or a word of parting ends."""

    prompt = "Cartridge: "

    def __init__(self, look: Callable[[str], bool]):
        super().__init__(completekey=None)
        self._look = look

    def emptyline(self) -> bool:
        return True

    def onecmd(self, line: str) -> bool:
        name = line.strip()
        if name.lower() in {"", "eof", "q", "quit", "exit"}:
            return True
        try:
            self._look(name)
        except Exception as e:  # noqa: BLE001, one bad lookup does not end the rest
            print(f"Lookup failed: {e}")
        return False


def arguments() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="tabularium", description=__doc__)
    out.add_argument("shelf", help="folder of a shelf")
    out.add_argument("cartridge", nargs="?")
    out.add_argument("--sources", type=source_names, default=list(PUBLISHERS), help="comma-separated; default: all")
    out.add_argument("--harvest", action="store_true", help="fetch into the shelf first")
    out.add_argument("--no-report", action="store_true")
    out.add_argument("--no-open", action="store_true")
    out.add_argument("--report-dir", default="reports")
    return out


def main(argv: list[str] | None = None, spark=None, **fetching) -> int:
    args = arguments().parse_args(argv)
    if spark is None:
        from tabularium.session import local_session, ship

        spark = local_session()
        ship(spark)

    def look(name: str) -> bool:
        if args.harvest:
            from tabularium.plans.harvest import harvest

            harvest(spark, name, args.shelf, args.sources, **fetching)
        results, lines = report.fetched(lookup(open_shelf(spark, args.shelf), name, args.sources))
        page = None if args.no_report else report.write_report(name, results, lines, args.report_dir)
        said = [report.as_text(results, lines)]
        if not lines:
            said.append(f"Nothing on {name!r}; asked were {', '.join(args.sources)}.")
        if page is not None:
            said.append(f"Page written to {page}")
        print("\n".join(said))
        if page is not None and not args.no_open:
            webbrowser.open("file://" + os.path.abspath(page))
        return bool(lines)

    if args.cartridge is not None:
        return 0 if look(args.cartridge) else 1
    try:
        Names(look).cmdloop()
    except KeyboardInterrupt:
        print()
    return 0


if __name__ == "__main__":
    sys.exit(main())
