"""Registrations from the command line.

    python -m gridloom SETTINGS [--compat]           a file of key = value lines
    python -m gridloom register KEY VALUE ...        the same keys as arguments
    python -m gridloom test FOLDER [REPORTS]         every *.testconf below a folder
    python -m gridloom overlay FIXED MOVED OUTPUT.png [--flip]
    python -m gridloom mapplot IMAGE MAP OUTPUT.svg [LANDMARKS.csv] [--invert-map] [--flip]
"""

from __future__ import annotations

import sys

from .plans.program import EXPECTED, overlay_files, plot_map, run, run_tests
from .session import session
from .sources.config import from_arguments, from_file


def main(arguments: list[str]) -> int:
    words = [a.lower() for a in arguments]
    if not words or words[0] in ("help", "-h", "--help") or words[0] == "register" and "help" in words:
        print(__doc__)
        return 0
    try:
        if words[0] == "test":
            if len(arguments) < 2:
                print(__doc__)
                return 2
            found = run_tests(session(), arguments[1], arguments[2] if len(arguments) > 2 else ".")
            for name, measures in found.items():
                print(name, *(f"{k}: {v:.3f}" for k, v in measures.items()), sep="\n  ")
            return 0
        if words[0] in ("overlay", "mapplot"):
            files, switches = [a for a in arguments[1:] if not a.startswith("--")], {w for w in words if w.startswith("--")}
            if words[0] == "overlay" and len(files) == 3 and switches <= {"--flip"}:
                overlay_files(session(), *files, flip="--flip" in switches)
            elif words[0] == "mapplot" and len(files) in (3, 4) and switches <= {"--flip", "--invert-map"}:
                plot_map(session(), *files, invert="--invert-map" in switches, flip="--flip" in switches)
            else:
                print(__doc__)
                return 2
            print(f"Saved {files[2]}")
            return 0
        compat = "--compat" in words
        settings = from_arguments(arguments) if words[0] == "register" else from_file(next(a for a in arguments if a != "--compat"))
        run(session(), settings, compat=compat)
    except EXPECTED as e:
        print(f"Error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
