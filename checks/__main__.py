"""Command line of the comparison harness."""

from __future__ import annotations

import argparse

from checks import load_all
from checks.harness import compare, duck_connection
from larder.session import local_session


def main() -> None:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    options = parser.parse_args()
    queries = load_all()
    spark = local_session(8, "checks")
    con = duck_connection(options.sf)
    names = [n for n in queries if not options.names or any(n.startswith(p) for p in options.names)]
    bad = 0
    for name in names:
        try:
            line = compare(spark, con, options.sf, name)
        except Exception as error:  # a broken query must not hide the others
            line = f"ERROR {name}: {str(error)[:900]}"
        bad += not line.startswith(("ok", "ROWS"))
        print(line, flush=True)
    print(f"{len(names) - bad} of {len(names)} fine")


if __name__ == "__main__":
    main()
