"""Compare every registered query with its SQL: ``python tests/check_queries.py SF_DIR [NAME ...]``."""

from __future__ import annotations

import os
import sys
import time
import traceback

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.path.dirname(os.path.abspath(__file__))]

import __spark_entry__ as entry  # noqa: E402
from compare import compare, connect  # noqa: E402

from flowquarry.session import build_session  # noqa: E402


def main(sf_dir: str, wanted: list[str]) -> int:
    spark = build_session(master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
                          spark__ui__showConsoleProgress="false", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad, checks = 0, entry.oracle_sql()
    for name, run in entry.queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            if name in checks:
                problems = compare(run(spark, sf_dir), con, checks[name])
            else:
                problems = [] if run(spark, sf_dir).count() else ["no rows"]
        except Exception as error:  # noqa: BLE001
            problems = [f"{type(error).__name__}: {str(error)[:700]}"]
            if os.environ.get("TRACE"):
                traceback.print_exc()
        bad += bool(problems)
        kind = "sql " if name in checks else "rows"
        print(f"{'FAIL' if problems else 'ok  '} {kind} {time.time() - start:6.1f}s {name}", *problems, sep="\n     " if problems else " ", flush=True)
    print(f"{bad} failing")
    return bad


if __name__ == "__main__":
    sys.exit(min(1, main(sys.argv[1], sys.argv[2:])))
