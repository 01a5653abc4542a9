"""Command line check: python -m tests.check [--sf 0.01] [name prefix ...]"""

from __future__ import annotations

import sys
import time

import __spark_entry__ as entry
from partloom.session import build_session
from tests.compare import connection, difference


def main(argv: list[str]) -> int:
    sf = "0.01"
    if argv[:1] == ["--sf"]:
        sf, argv = argv[1], argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session(
        "check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connection(sf_dir)
    oracles, failed = entry.oracle_sql(), []
    for name, run in entry.queries().items():
        if argv and not any(name.startswith(a) for a in argv):
            continue
        start = time.time()
        try:
            df = run(spark, sf_dir)
            rows = df.collect()
            spent = f"{len(rows)} rows, spark {time.time() - start:.1f}s"
            problem = difference(df, con, oracles[name], rows) if name in oracles else None
            note = f"{spent} {problem or ('same' if name in oracles else 'no SQL')}"
        except Exception as error:  # noqa: BLE001
            problem = note = f"{type(error).__name__}: {str(error)[:900]}"
        if problem:
            failed.append(name)
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - start:.1f}s {note}", flush=True)
    print(f"failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
