"""Run each registered query and its oracle on one data folder and compare the rows.

    python tools/check_oracles.py [folder] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from bindings import registry  # noqa: E402
from entitylake.session import session  # noqa: E402


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def cell(v):
        if isinstance(v, float):
            return None if math.isnan(v) else repr(v + 0.0)
        return repr(v)

    return sorted(tuple(cell(r[i]) or "" for i in order) for r in rows)


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    queries, oracles = registry()
    wanted = sys.argv[2:] or list(queries)
    spark = session(
        "check",
        "local[8]",
        **{
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.sql.shuffle.partitions": "8",
            "spark.driver.memory": "8g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    db = duckdb.connect()
    for f in Path(sf).glob("*.parquet"):
        db.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    bad = 0
    for name in wanted:
        started = time.time()
        try:
            df = queries[name](spark, sf)
            rows = [tuple(r) for r in df.collect()]
            took = time.time() - started
            if name not in oracles:
                print(f"rows  {name:24s} {len(rows):8d} {took:6.2f}s")
                continue
            result = db.execute(oracles[name])
            names = [d[0] for d in result.description]
            expected = result.fetchall()
        except Exception as e:  # report and go on with the next query
            print(f"ERROR {name}: {str(e)[:500]}")
            bad += 1
            continue
        ours, theirs = canonical(rows, df.columns), canonical(expected, names)
        ok = sorted(df.columns) == sorted(names) and ours == theirs
        print(f"{'ok   ' if ok else 'DIFF '} {name:24s} {len(rows):8d} {len(expected):8d} {took:6.2f}s", flush=True)
        if not ok:
            bad += 1
            print("   columns", sorted(df.columns), sorted(names))
            a, b = set(ours), set(theirs)
            print("   only ours  ", [str(x)[:400] for x in list(a - b)[:2]])
            print("   only theirs", [str(x)[:400] for x in list(b - a)[:2]])
    print("failed:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
