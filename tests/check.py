"""python tests/check.py [sf] [name-substring ...]: compare queries with their SQL."""

import os
import sys
import time

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.path.dirname(os.path.abspath(__file__))]

from compare import compare, duck  # noqa: E402

from tidewatch.plans import all_queries  # noqa: E402
from tidewatch.session import local_session  # noqa: E402


def main() -> None:
    sf_dir = f"/root/testdata/sf{sys.argv[1] if len(sys.argv) > 1 else '0.01'}"
    wanted = sys.argv[2:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    queries, oracles = all_queries()
    failed = 0
    for name, q in queries.items():
        if wanted and not any(w in name for w in wanted):
            continue
        t = time.time()
        try:
            if name in oracles:
                problem = compare(spark, con, name, q, oracles[name], sf_dir)
            else:
                problem = None if q(spark, sf_dir).count() else "no rows"
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        failed += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {time.time() - t:6.2f}s {name}{'' if name in oracles else ' (rows)'} {problem or ''}", flush=True)
    print("failed", failed)


main()
