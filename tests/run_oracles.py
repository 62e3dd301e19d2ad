"""Compare queries with their oracles and print one line per query.

Usage: python tests/run_oracles.py [sf_dir] [name ...]
"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from oracle_compare import compare, duck  # noqa: E402

from pressgrid.plans.oracles import ORACLES  # noqa: E402
from pressgrid.plans.queries import REGISTRY  # noqa: E402
from pressgrid.session import build_session  # noqa: E402

if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    names = sys.argv[2:] or sorted(ORACLES)
    spark = build_session("local[8]", shuffle_partitions=8)
    con = duck(sf)
    bad = 0
    for n in names:
        t = time.time()
        try:
            p = compare(spark, con, n, REGISTRY[n], ORACLES[n], sf)
        except Exception as e:  # report and go on
            p = [f"{type(e).__name__}: {str(e)[:600]}"]
        bad += bool(p)
        print(f"{'OK ' if not p else 'BAD'} {n:24s} {time.time() - t:6.1f}s {' | '.join(p)[:1500]}", flush=True)
    print("mismatches:", bad)
