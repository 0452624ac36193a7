"""Run registered queries against their DuckDB oracles: python tests/run_oracles.py [sf_dir] [names...]"""
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from oracle_compare import compare, duck  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from riskloom.session import local_session  # noqa: E402

sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
only = set(sys.argv[2:])
spark = local_session(8)
con = duck(sf)
qs, sqls = entry.queries(), entry.oracle_sql()
bad = 0
for name, q in qs.items():
    if only and name not in only:
        continue
    t0 = time.time()
    try:
        df = q(spark, sf)
        if name in sqls:
            probs = compare(df, sqls[name], con)
            status = "OK" if not probs else f"FAIL {probs}"
        else:
            n = df.count()
            status = f"rows-only {n}"
    except Exception as e:  # noqa: BLE001
        status = f"ERROR {type(e).__name__}: {str(e)[:400]}"
    bad += status.startswith(("FAIL", "ERROR"))
    print(f"{name:32s} {time.time() - t0:6.2f}s {status}", flush=True)
print("failures:", bad)
