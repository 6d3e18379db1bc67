"""Ad-hoc: python tests/run_compare.py [sf_dir] [name ...] -- Spark vs DuckDB per query."""
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from oracle_check import compare, duck  # noqa: E402

import __spark_entry__ as E  # noqa: E402
from vectables.session import local_session, storage_root  # noqa: E402

sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
names = sys.argv[2:]
spark = local_session(8, 8)

storage_root(spark)  # shared folder from the session; a temp one only in local mode
Q, O = E.queries(), E.oracle_sql()
con = duck(sf)
bad = 0
for n in names or list(Q):
    t = time.time()
    try:
        sp = Q[n](spark, sf).toPandas()
    except Exception as e:  # noqa: BLE001
        print(f"{n:32s} SPARK-ERROR {type(e).__name__}: {str(e)[:300]}")
        bad += 1
        continue
    ts = time.time() - t
    if n not in O:
        print(f"{n:32s} rows-only {len(sp)} rows {ts:.1f}s")
        continue
    try:
        dk = con.sql(O[n]).df()
    except Exception as e:  # noqa: BLE001
        print(f"{n:32s} DUCK-ERROR {str(e)[:300]}")
        bad += 1
        continue
    err = compare(sp, dk)
    print(f"{n:32s} {'OK ' if err is None else 'DIFF'} {len(sp)} rows {ts:.1f}s {err or ''}")
    bad += err is not None
print("bad", bad)
