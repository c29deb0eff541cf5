"""Compare every query with its SQL twin: python tests/check_oracles.py [sf_dir] [name ...]"""

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from __spark_entry__ import oracle_sql, queries  # noqa: E402
from tests.harness import compare, duck, session  # noqa: E402

sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
wanted = sys.argv[2:]
spark, con, sqls, bad = session(), duck(sf_dir), oracle_sql(), []
for name, run in queries().items():
    if wanted and name not in wanted:
        continue
    begun = time.time()
    try:
        df = run(spark, sf_dir)
        found = compare(df, con, sqls[name]) if name in sqls else f"rows only: {df.count()}"
        ok = found is None or found.startswith("rows only")
    except Exception as error:
        found, ok = f"{type(error).__name__}: {str(error)[:1500]}", False
        if wanted:
            traceback.print_exc()
    print(f"{'ok ' if ok else 'BAD'} {time.time() - begun:6.2f}s {name} {found or ''}", flush=True)
    if not ok:
        bad.append(name)
print("BAD:", bad)
spark.stop()
