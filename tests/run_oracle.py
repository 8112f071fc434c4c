"""python tests/run_oracle.py [folder] [name ...]: compare queries with their SQL and print the times."""

import sys
import time
from pathlib import Path

sys.path[:0] = [str(Path(__file__).parents[1]), str(Path(__file__).parent)]

from oracle import compare, connect  # noqa: E402

from tallyfield.registry import ORACLES, QUERIES  # noqa: E402
from tallyfield.session import build_session  # noqa: E402

folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
names = sys.argv[2:]
spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g"})
spark.sparkContext.setLogLevel("ERROR")
con = connect(folder)
bad = 0
for name, run in QUERIES.items():
    if names and not any(name.startswith(n) for n in names):
        continue
    t = time.time()
    try:
        df = run(spark, folder)
        if name in ORACLES:
            ok, message = compare(df, con, ORACLES[name])
        else:
            ok, message = True, f"{len(df.collect())} rows, no SQL"
    except Exception as e:  # noqa: BLE001
        ok, message = False, f"{type(e).__name__}: {str(e)[:900]}"
    bad += not ok
    print(f"{'ok  ' if ok else 'BAD '} {name:32s} {time.time() - t:6.1f}s {message}", flush=True)
print("bad:", bad)
