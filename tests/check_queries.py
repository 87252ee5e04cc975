"""Run named queries against their SQL: ``python tests/check_queries.py <sf_dir> [name ...]``."""

from __future__ import annotations

import sys
import time
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from oracle import compare, connect  # noqa: E402
from txquality.catalog import ORACLES, QUERIES  # noqa: E402
from txquality.session import local_session  # noqa: E402

if __name__ == "__main__":
    sf_dir, names = sys.argv[1], sys.argv[2:]
    if names and all(n.endswith("_queries") for n in names):
        names = [q for q, fn in QUERIES.items() if fn.__module__.split(".")[-1] in names]
    spark, con = local_session(), connect(sf_dir)
    bad = 0
    for name in names or QUERIES:
        start = time.time()
        try:
            if name in ORACLES:
                note = f"{compare(spark, con, QUERIES[name], ORACLES[name], sf_dir)} rows equal"
            else:
                note = f"{QUERIES[name](spark, sf_dir).count()} rows (no SQL)"
        except Exception as error:  # noqa: BLE001
            bad += 1
            note = "FAILED " + str(error)[:1500]
            if not isinstance(error, AssertionError):
                note += "\n" + "".join(traceback.format_exc().splitlines(True)[-6:])[:1500]
        print(f"{name:32s} {time.time() - start:6.2f}s  {note}", flush=True)
    print("failed:", bad)
