"""python tests/check_queries.py [sf_dir] [name ...]: run queries against their SQL, print one line each."""

import sys
import time
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from oracle import compare  # noqa: E402
from signalframe.plans.catalog import REGISTRY  # noqa: E402
from signalframe.session import local_session  # noqa: E402

if __name__ == "__main__":
    d = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    names = [n for n in REGISTRY if not [a for a in sys.argv[2:] if a != "-v"] or any(p in n or REGISTRY[n].run.__module__.endswith(p) for p in sys.argv[2:])]
    spark = local_session("check", 8)
    spark.sparkContext.setLogLevel("ERROR")
    failed = []
    for n in names:
        t = time.time()
        try:
            problem, rows = compare(spark, REGISTRY[n], d)
        except Exception as e:  # report and go on
            problem, rows = "".join(traceback.format_exception_only(e))[:1500], 0
            if "-v" in sys.argv:
                traceback.print_exc()
        if problem:
            failed.append(n)
        kind = "O" if REGISTRY[n].sql else "R"
        print(f"{'FAIL' if problem else 'ok  '} {kind} {time.time() - t:6.2f}s {rows:7d} {n} {problem or ''}", flush=True)
    print(f"{len(names) - len(failed)} ok, {len(failed)} failed: {failed}")
