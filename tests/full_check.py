"""Compares every query with its SQL: python tests/full_check.py [table folder] [name,name,...]"""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import compare  # noqa: E402
from marketloom.plans.catalog import ORACLES, QUERIES  # noqa: E402
from marketloom.session import local_session  # noqa: E402

folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
names = sys.argv[2].split(",") if len(sys.argv) > 2 else list(QUERIES)
spark = local_session(8, 8, "full-check")
con = compare.connect(folder)
for name in names:
    if name in ORACLES:
        problem, rows, a, b = compare.compare(spark, con, folder, QUERIES[name], ORACLES[name])
        print(f"{'ok ' if problem is None else 'BAD'} {name} rows={rows} spark={a:.1f}s sql={b:.1f}s {problem or ''}", flush=True)
    else:
        print(f"rows {name} {QUERIES[name](spark, folder).count()}", flush=True)
