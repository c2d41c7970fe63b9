"""Tasks find the package wherever the driver was started and whatever the workers' path is."""

from __future__ import annotations

import os
import subprocess
import sys

from conftest import ROOT, SF_SMALL

SCRIPT = f"""
import sys
sys.path.insert(0, {ROOT!r})
from weftcast.session import get_spark
from weftcast.sources.tables import read_table
from weftcast.plans.modelling import case_value
spark = get_spark("local[2]", 2)
def run(parts):
    import numpy as np
    for part in parts:
        yield part.assign(r_regionkey=case_value(np.array([1.0, 2.0, 5.0]), "lag", 1))[["r_regionkey"]]
rows = read_table(spark, {SF_SMALL!r}, "region").select("r_regionkey").mapInPandas(run, "r_regionkey double").collect()
assert rows and all(r.r_regionkey == 5.0 for r in rows)
print("found")
"""


def test_tasks_find_the_package_from_another_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert "found" in done.stdout, done.stderr[-2000:]
