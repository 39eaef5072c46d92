"""Oracles are complete whichever plan module is imported first."""
from __future__ import annotations

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
PLANS = [f[:-3] for f in sorted(os.listdir(f"{ROOT}/silvergrain/plans")) if f.endswith(".py") and f != "__init__.py"]


@pytest.mark.parametrize("module", PLANS)
def test_any_plan_first(module):
    code = (f"import silvergrain.plans.{module}, __spark_entry__ as e\n"
            "from silvergrain.plans import oracle\n"
            "sql = e.oracle_sql()\n"
            "for name, text in sql.items():\n"
            "    for view in oracle._used(text):\n"
            "        assert f'{view} AS (' in text, (name, view)\n"
            "assert len(sql) > 100\n")
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-800:]
