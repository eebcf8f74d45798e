"""The library where the training-data operators have been removed."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("pipeline", [False, True])
def test_entry_without_llm(tmp_path, sf_dir, pipeline):
    for name in ("wordweave", "tests", "__spark_entry__.py", "bench.py") + ("corpus_pipeline.py",) * pipeline:
        if (ROOT / name).is_dir():
            shutil.copytree(ROOT / name, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        elif (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path / name)
    code = "import bench, __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q) and 'graph_hubs' in q and 'pipeline' not in q and not any(n.startswith('op1') for n in q)"
    if not pipeline:
        code += "; from pyspark.sql import SparkSession; s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate(); assert e.entry(s).count() == 15"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=300, env=_plain_env())


def _plain_env():
    import os

    return {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
