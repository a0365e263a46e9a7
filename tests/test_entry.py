"""The entry module without the optional part: neither its folders nor the pipeline's file must be there."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
COUNT = "import __spark_entry__ as e; q = e.queries(); print(len(q), sum(n.startswith('op') and n[2].isdigit() or n == 'pipeline' for n in q))"


@pytest.mark.parametrize("left", ["nothing", "compiled files", "the pipeline's file"])
def test_entry_without_the_optional_part(tmp_path, left):
    shutil.copytree(os.path.join(ROOT, "tallyrisk"), tmp_path / "tallyrisk", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    if left == "compiled files":
        (tmp_path / "tallyrisk" / "llm" / "__pycache__").mkdir(parents=True)
    if left == "the pipeline's file" and os.path.exists(os.path.join(ROOT, "corpus_pipeline.py")):
        shutil.copy(os.path.join(ROOT, "corpus_pipeline.py"), tmp_path)
    got = subprocess.run([sys.executable, "-c", COUNT], cwd=tmp_path, env=os.environ | {"PYTHONPATH": ""}, capture_output=True, text=True)
    assert got.returncode == 0, got.stderr
    total, optional = map(int, got.stdout.split())
    assert total >= 130 and optional == 0


def test_chosen_settings_stay(spark):
    from tallyrisk.session import tune

    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    tune(spark)
    assert spark.conf.get(key) == before == "false"
