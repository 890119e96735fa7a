"""What the driver calls, with and without the training-data operators."""

import subprocess
import sys

import __spark_entry__ as entry
from conftest import ROOT


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_imports_without_the_training_data_operators():
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("tidemark.llm"):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert "drv03_position_snapshot" in e.queries() and not any(k[:2] == "op" and k[2].isdigit() or k == "pipeline" for k in e.queries())
"""
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
