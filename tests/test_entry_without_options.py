"""The library stands without its optional subpackage."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
CODE = """
import importlib.abc, sys
class Gone(importlib.abc.MetaPathFinder):
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("jobscope.llm"):
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
names = set(e.queries())
assert names and not any(n.startswith("op") and n[2].isdigit() or n == "pipeline" for n in names)
assert set(e.oracle_sql()) <= names
"""


def test_entry_without_the_optional_subpackage():
    done = subprocess.run([sys.executable, "-c", CODE], cwd=ROOT, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
