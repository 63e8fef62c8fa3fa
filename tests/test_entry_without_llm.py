"""The entry file where the training-data package is not there."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
# Without either folder, and with the pipeline file left behind or not.
CODE = """
import sys
from importlib.machinery import PathFinder

class Hidden:
    def find_spec(self, name, path=None, target=None):
        if name.split(".")[:2] == ["crosstape", "llm"] or name in HIDE:
            return None
        return PathFinder.find_spec(name, path, target)

HIDE = %r
sys.meta_path[:] = [f for f in sys.meta_path if f is not PathFinder] + [Hidden()]
import __spark_entry__ as e
names = e.queries()
assert len(names) > 150 and not any(n.startswith("op") and n[2].isdigit() for n in names) and "pipeline" not in names
assert set(e.oracle_sql()) <= set(names)
"""


def test_entry_without_the_package():
    for hide in ([], ["corpus_pipeline"]):
        done = subprocess.run([sys.executable, "-B", "-c", CODE % (hide,)], cwd=ROOT, capture_output=True, text=True, timeout=120)
        assert done.returncode == 0, done.stderr
