"""The entry works without the optional training-data part."""

import subprocess
import sys
from pathlib import Path

PROGRAM = """
import sys

class Missing:
    def find_spec(self, name, path=None, target=None):
        if name.startswith("scorecraft.llm") or name == "corpus_pipeline":
            raise ModuleNotFoundError(name)

sys.meta_path.insert(0, Missing())
import __spark_entry__ as E
names = set(E.queries())
assert len(names) >= 60 and set(E.oracle_sql()) <= names
assert not any(n.startswith("op") and n[2].isdigit() for n in names) and "pipeline" not in names
"""


def test_entry_without_the_optional_part():
    root = Path(__file__).resolve().parent.parent
    subprocess.run([sys.executable, "-c", PROGRAM], cwd=root, check=True, timeout=120)
