"""The entry file without the optional part, or without a package that it needs."""

import os
import subprocess
import sys

import pytest

from conftest import ROOT
from dxcohort.plans import catalog

CODE = """
import sys
class Blocked:
    def find_spec(self, name, path=None, target=None):
        if name in {blocked!r} or any(name.startswith(b + ".") for b in {blocked!r}):
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Blocked())
sys.path.insert(0, {root!r})
import __spark_entry__ as e
print("NAMES", *e.queries())
print("SQL", *e.oracle_sql())
"""


@pytest.mark.parametrize("blocked", [["xxhash"], ["tokenizers"], ["pyarrow"], ["dxcohort.llm"],
                                     ["dxcohort.llm", "corpus_pipeline"], ["corpus_pipeline"]])
def test_cohort_queries_survive_a_failing_import(blocked):
    done = subprocess.run([sys.executable, "-c", CODE.format(blocked=blocked, root=ROOT)],
                          capture_output=True, text=True, timeout=300, cwd=os.path.dirname(ROOT))
    assert done.returncode == 0, done.stderr[-800:]
    lines = {x.split()[0]: set(x.split()[1:]) for x in done.stdout.splitlines() if x}
    assert set(catalog.builders()) <= lines["NAMES"] and set(catalog.builders()) <= lines["SQL"]
