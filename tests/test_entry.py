import subprocess
import sys

from gaugeworks.plans.registry import QUERIES

BLOCK = """
import sys
class Blocked:
    def find_spec(self, name, path=None, target=None):
        if name.split(".")[0] in sys.argv[1:]:
            raise ImportError(name)
sys.meta_path.insert(0, Blocked())
import __spark_entry__ as entry
print(len(entry.queries()), set(entry.oracle_sql()) <= set(entry.queries()))
"""


def test_core_queries_stay_without_a_corpus_library():
    for missing in ("zstandard", "corpus_pipeline"):
        run = subprocess.run([sys.executable, "-c", BLOCK, missing], capture_output=True, text=True, timeout=120)
        assert run.stdout.split() == [str(len(QUERIES)), "True"], run.stderr
