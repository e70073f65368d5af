import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parent.parent
BLOCK = """
import sys
class Block:
    def find_spec(self, name, path=None, target=None):
        if name.startswith('flowquarry.llm') or name == 'corpus_pipeline':
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Block())
import __spark_entry__ as e
assert len(e.queries()) > 100 and not any(n.startswith('op') and n[2].isdigit() for n in e.queries()) and 'pipeline' not in e.queries()
assert set(e.oracle_sql()) <= set(e.queries())
"""


def test_entry_without_the_optional_part():
    subprocess.run([sys.executable, "-c", BLOCK], cwd=ROOT, check=True)


def test_entry(spark):
    import __spark_entry__ as e

    assert {r["label"] for r in e.entry(spark).collect()} == {"Normal", "DDoS", "PortScan"}
    assert set(e.oracle_sql()) <= set(e.queries())
