import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent

BLOCK = """
import sys
class Block:
    def find_spec(self, name, path=None, target=None):
        if name == "corpusloom.llm" or name.startswith("corpusloom.llm.") or name == "corpus_pipeline":
            raise ImportError(name)
sys.meta_path.insert(0, Block())
import __spark_entry__ as e
names = set(e.queries())
assert "g04_most_cited" in names and not any(n.startswith("op") for n in names) and "pipeline" not in names
assert set(e.oracle_sql()) <= names
"""


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["urn", "citation_count", "title", "type", "year"]
    assert df.count() == 50
    assert set(e.oracle_sql()) <= set(e.queries())


def test_imports_without_the_training_data_operators():
    subprocess.run([sys.executable, "-c", BLOCK], cwd=ROOT, check=True)
