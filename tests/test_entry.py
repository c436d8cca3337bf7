import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parent.parent


def test_every_sql_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert "kmer_histogram" in __spark_entry__.queries()


def test_entry_runs(spark):
    assert __spark_entry__.entry(spark).columns == ["count", "n_kmers"]


def test_entry_imports_without_the_training_data_operators(tmp_path):
    code = "import sys, importlib.abc\nclass Gone(importlib.abc.MetaPathFinder):\n    def find_spec(self, name, path, target=None):\n        if name == 'corpus_pipeline' or name.startswith('kmerspark.llm'):\n            raise ModuleNotFoundError(name)\nsys.meta_path.insert(0, Gone())\nimport __spark_entry__ as e\nq = e.queries()\nassert 'kmer_histogram' in q and not any(k.startswith('op') and k[2].isdigit() for k in q), q"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
