import os
import subprocess
import sys

import __spark_entry__ as E

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_every_oracle_has_its_query():
    assert set(E.oracle_sql()) <= set(E.queries()) and "flagship" in E.queries()


def test_the_engine_does_not_need_the_training_data_operators():
    """With those operators hidden, the entry module still imports and offers the rest."""
    code = (
        "import sys\n"
        "class Hide:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name in ('corpus_pipeline', 'treesift.llm'):\n"
        "            raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Hide())\n"
        "import __spark_entry__ as e\n"
        "names = e.queries()\n"
        "assert 'flagship' in names and 'pipeline' not in names and not any(n.startswith('op') and n[2].isdigit() for n in names)\n"
        "assert not any(m.startswith('treesift.llm') for m in sys.modules)\n"
    )
    subprocess.run([sys.executable, "-c", code], check=True, cwd=ROOT)


def test_entry_runs(spark):
    assert E.entry(spark).count() > 0
