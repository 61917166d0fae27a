import subprocess
import sys

import pytest
from conftest import ROOT

from shardloom.plans import catalog


@pytest.mark.parametrize("name", list(catalog.ORACLES))
def test_same_rows_as_sql(name, compare):
    compare(catalog.QUERIES[name], catalog.ORACLES[name])


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)


def test_entry_without_the_training_part():
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.startswith(("shardloom.llm", "corpus_pipeline")):
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert len(e.queries()) > 50 and not [q for q in e.queries() if q.startswith("op") or q == "pipeline"]
"""
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_flagship_on_the_smallest_tables(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
