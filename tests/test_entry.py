"""The entry module, and its heaviest queries with compiled code, which the other tests switch off."""

from pathlib import Path

import pytest

import __spark_entry__ as entry

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture
def compiled(spark):
    """Code generation without the way out: code that is too large fails."""
    names = {"spark.sql.codegen.wholeStage": "true", "spark.sql.codegen.factoryMode": "CODEGEN_ONLY", "spark.sql.codegen.fallback": "false"}
    old = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.skipif(not DATA.exists(), reason="no test data here")
@pytest.mark.parametrize("name", [n for n in ("p1_found", "p3_found", "p4_found", "p5_found", "p8_found", "k12_dataflow_audit", "d12_scores") if n in entry.queries()])
def test_code_fits(compiled, name):
    assert entry.queries()[name](compiled, str(DATA)).count() >= 0


def test_every_query_is_named_once():
    assert entry.oracle_sql().keys() <= entry.queries().keys()
