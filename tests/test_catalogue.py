"""Every registered query against its SQL on the smallest tables, and what the plans must look like."""

import os
import subprocess
import sys

import pytest
from check import compare, duck
from conftest import SF, plan

from __spark_entry__ import entry, oracle_sql, queries
from catalogue.queries import ORACLES, QUERIES, fact_student
from layerwright import plans
from layerwright.operators import quality_report
from layerwright.literacy import FACT_RULES


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    assert compare(QUERIES[name](spark, SF), con, ORACLES[name]) is None


@pytest.mark.parametrize("name", ["fact_student", "fact_area_targets", "fact_state_targets", "features_student"])
def test_shuffle_path_equals_sql_too(spark, con, no_broadcast, name):
    assert compare(queries()[name](spark, SF), con, oracle_sql()[name]) is None


def test_entry(spark):
    df = entry(spark)
    assert df.count() > 0 and "percentual_alunos" in df.columns


def test_every_query_has_sql_and_is_registered():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(queries()) and set(ORACLES) <= set(oracle_sql())


def test_no_python_workers(spark):
    for name in ("mart_level_distribution", "features_student"):
        text = plan(queries()[name](spark, SF))
        assert "Python" not in text and "Pandas" not in text


def test_student_fact_moves_only_repeated_keys(spark):
    text = plan(fact_student(spark, SF))
    alone, copies = text.split("LeftSemi")[0], text.split("LeftSemi")
    assert "LeftAnti" in alone and len(copies) == 2
    assert "SortMergeJoin" not in text and "CartesianProduct" not in text and "NestedLoop" not in text
    shuffles = [line for line in text.splitlines() if "Exchange hashpartitioning" in line]
    assert sum("id_aluno" in line for line in shuffles) == 1
    assert len(shuffles) == 2  # the other one adds up the state indicators


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "fact")
    fact_student(spark, SF).write.parquet(path)
    fact = spark.read.parquet(path)
    levels = plan(plans.level_distribution(fact))
    assert "IsNotNull(compareceu)" in levels and "EqualTo(compareceu,true)" in levels
    assert "proficiencia" not in levels and "media_portugues" not in levels
    schools = plan(plans.school_statistics(fact))
    assert schools.count("Exchange") == 1 and schools.count("HashAggregate") == 2
    rules = plan(quality_report(fact, FACT_RULES["fct_avaliacao_aluno"]))
    assert rules.count("FileScan") == 1 and "peso_aluno" not in rules


def test_entry_stands_without_what_the_training_data_operators_need(tmp_path):
    """With a library missing that only they import, all other queries are still registered."""
    (tmp_path / "public_tokenizers.py").write_text("raise ImportError('not installed')\n")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    told = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(n.startswith('op') for n in e.queries()))"
    paths = os.pathsep.join([str(tmp_path), root])
    out = subprocess.run([sys.executable, "-c", told], capture_output=True, text=True, check=True, env=os.environ | {"PYTHONPATH": paths}, cwd=tmp_path)
    from catalogue import queries

    assert out.stdout.split() == [str(len(queries.QUERIES)), str(len(queries.ORACLES)), "False"]
