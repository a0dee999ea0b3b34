import random
from datetime import datetime, timezone

import pytest
from conftest import rows
from test_marts import fact

from layerwright import plans
from layerwright.operators import RunStamp
from layerwright.sources import read_table, write_partitioned

MONTHS = [RunStamp(datetime(2026, m, 1, tzinfo=timezone.utc)) for m in (7, 8, 9)]
TABLE = "fct_avaliacao_aluno"


def students(seed, n):
    rng = random.Random(seed)
    flag = lambda: rng.choice([True, True, False, None])
    return [(i, rng.choice([10, 20, 30]), rng.choice([0.0, 650.25, 701.5, None]), flag(), flag(), flag(), rng.randint(0, 3)) for i in range(n)]


def put(spark, layout, stamp, some):
    placed = fact(spark, *some).withColumns(stamp.partition("_proc_ano", "_proc_mes"))
    write_partitioned(placed, f"{layout.silver}/{TABLE}", ("_proc_ano", "_proc_mes"), keep_others=False)


def check(spark, layout, some):
    all_of = fact(spark, *some)
    for name, mart in (("estatisticas_escolares", plans.school_statistics), ("distribuicao_niveis", plans.level_distribution)):
        want = mart(all_of)
        assert rows(read_table(spark, f"{layout.gold}/{name}").select(*want.columns)) == rows(want)


@pytest.fixture
def layout(tmp_path):
    return plans.Layout("", "", f"{tmp_path}/silver", f"{tmp_path}/gold")


def test_months_add_up_to_all_students_at_once(spark, layout):
    months = [students(seed, n) for seed, n in ((1, 60), (2, 5), (3, 40))]
    for i, (stamp, some) in enumerate(zip(MONTHS, months)):
        put(spark, layout, stamp, some)  # in place of the month before, which is not read again
        report = plans.add_month(spark, layout, stamp)
        assert {r.status for r in report} == {"written"} and len(report) == 2
        check(spark, layout, sum(months[: i + 1], []))
    again = students(4, 30)
    put(spark, layout, MONTHS[1], again)
    plans.add_month(spark, layout, MONTHS[1])
    check(spark, layout, months[0] + again + months[2])


def test_a_month_without_assessed_students_replaces_what_it_gave(spark, layout):
    some, none = students(5, 20), [(1, 10, None, False, False, None, 0)]
    for stamp, month in ((MONTHS[0], some), (MONTHS[1], some), (MONTHS[1], none)):
        put(spark, layout, stamp, month)
        plans.add_month(spark, layout, stamp)
    check(spark, layout, some + none)


def test_a_missing_month_and_a_failed_rule_change_nothing(spark, layout, monkeypatch):
    some = students(6, 20)
    put(spark, layout, MONTHS[0], some)
    plans.add_month(spark, layout, MONTHS[0])
    with pytest.raises(plans.RunFailed):
        plans.add_month(spark, layout, MONTHS[1])
    put(spark, layout, MONTHS[1], students(7, 9))
    with monkeypatch.context() as m:
        m.setitem(plans.months.ADDING_UP, "distribuicao_niveis", (plans.level_sums, lambda sums: plans.levels_of(sums).drop("rede")))
        with pytest.raises(plans.RunFailed, match="columns"):
            plans.add_month(spark, layout, MONTHS[1])
    check(spark, layout, some)
    plans.add_month(spark, layout, MONTHS[1])
    check(spark, layout, some + students(7, 9))


def test_equal_scores_have_no_deviation(spark):
    parts = [plans.school_sums(fact(spark, *((i, 10, 700.1, True, True, True, 1) for i in range(n)))) for n in (3, 4)]
    found = plans.schools_of(parts[0].unionByName(parts[1])).first()
    assert (found["media_proficiencia"], found["desvio_padrao_proficiencia"], found["total_alunos"]) == (700.1, 0.0, 7)
