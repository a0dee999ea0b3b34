import os
import shutil
from datetime import datetime, timezone

import pytest
from conftest import plan, rows
from pyspark.sql import functions as F

from layerwright import plans
from layerwright.literacy import TARGETS, entities
from layerwright.operators import RunStamp, add_lineage
from layerwright.sources import (
    MissingPartition,
    ragged_per_file,
    read_landing,
    read_partition,
    read_table,
    read_text,
    shared_folder,
    stage,
    write_partitioned,
)


JULY = RunStamp(datetime(2026, 7, 31, 23, 59, 59, tzinfo=timezone.utc))
AUGUST = RunStamp(datetime(2026, 8, 1, tzinfo=timezone.utc))
MEASURES = "taxa_alfabetizacao,percentual_participacao," + ",".join(f"meta_alfabetizacao_{y}" for y in TARGETS)
GOALS = ",".join(["50.5"] * 9)

FILES = {
    "avaliacao_aluno": [
        "ano,id_municipio,id_escola,id_aluno,caderno,serie,rede,presenca,preenchimento_caderno,alfabetizado,proficiencia,peso_aluno",
        "2024,1,10,100,1,2,3,1,1,1,750.5,1.25",
        "2024,1,10,101,1,2,3,1,1,0,700,1.25",
        "2024,2,20,102,1,2,9,0,0,0,,",
        "2024,1,10,100,2,2,3,1,1,1,750.5,1.25",
    ],
    "meta_brasil": ["ano,rede," + MEASURES, "2024,publica," + GOALS],
    "meta_municipio": ["ano,id_municipio,rede,nivel_alfabetizacao," + MEASURES, "2024,1,publica,3," + GOALS],
    "meta_uf": ["ano,sigla_uf,rede," + MEASURES, "2024, sp ,publica," + GOALS],
    "municipio": ["id_municipio,ano,serie,rede,taxa_alfabetizacao,media_portugues", "1,2024,2,3,60,710", "2,2024,2,0,61,711"],
    "uf": ["ano,sigla_uf,serie,rede,taxa_alfabetizacao,media_portugues", "2024,SP,2,3,60,713"],
    "mapeamento_municipio": ["id_municipio,nome_municipio,sigla_uf", "1, Town ,sp"],
}


def land(root, **changed):
    for name, lines in (FILES | changed).items():
        os.makedirs(f"{root}/landing/{name}", exist_ok=True)
        with open(f"{root}/landing/{name}/data.csv", "w") as out:
            out.write("\n".join(lines) + "\n")
    return layers(root)


def run_all(spark, layout, stamp):
    return [
        *plans.run_bronze(spark, layout, stamp),
        *plans.run_silver(spark, layout, stamp),
        *plans.run_gold(spark, layout, stamp),
    ]


def layers(root):
    return plans.Layout(*(f"{root}/{layer}" for layer in ("landing", "bronze", "silver", "gold")))


@pytest.fixture(scope="module")
def july(spark, tmp_path_factory):
    """A lake after the July run, and the run's report; tests that write take a copy."""
    root = str(tmp_path_factory.mktemp("july"))
    return root, run_all(spark, land(root), JULY)


@pytest.fixture
def july_copy(july, tmp_path):
    shutil.copytree(july[0], tmp_path, dirs_exist_ok=True)
    return layers(tmp_path)


def test_csv_columns_go_by_name_and_bad_values_become_null(spark, tmp_path):
    (tmp_path / "a.csv").write_text('name,id,extra\n" x ",07,1\ny,12a,\n')
    df = read_landing(spark, str(tmp_path), {"id": "int", "name": "string"})
    assert df.dtypes == [("name", "string"), ("id", "int"), ("extra", "string")]
    assert rows(df) == [(" x ", 7, "1"), ("y", None, None)]
    assert read_landing(spark, str(tmp_path), infer=True).dtypes[2] == ("extra", "int")


def test_csv_with_another_header_is_refused(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name\n1,x\n")
    (tmp_path / "b.csv").write_text("name,id\nx,1\n")
    with pytest.raises(Exception, match="header"):
        read_landing(spark, str(tmp_path), {"id": "int"}).collect()


def test_lineage(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name\n1,x\n")
    row = add_lineage(read_landing(spark, str(tmp_path), {"id": "int"}), "things", JULY).first().asDict()
    assert row.pop("_source_file").endswith("/a.csv")
    assert len(row.pop("_record_hash")) == 64
    assert row == {
        "id": 1, "name": "x", "_ingestion_timestamp": "20260731_235959", "_ingestion_date": "2026-07-31",
        "_source_entity": "things", "_ing_ano": "2026", "_ing_mes": "07",
    }


def test_partition_write_keeps_or_replaces_the_rest(spark, tmp_path):
    df = spark.range(10).select("id", (F.col("id") % 2).alias("p"))
    path = str(tmp_path / "t")
    found = write_partitioned(df, path, ("p",), keep_others=True, metrics={"top": F.max("id")})
    assert found == {"rows": 10, "top": 9}
    write_partitioned(df.where("p = 1 AND id > 5"), path, ("p",), keep_others=True)
    assert rows(spark.read.parquet(path).groupBy("p").count()) == [(0, 5), (1, 2)]
    assert rows(read_partition(spark, path, p=1)) == [(7, 1), (9, 1)]
    with pytest.raises(MissingPartition, match="p=7"):
        read_partition(spark, path, p=7)
    write_partitioned(df.where("p = 0"), path, ("p",), keep_others=False, gather=True)
    assert rows(spark.read.parquet(path).groupBy("p").count()) == [(0, 5)]


def test_partition_read_prunes(spark, tmp_path):
    path = str(tmp_path / "t")
    write_partitioned(spark.range(4).select("id", F.lit("07").alias("_ing_mes")), path, ("_ing_mes",), True)
    scan = read_partition(spark, path, _ing_mes=7)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_ing_mes" in scan


def test_whole_run_and_report(spark, july):
    layout = layers(july[0])
    runs = {(r.layer, r.table, r.status): r for r in july[1]}
    assert runs["bronze", "avaliacao_aluno", "written"].rows == 4
    assert runs["silver", "avaliacao_aluno", "read"].duplicates == 1
    fact = runs["silver", "fct_avaliacao_aluno", "written"]
    assert (fact.rows, fact.unmatched) == (3, 1)
    lost = runs["silver", "fct_meta_municipio", "written"]
    assert (lost.rows, lost.unmatched) == (1, 1)
    assert {t: r.rows for (layer, t, _), r in runs.items() if layer == "gold"} == {
        "consolidado_municipio": 1, "consolidado_uf": 1, "distribuicao_niveis": 2, "estatisticas_escolares": 2, "ml_aluno": 2,
    }
    assert lost.message == "1 rows lost: no state"
    assert runs["silver", "fct_meta_uf", "written"].unmatched == 0
    report = plans.report_frame(spark, list(runs.values()))
    assert report.count() == 7 + 7 + 3 + 5
    stored = spark.read.parquet(f"{layout.gold}/ml_aluno")
    assert dict(stored.dtypes)["_gold_processed_at"] == "timestamp" and stored.first()["ano"] == 2024
    silver = spark.read.parquet(f"{layout.silver}/fct_avaliacao_aluno").first()
    assert silver["_silver_processed_at"] == JULY.utc.replace(tzinfo=None) and silver["_proc_mes"] == 7


def test_two_months_stay_apart_and_a_rerun_replaces_its_own(spark, july_copy, tmp_path):
    layout = july_copy
    before = rows(spark.read.parquet(f"{layout.bronze}/municipio/_ing_ano=2026/_ing_mes=07"))
    land(str(tmp_path), municipio=FILES["municipio"][:2])
    for _ in range(2):
        plans.run_bronze(spark, layout, AUGUST)
    plans.run_silver(spark, layout, AUGUST)
    assert rows(spark.read.parquet(f"{layout.bronze}/municipio/_ing_ano=2026/_ing_mes=07")) == before
    assert spark.read.parquet(f"{layout.bronze}/municipio/_ing_ano=2026/_ing_mes=08").count() == 1
    by_month = spark.read.parquet(f"{layout.silver}/fct_avaliacao_aluno").groupBy("_proc_mes").count()
    assert rows(by_month) == [(7, 3), (8, 3)]


def test_reported_duplicates_are_kept_on_request(spark, july_copy):
    layout = july_copy
    runs = plans.run_silver(spark, layout, JULY, dedup="report")
    assert next(r for r in runs if r.table == "fct_avaliacao_aluno").rows == 4
    with pytest.raises(ValueError):
        plans.run_silver(spark, layout, JULY, dedup="other")


def test_bronze_failure_leaves_other_entities_alone(spark, tmp_path):
    broken = FILES["uf"][:1] + ["x,SP,2,3,60,713"]
    layout = land(str(tmp_path), uf=broken, meta_uf=FILES["meta_uf"][:1])
    with pytest.raises(plans.RunFailed) as failure:
        plans.run_bronze(spark, layout, JULY)
    status = {r.table: r.status for r in failure.value.runs}
    assert {t for t, s in status.items() if s == "failed"} == {"uf", "meta_uf"}
    assert "not_null(ano) measured 1" in str(failure.value) and "min_count(*, 1) measured 0" in str(failure.value)
    assert not os.path.exists(f"{layout.bronze}/uf") and os.path.exists(f"{layout.bronze}/municipio")


def test_missing_landing_folder_fails(spark, tmp_path):
    layout = land(str(tmp_path))
    os.makedirs(f"{tmp_path}/empty/uf")
    with pytest.raises(plans.RunFailed):
        only = {"uf": entities()["uf"]}
        plans.run_bronze(spark, plans.Layout(f"{tmp_path}/empty", layout.bronze, "", ""), JULY, only)


def test_failed_rule_writes_no_fact_at_all(spark, tmp_path):
    outside = [FILES["uf"][0], "2024,SP,2,3,160,713"]
    layout = land(str(tmp_path), uf=outside)
    plans.run_bronze(spark, layout, JULY)
    with pytest.raises(plans.RunFailed, match="taxa_alfabetizacao") as failure:
        plans.run_silver(spark, layout, JULY)
    assert {r.table: r.status for r in failure.value.runs} == {
        **dict.fromkeys(FILES, "read"),
        "fct_avaliacao_aluno": "withheld", "fct_meta_municipio": "withheld", "fct_meta_uf": "failed",
    }
    assert not os.path.exists(layout.silver)


def test_failed_mart_keeps_the_old_marts(spark, july_copy):
    layout = july_copy
    stored = spark.read.parquet(f"{layout.silver}/fct_meta_uf").drop("_proc_ano", "_proc_mes")
    nameless = [(r["sigla_uf"], r["ano"], None, *r[3:]) for r in stored.collect()]
    spark.createDataFrame(nameless, stored.schema).write.mode("overwrite").parquet(f"{layout.silver}/fct_meta_uf/_proc_ano=2026/_proc_mes=07")
    before = rows(spark.read.parquet(f"{layout.gold}/ml_aluno"))
    with pytest.raises(plans.RunFailed, match="consolidado_uf"):
        plans.run_gold(spark, layout, JULY)
    assert rows(spark.read.parquet(f"{layout.gold}/ml_aluno")) == before


def test_columns_are_those_to_deliver(spark, july_copy, monkeypatch):
    real = plans.runs.build_marts
    monkeypatch.setattr(plans.runs, "build_marts", lambda *a: real(*a) | {"ml_aluno": real(*a)["ml_aluno"].drop("ano")})
    with pytest.raises(plans.RunFailed, match="columns are") as failure:
        plans.run_gold(spark, july_copy, JULY)
    assert {r.table for r in failure.value.runs if r.status == "failed"} == {"ml_aluno"}


def test_gold_run_drops_stale_years(spark, july_copy):
    layout = july_copy
    for fact in ("fct_avaliacao_aluno", "fct_meta_municipio", "fct_meta_uf"):
        stored = spark.read.parquet(f"{layout.silver}/{fact}").drop("_proc_ano", "_proc_mes")
        later = stored.withColumn("ano", F.col("ano") + 1)
        later.write.parquet(f"{layout.silver}/{fact}/_proc_ano=2026/_proc_mes=08")
    plans.run_gold(spark, layout, AUGUST)
    for mart in ("ml_aluno", "consolidado_uf"):
        assert rows(spark.read.parquet(f"{layout.gold}/{mart}").select("ano").distinct()) == [(2025,)]


def test_text_that_does_not_fit_stays_in_bronze(spark, tmp_path):
    """Two scores that are no numbers keep their text and different hashes, and do not pass as scores of 0 unseen."""
    students = [FILES["avaliacao_aluno"][0], '2024,1,10,100,1,2,3,1,1,1,"745,5",1.25', "2024,1,10,100,1,2,3,1,1,1,abc,1.25"]
    layout = land(str(tmp_path), avaliacao_aluno=students)
    only = {"avaliacao_aluno": entities()["avaliacao_aluno"]}
    with pytest.raises(plans.RunFailed, match=r"parsed\(proficiencia\) measured 2"):
        plans.run_bronze(spark, layout, JULY, only)
    (run,) = plans.run_bronze(spark, layout, JULY, only, unparsed="report")
    assert (run.rows, run.unparsed, run.message) == (2, 2, "2 unparsed in proficiencia")
    stored = spark.read.parquet(f"{layout.bronze}/avaliacao_aluno").collect()
    assert {r["_unparsed"]["proficiencia"] for r in stored} == {"745,5", "abc"}
    assert [r["proficiencia"] for r in stored] == [None, None] and len({r["_record_hash"] for r in stored}) == 2
    with pytest.raises(ValueError):
        plans.run_bronze(spark, layout, JULY, only, unparsed="other")


RAGGED_LINES = [
    FILES["mapeamento_municipio"][0], "1,Town,SP", "2,Short", "3,Long,SP,surplus", '4,"Two', 'lines",SP', '5,"A, b",RJ', "6,C,BA",
]


def test_ragged_lines_fail_an_entity_or_stay_as_lines(spark, tmp_path):
    layout = land(str(tmp_path), mapeamento_municipio=RAGGED_LINES)
    only = {"mapeamento_municipio": entities()["mapeamento_municipio"]}
    with pytest.raises(plans.RunFailed, match=r"width\(\*\) measured 4; 4 ragged in file:.*/mapeamento_municipio/data.csv"):
        plans.run_bronze(spark, layout, JULY, only)
    assert not os.path.exists(f"{layout.bronze}/mapeamento_municipio")
    (run,) = plans.run_bronze(spark, layout, JULY, only, ragged="report")
    assert (run.rows, run.ragged, run.unparsed) == (7, 4, 0) and run.message.startswith("4 ragged in file:")
    stored = read_partition(spark, f"{layout.bronze}/mapeamento_municipio", _ing_ano=2026, _ing_mes=7)
    assert {r["_ragged"] for r in stored.where("_ragged IS NOT NULL").collect()} == set(RAGGED_LINES[2:6])
    assert rows(stored.where("_ragged IS NOT NULL").select("id_municipio", "nome_municipio", "sigla_uf").distinct()) == [(None, None, None)]
    assert stored.select("_record_hash").distinct().count() == 7
    silver = plans.read_conformed(spark, layout, JULY, only)["mapeamento_municipio"]
    assert {r["id_municipio"] for r in silver.collect()} == {1, 5, 6}
    with pytest.raises(ValueError):
        plans.run_bronze(spark, layout, JULY, only, ragged="drop")


def test_ragged_lines_with_guessed_types(spark, tmp_path):
    layout = land(str(tmp_path), mapeamento_municipio=RAGGED_LINES)
    only = {"mapeamento_municipio": entities()["mapeamento_municipio"]}
    (run,) = plans.run_bronze(spark, layout, JULY, only, infer=True, ragged="report")
    assert (run.rows, run.ragged) == (7, 4)


def test_quoted_line_breaks_are_read_on_request(spark, tmp_path):
    layout = land(str(tmp_path), mapeamento_municipio=[*RAGGED_LINES[:2], *RAGGED_LINES[4:]])
    only = {"mapeamento_municipio": entities()["mapeamento_municipio"]}
    (run,) = plans.run_bronze(spark, layout, JULY, only, multiline=True)
    assert (run.rows, run.ragged) == (4, 0)
    stored = spark.read.parquet(f"{layout.bronze}/mapeamento_municipio")
    assert {r["nome_municipio"] for r in stored.collect()} == {"Town", "Two\nlines", "A, b", "C"}


def test_ragged_lines_of_several_files_are_told_by_file(spark, tmp_path):
    for name in "abcdefg":
        (tmp_path / f"{name}.csv").write_text("id,name\n1,x\n" + "2\n" * (1 + (name == "c")))
    found = read_landing(spark, str(tmp_path), {"id": "int"}, ragged=True)
    assert rows(found.select("id").distinct()) == [(1,), (None,)]
    stored = stage(add_lineage(read_text(spark, str(tmp_path), ragged=True), "things", JULY), "ragged").df
    per_file = ragged_per_file(stored, "_source_file")
    assert sorted((r[0][-5:], r[1]) for r in per_file.collect()) == [(f"{n}.csv", 1 + (n == "c")) for n in "abcdefg"]
    assert rows(read_landing(spark, str(tmp_path)).select("id").distinct()) == [("1",), ("2",)]


def test_hash_is_of_the_text(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id\n1\n01\n")
    hashed = add_lineage(read_text(spark, str(tmp_path)), "things", JULY)
    assert hashed.select("_record_hash").distinct().count() == 2


def left_behind(spark):
    """Folders of runs that still stand in the shared folder."""
    root = shared_folder(spark)
    return [d for d in (os.listdir(root) if os.path.isdir(root) else []) if d.startswith("run-")]


def test_runs_leave_nothing_staged(spark, tmp_path, july):
    assert left_behind(spark) == []
    layout = land(str(tmp_path), uf=FILES["uf"][:1])
    with pytest.raises(plans.RunFailed):
        plans.run_bronze(spark, layout, JULY)
    assert left_behind(spark) == []


def statuses(failure):
    return {(r.layer, r.table): r.status for r in failure.value.runs}


def test_missing_entity_folder_is_reported(spark, july_copy):
    shutil.rmtree(f"{july_copy.bronze}/uf")
    with pytest.raises(plans.RunFailed, match="uf") as failure:
        plans.run_silver(spark, july_copy, JULY)
    assert statuses(failure) == {("silver", n): "failed" if n == "uf" else "withheld" for n in FILES}
    assert left_behind(spark) == []


def test_missing_month_is_reported(spark, july_copy):
    with pytest.raises(plans.RunFailed, match="municipio has no rows for _ing_ano=2026, _ing_mes=8") as failure:
        plans.run_silver(spark, july_copy, AUGUST)
    assert set(statuses(failure).values()) == {"failed"}
    with pytest.raises(plans.RunFailed, match="fct_meta_uf has no rows") as failure:
        plans.run_gold(spark, july_copy, AUGUST)
    assert len(failure.value.runs) == 3


def test_failing_write_is_reported(spark, july_copy, monkeypatch):
    real = plans.runs.write_partitioned

    def write(df, path, *args, **options):
        if path.endswith(("fct_meta_uf", "consolidado_uf")):
            raise OSError("disk full")
        return real(df, path, *args, **options)

    monkeypatch.setattr(plans.runs, "write_partitioned", write)
    with pytest.raises(plans.RunFailed, match="disk full") as failure:
        plans.run_silver(spark, july_copy, JULY)
    found = statuses(failure)
    assert found["silver", "fct_meta_uf"] == "failed" and found["silver", "fct_avaliacao_aluno"] == "written"
    with pytest.raises(plans.RunFailed, match="disk full") as failure:
        plans.run_gold(spark, july_copy, JULY)
    found = statuses(failure)
    assert found["gold", "consolidado_uf"] == "failed" and found["gold", "ml_aluno"] == "written"


def test_row_level_mart_is_written_without_a_shuffle(spark, july_copy, monkeypatch):
    """Publishing adds no exchange to those that the school means need; the aggregated marts are gathered."""
    hints = {}
    real = plans.runs.write_partitioned

    def write(df, path, *args, **options):
        hints[os.path.basename(path)] = options.get("gather", False)
        if path.endswith("ml_aluno"):
            spark.conf.set("spark.sql.adaptive.enabled", "false")
            text = plan(df)
            spark.conf.set("spark.sql.adaptive.enabled", "true")
            assert "REBALANCE" not in text and "Exchange hashpartitioning" not in text
        return real(df, path, *args, **options)

    monkeypatch.setattr(plans.runs, "write_partitioned", write)
    plans.run_gold(spark, july_copy, JULY)
    assert hints.pop("ml_aluno") is False and all(hints.values()) and len(hints) == 4


def test_every_reason_of_a_loss_is_told(spark, tmp_path):
    layout = land(
        str(tmp_path),
        municipio=[FILES["municipio"][0], "1,2024,2,3,60,710", "2,2024,2,0,61,711", "3,2024,2,0,61,711", "4,2024,2,0,61,711"],
        mapeamento_municipio=[FILES["mapeamento_municipio"][0], "1,Town,sp", "3,Three,rj", "4,Four,sp"],
        uf=[FILES["uf"][0], "2024,SP,2,3,60,713", "2024,RJ,2,3,60,713"],
    )
    plans.run_bronze(spark, layout, JULY)
    runs = {r.table: r for r in plans.run_silver(spark, layout, JULY) if r.status == "written"}
    area, state = runs["fct_meta_municipio"], runs["fct_meta_uf"]
    assert (area.rows, area.unmatched) == (1, 3)
    assert area.message == "1 rows lost: no state; 1 rows lost: no state target; 1 rows lost: no target"
    assert (state.rows, state.unmatched, state.message) == (1, 1, "1 rows lost: no target")


def test_stamp_is_utc():
    from datetime import timedelta

    late = datetime(2026, 7, 31, 22, 0, tzinfo=timezone(timedelta(hours=-3)))
    assert (RunStamp(late).year, RunStamp(late).month) == ("2026", "08")


class Session:
    """A session's settings, without Spark."""

    def __init__(self, master, folder=None):
        self.conf, self.sparkContext = {"spark.checkpoint.dir": folder}, self
        self.master, self.applicationId, self.folder = master, "app-1", None

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


def test_shared_folder_is_the_one_the_cluster_names():
    named = Session("spark://host:7077", "hdfs://shared/ckpt/")
    assert shared_folder(named) == "hdfs://shared/ckpt/layerwright/app-1"


def test_shared_folder_is_never_local_on_a_cluster():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(Session("spark://host:7077"))
    for folder in ("file:/tmp/x", "file:///tmp/x"):
        with pytest.raises(RuntimeError, match="each machine"):
            shared_folder(Session("spark://host:7077", folder))
    alone = Session("local[2]")
    assert shared_folder(alone) == shared_folder(alone)
    assert alone.folder is None  # the caller's settings stay as they are


class Cluster(Session):
    """A real session that says it runs on a cluster."""

    def __init__(self, spark, folder):
        super().__init__("spark://host:7077", folder)
        self.spark = spark

    def __getattr__(self, name):
        return getattr(self.spark, name) if hasattr(self.spark, name) else getattr(self.spark.sparkContext, name)


@pytest.mark.parametrize("scheme", ["", "file:", "file://"])
def test_a_path_of_the_machines_that_all_executors_see_is_shared(spark, tmp_path, scheme):
    folder = f"{scheme}{tmp_path}"
    cluster = Cluster(spark, folder)
    assert shared_folder(cluster) == shared_folder(cluster) == f"{folder}/layerwright/app-1"
    assert list(tmp_path.glob("layerwright/app-1/*")) == []  # the trial leaves nothing


def test_a_path_where_executors_write_for_themselves_is_refused(spark, tmp_path):
    class Apart(Cluster):
        def range(self, *bounds):
            return self.spark.range(*bounds).where("id % 3 <> 1")  # what the other machines wrote is not there

    apart = Apart(spark, f"file://{tmp_path}")
    for _ in range(2):
        with pytest.raises(RuntimeError, match=r"each machine has for itself: of 8 rows written there, 5 are seen"):
            shared_folder(apart)
    assert list(tmp_path.glob("layerwright/app-1/*")) == []


def snapshot(spark, layout):
    """What readers of silver and gold see: rows of every fact and mart but for their times."""
    month = {"_proc_ano": 2026, "_proc_mes": 7}
    seen = {n: read_partition(spark, f"{layout.silver}/{n}", **month) for n in os.listdir(layout.silver) if not n.startswith("_")}
    seen |= {n: read_table(spark, f"{layout.gold}/{n}") for n in os.listdir(layout.gold) if not n.startswith("_")}
    return {n: rows(df.drop("_silver_processed_at", "_gold_processed_at")) for n, df in seen.items()}


CHANGED_STUDENTS = [*FILES["avaliacao_aluno"][:2], "2024,1,10,109,1,2,3,1,1,1,800,1.25"]


@pytest.mark.parametrize("layer", ["silver", "gold"])
def test_a_run_that_stops_after_a_table_leaves_the_old_ones_whole(spark, july_copy, tmp_path, monkeypatch, layer):
    from layerwright.plans import runs

    layout = july_copy
    old = snapshot(spark, layout)
    assert len(old) == 8
    land(str(tmp_path), avaliacao_aluno=CHANGED_STUDENTS)
    plans.run_bronze(spark, layout, JULY)
    if layer == "gold":
        plans.run_silver(spark, layout, JULY)
        old |= {n: r for n, r in snapshot(spark, layout).items() if n.startswith("fct")}
    real, done = runs.write_partitioned, []

    def stops(df, path, *args, **options):
        if done:
            raise OSError("the disk is gone")
        done.append(path)
        return real(df, path, *args, **options)

    monkeypatch.setattr(runs, "side_by_side", lambda work, names: {n: work(n) for n in names})
    monkeypatch.setattr(runs, "write_partitioned", stops)
    with pytest.raises(plans.RunFailed, match="the disk is gone"):
        {"silver": plans.run_silver, "gold": plans.run_gold}[layer](spark, layout, JULY)
    assert snapshot(spark, layout) == old
    monkeypatch.undo()
    plans.run_silver(spark, layout, JULY)
    plans.run_gold(spark, layout, JULY)
    new = snapshot(spark, layout)
    assert new["fct_avaliacao_aluno"] != old["fct_avaliacao_aluno"] or layer == "gold"
    assert new["ml_aluno"] != old["ml_aluno"]
    # What broke off is gone.
    for folder in (layout.silver, layout.gold):
        assert not [n for d in ("_runs", "_published") if os.path.isdir(f"{folder}/{d}") for n in os.listdir(f"{folder}/{d}") if not n.startswith(".")]


@pytest.mark.parametrize("moved", [0, 1, 2])
def test_tables_published_but_not_yet_moved_count(spark, july_copy, tmp_path, monkeypatch, moved):
    """The moving of a silver run's tables breaks off; readers see the new month, and the next run ends the moving."""
    from layerwright.sources import versions

    layout = july_copy
    old = snapshot(spark, layout)
    land(str(tmp_path), avaliacao_aluno=CHANGED_STUDENTS, mapeamento_municipio=["id_municipio,nome_municipio,sigla_uf", "1,City,sp"])
    plans.run_bronze(spark, layout, JULY)
    real, done = versions._move, []

    def stops(*args):
        if len(done) == moved:
            raise OSError("the disk is gone")
        done.append(args)
        real(*args)

    monkeypatch.setattr(versions, "_move", stops)
    with pytest.raises(OSError):
        plans.run_silver(spark, layout, JULY)
    monkeypatch.undo()
    seen = snapshot(spark, layout)
    assert seen["fct_avaliacao_aluno"] != old["fct_avaliacao_aluno"] and {r[0] for r in seen["fct_meta_municipio"]} == {"City"}
    versions.finish(spark, layout.silver)
    assert snapshot(spark, layout) == seen
    for name in (n for n in seen if n.startswith("fct")):
        assert rows(spark.read.parquet(f"{layout.silver}/{name}").drop("_silver_processed_at")) == seen[name]
    plans.run_silver(spark, layout, JULY)
    assert snapshot(spark, layout) == seen
