"""The three layer runs. Each reads and writes Parquet tables, so a run can be repeated alone."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from layerwright.functions import count_where
from layerwright.jobs import side_by_side
from layerwright.literacy import DELIVERED, FACT_RULES, MART_RULES, NOT_FOUND, entities
from layerwright.operators.conform import conform
from layerwright.operators.dedup import dedup_by_key, find_repeats
from layerwright.operators.lineage import (
    BATCH,
    BRONZE_PARTITION,
    GOLD_TIME,
    SILVER_PARTITION,
    SILVER_TIME,
    SOURCE_FILE,
    RunStamp,
    add_lineage,
)
from layerwright.operators.quality import Outcome, counters, evaluate
from layerwright.plans import facts as fact_plans
from layerwright.plans import marts as mart_plans
from layerwright.sources.landing import RAGGED, ragged_per_file, read_text, typed
from layerwright.sources.layers import read_partition, write_partitioned
from layerwright.sources.versions import publish, run_folder
from layerwright.sources.workspace import Staged, stage, staging
from layerwright.spec import Entity, Rule

# The batch that a bronze run writes, beside those of a stream.
RUN = "run"
REPORT_SCHEMA = (
    "layer string, table_name string, status string, row_count bigint, duplicates bigint,"
    " unmatched bigint, unparsed bigint, ragged bigint, message string"
)


@dataclass(frozen=True)
class Layout:
    """Root folders of the layers."""

    landing: str
    bronze: str
    silver: str
    gold: str


@dataclass(frozen=True)
class TableRun:
    """What a run did with one table. Status is read, written, failed or withheld.

    ``unmatched`` counts rows that found no partner in a lookup; ``unparsed`` counts values whose text
    did not fit their type, ``ragged`` lines of another width than their header. The message says which, or why the table failed.
    """

    layer: str
    table: str
    status: str
    rows: int | None = None
    duplicates: int | None = None
    unmatched: int | None = None
    unparsed: int | None = None
    ragged: int | None = None
    message: str | None = None


class RunFailed(Exception):
    """A run in which a table failed; ``runs`` tells what became of each table."""

    def __init__(self, runs: list[TableRun]):
        self.runs = runs
        super().__init__("; ".join(f"{r.table}: {r.message}" for r in runs if r.status == "failed"))


def report_frame(spark: SparkSession, runs: list[TableRun]) -> DataFrame:
    """The run report, one row per table."""
    rows = [
        (r.layer, r.table, r.status, r.rows, r.duplicates, r.unmatched, r.unparsed, r.ragged, r.message) for r in runs
    ]
    return spark.createDataFrame(rows, REPORT_SCHEMA)


def _failures(outcomes: list[Outcome]) -> str:
    return "; ".join(f"{o.rule} measured {o.measured}" for o in outcomes if not o.passed)


def _require(
    layer: str, outcomes: dict[str, list[Outcome]], done: list[TableRun] = (), told: Iterable[str] = ()
) -> None:
    """Raise before anything is written if any table of the layer fails a rule. ``told`` is added to the message."""
    messages = {table: "; ".join([text, *told]) if (text := _failures(found)) else "" for table, found in outcomes.items()}
    if any(messages.values()):
        raise RunFailed(
            [
                *done,
                *(TableRun(layer, t, "failed" if text else "withheld", message=text or None)
                for t, text in messages.items()),
            ]
        )


def _attempt(layer: str, work: Callable, names: Iterable[str]) -> tuple[dict, list[TableRun]]:
    """``work`` for each table, side by side: what it gave for those that went well, and the failures."""

    def one(name: str):
        try:
            return work(name), None
        except RunFailed as failure:
            return None, failure.runs[0]
        except Exception as error:  # recorded here, raised with the report
            return None, TableRun(layer, name, "failed", message=str(error) or type(error).__name__)

    found = side_by_side(one, names)
    return {n: r for n, (r, failed) in found.items() if failed is None}, [f for _, f in found.values() if f]


def _stop_on(failed: list[TableRun], layer: str, names: Iterable[str], done: list[TableRun] = ()) -> None:
    """Raise with a status for every table if any failed; those not done are withheld."""
    if failed:
        known = {r.table for r in (*done, *failed) if r.layer == layer}
        rest = [TableRun(layer, n, "withheld") for n in names if n not in known]
        raise RunFailed([*done, *failed, *rest])


def _check(layer: str, tables: dict, rules: dict, done: list[TableRun] = ()) -> None:
    """Raise before anything is written if any table has other columns than it is to deliver, fails a rule,
    or cannot be checked at all."""
    for name, table in tables.items():
        columns = tuple((table.df if isinstance(table, Staged) else table).columns)
        if columns != DELIVERED[name]:
            _stop_on([TableRun(layer, name, "failed", message=f"columns are {columns}")], layer, tables, done)
    try:
        outcomes = evaluate({name: (t, rules[name]) for name, t in tables.items()})
    except Exception:  # tell which table it was
        outcomes, failed = _attempt(layer, lambda n: evaluate({n: (tables[n], rules[n])})[n], tables)
        _stop_on(failed, layer, tables, done)
    _require(layer, outcomes, done)


#: Files that a message names.
FILES_TOLD = 5


def _told_files(staged: Staged, ragged: int) -> list[str]:
    """The files with the most ragged lines, and how many other files have some."""
    if not ragged:
        return []
    per_file = ragged_per_file(staged.df, SOURCE_FILE)
    first = per_file.orderBy(F.desc("ragged"), SOURCE_FILE).limit(FILES_TOLD).collect()
    rest = per_file.count() - len(first)
    return [*(f"{r['ragged']} ragged in {r[SOURCE_FILE]}" for r in first), *([f"and in {rest} other files"] if rest else [])]


def _ingest(
    spark: SparkSession,
    layout: Layout,
    entity: Entity,
    stamp: RunStamp,
    infer: bool,
    null_safe: bool,
    unparsed: str,
    ragged: str,
    multiline: bool,
) -> TableRun:
    """Parse the files once, into a staged table that is checked and then published.

    The hash is of the text as it came. Text that does not fit its type stays in the table beside
    the NULL it became, and is counted by column. A line of another width than its header stays as a line and is counted by file.
    """
    raw = read_text(spark, f"{layout.landing}/{entity.name}", ragged=True, multiline=multiline, infer=infer)
    lined = add_lineage(raw, entity.name, stamp, null_safe)
    bronze = typed(lined, {} if infer else entity.raw_types, unparsed=True).withColumn(BATCH, F.lit(RUN))
    rules = (*entity.rules, *entity.parse_rules(raw.columns), Rule("width"))
    staged = stage(bronze, entity.name, counters(bronze, rules))
    outcomes = evaluate({entity.name: (staged, rules)})[entity.name]
    lost = {o.rule.column: o.measured for o in outcomes if o.rule.kind == "parsed" and o.measured}
    n_ragged = sum(o.measured for o in outcomes if o.rule.kind == "width")
    files = _told_files(staged, n_ragged)
    reported = {kind for kind, handling in (("parsed", unparsed), ("width", ragged)) if handling == "report"}
    gated = [o for o in outcomes if o.rule.kind not in reported]
    _require("bronze", {entity.name: gated}, told=files)
    found = write_partitioned(
        staged.df, f"{layout.bronze}/{entity.name}", (*BRONZE_PARTITION, BATCH), keep_others=True
    )
    told = "; ".join([*(f"{n} unparsed in {c}" for c, n in lost.items()), *files])
    return TableRun(
        "bronze", entity.name, "written", found["rows"], unparsed=sum(lost.values()), ragged=n_ragged, message=told or None
    )


def run_bronze(
    spark: SparkSession,
    layout: Layout,
    stamp: RunStamp,
    pack: dict[str, Entity] | None = None,
    infer: bool = False,
    null_safe_hash: bool = True,
    unparsed: str = "fail",
    ragged: str = "fail",
    multiline: bool = False,
) -> list[TableRun]:
    """Land every entity in its bronze table, replacing what a run has written this month and nothing else.

    An entity that fails leaves the others alone; the run raises at its end. A value that does not
    fit its declared type fails its entity; with ``unparsed="report"`` it is kept as text, counted and reported.
    So does a line that has more or fewer values than its header; with ``ragged="report"`` bronze keeps the line, and silver
    leaves it out. ``multiline`` reads quoted values that hold line breaks.
    """
    for name, handling in (("unparsed", unparsed), ("ragged", ragged)):
        if handling not in ("fail", "report"):
            raise ValueError(f"{name} must be 'fail' or 'report', not {handling!r}")
    pack = pack or entities()
    with staging(spark):
        done, failed = _attempt(
            "bronze", lambda n: _ingest(spark, layout, pack[n], stamp, infer, null_safe_hash, unparsed, ragged, multiline), pack
        )
    if failed:
        by_name = {r.table: r for r in (*done.values(), *failed)}
        raise RunFailed([by_name[n] for n in pack])
    return list(done.values())


def _month(stamp: RunStamp, partition: tuple[str, str]) -> dict[str, int]:
    return dict(zip(partition, (int(stamp.year), int(stamp.month))))


def read_conformed(
    spark: SparkSession, layout: Layout, stamp: RunStamp, pack: dict[str, Entity]
) -> dict[str, DataFrame]:
    """This month's bronze rows of every entity, conformed; an entity without any fails the run."""
    month = _month(stamp, BRONZE_PARTITION)

    def read(name: str) -> DataFrame:
        rows = read_partition(spark, f"{layout.bronze}/{name}", **month)
        whole = rows.where(F.col(RAGGED).isNull()) if RAGGED in rows.columns else rows
        return conform(whole, pack[name])

    tables, failed = _attempt("silver", read, pack)
    _stop_on(failed, "silver", pack)
    return tables


def without_duplicates(
    tables: dict[str, DataFrame], pack: dict[str, Entity], dedup: str = "drop"
) -> tuple[dict[str, DataFrame], list[TableRun]]:
    """Count duplicate keys of each table, and drop them where there are any.

    A table that has duplicates is staged without them, so that what follows does not shuffle it
    again. ``dedup="report"`` counts and keeps all rows.
    """
    if dedup not in ("drop", "report"):
        raise ValueError(f"dedup must be 'drop' or 'report', not {dedup!r}")

    def handle(name: str) -> tuple[DataFrame, TableRun]:
        df, key = tables[name], pack[name].key
        repeats = find_repeats(df, key)
        if dedup == "drop" and repeats.duplicates:
            df = stage(dedup_by_key(df, key, repeats), name).df
        return df, TableRun("silver", name, "read", repeats.total_rows, repeats.duplicates)

    found, failed = _attempt("silver", handle, tables)
    runs = [run for _, run in found.values()]
    _stop_on(failed, "silver", tables, runs)
    return {n: df for n, (df, _) in found.items()}, runs


def _told(lost: dict[str, int]) -> str | None:
    return "; ".join(f"{n} rows lost: {reason}" for reason, n in lost.items() if n) or None


def run_silver(
    spark: SparkSession,
    layout: Layout,
    stamp: RunStamp,
    pack: dict[str, Entity] | None = None,
    dedup: str = "drop",
) -> list[TableRun]:
    """Build the facts from this month's bronze partitions: check all of them, write all, then let them count at once.

    Readers (``read_partition``) see the facts of the run before until the last one is written.

    ``unmatched`` counts students without a known municipality, and the indicator rows that a target
    fact loses; the message gives the reasons. They are counted in the pass that checks the rules.
    """
    pack = pack or entities()
    with staging(spark), run_folder(spark, layout.silver) as folder:
        tables, runs = without_duplicates(read_conformed(spark, layout, stamp, pack), pack, dedup)
        area, state = Observation(), Observation()
        builders = {
            "fct_avaliacao_aluno": lambda: fact_plans.student_fact(tables),
            "fct_meta_municipio": lambda: fact_plans.area_target_fact(tables, seen=area),
            "fct_meta_uf": lambda: fact_plans.state_target_fact(tables, seen=state),
        }
        facts, failed = _attempt("silver", lambda n: builders[n](), builders)
        _stop_on(failed, "silver", builders, runs)
        _check("silver", facts, FACT_RULES, runs)
        losses = {"fct_meta_municipio": dict(area.get), "fct_meta_uf": dict(state.get)}

        def write(name: str) -> TableRun:
            stamped = facts[name].withColumns(
                {SILVER_TIME: stamp.timestamp(), **stamp.partition(*SILVER_PARTITION)}
            )
            unplaced = {"unmatched": count_where(F.col("nome_municipio") == NOT_FOUND)}
            found = write_partitioned(
                stamped,
                f"{folder}/{name}",
                SILVER_PARTITION,
                keep_others=False,
                metrics=None if name in losses else unplaced,
            )
            lost = losses.get(name, {})
            unmatched = sum(lost.values()) if name in losses else found["unmatched"]
            return TableRun("silver", name, "written", found["rows"], unmatched=unmatched, message=_told(lost))

        written, failed = _attempt("silver", write, facts)
        _stop_on(failed, "silver", facts, [*runs, *written.values()])
        publish(spark, folder, **_month(stamp, SILVER_PARTITION))
    return [*runs, *written.values()]


def build_marts(facts: dict[str, DataFrame], missing_target: str = "zero") -> dict[str, DataFrame]:
    student = facts["fct_avaliacao_aluno"]
    return {
        "consolidado_municipio": mart_plans.area_targets(facts["fct_meta_municipio"], missing_target),
        "consolidado_uf": mart_plans.state_targets(facts["fct_meta_uf"], missing_target),
        "distribuicao_niveis": mart_plans.level_distribution(student),
        "estatisticas_escolares": mart_plans.school_statistics(student),
        "ml_aluno": mart_plans.student_features(student),
    }


# Marts with a row per student: written by the tasks that compute them, so that no row moves for the
# sake of files. Checking and writing scan the fact twice; staging, as for the aggregated marts, would
# write them twice instead.
ROW_LEVEL_MARTS = ("ml_aluno",)


def run_gold(
    spark: SparkSession, layout: Layout, stamp: RunStamp, missing_target: str = "zero"
) -> list[TableRun]:
    """Rebuild the marts from this month's facts: check all of them, write all, then let them replace the marts before at once.

    Readers (``read_table``) see the old marts until the last one is written.
    """
    month = _month(stamp, SILVER_PARTITION)
    with staging(spark), run_folder(spark, layout.gold) as folder:
        read = lambda n: read_partition(spark, f"{layout.silver}/{n}", **month)
        facts, failed = _attempt("silver", read, FACT_RULES)
        _stop_on(failed, "silver", FACT_RULES)
        plans = build_marts(facts, missing_target)

        def prepare(name: str) -> DataFrame | Staged:
            df = plans[name]
            return df if name in ROW_LEVEL_MARTS else stage(df, name, counters(df, MART_RULES[name]))

        marts, failed = _attempt("gold", prepare, plans)
        _stop_on(failed, "gold", plans)
        _check("gold", marts, MART_RULES)

        def write(name: str) -> TableRun:
            table = marts[name]
            df = table.df if isinstance(table, Staged) else table
            found = write_partitioned(
                df.withColumn(GOLD_TIME, stamp.timestamp()),
                f"{folder}/{name}",
                ("ano",),
                keep_others=False,
                gather=name not in ROW_LEVEL_MARTS,
            )
            return TableRun("gold", name, "written", found["rows"])

        written, failed = _attempt("gold", write, marts)
        _stop_on(failed, "gold", marts, list(written.values()))
        publish(spark, folder)
    return list(written.values())
