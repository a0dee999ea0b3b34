import os
from datetime import datetime, timezone

import pytest
from conftest import rows

from layerwright import plans
from layerwright.operators import RunStamp
from layerwright.sources import read_landing, read_partition, read_text, shared_folder
from layerwright.sources import stage as stage_table
from layerwright.spec import Entity, Field, ruleset
from layerwright.streaming import compact_month, ingest_new_files, land_increment, read_ledger

THING = Entity(
    "things",
    ("id",),
    (Field("id", "int"), Field("name", "string")),
    ruleset(required=("id",)),
)
JULY = RunStamp(datetime(2026, 7, 1, tzinfo=timezone.utc))
AUGUST = RunStamp(datetime(2026, 8, 1, tzinfo=timezone.utc))


def sources_stage(df):
    return stage_table(df.selectExpr("CAST(id AS INT) AS id", "name"), "raw")


class Folders:
    def __init__(self, root):
        self.landing, self.target, self.progress = (f"{root}/{d}" for d in ("landing", "bronze", "progress"))
        os.makedirs(self.landing)

    def land(self, name, *lines):
        with open(f"{self.landing}/{name}.csv", "w") as out:
            out.write("\n".join(("id,name", *lines)) + "\n")

    def take_in(self, spark, stamp=JULY, **options):
        ingest_new_files(
            spark, self.landing, self.target, self.progress, THING, lambda: stamp, **options
        ).awaitTermination()

    def stored(self, spark):
        return spark.read.parquet(self.target)


@pytest.fixture
def folders(tmp_path):
    return Folders(tmp_path)


def test_stream_equals_batch(spark, folders):
    folders.land("a", "1,x", "2,")
    folders.land("b", "3,z")
    folders.take_in(spark, max_files=1)
    folders.land("c", "04,w", '5,"q,r"')
    folders.take_in(spark, AUGUST)
    folders.take_in(spark, AUGUST)
    batch = read_landing(spark, folders.landing, THING.raw_types)
    assert rows(folders.stored(spark).select("id", "name")) == rows(batch)
    by_batch = rows(folders.stored(spark).groupBy("_batch", "_ing_mes").count())
    assert [r[:2] for r in by_batch] == [("stream-0", 7), ("stream-1", 7), ("stream-2", 8)]
    assert sorted(r[2] for r in by_batch) == [1, 2, 2]
    files = {r["_source_file"].rsplit("/", 1)[1] for r in folders.stored(spark).collect()}
    assert files == {"a.csv", "b.csv", "c.csv"}


def test_failed_rule_keeps_the_batch_for_later(spark, folders):
    folders.land("a", "1,x")
    folders.take_in(spark)
    folders.land("b", "bad,y", "2,z")
    with pytest.raises(Exception, match="not_null"):
        folders.take_in(spark)
    assert rows(folders.stored(spark).select("id")) == [(1,)]
    folders.land("b", "2,y", "3,z")
    folders.take_in(spark)
    assert rows(folders.stored(spark).select("id")) == [(1,), (2,), (3,)]


def test_batch_that_comes_again_adds_nothing(spark, folders):
    folders.land("a", "1,x", "2,y")
    raw = read_text(spark, folders.landing)
    for stamp in (JULY, AUGUST):
        land_increment(THING, folders.target, lambda: stamp)(raw, 0)
    assert rows(folders.stored(spark).select("id", "_ing_mes", "_batch")) == [(1, 8, "stream-0"), (2, 8, "stream-0")]
    root = shared_folder(spark)
    assert not [d for d in (os.listdir(root) if os.path.isdir(root) else []) if d.startswith("run-")]


def test_text_that_does_not_fit_is_kept_on_request(spark, folders):
    folders.land("a", "x,1")
    with pytest.raises(Exception, match="parsed"):
        folders.take_in(spark)
    lenient = Entity(THING.name, THING.key, THING.fields)
    query = ingest_new_files(
        spark, folders.landing, folders.target, folders.progress + "2", lenient, lambda: JULY, unparsed="report"
    )
    query.awaitTermination()
    assert folders.stored(spark).first()["_unparsed"] == {"id": "x"}


KEYED = Entity("things", ("id",), THING.fields, ruleset(required=("name",), unique=("id",)))


def test_a_key_that_comes_again_fails_its_batch(spark, folders, monkeypatch):
    take_in = lambda stamp, **options: ingest_new_files(
        spark, folders.landing, folders.target, folders.progress, KEYED, lambda: stamp, **options
    ).awaitTermination()
    folders.land("a", "1,x", "2,y", ",none")
    take_in(JULY)
    folders.land("b", "3,z", "4,w", ",none")
    take_in(AUGUST)
    folders.land("c", "5,v", "2,again", "4,again", ",none")
    with pytest.raises(Exception, match=r"unique\(id\) measured 2"):
        take_in(AUGUST)
    assert rows(folders.stored(spark).where("id IS NOT NULL").select("id")) == [(1,), (2,), (3,), (4,)]
    assert compact_month(spark, folders.target, AUGUST) == 1
    monkeypatch.setattr("layerwright.streaming.seen.broadcast_limit", lambda s: 0)
    with pytest.raises(Exception, match=r"unique\(id\) measured 2"):
        take_in(AUGUST)
    with pytest.raises(ValueError):
        land_increment(KEYED, folders.target, lambda: JULY, unique_over="month")
    take_in(AUGUST, unique_over="batch")
    assert folders.stored(spark).count() == 10


def test_keys_are_read_only_where_a_hash_was_seen(spark, folders, monkeypatch):
    """A batch that comes again does not meet itself, and without a hit the table is not read."""
    import layerwright.streaming.seen as seen

    folders.land("a", "1,x", "2,y")
    raw = read_text(spark, folders.landing)
    land = land_increment(KEYED, folders.target, lambda: JULY)
    land(raw, 0)
    monkeypatch.setattr(seen, "BRONZE_PARTITION", seen.BRONZE_PARTITION)
    land(raw, 0)
    assert folders.stored(spark).count() == 2
    with pytest.raises(Exception, match="measured 2"):
        land(raw, 1)
    # Another text under an equal hash is no key that came before.
    monkeypatch.setattr(seen.F, "xxhash64", lambda *c: seen.F.lit(7).cast("bigint"))
    other = spark.createDataFrame([("3", "z", "file")], "id string, name string, _source_file string")
    seen.remember(sources_stage(raw), folders.target, ["id"], "stream-0", (2026, 7))
    land(other, 2)
    assert rows(folders.stored(spark).select("id")) == [(1,), (2,), (3,)]


def test_ragged_lines_fail_a_batch_or_stay_as_lines(spark, folders):
    folders.land("a", "1,x", "2", "3,y,z", "4,w")
    with pytest.raises(Exception, match="width"):
        folders.take_in(spark)
    assert not os.path.exists(folders.target)
    folders.take_in(spark, ragged="report")
    stored = folders.stored(spark)
    assert rows(stored.select("id", "_ragged")) == [(1, None), (4, None), (None, "2"), (None, "3,y,z")]


def test_a_run_and_a_stream_share_a_bronze_table(spark, folders, tmp_path):
    folders.target = f"{tmp_path}/bronze/things"
    folders.land("a", "1,x")
    folders.take_in(spark)
    os.makedirs(f"{tmp_path}/runs/things")
    with open(f"{tmp_path}/runs/things/b.csv", "w") as out:
        out.write("id,name\n2,y\n")
    layout = plans.Layout(f"{tmp_path}/runs", f"{tmp_path}/bronze", "", "")
    for _ in range(2):
        plans.run_bronze(spark, layout, JULY, {"things": THING})
    july = read_partition(spark, folders.target, _ing_ano=2026, _ing_mes=7)
    assert rows(july.select("id", "_batch")) == [(1, "stream-0"), (2, "run")]
    hashes = rows(july.select("_record_hash"))
    assert compact_month(spark, folders.target, JULY) == 2
    assert compact_month(spark, folders.target, JULY) == 1
    compacted = read_partition(spark, folders.target, _ing_ano=2026, _ing_mes=7)
    assert rows(compacted.select("id", "_batch")) == [(1, "compacted"), (2, "compacted")]
    assert rows(compacted.select("_record_hash")) == hashes
    with pytest.raises(Exception, match="no rows"):
        compact_month(spark, folders.target, AUGUST)


def test_compaction_that_broke_off_is_finished(spark, folders, monkeypatch):
    folders.land("a", "1,x")
    folders.take_in(spark)
    folders.land("b", "2,y")
    folders.take_in(spark)
    import layerwright.streaming.increment as increment

    class Broken(Exception):
        pass

    real = increment.file_system

    class Files:
        def __init__(self, files):
            self.files = files

        def __getattr__(self, name):
            return getattr(self.files, name)

        def delete(self, path, deep):
            self.files.delete(path, deep)
            raise Broken

    monkeypatch.setattr(increment, "file_system", lambda s, p: (real(s, p)[0], Files(real(s, p)[1])))
    with pytest.raises(Broken):
        compact_month(spark, folders.target, JULY)
    monkeypatch.setattr(increment, "file_system", real)
    compact_month(spark, folders.target, JULY)
    assert rows(folders.stored(spark).select("id", "_batch")) == [(1, "compacted"), (2, "compacted")]


def judged(spark, folders):
    base = lambda path: path and path.rsplit("/", 1)[1].removesuffix(".csv")
    return sorted((base(r["file"]), r["rows"], base(r["same_as"]), r["_batch"]) for r in read_ledger(spark, folders.target).collect())


def test_a_file_under_another_name_is_refused(spark, folders):
    assert read_ledger(spark, folders.target).count() == 0
    folders.land("a", "1,x", "2,")
    folders.land("b", "2,", "1,x")
    folders.land("c", "1,x", "2,", "2,")
    folders.take_in(spark)
    first = [("a", 2, None, "stream-0"), ("b", 2, "a", "stream-0"), ("c", 3, None, "stream-0")]
    assert judged(spark, folders) == first
    assert rows(folders.stored(spark).select("id")) == [(1,), (1,), (2,), (2,), (2,)]
    folders.land("d", "2,", "1,x")
    folders.take_in(spark)  # nothing is left of this batch
    folders.land("e", "1,x", "2,", "2,")
    folders.land("f", "1,y", "2,")
    folders.take_in(spark, AUGUST)
    later = [("d", 2, "a", "stream-1"), ("e", 3, "c", "stream-2"), ("f", 2, None, "stream-2")]
    assert judged(spark, folders) == first + later
    assert rows(folders.stored(spark).groupBy("_batch").count()) == [("stream-0", 5), ("stream-2", 2)]
    assert "_row_digest" not in folders.stored(spark).columns
    folders.land("g", "1,y", "2,")
    folders.take_in(spark, AUGUST, copies="take")
    assert folders.stored(spark).count() == 9
    with pytest.raises(ValueError):
        folders.take_in(spark, copies="drop")


def test_refused_files_do_not_fail_unique_rules_and_nulls_tell_files_apart(spark, folders, no_broadcast):
    options = {"clock": lambda: JULY, "null_safe_hash": False}
    take_in = lambda entity: ingest_new_files(spark, folders.landing, folders.target, folders.progress, entity, **options).awaitTermination()
    folders.land("a", "1,x", "2,y")
    take_in(KEYED)
    folders.land("b", "2,y", "1,x")
    folders.land("c", "3,z")
    take_in(KEYED)
    assert rows(folders.stored(spark).select("id", "_batch")) == [(1, "stream-0"), (2, "stream-0"), (3, "stream-1")]
    folders.land("d", "9,")
    folders.land("e", ",9")  # the same text once NULLs are skipped
    take_in(Entity(THING.name, THING.key, THING.fields))
    assert rows(folders.stored(spark).where("_batch = 'stream-2'").select("id", "name")) == [(9, None), (None, "9")]


def test_a_batch_that_failed_leaves_no_files_and_may_come_again(spark, folders):
    folders.land("a", "bad,y")
    with pytest.raises(Exception, match="not_null"):
        folders.take_in(spark)
    assert read_ledger(spark, folders.target).count() == 0
    folders.land("a", "1,y")
    folders.take_in(spark)
    raw = read_text(spark, folders.landing)
    land_increment(THING, folders.target, lambda: AUGUST)(raw, 0)
    assert judged(spark, folders) == [("a", 1, None, "stream-0")]
    assert rows(folders.stored(spark).select("id", "_ing_mes")) == [(1, 8)]
