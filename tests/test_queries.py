"""Every query with SQL agrees with DuckDB; tiers, paging and exports keep their promises."""

import csv
import glob
import math

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidemark import queries
from tidemark.operators import index, records
from tidemark.plans import tiers

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(rows):
    def one(x):
        if x is None or isinstance(x, float) and math.isnan(x):
            return None
        return round(x, 9) if isinstance(x, float) else x

    return sorted((tuple(map(one, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_sql(spark, sf, duck, name):
    got = entry.queries()[name](spark, sf)
    want = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert plain(got.select(*names).collect()) == plain(want.fetchall())


def test_entry(spark):
    rows = entry.entry(spark)
    assert rows.count() == 50 * rows.select("run_id").distinct().count() > 0


@pytest.fixture(scope="module")
def rows(spark, sf):
    return queries.recording(spark, sf).cache()


def test_tier_choice_and_containment(rows):
    stats = index.frame_stats(rows, F.col("value"))
    args = (rows, stats, queries.START, queries.END)
    wide = tiers.envelope(*args, points=30, most_frames=0).collect()
    exact = tiers.envelope(*args, points=30, most_frames=10**6).collect()
    assert {r.tier for r in wide} == {"stats"} and {r.tier for r in exact} == {"exact"}
    bounds = {(r.run_id, r.x): r for r in wide}
    for r in exact:
        if r.n and not r.exact:
            w = bounds[r.run_id, r.x]
            assert w.min <= r.min and w.max >= r.max
    assert all(r.exact for r in tiers.envelope(*args, points=5000, run=7, most_frames=10**6).collect())


def test_errors(rows):
    for f, kind in ((tiers.envelope, "categorical"), (tiers.states, "numeric"), (tiers.events, "blob")):
        with pytest.raises(records.QueryError):
            f(rows, None, 0, 1, kind=kind)
    assert records.window(None, 5, 1, 9) == (1, 5) and records.window(7, 2, 1, 9) == (2, 7)


def test_states_and_events_by_tier(rows):
    stats = index.frame_stats(rows, F.col("state"))
    exact = tiers.states(rows, stats, queries.START, queries.END, run=7, most_frames=10**6).collect()
    assert all(a.raw != b.raw for a, b in zip(exact, exact[1:])) and exact[-1].x1 == queries.END
    assert {r.tier for r in tiers.states(rows, stats, queries.START, queries.END, points=2, most_frames=10**6).collect()} == {"exact"}
    assert {r.tier for r in tiers.states(rows, stats, queries.START, queries.END, most_frames=0).collect()} == {"stats"}
    text = index.frame_stats(rows, F.col("text"), bounds=False)
    assert tiers.events(rows, text, queries.START, queries.END, run=7)[1] == "exact"
    density, tier = tiers.events(rows, text, queries.START, queries.END, most_frames=0)
    assert tier == "stats" and density.count() > 0


@pytest.mark.parametrize("offset", [0, 1, 57, 300, 10**6])
def test_pages_agree_with_a_scan(rows, offset):
    frames = index.frame_index(rows)
    scan = rows.where(F.col("axis").between(queries.START, queries.END)).orderBy("segment", "run_id", "frame", "axis", "seq").collect()
    page = records.record_page(rows, frames, queries.START, queries.END, offset, 50).collect()
    assert [r.seq for r in page] == [r.seq for r in scan[offset : offset + 50]]


def test_export(rows, tmp_path):
    frames, path = index.frame_index(rows), str(tmp_path / "csv")
    records.export_csv(rows, frames, path, queries.START, queries.END, ["value", "amount"], {"value": "V"})
    lines = [r for f in glob.glob(f"{path}/*.csv") for r in csv.DictReader(open(f))]
    assert len(lines) == rows.where(F.col("axis").between(queries.START, queries.END)).count() and set(lines[0]) == {"axis", "run", "value [V]", "amount"} and any(r["amount"] == "" for r in lines)
    with pytest.raises(records.QueryError):
        records.export_csv(rows, frames, path, queries.START, queries.END, ["nothing"])
    with pytest.raises(records.QueryError):
        records.export_csv(rows, frames, path, queries.START, queries.END, ["value"], most=3)


def test_labels_and_classes(spark):
    assert spark.sql("SELECT map('b', '2', 'a', '1') AS m").select(records.run_label(F.col("m"))).first()[0] == "a=1 b=2"
    assert [records.field_class(*x) for x in (("string",), ("complex",), ("bool",), ("uint", "value_to_text"), ("float",))] == ["event", "blob", "categorical", "categorical", "numeric"]


def test_states_by_frame_are_those_of_whole_runs(spark):
    from tidemark.operators import decimate

    rows = spark.createDataFrame([(r, i // 3, i, i, v) for r in (1, 2) for i, v in enumerate(["a", "a", None, None, "b", "b", "b", "b", "b", "a", None, "a", "a"])], "run_id int, frame int, axis long, seq long, state string")
    whole, framed = (decimate.states(rows, ["run_id"], 1, 12, "state", f).orderBy("run_id", "run_no").collect() for f in (None, "frame"))
    assert whole == framed and [r.raw for r in whole if r.run_id == 1] == ["a", None, "b", "a", None, "a"]


def test_one_run_is_that_of_the_whole_table(spark, sf):
    """The option that names a run, on the rows of all runs."""
    rows, index_ = queries.recording(spark, sf), index.frame_index(queries.recording(spark, sf))
    run = rows.groupBy("run_id").count().orderBy(F.desc("count"), "run_id").first().run_id
    own = index.overlapping(index_, queries.START, queries.END, run).collect()
    assert own and plain(own) == plain(entry.queries()["run_frames"](spark, sf).where(F.col("run_id") == run).collect())


@pytest.mark.parametrize("offset", [0, 57, 300, 10**6])
def test_what_goes_with_a_page(rows, offset):
    frames = index.frame_index(rows)
    own = rows.where(F.col("axis").between(queries.START, queries.END))
    n = own.count()
    info = records.page_info(rows, frames, queries.START, queries.END, offset, 50)
    assert info.more == (offset + 50 < n) and info.total >= n and (info.total == n or not info.total_exact)
    assert 0 <= info.decoded <= index.overlapping(frames, queries.START, queries.END).count()
    all_of = records.page_info(rows, frames, -1, 10**15, 0, 50)
    assert all_of.total == rows.count() and all_of.total_exact and all_of.decoded < frames.count()
    run = rows.first().run_id
    one = records.page_info(rows, frames, -1, 10**15, 0, 5000, run)
    assert (one.total, one.more) == (rows.where(F.col("run_id") == run).count(), False)


def test_damaged_container_has_few_segments_where_each_task_reads_all_runs(spark, tmp_path, monkeypatch):
    from tidemark.sources import container

    spark.range(0, 4000, 1, 8).selectExpr("id AS event_id", "timestamp_seconds(id) AS ts", "id % 100 AS user_id", "'view' AS event_type", "CAST(id AS DOUBLE) AS value", "'' AS props").write.parquet(f"{tmp_path}/events.parquet")
    seen, write = [], container.write_values
    monkeypatch.setattr(container, "write_values", lambda rows, *a, **k: (seen.append(rows), write(rows, *a, **k)))
    got = queries.QUERIES["container_damaged"](spark, str(tmp_path)).collect()
    assert sorted((r.run_id, r.records, r.total) for r in got) == [(u, 40, float(sum(range(u, 4000, 100)))) for u in range(1, 100)]
    dealt = seen[0].select("run_id", F.spark_partition_id().alias("task")).distinct()
    assert dealt.count() <= 100 + dealt.select("task").distinct().count()
