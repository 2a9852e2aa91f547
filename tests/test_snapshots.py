"""Snapshot tables, ingest on top of them, and streams whose state and counters must be whole."""

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import reports
from corpusloom.operators.ingest import Library
from corpusloom.sources.snapshots import SnapshotTable
from corpusloom.streaming import jobs

SHAPE = "id long, v string"


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture()
def table(spark, tmp_path):
    return SnapshotTable(spark, f"file://{tmp_path}/t", "id", SHAPE, 4)


def test_replace_and_versions(spark, table):
    frame = lambda *r: spark.createDataFrame(r, SHAPE)
    assert rows(table.read()) == [] and table.pointer() is None
    assert table.replace(frame().select("id"), frame((1, "a"), (1, "b"), (2, "c"), (None, "n")), ("s", 0))
    assert table.replace(frame((1, ""), (3, "")).select("id"), frame((1, "z"), (4, "d")), ("s", 1))
    assert rows(table.read().dropna()) == [(1, "z"), (2, "c"), (4, "d")] and table.read().count() == 4
    assert rows(table.read(1).dropna()) == [(1, "a"), (1, "b"), (2, "c")]
    assert not table.replace(frame((2, "")).select("id"), frame((9, "x")), ("s", 1))  # a repeated batch
    assert not table.upsert(frame((9, "x")), "v", ("s", 0))
    assert rows(table.read().dropna()) == [(1, "z"), (2, "c"), (4, "d")]
    untouched = {f for b, f in table.pointer(2)["folders"].items() if table.pointer(1)["folders"].get(b) == f}
    assert table.upsert(frame((2, "a"), (4, "e")), "v") and rows(table.read().dropna()) == [(1, "z"), (2, "c"), (4, "e")]
    table.vacuum(1)
    assert rows(table.read().dropna()) == [(1, "z"), (2, "c"), (4, "e")] and table.pointer(1) is None
    assert untouched or table.buckets == 4


def test_a_failed_write_is_not_seen(spark, table, monkeypatch):
    table.replace(spark.createDataFrame([], SHAPE).select("id"), spark.createDataFrame([(1, "a")], SHAPE))
    with monkeypatch.context() as m:
        m.setattr(table, "_swap", lambda pointer: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            table.replace(spark.createDataFrame([(1, "")], SHAPE).select("id"), spark.createDataFrame([(2, "b")], SHAPE), ("s", 0))
    assert rows(table.read()) == [(1, "a")] and not table.written(("s", 0))
    assert table.replace(spark.createDataFrame([(1, "")], SHAPE).select("id"), spark.createDataFrame([(2, "b")], SHAPE), ("s", 0))
    assert rows(table.read()) == [(2, "b")] and len(table.vacuum(1)) >= 1


def test_two_writers_of_one_version(spark, table):
    table.replace(spark.createDataFrame([], SHAPE).select("id"), spark.createDataFrame([(1, "a")], SHAPE))
    with pytest.raises(RuntimeError, match="another writer"):
        table._swap(table.pointer())


FILES = "path string, content string, mtime long"


def test_modified_files_replace_their_chunks(spark, tmp_path):
    library = Library(spark, f"file://{tmp_path}/lib", 4)
    first = [("d/s/c/a.txt", "alpha text", 1), ("d/s/c/b.txt", "alpha text", 2), ("d/x.txt", "beta", 3), ("e.txt", "", 4)]
    report = {r["path"]: r for r in library.ingest(spark.createDataFrame(first, FILES)).collect()}
    assert {p: r["status"] for p, r in report.items()} == {"d/s/c/a.txt": "new_file", "d/s/c/b.txt": "duplicate_skipped", "d/x.txt": "new_file", "e.txt": "new_file"}
    assert (report["d/s/c/a.txt"]["department"], report["d/s/c/a.txt"]["semester"], report["d/s/c/a.txt"]["course"], report["d/x.txt"]["course"]) == ("d", "s", "c", "d")
    again = library.ingest(spark.createDataFrame(first, FILES)).select("status").distinct().collect()
    assert {r[0] for r in again} == {"unchanged", "duplicate_skipped"}
    second = library.ingest(spark.createDataFrame([("d/s/c/a.txt", "gamma", 9), ("d/n.txt", "beta", 9)], FILES), ("run", 7)).collect()
    assert {r["path"]: r["status"] for r in second} == {"d/s/c/a.txt": "modified", "d/n.txt": "duplicate_skipped"}
    held = lambda: {(r["path"], r["text"]) for r in library.chunks.read().collect()}
    assert held() == {("d/s/c/a.txt", "gamma"), ("d/x.txt", "beta")}
    version = library.chunks.pointer()["version"]
    library.ingest(spark.createDataFrame([("d/s/c/a.txt", "delta", 11)], FILES), ("run", 7))
    assert held() == {("d/s/c/a.txt", "gamma"), ("d/x.txt", "beta")} and library.chunks.pointer()["version"] == version
    assert library.ingest(spark.createDataFrame([], FILES)).count() == 0


def test_a_batch_that_fails_between_its_two_tables(spark, tmp_path, monkeypatch):
    library = Library(spark, f"file://{tmp_path}/lib", 2)
    scan = spark.createDataFrame([("a.txt", "one", 1), ("b.txt", "two", 1)], FILES)
    with monkeypatch.context() as m:
        m.setattr(library.manifest, "replace", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            library.ingest(scan, ("s", 0))
    assert library.manifest.pointer() is None
    assert {r["status"] for r in library.ingest(scan, ("s", 0)).collect()} == {"new_file"}
    assert library.chunks.pointer()["version"] == 1 and library.chunks.read().count() == 2 and library.manifest.read().count() == 2


def test_totals_beyond_a_hundred_batches(spark, tmp_path):
    spark.range(0, 240, 1, 120).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    counted = jobs.counted(stream, "progress", n=F.count("*"), odd=F.count_if(F.col("id") % 2 == 1))
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        heard = jobs.totals(counted, "progress", str(tmp_path / "cp"), lambda d, _: d.write.format("noop").mode("append").save())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert dict(heard.sums) == {"n": 240, "odd": 120} and len(heard.batches) >= 120


def test_limiter_state_goes_when_it_no_longer_counts(spark, tmp_path):
    """A second run, hours later: timers have cleared the first hours' state, and attempts are judged as by the fold."""
    at = lambda second: 1_704_067_200_000_000 + second * 1_000_000
    waves = [[(1, at(i)) for i in range(5)] + [(2, at(10))], [(1, at(36_000)), (3, at(36_001))], [(1, at(36_002)), (2, at(72_000))]]
    with jobs.keyed_state(spark):
        for k, wave in enumerate(waves):
            spark.createDataFrame(wave, "user_id long, at_us long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = spark.readStream.schema("user_id long, at_us long").parquet(str(tmp_path / "in"))
            out = []
            jobs.start(jobs.limited(stream, 60, 2), str(tmp_path / "cp"), each=lambda d, _: out.extend(map(tuple, d.collect()))).awaitTermination()  # noqa: B023
            want = [jobs.admitted([t for u, t in sum(waves[: k + 1], []) if u == user], 60, 2, [])[0] for user in (1, 2, 3)]
            for user in (1, 2, 3):
                mine = [ok for u, _, ok in sorted(out) if u == user]
                assert mine == want[user - 1][len(want[user - 1]) - len(mine) :], (k, user)
            assert len(out) == len(wave)


def test_alerts_fire_after_their_hold(spark):
    at = lambda m: f"2024-01-01 {m // 60:02d}:{m % 60:02d}:30"
    audit = [(at(m), 9000.0 if 10 <= m < 20 else 10.0, "INCORRECT" if m in (40, 41) else "CORRECT", "local") for m in range(60)]
    df = spark.createDataFrame(audit, "ts string, latency_ms double, crag_decision string, served_by string").withColumn("ts", F.col("ts").cast("timestamp"))
    got = sorted(reports.alerts(df).collect(), key=lambda r: r["minute"])
    first = got[0]["minute"]
    fires = lambda c: [r["minute"] - first for r in got if r[f"{c}_fires"]]
    slow = [r["minute"] - first for r in got if r["slow"]]
    assert slow == list(range(slow[0], slow[0] + len(slow))) and fires("slow") == slow[5:]
    failing = [r["minute"] - first for r in got if r["failing"]]
    assert failing == list(range(40, 46)) and fires("failing") == failing[2:]
    assert fires("cold") == list(range(30, len(got)))


def _bytes_of(path, act):
    """The bytes of the files that act leaves below path."""
    import glob
    import os

    before = {f: os.path.getsize(f) for f in glob.glob(f"{path}/**", recursive=True) if os.path.isfile(f)}
    act()
    return sum(os.path.getsize(f) for f in glob.glob(f"{path}/**", recursive=True) if os.path.isfile(f) and f not in before)


def test_an_ingest_run_writes_texts_twice(spark, tmp_path):
    """Contents are written as the scan and as the chunks of the library; steps between them hold hashes and numbers alone."""
    import random

    from corpusloom.sources.scratch import shared_folder

    draw = random.Random(3)
    files = [(f"d/{i}.txt", "\n\n".join("".join(draw.choices("abcdefghijklmnop rst", k=1200)) for _ in range(20)), i) for i in range(40)]
    library = Library(spark, f"file://{tmp_path}/lib", 2)
    scan = spark.createDataFrame(files, FILES)
    steps = shared_folder(spark).removeprefix("file://")
    size = _bytes_of(steps, lambda: scan.write.parquet(f"file://{steps}/plain-{tmp_path.name}"))
    assert _bytes_of(steps, lambda: library.ingest(scan, ("s", 0))) < 1.5 * size
    assert library.chunks.read().count() == 40 * 20


def test_equal_chunks_of_files_are_stored_once_and_by_the_first(spark, tmp_path):
    """Files whose chunks are partly known: indexes, hashes and texts of what is stored belong together."""
    import hashlib

    para = lambda c: c * 1400
    text = lambda s: "\n\n".join(para(c) for c in s)
    library = Library(spark, f"file://{tmp_path}/lib", 2)
    got = {r["path"]: (r["status"], r["chunks"], r["stored"]) for r in library.ingest(spark.createDataFrame([("a", text("xyx"), 5), ("b", text("yzx"), 1), ("c", None, 1), (None, "q", 1)], FILES)).collect() if r["path"]}
    assert got["a"] == ("new_file", 2, 0) and got["b"] == ("new_file", 3, 3)
    got = {r["path"]: (r["status"], r["chunks"], r["stored"]) for r in library.ingest(spark.createDataFrame([("b", text("wyz"), 9), ("d", text("ywvx"), 2)], FILES)).collect()}
    assert got["b"] == ("modified", 3, 1) and got["d"] == ("new_file", 4, 4)
    held = sorted((r["path"], r["chunk_index"], r["text"][0]) for r in library.chunks.read().collect() if r["path"])
    assert held == [("b", 2, "z"), ("d", 0, "y"), ("d", 1, "w"), ("d", 2, "v"), ("d", 3, "x")]
    assert all(hashlib.sha256(r["text"].encode()).hexdigest() == r["content_hash"] for r in library.chunks.read().collect())


def test_a_batch_that_holds_a_file_twice(spark, tmp_path):
    """The last of them counts, and rows of replaced keys go while new ones of the same keys stay."""
    library = Library(spark, f"file://{tmp_path}/lib", 2)
    for wave in ([("a", "one", 1), ("a", "two", 3), ("b", "three", 1)], [("a", "four", 7)]):
        spark.createDataFrame(wave, FILES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        library.follow(spark.readStream.schema(FILES).parquet(str(tmp_path / "in")), str(tmp_path / "cp")).awaitTermination()
    assert rows(library.chunks.read().select("path", "text")) == [("a", "four"), ("b", "three")]
