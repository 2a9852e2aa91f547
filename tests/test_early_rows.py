"""Streams of keyed state keep rows of 1970 and before, which are not later than Spark's first watermark."""

from corpusloom.streaming import jobs


def streamed(spark, rows, path, job, name):
    rows.coalesce(1).write.parquet(f"{path}/in")
    with jobs.keyed_state(spark):
        jobs.start(job(spark.readStream.schema(rows.schema).parquet(f"{path}/in")), f"{path}/cp", name=name).awaitTermination()
    return sorted(map(tuple, spark.table(name).collect()))


def test_limiter_keeps_early_attempts(spark, tmp_path):
    rows = spark.createDataFrame([(u, (i - 5) * 7_000_000) for u in range(3) for i in range(20)], "user_id long, at_us long")
    got = streamed(spark, rows, tmp_path, lambda x: jobs.limited(x, 60, 4), "early_limited")
    assert got == sorted(map(tuple, jobs.limited_batch(rows, 60, 4).collect())) and len(got) == 60


def test_repeats_of_early_questions(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", -500), (2, "a", -100), (3, "a", 0), (4, "a", 30), (5, "b", 0), (6, "b", 7200)], "message_id long, key string, asked_s long")
    assert streamed(spark, rows, tmp_path, lambda x: jobs.repeated(x, 3600), "early_repeats") == [(2, 400), (3, 100), (4, 30)]


def test_early_questions_of_a_later_batch(spark, tmp_path):
    """What is kept of a key is its last question, also if that is before 1970."""
    waves = [[(1, "a", -500)], [(2, "a", -100)]]
    out = []
    for wave in waves:
        spark.createDataFrame(wave, "message_id long, key string, asked_s long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("message_id long, key string, asked_s long").parquet(str(tmp_path / "in"))
        with jobs.keyed_state(spark):
            jobs.start(jobs.repeated(stream, 3600), str(tmp_path / "cp"), each=lambda d, _: out.extend(map(tuple, d.collect()))).awaitTermination()
    assert out == [(2, 400)]
