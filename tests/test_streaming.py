"""The stream gives what the batch gives, and running a batch again changes nothing."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from gazette.plans.ingest import ingest_batch
from gazette.sources import export, feeds, seeds
from gazette.streaming import ingest, rolling

NOW = datetime(2024, 1, 4)
WORDS = [("CN", "China"), ("US", "America")]
SCHEMA = (
    "news_id long, title string, content string, source_url string, source_name string, published_at timestamp, created_at timestamp, "
    "country_hint string, category_hint string, image_url string"
)


def raw(spark, ids):
    rows = []
    for i in ids:
        place = ("China", "America", "Nowhere")[i % 3]
        at = NOW - timedelta(minutes=37 * (200 - i))
        rows.append((i, f"Report {i} on {place}", "word " * 20 + place, f"http://x/{i % 80}", "CNN", at - timedelta(hours=(i % 5) * 13), at, None, None, "img"))
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({"images": F.array().cast(feeds.EMPTY_IMAGES), "videos": F.array().cast(feeds.EMPTY_VIDEOS)})


def test_micro_batches_equal_one_batch(spark, tmp_path):
    landed = str(tmp_path / "landed")
    for k in range(3):
        raw(spark, range(k * 40, k * 40 + 40)).coalesce(1).write.mode("append").parquet(landed)
    schema = spark.read.parquet(landed).schema
    cats = seeds.categories(spark)
    root = str(tmp_path / "stream")
    stream = ingest.landed_files(spark, schema, landed, files_per_batch=1)
    ingest.start_ingest(stream, root, root + "-p", WORDS, cats, F.col("created_at")).awaitTermination()
    whole, gated, kept = ingest_batch(raw(spark, range(120)), F.col("created_at"), WORDS, cats)
    for name in ("news", "news_countries", "news_categories", "media", "inverted_index", "index_build_logs"):
        got = export.read_committed(spark, root, name)
        cols = [c for c in whole[name].columns]
        assert sorted(map(repr, got.select(*cols).collect())) == sorted(map(repr, whole[name].select(*cols).collect())), name
    bad = export.read_committed(spark, root, "rejected").count()
    assert bad == gated.where("status_kind != 'ok'").count() > 0
    kept.unpersist()
    # nothing new has landed: the finished stream adds nothing
    ingest.start_ingest(stream, root, root + "-p", WORDS, cats, F.col("created_at")).awaitTermination()
    assert export.read_committed(spark, root, "news").count() == whole["news"].count()


def test_a_batch_run_again_replaces_itself(spark, tmp_path):
    root = str(tmp_path / "t")
    run = ingest.write_ingest(root, WORDS, seeds.categories(spark), F.col("created_at"))
    run(raw(spark, range(40)), 0)
    first = export.read_committed(spark, root, "news").count()
    run(raw(spark, range(40)), 0)
    assert export.read_committed(spark, root, "news").count() == first
    run(raw(spark, range(40)), 1)
    assert export.read_committed(spark, root, "news").count() == first


def test_stream_dedupe_across_files(spark, tmp_path):
    landed = str(tmp_path / "in")
    for k in range(2):
        rows = [(k * 10 + i, f"http://X/{i}" if k else f"http://x/{i}", NOW) for i in range(5)]
        spark.createDataFrame(rows, "news_id long, source_url string, created_at timestamp").coalesce(1).write.mode("append").parquet(landed)
    stream = ingest.landed_files(spark, spark.read.parquet(landed).schema, landed, files_per_batch=1)
    out = str(tmp_path / "out")
    rolling.run_to_table(ingest.stream_dedupe(stream), out, out + "-p")
    assert spark.read.parquet(out).count() == 5


def test_rolling_counts_exclude_the_edge(spark, tmp_path):
    landed, out = str(tmp_path / "in"), str(tmp_path / "out")
    edge = NOW - timedelta(hours=48)
    rows = [("US", edge), ("US", edge + timedelta(microseconds=1)), ("US", NOW), ("CN", NOW - timedelta(hours=1)), (None, NOW)]
    spark.createDataFrame(rows, "country_code string, created_at timestamp").write.parquet(landed)
    stream = ingest.landed_files(spark, spark.read.parquet(landed).schema, landed)
    rolling.run_updates(rolling.country_buckets(stream), out, out + "-p")
    buckets = rolling.latest_updates(spark, out, ["bucket_start", "country_code"])
    got = rolling.rolling_country_counts(buckets, F.lit(str(NOW)).cast("timestamp"))
    assert {r.country_code: r.news_count for r in got.collect()} == {"US": 2, "CN": 1}


def land(spark, path, batches, schema):
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return ingest.landed_files(spark, spark.read.parquet(path).schema, path, files_per_batch=1)


def test_buckets_are_freed_and_updated(spark, tmp_path):
    days = [[("US", NOW + timedelta(days=2 * k, minutes=m)) for m in range(1, 1400, 10)] for k in range(5)]
    days[1].append(("US", NOW + timedelta(hours=23, minutes=1)))  # one more for a bucket of the batch before
    stream = land(spark, str(tmp_path / "in"), days, "country_code string, created_at timestamp")
    out = str(tmp_path / "out")
    query = rolling.run_updates(rolling.country_buckets(stream), out, out + "-p")
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(held) < 5 * 47 and held[-1] < max(held)
    buckets = rolling.latest_updates(spark, out, ["bucket_start", "country_code"])
    assert buckets.agg(F.sum("news_count")).first()[0] == 5 * 140 + 1 and buckets.count() == 5 * 47


def test_late_rows_count_for_ever(spark, tmp_path):
    from gazette.operators.stats import source_stats

    batches = [[(1, NOW + timedelta(days=k, minutes=i)) for i in range(5)] + [(2, NOW)] for k in range(4)]
    batches[3] += [(1, NOW + timedelta(hours=12)), (3, NOW - timedelta(hours=60))]  # 60 hours late and more
    stream = land(spark, str(tmp_path / "in"), batches, "source_id int, created_at timestamp")
    out = str(tmp_path / "out")
    rolling.run_increments(stream, rolling.source_days, out, out + "-p")
    got = rolling.source_stats_on_read(spark.read.parquet(out)).collect()
    want = source_stats(spark.read.parquet(str(tmp_path / "in"))).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == 3


def test_late_rows_leave_a_stream_apart(spark, tmp_path):
    landed, root = str(tmp_path / "in"), str(tmp_path / "out")
    for k in range(3):
        raw(spark, range(k * 10, k * 10 + 10)).coalesce(1).write.mode("append").parquet(landed)
    stream = ingest.landed_files(spark, spark.read.parquet(landed).schema, landed, files_per_batch=1)
    ingest.start_split(stream, root, root + "-p", F.col("created_at")).awaitTermination()
    on_time, late = (export.read_committed(spark, root, name).count() for name in ("on_time", "late"))
    assert (on_time, late) == (24, 6)


def test_the_whole_job(spark, tmp_path):
    """Numbers, counters, totals, repair and retention over several batches; a batch run again changes nothing."""
    root = str(tmp_path / "t")
    run = ingest.write_ingest(root, WORDS, seeds.categories(spark), F.col("created_at"), number_by=["created_at", "source_url"], retain=True)
    for k in range(3):
        run(raw(spark, range(k * 40, k * 40 + 40)), k)
    run(raw(spark, range(80, 120)), 2)
    last = NOW - timedelta(minutes=37 * (200 - 119))
    news = export.read_committed(spark, root, "news")
    assert news.agg(F.min("created_at")).first()[0] >= last - timedelta(hours=48)
    ids = sorted(r.news_id for r in news.collect())
    assert ids and max(ids) <= 120 and len(set(ids)) == len(ids)
    for name in ("news_countries", "inverted_index", "media"):
        assert {r.news_id for r in export.read_committed(spark, root, name).select("news_id").distinct().collect()} <= set(ids)
    totals = export.read_committed(spark, root, "job_totals").where("source_id is null").agg(F.sum("fetched"), F.sum("saved")).first()
    stats = rolling.source_stats_on_read(export.read_committed(spark, root, "source_days")).agg(F.sum("total_news")).first()
    assert totals[0] == 120 and totals[1] == stats[0] > len(ids)
    # an article without a build log is indexed by the next repair
    assert not ingest.repair(spark, root, F.lit(last), "b9")
    extra = news.limit(1).drop("ingest_date", "batch_id").withColumns({"news_id": F.lit(999).cast("long"), "created_at": F.lit(last)})
    export.write_news_tables({"news": extra}, root, "b8")
    assert ingest.repair(spark, root, F.lit(last), "b8") and not ingest.repair(spark, root, F.lit(last), "b8")
    assert export.read_committed(spark, root, "inverted_index").where("news_id = 999").count() > 0


def test_late_rows_are_kept_apart(spark):
    df = raw(spark, range(30))
    on_time, late = ingest.split_late(df, F.col("created_at"))
    assert on_time.count() + late.count() == 30 and late.count() == 6


def test_streams_read_a_table_that_is_a_folder(spark, tmp_path):
    """A larger table is a folder of files, a small one is one file; streams over both give the same."""
    from gazette.checks import queries

    rows = [(i, f"Title {i}\nThe report on place {i}", "en", "web", 9) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    folder, file = tmp_path / "folder", tmp_path / "file"
    docs.repartition(3).write.parquet(str(folder / "documents.parquet"))
    docs.coalesce(1).write.parquet(str(tmp_path / "one"))
    file.mkdir()
    next((tmp_path / "one").glob("*.parquet")).rename(file / "documents.parquet")
    for name in ("late_reject", "stream_dedupe", "stream_source_stats"):
        got, want = (sorted(map(tuple, queries.queries()[name](spark, str(d)).collect())) for d in (folder, file))
        assert want and got == want


def test_ingest_keeps_nothing_in_memory(spark):
    """The frames of a batch are files that go with it, not blocks of the executors."""
    import os

    from gazette.session import StoredFrames

    before, files = set(spark.sparkContext._jsc.getPersistentRDDs()), StoredFrames(spark)
    tables, gated, _ = ingest_batch(raw(spark, range(120)), F.col("created_at"), WORDS, seeds.categories(spark), files=files)
    assert gated.count() > 0 and set(spark.sparkContext._jsc.getPersistentRDDs()) == before
    plan = tables["news"]._jdf.queryExecution().executedPlan().toString()
    assert "InMemoryTableScan" not in plan and "FileScan parquet" in plan
    paths = [p.removeprefix("file:") for p in files.paths]
    assert len(paths) == 2 and all(os.path.isdir(p) for p in paths)
    files.drop()
    assert not any(os.path.exists(p) for p in paths)
