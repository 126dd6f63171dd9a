"""Files, the JSON API source, requests, resumable generation and ingestion."""

import json

from pyspark.sql import functions as F

from trellisq.operators import knowledge as K
from trellisq.operators import requests as Q
from trellisq.sources import api, files
from trellisq.sources.tables import register_views
from trellisq.streaming import jobs as J

DIR = "/root/testdata/sf0.001"


def fake(url: str) -> str:
    """Stands for the network on the executors."""
    if "broken" in url:
        return json.dumps({"status": "FAILED", "comment": "handle not found"})
    if "problems" in url:
        return json.dumps({"status": "OK", "result": {
            "problems": [{"contestId": 1, "index": "A", "name": "x", "rating": 800, "tags": ["dp"]}, {"contestId": 1, "index": "B", "name": "y", "tags": []}],
            "problemStatistics": [{"contestId": 1, "index": "A", "solvedCount": 5}]}})
    return json.dumps({"status": "OK", "result": [
        {"id": k, "creationTimeSeconds": 1000 + k, "verdict": "OK" if k else "WRONG_ANSWER", "problem": {"contestId": 1, "index": "A"}} for k in range(3)]})


def answers(spark, *urls):
    spark.sparkContext.addPyFile(__file__)
    api.register(spark)
    return spark.read.format("json_api").options(urls=json.dumps(urls), transport="test_sources:fake", wait="0").load()


def test_catalogue_refresh_and_submissions_from_the_api(spark):
    got = {(r.contest_id, r.idx): (r.rating, r.tags, r.solved_count) for r in api.catalogue_of(answers(spark, "api/problems")).collect()}
    assert got == {(1, "A"): (800, ["dp"], 5), (1, "B"): (None, [], 0)}
    subs = api.submissions_of(answers(spark, "api/status?u=1", "api/status?u=2").withColumn("user_id", F.substring("url", -1, 1))).collect()
    assert len(subs) == 6 and sum(r.ok for r in subs) == 4 and {r.user_id for r in subs} == {"1", "2"}


def test_one_failing_ingestion_does_not_stop_the_others(spark):
    seen = []
    done = api.isolated({"bad": lambda: answers(spark, "api/broken").collect(), "good": lambda: seen.append(answers(spark, "api/problems").count())})
    assert done["good"] == "ok" and done["bad"] != "ok" and seen == [1]


def test_loads_and_saves(spark, tmp_path):
    path, calls = str(tmp_path / "c"), []

    def fetch():
        calls.append(1)
        return spark.range(3)

    assert files.load_or_fetch(spark, path, fetch).count() == files.load_or_fetch(spark, path, fetch).count() == 3 and calls == [1]
    assert files.load_or_empty(spark, str(tmp_path / "none"), "id bigint").count() == 0
    files.save(spark.range(2), path)
    assert spark.read.parquet(path).count() == 2
    by = str(tmp_path / "by")
    files.save_by(spark.createDataFrame([("a", 1), ("b", 2)], "u string, n int"), by, "u")
    files.save_by(spark.createDataFrame([("b", 3)], "u string, n int"), by, "u")
    assert {(r.u, r.n) for r in spark.read.parquet(by).collect()} == {("a", 1), ("b", 3)}
    (tmp_path / "one.json").write_text(json.dumps([{"id": 1}, {"id": 2}]))
    assert files.load_json(spark, str(tmp_path / "one.json"), "id bigint").count() == 2
    log = str(tmp_path / "log")
    for _ in range(2):
        files.append_log(spark.createDataFrame([("done",)], "line string"), log)
    assert spark.read.text(log).count() == 2
    solved = spark.createDataFrame([("u", 3), ("u", 1), ("u", 3)], "username string, task_id bigint")
    r = files.solved_cache(solved, F.lit("now")).first()
    assert (r.solved_ids, r.solved_count) == ([1, 3], 2)
    names = spark.createDataFrame([("a/b c.ü-1",)], "n string").select(files.safe_name(F.col("n"))).first()[0]
    assert names == "a_b_c.ü-1"


def test_views(spark):
    assert "v_users" in register_views(spark, DIR, "v_")
    assert spark.sql("SELECT count(*) FROM v_users").first()[0] > 0


def test_requests_and_eta(spark):
    df = spark.createDataFrame([(1, {"handle": "h"}), (2, {"count": "x", "tags": "a, b", "min_rating": "", "max_rating": "9", "platform": "p"}), (3, None)],
                               "request_id int, params map<string,string>")
    got = {r.request_id: r for r in Q.parsed(df).collect()}
    assert (got[1].count if False else got[1]["count"], got[1]["mode"], got[1].tag_filter) == (8, "balanced", None)
    assert (got[2]["count"], got[2].tag_filter, got[2].min_rating, got[2].max_rating, got[2].platform_filter) == (None, ["a", "b"], None, 9, "p")
    assert got[3]["count"] == 8 and got[3].handle is None
    eta = Q.remaining_minutes(spark.createDataFrame([(1, 60.0), (2, 60.0)], "step int, elapsed double"), 4).collect()
    assert {r.step: r.eta for r in eta} == {1: 3.0, 2: 1.0}
    e = Q.envelope(spark.createDataFrame([("b", 1), ("a", 2)], "k string, n int"), [F.col("k")]).first()
    assert (e.success, e["count"], json.loads(e.data)) == (True, 2, [{"k": "a", "n": 2}, {"k": "b", "n": 1}])


def test_generation_goes_on_where_it_stopped_and_retries_what_failed(spark, tmp_path):
    path = str(tmp_path / "kb")
    wanted = spark.createDataFrame([(f"s{k}",) for k in range(10)], "slug string")
    made = []

    def make(part, bad=("s3",)):
        slugs = [r.slug for r in part.collect()]
        made.append(slugs)
        if len(made) == 2 and bad:
            raise KeyboardInterrupt
        rows = [(s, K.SENTINEL if s in bad else "text", "int f();") for s in slugs]
        return spark.createDataFrame(rows, "slug string, description string, cpp string")

    try:
        K.resumable(wanted, path, make, steps=4)
    except KeyboardInterrupt:
        pass
    first = set(made[0])
    assert {r.slug for r in spark.read.parquet(path).collect()} == first
    done = {r.slug: r.description for r in K.resumable(wanted, path, make, steps=4).collect()}
    assert len(done) == 10 and done["s3"] == K.SENTINEL and not first & set(sum(made[2:], []))
    made.clear()
    again = {r.slug: r.description for r in K.resumable(wanted, path, lambda p: make(p, ()), steps=4, again=True).collect()}
    assert again["s3"] == "text" and sum(made, []) == ["s3"]


def test_answers_that_are_no_json_are_tried_again(spark):
    assert K.json_object('<think>{"a": 0}</think> ok {"a": "\\(x\\)"} end') == {"a": "\\(x\\)"}
    assert K.json_object("none") is None and K.json_object(None) is None
    topics = spark.createDataFrame([("s", "T", "C", None)], "slug string, title string, category string, tags array<string>")
    r = K.generate_entries(topics, lambda p: "no", lambda p: '{"cpp": "x", "cpp_notes": ["n"]}', tries=2, wait=0).first()
    assert (r.description, r.cpp, r.cpp_notes, r.variants, r.proof) == (K.SENTINEL, "x", ["n"], [], "")


def test_stream_merges_late_and_repeated_rows_over_batches(spark, tmp_path):
    schema = "submission_id bigint, user_id bigint, contest_id bigint, idx string, verdict string, submitted_at timestamp"
    path = tmp_path / "submissions.parquet"
    rows = [(1, 7, 1, "a ", "OK", "2024-03-01 10:00:00"), (2, 7, 1, "A", "OK", "2024-05-01 10:00:00"), (3, 7, 1, "B", None, "2024-05-01 11:00:00")]
    to_frame = lambda x: spark.createDataFrame(x, schema.replace("timestamp", "string")).withColumn("submitted_at", F.to_timestamp("submitted_at"))
    for part in (rows[1:], rows[:1], rows[2:]):
        to_frame(part).coalesce(1).write.mode("append").parquet(str(path))
    stream = J.submission_stream(spark, str(tmp_path))
    assert {(str(r.date), r.attempted, r.solved) for r in J.daily_activity(stream).collect()} == {("2024-03-01", 1, 1), ("2024-05-01", 2, 1)}
    assert [str(r.date) for r in J.first_seen(stream).collect()] == ["2024-03-01"]
