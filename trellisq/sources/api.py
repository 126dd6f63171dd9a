"""A JSON API as a Spark data source, with retries and an injectable transport."""

from __future__ import annotations

import importlib
import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Tries, seconds between them, and seconds that a call may take.
TRIES, WAIT_SECONDS, TIMEOUT_SECONDS = 3, 5, 20


class RateLimited(Exception):
    """The server asks to come back later."""


class ApiError(Exception):
    """The server refuses the request; asking again does not help."""


def http_get(url: str) -> str:
    with urllib.request.urlopen(url, timeout=TIMEOUT_SECONDS) as r:
        return r.read().decode()


def fetch(url: str, transport: Callable[[str], str] = http_get, tries: int = TRIES, wait: float = WAIT_SECONDS):
    """The ``result`` of the API's answer.

    A rate limit or a network error is tried again after a pause, up to
    ``tries`` calls; any other error of the API is raised at once.
    """
    for k in range(tries):
        try:
            answer = json.loads(transport(url))
            if answer.get("status") == "OK":
                return answer["result"]
            comment = str(answer.get("comment", ""))
            if "limit" not in comment.lower():
                raise ApiError(comment)
            problem: Exception = RateLimited(comment)
        except (OSError, urllib.error.URLError, ValueError) as e:
            problem = e
        if k + 1 < tries:
            time.sleep(wait)
    raise problem


class _Page(InputPartition):
    def __init__(self, url: str):
        self.url = url


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        """One task per URL."""
        return [_Page(u) for u in json.loads(self.options["urls"])]

    def read(self, partition: _Page) -> Iterator[tuple]:
        name = self.options.get("transport")
        transport = http_get
        if name:
            module, _, function = name.partition(":")
            transport = getattr(importlib.import_module(module), function)
        result = fetch(partition.url, transport, wait=float(self.options.get("wait", WAIT_SECONDS)))
        for row in result if isinstance(result, list) else [result]:
            yield (partition.url, json.dumps(row))


class JsonApi(DataSource):
    """``format("json_api")`` with options urls (a JSON list) and transport (module:function); rows are (url, body)."""

    @classmethod
    def name(cls) -> str:
        return "json_api"

    def schema(self) -> str:
        return "url string, body string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


PROBLEMS = (
    "struct<problems: array<struct<contestId: bigint, index: string, name: string, rating: int, tags: array<string>>>, "
    "problemStatistics: array<struct<contestId: bigint, index: string, solvedCount: bigint>>>")
SUBMISSION = "struct<id: bigint, creationTimeSeconds: bigint, verdict: string, problem: struct<contestId: bigint, index: string>>"


def catalogue_of(answers: DataFrame) -> DataFrame:
    """(contest_id, idx, name, rating, tags, solved_count) of catalogue answers (body); problems without statistics have 0."""
    r = answers.select(F.from_json("body", PROBLEMS).alias("r"))
    p = r.select(F.inline("r.problems")).withColumnsRenamed({"contestId": "contest_id", "index": "idx"})
    s = r.select(F.inline("r.problemStatistics")).groupBy(F.col("contestId").alias("contest_id"), F.col("index").alias("idx")).agg(
        F.max("solvedCount").alias("solved_count"))
    return p.join(s, ["contest_id", "idx"], "left").fillna(0, ["solved_count"])


def submissions_of(answers: DataFrame, user_id: str = "user_id") -> DataFrame:
    """(user, submission_id, contest_id, idx, ok, at) of submission answers (user, body)."""
    return answers.select(user_id, F.from_json("body", SUBMISSION).alias("r")).select(
        user_id, F.col("r.id").alias("submission_id"), F.col("r.problem.contestId").alias("contest_id"), F.col("r.problem.index").alias("idx"),
        F.col("r.verdict").eqNullSafe("OK").alias("ok"), F.timestamp_seconds("r.creationTimeSeconds").alias("at"))


def isolated(jobs: dict[str, Callable[[], None]]) -> dict[str, str]:
    """Runs every ingestion job; one that fails does not stop the others. Returns what happened to each."""
    done = {}
    for name, job in jobs.items():
        try:
            job()
            done[name] = "ok"
        except Exception as e:  # reported to the caller
            done[name] = f"{type(e).__name__}: {e}"
    return done


def register(spark: SparkSession) -> None:
    spark.dataSource.register(JsonApi)


def query_url(base: str, endpoint: str, **params) -> str:
    return f"{base}/{endpoint}?{urllib.parse.urlencode(sorted(params.items()))}"
