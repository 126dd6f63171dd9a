"""The topic knowledge base: index, lookup, search, statistics, upserts, prompts and generation."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trellisq.functions.ladders import escaped
from trellisq.functions.normalize import slug_key
from trellisq.sources.files import load_or_empty
from trellisq.sources.tables import latest_by

# Fixed value: what the generator stores where it failed.
SENTINEL = "GENERATION_FAILED"
# The fields that are searched after title, category and tags, in this order.
SEARCHED = (
    "description", "explanation", "key_insight", "worked_example", "when_to_use", "variants", "pitfalls", "prereqs",
    "leads_to", "cpp_notes", "walkthrough", "proof",
)


# How the searched fields are named to the user.
FIELD_LABELS = {
    "description": "description", "explanation": "explanation", "key_insight": "key insight", "worked_example": "example",
    "when_to_use": "when to use", "variants": "variants", "pitfalls": "pitfalls", "prereqs": "prerequisites",
    "leads_to": "advanced topics", "cpp_notes": "notes", "walkthrough": "walkthrough", "proof": "proof",
}
# The fields that each of the two models writes; those in the second list of each are lists.
MATH_FIELDS = (("description", "explanation", "proof", "worked_example", "time_complexity", "space_complexity", "when_to_use", "key_insight"),
               ("variants", "pitfalls"))
CODE_FIELDS = (("cpp", "walkthrough", "dry_run", "template_type", "complexity_note", "usage_example"), ("cpp_notes",))


def topic_index(topics: DataFrame) -> DataFrame:
    """(category, n, slugs): the slugs of a category in the order of entry, joined."""
    rows = F.array_sort(F.collect_list(F.struct("entry_id", "slug")))
    return topics.groupBy(F.coalesce("category", F.lit("Uncategorized")).alias("category")).agg(
        F.count(F.lit(1)).alias("n"), F.array_join(F.transform(rows, lambda r: r["slug"]), ",").alias("slugs"))


def topic_list(topics: DataFrame) -> DataFrame:
    """(category, entry_id, id, slug, title, tags): the topics of the index; entry_id is their order in a category."""
    tags = F.array_join(F.coalesce("tags", F.array().cast("array<string>")), ",")
    return topics.select(F.coalesce("category", F.lit("Uncategorized")).alias("category"), "entry_id", "id", "slug", "title", tags.alias("tags"))


def lookup(topics: DataFrame, slug: str, hints: int = 5) -> DataFrame:
    """The topic of that slug alone; on a miss up to ``hints`` topics whose slug holds it, in the order of entry."""
    s = slug.strip().lower()
    hit = topics.where(F.col("slug") == s).select("entry_id", "slug", "title", F.lit(True).alias("exact"))
    if hit.limit(1).count():
        return hit
    return topics.where(F.col("slug").contains(s)).select("entry_id", "slug", "title", F.lit(False).alias("exact")).orderBy("entry_id").limit(hints)


def from_id(topics: DataFrame, least: int) -> DataFrame:
    """The topics to process: ids from ``least`` on."""
    return topics.where(F.col("id") >= least).select("id", "slug", "title")


def available_categories(topics: DataFrame, category: str) -> DataFrame:
    """(category): what there is instead, if no topic has that category."""
    missed = topics.where(F.lower("category") == category.lower()).limit(1).count() == 0
    return topics.where(F.lit(missed) & F.col("category").isNotNull()).select("category").distinct()


def of_category(topics: DataFrame, category: str) -> DataFrame:
    """The topics of a category, in any case, with their place in the order of ids."""
    of = topics.where(F.lower("category") == category.lower())
    return of.select("id", "slug", "title", "category", F.rank().over(Window.partitionBy(F.lower("category")).orderBy("id")).cast("bigint").alias("pos"))


def _text(topics: DataFrame, name: str) -> Column:
    array = topics.schema[name].dataType.typeName() == "array"
    return F.lower(F.array_join(F.array_compact(name), " ") if array else F.col(name))


def search(topics: DataFrame, query: str) -> DataFrame:
    """(entry_id, slug, match_in): topics that hold the query, with the fields in which; an empty query finds none."""
    q = query.strip().lower()
    if not q:
        return topics.where(F.lit(False)).select("entry_id", "slug", F.lit("").alias("match_in"))
    hit = {"title": F.lower("title").contains(q), "category": F.lower("category").contains(q),
           "tags": F.exists("tags", lambda t: F.lower(t).contains(q))}
    hit |= {n: _text(topics, n).contains(q) for n in SEARCHED}
    names = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in hit.items()]))
    return topics.select("entry_id", "slug", names.alias("m")).where(F.size("m") > 0).select(
        "entry_id", "slug", F.array_join("m", ",").alias("match_in"))


def hint(match_in: Column, shown: int = 3) -> Column:
    """in a, b, c: up to ``shown`` of the text fields in which a topic matched, by their labels; empty without one."""
    labels = F.create_map(*[F.lit(x) for kv in FIELD_LABELS.items() for x in kv])
    named = F.transform(F.filter(F.split(match_in, ","), lambda x: x.isin(*FIELD_LABELS)), lambda x: F.element_at(labels, x))
    return F.when(F.size(named) > 0, F.concat(F.lit("in "), F.array_join(F.slice(named, 1, shown), ", "))).otherwise("")


def highlighted(title: Column, query: str) -> Column:
    """The escaped title with its first match marked."""
    q = query.strip().lower()
    at = F.locate(q, F.lower(title))
    n = len(q)
    marked = F.concat(
        escaped(F.substring(title, F.lit(1), at - 1)), F.lit("<mark>"), escaped(F.substring(title, at, F.lit(n))),
        F.lit("</mark>"), escaped(F.substring(title, at + n, F.length(title))))
    return F.when((at > 0) & F.lit(bool(q)), marked).otherwise(escaped(title))


def failed(topics: DataFrame) -> DataFrame:
    """(slug, math_failed, code_failed) of entries whose generation failed."""
    math = F.coalesce(F.col("description") == SENTINEL, F.lit(False))
    code = F.coalesce(F.col("cpp").contains(SENTINEL), F.lit(False))
    return topics.select("slug", math.alias("math_failed"), code.alias("code_failed")).where("math_failed or code_failed")


def stats(topics: DataFrame) -> DataFrame:
    return topics.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.coalesce(F.col("description") == SENTINEL, F.lit(False))).alias("math_failures"),
        F.count_if(F.coalesce(F.col("cpp").contains(SENTINEL), F.lit(False))).alias("code_failures"))


def histogram(topics: DataFrame, width: int = 30) -> DataFrame:
    """(category, n, bar): bars as long as their share of the largest category."""
    counts = topics.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    most = counts.agg(F.max("n").alias("most"))  # one row
    return counts.crossJoin(F.broadcast(most)).select("category", "n", F.floor(F.col("n") * width / F.col("most")).cast("bigint").alias("bar"))


def pending(wanted: DataFrame, topics: DataFrame) -> DataFrame:
    """Wanted slugs that the knowledge base lacks."""
    return wanted.select(slug_key(F.col("slug")).alias("slug")).where(F.col("slug").isNotNull()).distinct().join(
        topics.select("slug"), "slug", "left_anti")


def upsert(topics: DataFrame, new: DataFrame, columns: list[str]) -> DataFrame:
    """The knowledge base with the new rows in place of those of the same slug."""
    keys = new.select("slug")
    return topics.select("slug", *columns).join(keys, "slug", "left_anti").unionByName(new.select("slug", *columns))


def prompt(topics: DataFrame) -> DataFrame:
    """(slug, prompt): the request for a topic's text."""
    tags = F.array_join(F.coalesce("tags", F.array().cast("array<string>")), ", ")
    return topics.select("slug", F.format_string(
        "Topic: %s\nCategory: %s\nTags: %s\nAnswer with one JSON object.", F.coalesce("title", F.lit("")),
        F.coalesce("category", F.lit("Uncategorized")), tags).alias("prompt"))


def generate(prompts: DataFrame, model: Callable[[str], str], tries: int = 3) -> DataFrame:
    """(slug, description, failed): the model's answer to each prompt; the sentinel where all tries failed.

    The model is any function from prompt to text; it runs on the executors.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for p in b["prompt"]:
                answer = None
                for _ in range(tries):
                    try:
                        answer = model(p)
                        break
                    except Exception:  # any failure of the model is a failed try
                        continue
                out.append(answer)
            yield pd.DataFrame({
                "slug": b["slug"], "description": [SENTINEL if a is None else a for a in out], "failed": [a is None for a in out]})

    return prompts.select("slug", "prompt").mapInPandas(run, "slug string, description string, failed boolean")


def histogram_rank(histogram: DataFrame) -> DataFrame:
    """The histogram with ``pos``: largest categories first, then by name."""
    # As many rows as there are categories.
    return histogram.withColumn("pos", F.row_number().over(Window.orderBy(F.desc("n"), F.col("category").asc_nulls_first())).cast("bigint"))


def generate_entries(
    topics: DataFrame, math: Callable[[str], str], code: Callable[[str], str], tries: int = 3, wait: float = 5.0,
) -> DataFrame:
    """The generated fields of each topic (slug, title, category, tags), by two dependent calls.

    The second prompt quotes the answer to the first. Answers are read by
    ``json_object``; a call that fails or answers without JSON is tried again
    after ``wait`` seconds. After ``tries`` the sentinel stands in description
    or cpp, template_type is ``unknown`` and the other fields are empty; fields
    that an answer lacks are empty too.
    """
    text = [*MATH_FIELDS[0], *CODE_FIELDS[0]]
    lists = [*MATH_FIELDS[1], *CODE_FIELDS[1]]
    schema = "slug string, " + ", ".join(f"{f} string" for f in text) + ", " + ", ".join(f"{f} array<string>" for f in lists)

    def ask(model: Callable[[str], str], prompt: str) -> dict | None:
        for k in range(tries):
            try:
                answer = json_object(model(prompt))
                if answer is not None:
                    return answer
            except Exception:  # any failure of the model is a failed try
                pass
            if k + 1 < tries:
                time.sleep(wait)
        return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for slug, request in zip(b["slug"], b["prompt"]):
                first = ask(math, request)
                first = {"description": SENTINEL} if first is None else first
                context = "\n\n".join(f"{n}: {first.get(n) or ''}" for n in ("description", "explanation", "proof", "worked_example"))
                second = ask(code, f"{request}\n\n{context}")
                both = first | ({"cpp": f"// {SENTINEL}", "template_type": "unknown"} if second is None else second)
                rows.append([slug, *[str(both.get(n) or "") for n in text], *[[str(x) for x in both.get(n) or []] for n in lists]])
            yield pd.DataFrame(rows, columns=["slug", *text, *lists])

    return prompt(topics).mapInPandas(run, schema)


def json_object(raw: str) -> dict | None:
    """The outermost JSON object of a model's answer, as ``tolerant_json`` cuts it out; None if there is none."""
    body = re.sub(r"(?s)<think>.*?</think>", "", raw or "")
    found = re.search(r"(?s)\{.*\}", body)
    if not found:
        return None
    value = json.loads(re.sub(r'\\(?!["\\/bfnrtu])', r"\\\\", found.group()))
    return value if isinstance(value, dict) else None


def resumable(wanted: DataFrame, path: str, make: Callable[[DataFrame], DataFrame], steps: int = 8, again: bool = False) -> DataFrame:
    """The stored entries at ``path`` after those of ``wanted`` (slug, ...) that it lacks were made and added.

    Works through hash parts of what is pending and saves each part when it is
    done, so a run that was stopped goes on where it ended. ``again`` makes
    entries whose generation failed once more. The last entry of a slug holds.
    """
    spark = wanted.sparkSession
    for k in range(steps):
        part = wanted.where(F.pmod(F.xxhash64("slug"), F.lit(steps)) == k)
        stored = load_or_empty(spark, path, "slug string, description string, cpp string, saved_at timestamp")
        if again:
            stored = latest_entries(stored).where(~(F.col("description").eqNullSafe(SENTINEL) | F.coalesce(F.col("cpp").contains(SENTINEL), F.lit(False))))
        todo = part.join(stored.select("slug"), "slug", "left_anti")
        if todo.limit(1).count():
            make(todo).withColumn("saved_at", F.current_timestamp()).write.mode("append").parquet(path)
    return latest_entries(spark.read.parquet(path))


def latest_entries(stored: DataFrame) -> DataFrame:
    rest = [c for c in stored.columns if c not in ("slug", "saved_at")]
    return latest_by(stored, ["slug"], "saved_at", rest)


def tolerant_json(raw: Column) -> Column:
    """The outermost JSON object of a model's answer as text; null if it has no braces.

    Thinking blocks and code fences are dropped and stray backslashes doubled.
    """
    text = F.trim(F.regexp_replace(raw, r"(?s)<think>.*?</think>", ""))
    text = F.regexp_replace(F.regexp_replace(text, r"^```(?:json)?\s*", ""), r"\s*```$", "")
    body = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    fixed = F.regexp_replace(body, r'\\(?!["\\/bfnrtu])', r"\\\\")
    return F.when(body != "", fixed)
