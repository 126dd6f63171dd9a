"""Catalogues of problems and contests, contest search and pages, progress, virtual contests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trellisq.functions.ladders import CONTEST_CLASSES, contest_class, natural_key, slugified
from trellisq.session import cut_lineage
from trellisq.sources.domain import solved_keys

# Target ratings of the slots of each division.
DIVISION_RATINGS = {
    1: [1900, 2100, 2300, 2600, 2900],
    2: [800, 1100, 1400, 1700, 2100],
    3: [800, 900, 1100, 1300, 1500, 1700],
    4: [800, 800, 900, 1000, 1100, 1200, 1400],
}
TOLERANCE, WIDEST_TOLERANCE, LEAST_CHOICE, HIGHEST_TARGET, PAGE = 200, 400, 3, 3500, 75


def catalog(problems: DataFrame, statistics: DataFrame) -> DataFrame:
    """Problems with the solver count of the statistics, 0 without one."""
    stats = statistics.select("contest_id", "idx", F.col("solved_count").alias("stat"))
    return problems.join(stats, ["contest_id", "idx"], "left").select(
        "contest_id", "idx", "platform", "name", "rating", F.array_join("tags", ",").alias("tags"),
        F.coalesce("stat", F.lit(0)).cast("bigint").alias("solved_count"))


def task_catalog(tasks: DataFrame) -> DataFrame:
    return tasks.select(
        "task_id", "name", "category", slugified(F.col("category")).alias("tags"), F.lit(None).cast("int").alias("rating"),
        F.col("solved_count").cast("bigint").alias("solved_count"))


def catalog_union(first: DataFrame, second: DataFrame) -> DataFrame:
    """Both catalogues in one table; a column that one of them lacks is null there."""
    return first.unionByName(second.withColumn("platform", F.lit("tasks")), allowMissingColumns=True)


def _labels() -> "F.Column":
    """The problem labels of a group in their natural order, joined."""
    pairs = F.array_sort(F.collect_list(F.struct(natural_key(F.col("idx")).alias("k"), F.col("idx").alias("idx"))))
    return F.array_join(F.transform(pairs, lambda p: p["idx"]), ",")


def contest_catalog(contests: DataFrame, problems: DataFrame) -> DataFrame:
    """(category, pos, contest_id, name, n_problems, labels): contests that have problems, newest id first."""
    per = problems.where(F.col("contest_id").isNotNull()).groupBy("contest_id").agg(
        F.count(F.lit(1)).alias("n_problems"), _labels().alias("labels"))
    joined = contests.join(per, "contest_id").withColumn("category", contest_class(F.col("name")))
    pos = F.row_number().over(Window.partitionBy("category").orderBy(F.desc("contest_id"))).cast("bigint")
    return joined.select("category", pos.alias("pos"), "contest_id", "name", "n_problems", "labels")


def mapped_catalog(contests: DataFrame, mapping: DataFrame, problems: DataFrame) -> DataFrame:
    """(series, pos, contest_id, n_problems, labels) of contests in the mapping.

    A contest whose mapped problems are all unknown stays, with an empty list.
    The series is the first word of the name; the latest start comes first,
    contests without a start last.
    """
    known = mapping.select("contest_id", "idx").distinct().join(
        problems.select("contest_id", "idx", F.lit(True).alias("known")), ["contest_id", "idx"], "left")
    per = known.groupBy("contest_id").agg(F.count("known").alias("n_problems"), F.array_join(F.transform(
        F.array_sort(F.collect_list(F.when(F.col("known"), F.struct(natural_key(F.col("idx")).alias("k"), F.col("idx").alias("idx"))))),
        lambda p: p["idx"]), ",").alias("labels"))
    series = F.lower(F.split_part("name", F.lit(" "), F.lit(1)))
    pos = F.row_number().over(
        Window.partitionBy("series").orderBy(F.desc_nulls_last("start_at"), "contest_id")).cast("bigint")
    return contests.join(per, "contest_id").withColumn("series", series).select(
        "series", pos.alias("pos"), "contest_id", "n_problems", "labels")


def contest_search(catalogue: DataFrame, query: str, category: str | None = None) -> DataFrame:
    """Contests, of one category if it is named, whose name or id holds the query, in any case."""
    q = query.strip().lower()
    if category is not None:
        catalogue = catalogue.where(F.col("category") == category)
    return catalogue.where(F.lower("name").contains(q) | F.col("contest_id").cast("string").contains(q)).select(
        "category", "contest_id", "name")


def contest_page(catalogue: DataFrame, page: int, size: int = PAGE) -> DataFrame:
    """Page ``page`` of each category; a page past the end is the last one."""
    n = F.count(F.lit(1)).over(Window.partitionBy("category"))
    last = F.greatest(F.lit(1), F.ceil(n / size))
    at = F.least(F.lit(max(1, page)), last)
    return catalogue.withColumns({"page": at.cast("bigint"), "pages": last.cast("bigint")}).where(
        F.ceil(F.col("pos") / size) == F.col("page")).select("category", "page", "pages", "pos", "contest_id")


def contest_progress(subs: DataFrame, problems: DataFrame) -> DataFrame:
    """(user_id, contest_id, solved, total) of contests in which the user solved something."""
    totals = problems.groupBy("contest_id").agg(F.count(F.lit(1)).alias("total"))
    solved = solved_keys(subs).join(problems.select("contest_id", "idx"), ["contest_id", "idx"], "left_semi")
    return solved.groupBy("user_id", "contest_id").agg(F.count(F.lit(1)).alias("solved")).join(totals, "contest_id").select(
        "user_id", "contest_id", "solved", "total")


def div_contests(
    users: DataFrame, subs: DataFrame, contests: DataFrame, problems: DataFrame, division: int, count: int = 5, examined: int = 50,
    samples: int = 3,
) -> DataFrame:
    """(user_id, pos, contest_id, name, unsolved, samples): up to ``count`` contests with problems the user has not solved.

    Of the ``examined`` newest finished contests of the division, those that
    have problems, newest first; samples are the first unsolved problems. The
    division is what the name holds, so a combined contest belongs to both; an
    unknown division is taken as 2.
    """
    div = division if division in DIVISION_RATINGS else 2
    chosen = contests.where((F.col("phase") == "FINISHED") & F.col("name").contains(f"Div. {div}")).orderBy(
        F.desc("contest_id")).limit(examined)
    listed = F.transform(F.array_sort(F.collect_list(F.struct(natural_key(F.col("idx")).alias("k"), F.col("idx").alias("idx")))), lambda p: p["idx"])
    per = problems.join(F.broadcast(chosen.select("contest_id")), "contest_id", "left_semi").groupBy("contest_id").agg(listed.alias("labels"))
    # One row of at most ``examined`` contests, newest first.
    every = chosen.join(per, "contest_id").agg(F.sort_array(F.collect_list(F.struct("contest_id", "name", "labels")), asc=False).alias("every"))
    known = cut_lineage(every)
    ids = known.select(F.explode("every.contest_id").alias("contest_id"))
    solved = solved_keys(subs).join(F.broadcast(ids), "contest_id", "left_semi").groupBy("user_id", "contest_id").agg(
        F.collect_set("idx").alias("solved"))
    offered = users.select("user_id").crossJoin(F.broadcast(known)).select("user_id", F.explode("every").alias("c")).select("user_id", "c.*")
    left = offered.join(solved, ["user_id", "contest_id"], "left").withColumn(
        "left", F.array_except("labels", F.coalesce("solved", F.array().cast("array<string>")))).where(F.size("left") > 0)
    pos = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("contest_id"))).cast("bigint")
    return left.withColumn("pos", pos).where(F.col("pos") <= count).select(
        "user_id", "pos", "contest_id", "name", F.size("left").cast("bigint").alias("unsolved"),
        F.array_join(F.slice("left", 1, samples), ",").alias("samples"))


def contest_problems(contests: DataFrame, problems: DataFrame, statistics: DataFrame) -> DataFrame:
    """(category, contest_id, contest, idx, name, rating, solved_count): the problems of finished contests with their solver counts."""
    finished = contests.where(F.col("phase") == "FINISHED").select("contest_id", F.col("name").alias("contest"))
    stats = statistics.select("contest_id", "idx", F.col("solved_count").alias("stat"))
    return problems.select("contest_id", "idx", "name", "rating").join(finished, "contest_id").join(stats, ["contest_id", "idx"], "left").select(
        contest_class(F.col("contest")).alias("category"), "contest_id", "contest", "idx", "name", "rating",
        F.coalesce("stat", F.lit(0)).cast("bigint").alias("solved_count"))


def category_counts(catalogue: DataFrame) -> DataFrame:
    """(category, n) of every category, those without a contest too."""
    spark = catalogue.sparkSession
    every = spark.createDataFrame([(c,) for c, _ in CONTEST_CLASSES] + [("Other",)], "category string")
    counts = catalogue.groupBy("category").agg(F.count(F.lit(1)).alias("n"))  # a row for each class
    return every.join(F.broadcast(counts), "category", "left").fillna(0, ["n"])


def dispatched(first: DataFrame, second: DataFrame, platform: str | None) -> DataFrame:
    """The catalogue of one platform (problems or tasks); both for any other name or none."""
    if platform == "problems":
        return catalog_union(first, second.limit(0))
    return catalog_union(first.limit(0), second) if platform == "tasks" else catalog_union(first, second)


def slot_targets(division: int, count: int) -> list[int]:
    """Target ratings of ``count`` slots: the division's own, then rising by its step up to the cap."""
    base = DIVISION_RATINGS.get(division, DIVISION_RATINGS[2])
    step = 100 if division >= 3 else 200
    return [base[k] if k < len(base) else min(base[-1] + step * (k - len(base) + 1), HIGHEST_TARGET) for k in range(count)]


def clamped_count(n: int) -> int:
    return max(3, min(10, n))


def recent_contest_solves(subs: DataFrame, problems: DataFrame, last: int = 50) -> DataFrame:
    """(user_id, contest_id, idx): catalogue problems solved in the user's latest submissions."""
    rn = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("at"), F.desc("submission_id")))
    return subs.withColumn("rn", rn).where((F.col("rn") <= last) & F.col("ok")).select("user_id", "contest_id", "idx").distinct().join(
        problems.select("contest_id", "idx"), ["contest_id", "idx"], "left_semi").select("user_id", "contest_id", "idx")


def virtual_contest(
    users: DataFrame, subs: DataFrame, problems: DataFrame, division: int = 2, count: int = 5, seed: int = 7, least_pool: int = 20,
) -> DataFrame:
    """(user_id, letter, contest_id, idx, rating): per slot an unsolved problem close to its target.

    The choice of a slot are the unsolved problems within 200 of its target,
    or within 400 where there are fewer than three, by distance, then
    (contest_id, idx). One of the first ``least_pool``, or of the first fourth
    if that is more, is drawn by a hash of user, slot and seed. No problem is used twice; a slot without a
    choice is skipped; at the end the slots are sorted by rating and lettered.
    The order of a slot's choice is the same for all users, so the r-th free
    one is found from the ranks that a user's problems take away: users and
    catalogue are never paired.
    """
    rated = cut_lineage(problems.where(F.col("rating").isNotNull()).select("contest_id", "idx", F.col("rating").cast("bigint").alias("rating")))
    solved = cut_lineage(solved_keys(subs).join(rated, ["contest_id", "idx"]).select("user_id", "contest_id", "idx"))
    picks = None
    for k, target in enumerate(slot_targets(division, count)):
        off = F.abs(F.col("rating") - target)
        # Ranks of one slot, for all users: those of a distance, after all smaller distances.
        reach = rated.where(off <= WIDEST_TOLERANCE).withColumn("off", off)
        sizes = reach.groupBy("off").agg(F.count(F.lit(1)).alias("n"))  # as many rows as there are ratings in reach
        before = sizes.select("off", (F.sum("n").over(Window.orderBy("off")) - F.col("n")).alias("before"))
        within = F.row_number().over(Window.partitionBy("off").orderBy("contest_id", "idx"))
        ranks = cut_lineage(reach.withColumn("within", within).join(before, "off").select(
            "contest_id", "idx", "rating", (F.col("off") <= TOLERANCE).alias("near"), (F.col("before") + F.col("within")).alias("rank")))
        totals = ranks.agg(F.count(F.lit(1)).alias("wide"), F.count_if("near").alias("close"))  # one row
        taken = solved if picks is None else solved.unionByName(picks.select("user_id", "contest_id", "idx"))
        blocked = taken.join(ranks.select("contest_id", "idx", "rank", "near"), ["contest_id", "idx"])
        nth = F.row_number().over(Window.partitionBy("user_id").orderBy("rank"))
        gone = blocked.withColumn("nth", nth).groupBy("user_id").agg(
            F.count(F.lit(1)).alias("out"), F.count_if("near").alias("out_near"), F.array_sort(F.collect_list(F.col("rank") - F.col("nth"))).alias("skips"))
        free_near, free_wide = F.col("close") - F.col("out_near"), F.col("wide") - F.col("out")
        n = F.when(free_near >= LEAST_CHOICE, free_near).otherwise(free_wide)
        pool = F.least(n, F.greatest(F.lit(least_pool), F.floor(n / 4)))
        draw = F.conv(F.substring(F.md5(F.concat_ws("/", F.col("user_id").cast("string"), F.lit(str(k)), F.lit(str(seed)))), 1, 8), 16, 10).cast("bigint")
        want = users.select("user_id").join(gone, "user_id", "left").fillna(0, ["out", "out_near"]).crossJoin(F.broadcast(totals)).withColumn(
            "n", n).where(F.col("n") > 0).withColumn("r", 1 + F.pmod(draw, F.greatest(F.lit(1), pool)))
        # Of the taken ranks those before the r-th free one have fewer than r free ranks before them.
        rank = F.col("r") + F.coalesce(F.size(F.filter("skips", lambda x: x < F.col("r"))), F.lit(0))
        choice = want.select("user_id", rank.cast("bigint").alias("rank")).join(ranks, "rank").select(
            "user_id", F.lit(k).alias("slot"), "contest_id", "idx", "rating")
        picks = cut_lineage(choice if picks is None else picks.unionByName(choice))
    letter = F.char(F.lit(64) + F.row_number().over(Window.partitionBy("user_id").orderBy("rating", "slot")))
    return picks.select("user_id", letter.alias("letter"), "contest_id", "idx", "rating")
