"""Mode-specific scores and diversity-aware top-k recommendations for all users at once.

Users and catalogue are never paired as rows. The catalogue is stored in blocks
in the shared folder; each task holds one block in memory, sorted by rating,
and scores the slice inside a user's rating window with array operations. Per
user and block only the few rows that can still be shown leave the task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trellisq.operators.profile import rating_window
from trellisq.operators.topics import explore_tags, topic_stats, weak_tags
from trellisq.session import read_block, stored_blocks
from trellisq.sources.domain import IGNORED_TAGS

# Ideal distance from the target and tolerance, and weights of rating, topic and popularity.
IDEALS = {"grind": (-100, 250), "stretch": (200, 300)}
TASK_IDEALS = {"grind": (-150, 300), "stretch": (200, 350)}
WEIGHTS = {"explore": (0.4, 0.6, 0.1), "grind": (0.3, 0.2, 0.6), "weak_topics": (0.3, 0.7, 0.1)}
DEFAULT_IDEAL, DEFAULT_TASK_IDEAL, DEFAULT_WEIGHTS = (100, 250), (50, 300), (0.5, 0.3, 0.2)
MODES = ("balanced", "explore", "grind", "stretch", "weak_topics")
#: Problems that a task holds at once, and ids that share one part when tasks are ranked.
BLOCK_ROWS, ID_PART = 500_000, 100_000
ATTEMPTED_PENALTY, PROBLEM_SOLVERS, TASK_SOLVERS = 0.1, 50_000, 200_000


def closeness(rating: Column, target: Column, ideal: int, tolerance: int) -> Column:
    return F.greatest(F.lit(0.0), 1 - F.abs(rating - target - ideal) / F.lit(float(tolerance)))


def popularity(count: Column, scale: int) -> Column:
    return F.log1p(count.cast("double")) / F.log1p(F.lit(float(scale)))


def _first_shown(scores: np.ndarray, tie: np.ndarray, groups: np.ndarray, urls: np.ndarray, count: int) -> list[int]:
    """Positions, best first, of the rows that ``diversified`` can show among these and rows of other blocks.

    A walk down the order until ``count`` rows stood among the first two of
    their group and 2 * ``count`` urls were seen. It keeps the first ``count``
    rows, the first two of a group and the first of a url.
    """
    n = len(scores)
    reach = min(n, 8 * count)
    while True:
        if reach < n:
            # Everything that ties with the last one taken comes along.
            among = np.flatnonzero(scores >= np.partition(scores, n - reach)[n - reach])
        else:
            among = np.arange(n)
        order = among[np.lexsort((tie[among], -scores[among]))]
        kept, in_group, seen, early = [], {}, set(), 0
        for rank, at in enumerate(order):
            g, u = groups[at], urls[at]
            nth = in_group[g] = in_group.get(g, 0) + 1
            new = u not in seen
            if rank < count or nth <= 2 or (new and len(seen) < 2 * count):
                kept.append(int(at))
            seen.add(u)
            early += nth <= 2
            if early >= count and len(seen) >= 2 * count:
                return kept
        if len(among) == n:
            return kept
        reach = min(n, 4 * reach)


def scored_problems(
    users: DataFrame, subs: DataFrame, problems: DataFrame, mode: str, tag_filter: list[str] | None = None,
    low: int | None = None, high: int | None = None, ignored: tuple[str, ...] = IGNORED_TAGS, count: int = 8,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(user_id, contest_id, idx, primary, url, catalog_pos, score) of the unsolved problems in the user's window.

    Of these the ones that ``diversified`` can show for ``count``, whatever the
    blocks. Tags and keys are compared by 64-bit hashes.
    """
    ideal, tolerance = IDEALS.get(mode, DEFAULT_IDEAL)
    w_rating, w_topic, w_pop = WEIGHTS.get(mode, DEFAULT_WEIGHTS)
    key = F.xxhash64("contest_id", "idx")
    catalogue = problems.where(F.col("rating").isNotNull())
    if tag_filter:
        catalogue = catalogue.where(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tag_filter])))
    catalogue = catalogue.select(
        key.alias("key"), F.col("rating").cast("bigint").alias("rating"), popularity(F.col("solved_count"), PROBLEM_SOLVERS).alias("pop"),
        F.transform(F.array_distinct(F.filter("tags", lambda t: ~t.isin(*ignored))), lambda t: F.xxhash64(t)).alias("tags"),
        "contest_id", "idx", "primary", "url", "catalog_pos")
    n_blocks = max(1, -(-catalogue.count() // block_rows))
    path = stored_blocks(catalogue, ["key"], n_blocks, "catalogue")

    none = F.array().cast("array<bigint>")
    # Arrays that travel with the user: the tags the mode looks for, what is solved and what was tried. None is longer
    # than the catalogue or the tag vocabulary, and each is combined map-side.
    if mode in ("balanced", "weak_topics"):
        wanted = weak_tags(topic_stats(subs, problems, ignored))
    elif mode == "explore":
        wanted = explore_tags(users, subs, problems, ignored)
    else:
        wanted = None
    who = rating_window(users, low, high).select("user_id", "target", "lo", "hi")
    tried = subs.groupBy("user_id").agg(
        F.collect_set(F.when(F.col("ok"), key)).alias("solved"), F.collect_set(key).alias("tried"))
    who = who.join(tried, "user_id", "left")
    if wanted is None:
        who = who.withColumn("wanted", none)
    else:
        who = who.join(wanted.groupBy("user_id").agg(F.collect_set(F.xxhash64("tag")).alias("wanted")), "user_id", "left")
    who = who.withColumns({c: F.coalesce(c, none) for c in ("solved", "tried", "wanted")})
    schema = ("user_id " + users.schema["user_id"].dataType.simpleString() + ", contest_id bigint, idx string, primary string, "
              "url string, catalog_pos bigint, score double")
    columns = ["contest_id", "idx", "primary", "url", "catalog_pos"]
    topical = wanted is not None

    def block_of(k: int):
        t = read_block(path, k)
        if t is None:
            return None
        f = t.select(["key", "rating", "pop", *columns]).to_pandas()
        tags = t["tags"].combine_chunks()
        sizes = np.diff(tags.offsets.to_numpy())
        by_rating = np.argsort(f["rating"].to_numpy(), kind="stable")
        starts = tags.offsets.to_numpy()[:-1]
        flat = tags.values.to_numpy(zero_copy_only=False)
        at = np.concatenate([np.arange(starts[x], starts[x] + sizes[x]) for x in by_rating]).astype(np.int64)
        words, codes = np.unique(flat[at], return_inverse=True)
        f = f.iloc[by_rating].reset_index(drop=True)
        tie = np.empty(len(f), dtype=np.int64)
        tie[f.sort_values(["catalog_pos", "contest_id", "idx"]).index.to_numpy()] = np.arange(len(f))
        ends = np.concatenate(([0], np.cumsum(sizes[by_rating])))
        row_of_key = np.argsort(f["key"].to_numpy())
        return (f, f["rating"].to_numpy(), f["pop"].to_numpy(), words, codes, ends, tie, pd.factorize(f["primary"])[0],
                pd.factorize(f["url"], use_na_sentinel=False)[0], f["key"].to_numpy()[row_of_key], row_of_key)

    def rows_of(keys: np.ndarray, mine: np.ndarray, row_of_key: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(keys, mine), len(keys) - 1)
        return row_of_key[at[keys[at] == mine]]

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for b in batches:
            for k in range(n_blocks):
                if k not in held:
                    held.clear()
                    held[k] = block_of(k)
                if held[k] is None:
                    continue
                frame, rating, pop, words, codes, ends, tie, groups, urls, keys, row_of_key = held[k]
                rows, whose, scores = [], [], []
                for user, target, lo, hi, solved, attempted, wants in zip(
                        b["user_id"], b["target"], b["lo"], b["hi"], b["solved"], b["tried"], b["wanted"]):
                    i, j = np.searchsorted(rating, lo), np.searchsorted(rating, hi, side="right")
                    if i >= j:
                        continue
                    total = np.maximum(0.0, 1 - np.abs(rating[i:j] - target - ideal) / float(tolerance)) * w_rating
                    if topical:
                        hit = np.zeros(len(words) + 1, dtype=np.int64)
                        at = np.searchsorted(words, wants)
                        hit[at[np.append(words, 0)[at] == wants]] = 1
                        running = np.concatenate(([0], np.cumsum(hit[codes[ends[i]:ends[j]]])))
                        hits = np.diff(running[ends[i:j + 1] - ends[i]])
                        topic = hits * 0.3
                        if mode == "explore":
                            # What is not wanted is already solved: such a tag costs 0.3.
                            topic = hits * 0.5 - np.where(np.diff(ends[i:j + 1]) > hits, 0.3, 0.0)
                        total = total + topic * w_topic
                    total = total + pop[i:j] * w_pop
                    again = rows_of(keys, np.asarray(attempted, dtype=np.int64), row_of_key)
                    again = again[(again >= i) & (again < j)] - i
                    total[again] -= ATTEMPTED_PENALTY
                    total = np.round(np.maximum(0.0, total), 6)
                    free = np.ones(j - i, dtype=bool)
                    done = rows_of(keys, np.asarray(solved, dtype=np.int64), row_of_key)
                    free[done[(done >= i) & (done < j)] - i] = False
                    left = np.flatnonzero(free)
                    own = left + i
                    for x in _first_shown(total[left], tie[own], groups[own], urls[own], count):
                        rows.append(own[x])
                        whose.append(user)
                        scores.append(total[left[x]])
                out = frame.iloc[rows][columns]
                out.insert(0, "user_id", whose)
                yield out.assign(score=scores)

    # A stated number of parts: the rows are few bytes but much work, so adaptive coalescing must not merge them.
    parts = int(users.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return who.repartition(parts, "user_id").mapInPandas(score, schema)


def diversified(scored: DataFrame, count: int, group: str, order: list, half_rule: bool, url: str | None = None) -> DataFrame:
    """The first ``count`` rows of each user with ``pos``, no group holding more than two before others had their turn.

    Greedy acceptance in closed form: a row is accepted if it is among the
    first count/2 (where the half rule holds) or the first two of its group;
    the accepted come first, the rest fills up, a repeated ``url`` only once
    (a null url is one url). Of a group only the first ``count`` rows and the
    first rows of its first 2 * ``count`` urls can be shown, so the others are
    cut before the wider windows.
    """
    by_user, in_group = Window.partitionBy("user_id"), Window.partitionBy("user_id", group)
    near = scored.withColumn("rg", F.row_number().over(in_group.orderBy(*order)))
    can = F.col("rg") <= max(count, 2)
    if url:
        first = F.row_number().over(Window.partitionBy("user_id", group, url).orderBy("rg")) == 1
        near = near.withColumn("first", first).withColumn("urls", F.sum(F.col("first").cast("int")).over(in_group.orderBy("rg")))
        can = can | (F.col("first") & (F.col("urls") <= 2 * count))
    near = near.where(can)
    ranked = near.withColumn("rk", F.row_number().over(by_user.orderBy(*order)))
    accepted = F.col("rg") <= 2
    if half_rule:
        accepted = accepted | (F.col("rk") <= max(1, count // 2))
    ranked = ranked.withColumn("late", F.when(accepted, 0).otherwise(1))
    # Of the accepted only those that are shown count as seen.
    ranked = ranked.withColumn("turn", F.row_number().over(by_user.orderBy("late", "rk"))).where((F.col("late") == 1) | (F.col("turn") <= count))
    if url:
        again = F.row_number().over(Window.partitionBy("user_id", url).orderBy("late", "rk"))
        ranked = ranked.withColumn("again", again).where((F.col("late") == 0) | (F.col("again") == 1)).drop("again", "first", "urls")
    return ranked.withColumn("pos", F.row_number().over(by_user.orderBy("late", "rk")).cast("bigint")).where(
        F.col("pos") <= count).drop("rg", "rk", "late", "turn")


def recommend(users, subs, problems, mode: str = "balanced", count: int = 8, ignored=IGNORED_TAGS, **filters) -> DataFrame:
    """(user_id, pos, contest_id, idx, score)."""
    scored = scored_problems(users, subs, problems, mode, ignored=ignored, count=count, **filters)
    order = [F.desc("score"), F.col("catalog_pos"), F.col("contest_id"), F.col("idx")]
    return diversified(scored, count, "primary", order, True, "url").select("user_id", "pos", "contest_id", "idx", "score")


def recommend_tasks(users: DataFrame, tasks: DataFrame, solved_tasks: DataFrame, mode: str = "balanced", count: int = 8) -> DataFrame:
    """(user_id, pos, task_id, score).

    Inside a category the score falls with the solver count, the same for all
    users. So the first ``count`` unsolved tasks of a category are among its
    first count + (solved by the user in it), and only those are joined.
    """
    ideal, tolerance = TASK_IDEALS.get(mode, DEFAULT_TASK_IDEAL)
    # Ranks of a category are summed over its solver counts and parts of the ids, so no category is sorted in one task.
    parts = tasks.select("task_id", "category", "solved_count", F.floor(F.col("task_id") / ID_PART).alias("part"))
    per = parts.groupBy("category", "solved_count", "part").agg(F.count(F.lit(1)).alias("n"))
    before = per.withColumn("before", F.sum("n").over(
        Window.partitionBy("category").orderBy(F.desc("solved_count"), "part")) - F.col("n")).drop("n")
    within = F.row_number().over(Window.partitionBy("category", "solved_count", "part").orderBy("task_id"))
    ranked = parts.withColumn("within", within).join(before, ["category", "solved_count", "part"]).select(
        "task_id", "category", "solved_count", (F.col("before") + F.col("within")).alias("rank"))
    sizes = tasks.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.first("rating").alias("rating"))
    solved = solved_tasks.join(tasks.select("task_id", "category"), "task_id").groupBy("user_id", "category").agg(
        F.count(F.lit(1)).alias("s"))
    target = F.col("target")
    # As many rows as there are categories.
    cats = sizes.agg(F.collect_list(F.struct("category", "n", "rating")).alias("cats"))
    want = users.crossJoin(F.broadcast(cats)).select("user_id", "target", F.explode("cats").alias("c")).select(
        "user_id", "target", "c.category", "c.n", F.coalesce("c.rating", "target").alias("rating"))
    want = want.where(F.col("rating").between(F.greatest(F.lit(400), target - 250), target + 450)).join(
        solved, ["user_id", "category"], "left")
    upto = F.least(F.col("n"), F.coalesce("s", F.lit(0)) + count)
    slots = want.select("user_id", "target", "category", "rating", F.explode(F.sequence(F.lit(1).cast("bigint"), upto)).alias("rank"))
    pairs = slots.join(ranked.select("category", "rank", "task_id", "solved_count"), ["category", "rank"]).join(
        solved_tasks, ["user_id", "task_id"], "left_anti")
    score = F.round(closeness(F.col("rating"), target, ideal, tolerance) * 0.65
                    + popularity(F.col("solved_count"), TASK_SOLVERS) * 0.35, 6)
    scored = pairs.select("user_id", "task_id", "category", score.alias("score"))
    order = [F.desc("score"), F.col("task_id")]
    return diversified(scored, count, "category", order, False).select("user_id", "pos", "task_id", "score")


def quotas(count: int, second_profile: bool) -> tuple[int, int]:
    """How many of ``count`` come from the first and the second platform."""
    second = max(1, count // 4) if second_profile and count > 1 else 0
    return count - second, second


def interleaved(first: DataFrame, second: DataFrame, count: int) -> DataFrame:
    """Alternates two ranked lists of (user_id, pos, platform, item_id, score), the first one leading."""
    both = first.withColumn("side", F.lit(0)).unionByName(second.withColumn("side", F.lit(1)))
    at = F.row_number().over(Window.partitionBy("user_id").orderBy("pos", "side")).cast("bigint")
    return both.withColumn("at", at).where(F.col("at") <= count).select(
        "user_id", F.col("at").alias("pos"), "platform", "item_id", "score")
