"""The practice queries: operators over the stored tables, with their SQL in practice_sql."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trellisq.functions import ladders as L
from trellisq.functions.normalize import slug_key
from trellisq.operators import contests as C
from trellisq.operators import hierarchy as H
from trellisq.operators import knowledge as K
from trellisq.operators import markup as M
from trellisq.operators import profile as P
from trellisq.operators import progress as G
from trellisq.operators import recommend as R
from trellisq.operators import reports
from trellisq.operators import requests as Q
from trellisq.operators import topics as T
from trellisq.sources import domain as D
from trellisq.sources.tables import table
from trellisq.streaming import jobs as J

QUERIES = {}
#: Tags that the registered queries ignore besides the fixed ones, so that the rule is exercised.
IGNORED = (*D.IGNORED_TAGS, "implementation")


def query(f):
    QUERIES[f.__name__] = f
    return f


def _facts(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return D.users(s, d), D.submissions(s, d), D.problems(s, d, IGNORED)


@query
def q_solved_keys(s, d):
    return D.solved_keys(D.submissions(s, d))


@query
def q_user_stats(s, d):
    return P.user_stats(D.users(s, d), D.submissions(s, d))


@query
def q_compare(s, d):
    users = D.users(s, d)
    request = users.select("user_id", F.row_number().over(Window.partitionBy(F.substring("handle", 1, 1)).orderBy("handle", "user_id")).cast("bigint").alias("pos"))
    return P.compare(P.user_stats(users, D.submissions(s, d)), request)


@query
def q_unsolved(s, d):
    return P.unsolved_counts(*_facts(s, d))


@query
def q_rating_window(s, d):
    return P.window_counts(D.users(s, d), D.problems(s, d))


@query
def q_tag_filter(s, d):
    return P.with_any_tag(D.problems(s, d), ["geometry", "games"]).select("contest_id", "idx")


@query
def q_topic_stats(s, d):
    return T.topic_stats(D.submissions(s, d), D.problems(s, d), IGNORED).drop("rating_sum")


def _weak(s, d, n=0):
    return T.weak_tags(T.topic_stats(D.submissions(s, d), D.problems(s, d), IGNORED), n)


@query
def q_weak_tags(s, d):
    return _weak(s, d)


@query
def q_weak_tags_top6(s, d):
    return _weak(s, d, 6)


@query
def q_explore_tags(s, d):
    return T.explore_tags(*_facts(s, d), IGNORED)


@query
def q_topic_breakdown(s, d):
    stats = T.topic_stats(D.submissions(s, d), D.problems(s, d), IGNORED)
    return T.breakdown(stats, T.weak_tags(stats))


def _recommend(mode):
    def q(s, d):
        return R.recommend(*_facts(s, d), mode, ignored=IGNORED)
    q.__name__ = f"q_recommend_{mode}"
    return query(q)


for _mode in R.MODES:
    _recommend(_mode)


@query
def q_recommend_tasks(s, d):
    return R.recommend_tasks(D.users(s, d), D.tasks(s, d), D.solved_tasks(s, d))


@query
def q_recommend_mixed(s, d):
    count = 8
    n_a, n_b = R.quotas(count, True)
    a = R.recommend(*_facts(s, d), "balanced", n_a, IGNORED).select(
        "user_id", "pos", F.lit("problems").alias("platform"),
        F.concat_ws("/", F.col("contest_id").cast("string"), "idx").alias("item_id"), "score")
    b = R.recommend_tasks(D.users(s, d), D.tasks(s, d), D.solved_tasks(s, d), "balanced", n_b).select(
        "user_id", "pos", F.lit("tasks").alias("platform"), F.col("task_id").cast("string").alias("item_id"), "score")
    return R.interleaved(a, b, count)


def _series(s, d):
    # Days come from the submissions; the rating history stands in the activity feed.
    subs = D.submissions(s, d).select("user_id", F.to_date("at").alias("date"), "ok")
    return G.daily(subs, D.rating_changes(D.activity(s, d)))


@query
def q_progress_daily(s, d):
    return _series(s, d)


@query
def q_rating_graph(s, d):
    return G.rating_graph(_series(s, d))


@query
def q_progress_recent(s, d):
    return G.recent(_series(s, d))


def _as_of(s, d):
    """The last day of the data, as a literal: one aggregate row."""
    return F.lit(table(s, d, "submissions").agg(F.max(F.to_date("submitted_at"))).first()[0]).cast("date")


@query
def q_streaks(s, d):
    return G.streaks(D.submissions(s, d), _as_of(s, d))


@query
def q_heatmap(s, d):
    as_of, tasks = _as_of(s, d), D.task_solves(s, d)
    # The task tables end years before the submissions: their last day is put on the last day shown.
    last = F.lit(tasks.agg(F.max("date")).first()[0]).cast("date")
    shifted = tasks.select("user_id", F.date_add("date", F.datediff(as_of, last)).alias("date"))
    return G.heatmap(G.last_solves(D.submissions(s, d), D.problems(s, d)), shifted, as_of)


@query
def q_week_grid(s, d):
    return G.padded_weeks(D.submissions(s, d).select(F.to_date("at").alias("date")).distinct())


@query
def q_solved_list(s, d):
    return D.accepted_list(s, d)


@query
def q_rating_histogram(s, d):
    return G.rating_histogram(G.last_solves(D.submissions(s, d), D.problems(s, d)))


@query
def q_tag_topn_other(s, d):
    p = D.problems(s, d)
    return G.tag_top_other(G.last_solves(D.submissions(s, d), p), p)


@query
def q_dashboard_totals(s, d):
    a = D.solved_keys(D.submissions(s, d)).groupBy("user_id").agg(F.count(F.lit(1)).alias("solved_problems"))
    b = D.solved_tasks(s, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("solved_tasks"))
    return D.users(s, d).select("user_id").join(a, "user_id", "left").join(b, "user_id", "left").fillna(0).withColumn(
        "total", F.col("solved_problems") + F.col("solved_tasks"))


@query
def q_first_seen(s, d):
    return G.first_seen(D.submissions(s, d))


@query
def q_rating_ladders(s, d):
    r = F.col("rating")
    return D.users(s, d).select(
        "user_id", L.heat_class(r).alias("heat"), L.list_class(r).alias("list"), L.practice_class(r).alias("practice"))


@query
def q_classify_contest(s, d):
    return D.contests(s, d).select("contest_id", L.contest_class(F.col("name")).alias("category"))


@query
def q_natural_sort(s, d):
    # Each contest's start time, name and id give labels of all three kinds.
    labels = D.contests(s, d).select("contest_id", F.explode(F.array(
        F.substring("name", 1, 1), F.concat(F.substring("name", 1, 2), F.col("contest_id").cast("string")), F.col("name"),
        F.col("contest_id").cast("string"), F.translate("name", "0123456789", ""))).alias("label"))
    k = L.natural_key(F.col("label"))
    return labels.select(
        "contest_id", "label", F.row_number().over(Window.partitionBy("contest_id").orderBy(k, "label")).cast("bigint").alias("pos"))


@query
def q_format_time(s, d):
    return table(s, d, "events").select("event_id", L.clock(F.col("event_id")).alias("clock"))


@query
def q_catalog(s, d):
    return C.catalog(D.problems(s, d), D.statistics(s, d))


@query
def q_catalog_tasks(s, d):
    return C.task_catalog(D.tasks(s, d))


@query
def q_catalog_union(s, d):
    return C.catalog_union(C.catalog(D.problems(s, d), D.statistics(s, d)), C.task_catalog(D.tasks(s, d)))


def _contests(s, d):
    return C.contest_catalog(D.contests(s, d), D.problems(s, d))


@query
def q_contest_catalog(s, d):
    return _contests(s, d)


@query
def q_contest_catalog_mapped(s, d):
    return C.mapped_catalog(D.contests(s, d), D.submissions(s, d), D.problems(s, d))


@query
def q_contest_search(s, d):
    return C.contest_search(_contests(s, d), " Spring Round 1")


@query
def q_contest_search_category(s, d):
    return C.contest_search(_contests(s, d), "round", "Div. 2")


@query
def q_contest_problems(s, d):
    return C.contest_problems(D.contests(s, d), D.problems(s, d), D.statistics(s, d))


@query
def q_contest_categories(s, d):
    return C.category_counts(_contests(s, d))


@query
def q_contest_series(s, d):
    prefix = F.element_at(F.array(*[F.lit(x) for x in ("abc", "arc", "agc", "past")]), (F.pmod("contest_id", F.lit(4)) + 1).cast("int"))
    label = F.concat(prefix, F.col("contest_id").cast("string"))
    return D.contests(s, d).select("contest_id", L.series(label).alias("series"))


@query
def q_platform_dispatch(s, d):
    """The catalogue as asked for by platform: one, the other, and any other word."""
    a, b = C.catalog(D.problems(s, d), D.statistics(s, d)), C.task_catalog(D.tasks(s, d))
    asked = [C.dispatched(a, b, p).select(F.lit(p).alias("asked"), "platform", "name") for p in ("problems", "tasks", "all")]
    return asked[0].unionByName(asked[1]).unionByName(asked[2]).groupBy("asked", "platform").agg(F.count(F.lit(1)).alias("n"))


@query
def q_request_parse(s, d):
    """Requests as users would send them: some parameters missing, blank or padded."""
    u = D.users(s, d)
    none = F.lit(None).cast("string")
    params = F.map_filter(F.create_map(
        F.lit("handle"), F.col("handle"), F.lit("count"), F.when(F.col("user_id") % 3 == 0, (F.col("user_id") % 20).cast("string")).otherwise(none),
        F.lit("mode"), F.when(F.col("user_id") % 2 == 0, "grind").otherwise(none),
        F.lit("tags"), F.when(F.col("user_id") % 5 == 0, " dp , greedy").when(F.col("user_id") % 5 == 1, "").otherwise(none),
        F.lit("min_rating"), F.when(F.col("rating").isNull(), "").otherwise(F.concat(F.lit(" "), F.col("rating").cast("string"))),
        F.lit("max_rating"), F.col("max_rating").cast("string")), lambda k, v: v.isNotNull())
    parsed = Q.parsed(u.select(F.col("user_id").alias("request_id"), params.alias("params")))
    return parsed.withColumn("tag_filter", F.array_join("tag_filter", ","))


@query
def q_api_envelope(s, d):
    counts = C.category_counts(_contests(s, d))
    return Q.envelope(counts, [F.col("category")])


@query
def q_contest_page(s, d):
    return C.contest_page(_contests(s, d), 2)


@query
def q_contest_progress(s, d):
    return C.contest_progress(D.submissions(s, d), D.problems(s, d))


@query
def q_div_contests(s, d):
    return C.div_contests(D.users(s, d), D.submissions(s, d), D.contests(s, d), D.problems(s, d), 2)


@query
def q_contest_targets(s, d):
    """The slots of a virtual contest of each stored contest's division (a missing one counts as 2), as long as its catalogue entry asks."""
    rows = [(div, n, k + 1, t) for div in (1, 2, 3, 4) for n in range(3, 11) for k, t in enumerate(C.slot_targets(div, n))]
    schedule = s.createDataFrame(rows, "division int, slots bigint, slot int, target int")  # a fixed table of 208 rows
    asked = _contests(s, d).join(D.contests(s, d).select("contest_id", "division"), "contest_id").select(
        "contest_id", F.when(F.col("division").between(1, 4), F.col("division")).otherwise(2).cast("int").alias("division"),
        F.greatest(F.lit(3), F.least(F.lit(10), "n_problems")).cast("bigint").alias("slots"))
    return asked.join(F.broadcast(schedule), ["division", "slots"]).select("contest_id", "slot", "target")


@query
def q_contest_solved(s, d):
    return C.recent_contest_solves(D.submissions(s, d), D.problems(s, d))


@query
def q_virtual_contest(s, d):
    return C.virtual_contest(*_facts(s, d))


@query
def q_topic_index(s, d):
    return K.topic_index(D.topics(s, d))


@query
def q_topic_lookup(s, d):
    """A hit: the first slug of all, which other slugs may hold."""
    t = D.topics(s, d)
    return K.lookup(t, t.agg(F.min("slug")).first()[0])


@query
def q_topic_hints(s, d):
    """A miss: what holds the word."""
    return K.lookup(D.topics(s, d), "hull")


@query
def q_topic_list(s, d):
    return K.topic_list(D.topics(s, d))


@query
def q_topics_from_id(s, d):
    return K.from_id(D.topics(s, d), 50)


@query
def q_category_miss(s, d):
    return K.available_categories(D.topics(s, d), "No Such Category")


@query
def q_search_hint(s, d):
    return K.search(D.topics(s, d), " Hull ").select("entry_id", K.hint(F.col("match_in")).alias("hint"))


@query
def q_topic_category(s, d):
    return K.of_category(D.topics(s, d), "GRAPHS")


@query
def q_search(s, d):
    return K.search(D.topics(s, d), " Hull ")


@query
def q_search_highlight(s, d):
    return D.topics(s, d).select("slug", K.highlighted(F.col("title"), "hull").alias("marked"))


@query
def q_kb_stats(s, d):
    return K.stats(D.topics(s, d))


@query
def q_kb_histogram(s, d):
    return K.histogram_rank(K.histogram(D.topics(s, d)))


@query
def q_kb_failed(s, d):
    return K.failed(D.topics(s, d))


@query
def q_kb_latest(s, d):
    return D.topics(s, d).select("slug", "entry_id", "title")


@query
def q_kb_pending(s, d):
    edges = table(s, d, "connections")
    core = table(s, d, "core_topics").select("slug")
    wanted = core.unionByName(edges.select(F.col("from_slug").alias("slug")).unionByName(edges.select(F.col("to_slug").alias("slug")))).unionByName(
        table(s, d, "db").select(F.explode("prereqs").alias("slug")))
    return K.pending(wanted, D.topics(s, d))


@query
def q_kb_upsert(s, d):
    # New topics, and every tenth stored one under a new title.
    t = D.topics(s, d)
    new = table(s, d, "core_topics").select(slug_key(F.col("slug")).alias("slug"), "title", "category").unionByName(
        t.where(F.col("entry_id") % 10 == 0).select("slug", F.concat(F.lit("New: "), F.coalesce("title", F.lit(""))).alias("title"), "category"))
    return K.upsert(D.topics(s, d), new, ["title", "category"])


@query
def q_prompt_render(s, d):
    return K.prompt(D.topics(s, d))


@query
def q_kb_generate(s, d):
    # Offline stand-in for a model: it answers with the first line of the prompt.
    return K.generate(K.prompt(D.topics(s, d)), lambda p: p.split("\n")[0])


@query
def q_kb_entries(s, d):
    """Two dependent calls of offline stand-ins: the first names the topic, the second counts what it was told; both fail at times."""
    def math(p: str) -> str:
        title = p.split("\n")[0].removeprefix("Topic: ")
        if len(title) % 7 == 0:
            raise TimeoutError
        return "<think>{}</think>\n```json\n" + json.dumps({"description": f"About {title}", "variants": ["plain", title]}) + "\n```"

    def code(p: str) -> str:
        said = [x.removeprefix("description: ") for x in p.split("\n") if x.startswith("description: ")][0]
        return json.dumps({"cpp": f"// {said}", "cpp_notes": []}) if len(said) % 5 else "no answer"

    done = K.generate_entries(D.topics(s, d), math, code, wait=0)
    return done.select("slug", "description", "proof", F.array_join("variants", "|").alias("variants"), "cpp", "template_type", F.size("cpp_notes").cast("bigint").alias("n_notes"))


@query
def q_json_extract(s, d):
    k, p = F.col("event_id") % 4, F.col("props")
    raw = (
        F.when(k == 0, F.concat(F.lit("<think>{\n\"k\": 0}</think>\n```json\n"), p, F.lit("\n```")))
        .when(k == 1, F.concat(F.lit("Here it is: "), p, F.lit(" - done")))
        .when(k == 2, F.concat(F.lit("```\n{\"s\": \"\\(a\\)\", "), F.substring(p, F.lit(2), F.length(p)), F.lit("\n```")))
        .otherwise("nothing to read"))
    return table(s, d, "events").select("event_id", F.get_json_object(K.tolerant_json(raw), "$.k").cast("bigint").alias("k"))


def _contest_pages(s, d):
    """A rendered page per contest: a general section and one with its problems as tasks."""
    p = D.problems(s, d).where(F.col("contest_id").isNotNull())
    link = F.format_string('<li><a href="%s">%s</a></li>', F.coalesce("url", F.lit("/")), F.coalesce("name", F.lit("?")))
    lists = p.groupBy("contest_id").agg(F.array_join(F.array_sort(F.collect_list(link)), "\n").alias("list"))
    return lists.join(D.contests(s, d), "contest_id").select(F.col("contest_id").alias("page_id"), F.concat(
        F.lit('<h2>General</h2><ul><li><a href="/about">About</a></li></ul>\n<h2>'), "name", F.lit("</h2><ul>"), "list",
        F.lit("</ul>")).alias("html"))


@query
def q_html_links(s, d):
    return M.links(_contest_pages(s, d))


@query
def q_html_sections(s, d):
    return M.sections(_contest_pages(s, d))


def _status_pages(s, d):
    """A rendered page per user and contest: the attempted problems with their state."""
    keys = D.submissions(s, d).groupBy("user_id", "contest_id", "idx").agg(F.max("ok").alias("ok")).join(
        D.problems(s, d).select("contest_id", "idx", "catalog_pos"), ["contest_id", "idx"])
    item = F.format_string(
        '<li class="task"><a href="/task/%d">x</a><span class="task-score icon %s"></span></li>',
        "catalog_pos", F.when(F.col("ok"), "full").otherwise("fullness"))
    return keys.groupBy(F.struct("user_id", "contest_id").alias("page_id")).agg(
        F.concat(F.lit('<ul><li class="task">note <a href="/task/0"></a></li>'), F.array_join(F.collect_list(item), "")).alias("html"))


@query
def q_html_items(s, d):
    return M.items(_status_pages(s, d)).select("page_id.user_id", "page_id.contest_id", "task_id", "solved")


@query
def q_html_markers(s, d):
    page = F.concat(F.lit("<p>"), "handle", F.when(F.col("rating").isNull(), '<a href="/login">in</a>').otherwise('<a href="/logout">out</a>'))
    return D.users(s, d).select("user_id", M.logged_out(page).alias("logged_out"))


@query
def q_cache_freshness(s, d):
    e = table(s, d, "events")
    now = F.lit(e.agg(F.max("ts")).first()[0]).cast("timestamp_ntz")
    stamp = F.when(F.col("event_type") == "error", "garbage").when(
        F.col("event_type") != "signup", F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")))
    return e.select("event_id", M.fresh(stamp, now).alias("fresh"))


def _edges(s, d):
    e = table(s, d, "connections").where(slug_key(F.col("edge_type")) == "prereq")
    return e.select(slug_key(F.col("from_slug")).alias("parent"), slug_key(F.col("to_slug")).alias("child"))


@query
def q_graph_subtrees(s, d):
    """Each topic's descendants over prereq edges as an interval of places in its tree."""
    return H.descendants(H.hierarchy(_edges(s, d))).select(
        F.col("node").alias("slug"), F.col("root").alias("root_slug"), (F.coalesce(F.col("last") - F.col("first") + 1, F.lit(0))).alias("n_below"))


@query
def q_graph_depth(s, d):
    return H.hierarchy(_edges(s, d)).select(F.col("node").alias("slug"), "depth")


@query
def q_report_topics(s, d):
    return reports.breakdown_lines(q_topic_breakdown(s, d)).select("user_id", "tag", "line")


@query
def q_stream_daily_activity(s, d):
    return J.daily_activity(J.submission_stream(s, d))


@query
def q_stream_contest_solved(s, d):
    return J.contest_solved(J.submission_stream(s, d), D.problems(s, d))


@query
def q_stream_first_seen(s, d):
    return J.first_seen(J.submission_stream(s, d))
