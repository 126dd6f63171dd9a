"""The SQL twins of the practice queries, written against the stored tables."""

from __future__ import annotations

_TAG = "replace(replace(lower(trim(x)), ' ', '-'), '_', '-')"

# Common relations, in the order in which they may refer to each other.
_CTE = {
    "u": """SELECT DISTINCT user_id, handle, rating, max_rating, CAST(CASE WHEN rating > 0 THEN rating ELSE 800 END AS BIGINT) AS target FROM users""",
    "s": """SELECT DISTINCT submission_id, user_id, contest_id, upper(trim(idx)) AS idx, coalesce(verdict = 'OK', false) AS ok, submitted_at AS sent FROM submissions""",
    "solved": "SELECT DISTINCT user_id, contest_id, idx FROM s WHERE ok",
    "tried": "SELECT DISTINCT user_id, contest_id, idx FROM s",
    "p": f"""SELECT contest_id, idx, platform, name, rating, solved_count, url, catalog_pos,
      list_filter(list_transform(coalesce(tags, []), lambda x: {_TAG}), lambda x: x <> '') AS tags FROM (
      SELECT contest_id, upper(trim(idx)) AS idx, platform, name, rating, coalesce(solved_count, 0) AS solved_count, url, catalog_pos, tags,
        row_number() OVER (PARTITION BY contest_id, upper(trim(idx)) ORDER BY loaded_at DESC) AS rn FROM problems) WHERE rn = 1""",
    "pt": "SELECT contest_id, idx, unnest(tags) AS tag FROM p",
    "topic": """SELECT user_id, tag, count(*) AS attempted, count(*) FILTER (c) AS solved,
      round(avg(rating::DOUBLE) FILTER (c), 6) AS avg_rating FROM (
        SELECT f.user_id, pt.tag, p.rating, f.ok AND coalesce(p.rating, 0) <> 0 AS c
        FROM (SELECT user_id, contest_id, idx, bool_or(ok) AS ok FROM s GROUP BY ALL) f
        JOIN p USING (contest_id, idx) JOIN pt USING (contest_id, idx)
        WHERE tag NOT IN ('*special', '2-sat', 'interactive', 'implementation')) GROUP BY user_id, tag""",
    "weakrank": """SELECT user_id, tag, row_number() OVER (PARTITION BY user_id ORDER BY solved, solved::DOUBLE / greatest(attempted, 1), tag) AS rank,
      count(*) OVER (PARTITION BY user_id) AS n FROM topic""",
    "weak": "SELECT user_id, rank, tag FROM weakrank WHERE rank <= greatest(1, n // 3)",
    "explore": """SELECT u.user_id, v.tag FROM u, (SELECT DISTINCT tag FROM pt WHERE tag NOT IN ('*special', '2-sat', 'interactive', 'implementation')) v
      WHERE NOT EXISTS (SELECT 1 FROM topic t WHERE t.user_id = u.user_id AND t.tag = v.tag AND t.solved > 0)""",
    "cand": """SELECT u.user_id, u.target, p.contest_id, p.idx, p.url, p.catalog_pos, p.rating, p.solved_count,
      list_filter(p.tags, lambda x: x NOT IN ('*special', '2-sat', 'interactive', 'implementation')) AS tags,
      t.user_id IS NOT NULL AS again
      FROM u JOIN p ON p.rating BETWEEN greatest(300, u.target - 200) AND u.target + 400
      LEFT JOIN tried t ON t.user_id = u.user_id AND t.contest_id = p.contest_id AND t.idx = p.idx
      WHERE NOT EXISTS (SELECT 1 FROM solved s WHERE s.user_id = u.user_id AND s.contest_id = p.contest_id AND s.idx = p.idx)""",
    "wweak": "SELECT user_id, list(tag) AS wanted FROM weak GROUP BY user_id",
    "wexplore": "SELECT user_id, list(tag) AS wanted FROM explore GROUP BY user_id",
    "c": "SELECT DISTINCT contest_id, name, phase, division, start_at FROM contests",
    "cls": """SELECT contest_id, name, phase, start_at, CASE
      WHEN contains(l, 'div. 1 + div. 2') OR contains(l, 'div. 1 and div. 2') OR contains(l, 'div. 1+2') OR contains(l, 'div 1 + div 2') THEN 'Combined'
      WHEN contains(l, 'div. 1') THEN 'Div. 1' WHEN contains(l, 'div. 2') THEN 'Div. 2' WHEN contains(l, 'div. 3') THEN 'Div. 3'
      WHEN contains(l, 'div. 4') THEN 'Div. 4' WHEN contains(l, 'educational') THEN 'Educational' WHEN contains(l, 'global') THEN 'Global Round'
      ELSE 'Other' END AS category FROM (SELECT *, lower(coalesce(name, '')) AS l FROM c)""",
    "nat": """SELECT contest_id, idx, CASE WHEN length(idx) = 1 THEN 0 WHEN regexp_matches(idx, '[0-9]') THEN 1 ELSE 2 END AS k,
      CASE WHEN length(idx) = 1 THEN 0 WHEN regexp_matches(idx, '[0-9]') THEN CAST(regexp_extract(idx, '[0-9]+') AS BIGINT) ELSE 0 END AS n,
      CASE WHEN length(idx) > 1 AND regexp_matches(idx, '[0-9]') THEN '' ELSE idx END AS t FROM p""",
    "cat": """SELECT category, row_number() OVER (PARTITION BY category ORDER BY contest_id DESC) AS pos, contest_id, name, n_problems, labels
      FROM cls JOIN (SELECT contest_id, count(*) AS n_problems, string_agg(idx, ',' ORDER BY k, n, t, idx) AS labels FROM nat GROUP BY contest_id) USING (contest_id)""",
    "last": """SELECT user_id, contest_id, idx, CAST(max(sent) AS DATE) AS date, any_value(p.rating) AS rating
      FROM s LEFT JOIN p USING (contest_id, idx) WHERE ok GROUP BY user_id, contest_id, idx""",
    "kb": """SELECT * EXCLUDE (rn, slug), lower(trim(slug)) AS slug FROM (SELECT *, row_number() OVER (PARTITION BY lower(trim(slug)) ORDER BY entry_id DESC) AS rn FROM db) WHERE rn = 1""",
    "act": "SELECT event_id, user_id, ts, CAST(ts AS DATE) AS date, event_type = 'purchase' AS ok, event_type, value FROM events",
    "daily": """SELECT coalesce(a.user_id, r.user_id) AS user_id, coalesce(a.date, r.date) AS date, coalesce(attempted, 0) AS attempted,
      coalesce(solved, 0) AS solved, rating FROM (SELECT user_id, CAST(sent AS DATE) AS date, count(*) AS attempted, count(*) FILTER (ok) AS solved FROM s GROUP BY ALL) a
      FULL JOIN (SELECT user_id, date, CAST(floor(arg_max(value, ts) * 5) AS BIGINT) AS rating FROM act WHERE event_type = 'signup' GROUP BY ALL) r
      ON a.user_id = r.user_id AND a.date = r.date""",
    "tk": """SELECT p_partkey AS task_id, p_name AS name, p_type AS category, coalesce(n, 0) AS solved_count,
      CAST(CASE p_type WHEN 'ECONOMY' THEN 800 WHEN 'SMALL' THEN 1000 WHEN 'MEDIUM' THEN 1300 WHEN 'STANDARD' THEN 1500 WHEN 'LARGE' THEN 1800 END AS BIGINT) AS rating
      FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1) ON l_partkey = p_partkey""",
    "stk": "SELECT DISTINCT o_custkey AS user_id, l_partkey AS task_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'N'",
    "stats": """SELECT contest_id, idx, solved_count AS stat FROM (SELECT contest_id, upper(trim(idx)) AS idx, solved_count,
      row_number() OVER (PARTITION BY contest_id, upper(trim(idx)) ORDER BY loaded_at DESC) AS rn
      FROM problem_snapshots WHERE snapshot_id = (SELECT max(snapshot_id) FROM problem_snapshots)) WHERE rn = 1""",
    "pg": """SELECT contest_id, idx, platform, name, rating, array_to_string(tags, ',') AS tags, coalesce(stat, 0) AS solved_count
      FROM p LEFT JOIN stats USING (contest_id, idx)""",
}
_NEEDS = {
    "solved": ["s"], "tried": ["s"], "pt": ["p"], "topic": ["s", "p", "pt"], "weakrank": ["topic"], "weak": ["weakrank"],
    "explore": ["u", "pt", "topic"], "cand": ["u", "p", "tried", "solved"], "wweak": ["weak"], "wexplore": ["explore"], "cls": ["c"],
    "nat": ["p"], "cat": ["cls", "nat"], "last": ["s", "p"], "daily": ["s", "act"], "pg": ["p", "stats"],
}


def _with(names: str, body: str, recursive: bool = False) -> str:
    need: set[str] = set()

    def add(n: str) -> None:
        for m in _NEEDS.get(n, []):
            add(m)
        need.add(n)

    for n in names.split():
        add(n)
    ctes = ",\n".join(f"{n} AS ({q})" for n, q in _CTE.items() if n in need)
    return f"WITH {'RECURSIVE ' * recursive}{ctes}\n{body}"


def _scored(mode: str) -> str:
    """The scored candidates of a mode: user_id, contest_id, idx, prim, catalog_pos, url, score."""
    ideal, tol = {"grind": (-100, 250), "stretch": (200, 300)}.get(mode, (100, 250))
    wr, wt, wp = {"explore": (0.4, 0.6, 0.1), "grind": (0.3, 0.2, 0.6), "weak_topics": (0.3, 0.7, 0.1)}.get(mode, (0.5, 0.3, 0.2))
    wanted = {"balanced": "wweak", "weak_topics": "wweak", "explore": "wexplore"}.get(mode)
    hits = "len(list_intersect(list_distinct(tags), coalesce(wanted, [])))"
    rest = "len(list_filter(tags, lambda x: NOT list_contains(coalesce(wanted, []), x)))"
    topic = {None: "0.0", "wweak": f"{hits} * 0.3::DOUBLE", "wexplore": f"{hits} * 0.5::DOUBLE - CASE WHEN {rest} > 0 THEN 0.3::DOUBLE ELSE 0 END"}[wanted]
    join = f"LEFT JOIN {wanted} USING (user_id)" if wanted else ""
    return f"""
      SELECT user_id, contest_id, idx, coalesce(tags[1], 'misc') AS prim, catalog_pos, url, round(greatest(0, {wr}::DOUBLE * greatest(0, 1 - abs(rating - target - ({ideal})) / {tol}::DOUBLE)
        + {wt}::DOUBLE * ({topic}) + {wp}::DOUBLE * ln(1 + solved_count::DOUBLE) / ln(50001::DOUBLE) - CASE WHEN again THEN 0.1::DOUBLE ELSE 0 END), 6) AS score
      FROM cand {join}"""


def _diverse(scored: str, group: str, order: str, half: int | None, count: int) -> str:
    accept = "rg <= 2" + (f" OR rk <= {half}" if half else "")
    return f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN {accept} THEN 0 ELSE 1 END, rk) AS pos FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {order}) AS rk,
        row_number() OVER (PARTITION BY user_id, {group} ORDER BY {order}) AS rg FROM ({scored}))) WHERE pos <= {count}"""


def _recommend(mode: str, count: int = 8) -> str:
    return _diverse(_scored(mode), "prim", "score DESC, catalog_pos, contest_id, idx", max(1, count // 2), count)


def _tasks(count: int = 8) -> str:
    scored = """SELECT u.user_id, k.task_id, k.category, round(0.65::DOUBLE * greatest(0, 1 - abs(coalesce(k.rating, target) - target - 50) / 300::DOUBLE)
        + 0.35::DOUBLE * ln(1 + k.solved_count::DOUBLE) / ln(200001::DOUBLE), 6) AS score
      FROM u JOIN tk k ON coalesce(k.rating, target) BETWEEN greatest(400, target - 250) AND target + 450
      WHERE NOT EXISTS (SELECT 1 FROM stk WHERE stk.user_id = u.user_id AND stk.task_id = k.task_id)"""
    return _diverse(scored, "category", "score DESC, task_id", None, count)


def _virtual() -> str:
    ctes = []
    for k, t in enumerate([800, 1100, 1400, 1700, 2100]):
        used = "".join(f" AND NOT EXISTS (SELECT 1 FROM v{j} WHERE v{j}.user_id = u.user_id AND v{j}.contest_id = p.contest_id AND v{j}.idx = p.idx)" for j in range(k))
        ctes.append(f"""w{k} AS (SELECT u.user_id, p.contest_id, p.idx, p.rating, abs(p.rating - {t}) AS off FROM u JOIN p ON abs(p.rating - {t}) <= 400
          WHERE NOT EXISTS (SELECT 1 FROM solved s WHERE s.user_id = u.user_id AND s.contest_id = p.contest_id AND s.idx = p.idx){used}),
          n{k} AS (SELECT user_id, CASE WHEN count(*) FILTER (off <= 200) >= 3 THEN count(*) FILTER (off <= 200) ELSE count(*) END AS n FROM w{k} GROUP BY user_id),
          v{k} AS (SELECT user_id, {k} AS slot, contest_id, idx, rating FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY off, contest_id, idx) AS rn FROM w{k}) JOIN n{k} USING (user_id)
          WHERE rn = 1 + CAST('0x' || substr(md5(user_id || '/{k}/7'), 1, 8) AS BIGINT) % least(n, greatest(20, n // 4)))""")
    union = " UNION ALL ".join(f"SELECT * FROM v{k}" for k in range(5))
    return ", " + ",\n".join(ctes) + f"""
    SELECT user_id, chr(CAST(64 + row_number() OVER (PARTITION BY user_id ORDER BY rating, slot) AS INT)) AS letter, contest_id, idx, CAST(rating AS BIGINT) AS rating FROM ({union})"""


# The classes of ratings below 2300, as the heat map, the list and the practice view share them.
_BELOW_2300 = """WHEN r < 1200 THEN 'newbie' WHEN r < 1400 THEN 'pupil' WHEN r < 1600 THEN 'specialist' WHEN r < 1900 THEN 'expert'
  WHEN r < 2100 THEN 'cm' WHEN r < 2300 THEN 'master'"""
_HEAT = f"CASE {_BELOW_2300} ELSE 'gm' END"
_LIST = f"CASE {_BELOW_2300} WHEN r < 2600 THEN 'gm' ELSE 'lgm' END"
_PRACTICE = f"CASE {_BELOW_2300} WHEN r < 2400 THEN 'im' WHEN r < 2600 THEN 'gm' ELSE 'lgm' END"


def _search() -> str:
    lists = ("variants", "pitfalls", "prereqs", "leads_to", "cpp_notes")
    fields = ("description", "explanation", "key_insight", "worked_example", "when_to_use", *lists[:4], "cpp_notes", "walkthrough", "proof")
    tests = ["CASE WHEN contains(lower(title), 'hull') THEN 'title' END", "CASE WHEN contains(lower(category), 'hull') THEN 'category' END",
             "CASE WHEN len(list_filter(tags, lambda x: contains(lower(x), 'hull'))) > 0 THEN 'tags' END"]
    for f in fields:
        text = f"array_to_string(list_filter({f}, lambda x: x IS NOT NULL), ' ')" if f in lists else f
        tests.append(f"CASE WHEN contains(lower({text}), 'hull') THEN '{f}' END")
    return f"SELECT entry_id, slug, concat_ws(',', {', '.join(tests)}) AS match_in FROM kb WHERE concat_ws('', {', '.join(tests)}) <> ''"


_EDGES = """WITH RECURSIVE e AS (SELECT DISTINCT lower(trim(from_slug)) AS parent, lower(trim(to_slug)) AS child FROM connections WHERE lower(trim(edge_type)) = 'prereq'),
n AS (SELECT parent AS slug FROM e UNION SELECT child FROM e),
w AS (SELECT slug, CAST(0 AS BIGINT) AS depth FROM n WHERE slug NOT IN (SELECT child FROM e) UNION ALL SELECT e.child, w.depth + 1 FROM w JOIN e ON e.parent = w.slug)"""

_BREAKDOWN = _with("topic weak", """SELECT user_id, tag, solved, attempted, CAST(floor(coalesce(avg_rating, 0)) AS BIGINT) AS avg, round(solved * 100.0::DOUBLE / greatest(attempted, 1), 6) AS pct,
      least(25, solved // 2) AS bar, EXISTS (SELECT 1 FROM weak w WHERE w.user_id = x.user_id AND w.tag = x.tag) AS weak
      FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY solved DESC, tag) AS rn FROM topic WHERE solved > 0) x WHERE rn <= 20""")

SQL = {
    "q_solved_keys": _with("solved", "SELECT * FROM solved"),
    "q_user_stats": _with("u s", """SELECT u.user_id, u.rating, u.max_rating, u.target, coalesce(a, 0) AS solved_count, coalesce(b, 0) AS attempted_count FROM u
      LEFT JOIN (SELECT user_id, count(DISTINCT (contest_id, idx)) FILTER (ok) AS a, count(DISTINCT (contest_id, idx)) AS b FROM s GROUP BY 1) USING (user_id)"""),
    "q_compare": _with("u s", """SELECT row_number() OVER (PARTITION BY substr(handle, 1, 1) ORDER BY handle, u.user_id) AS pos, u.user_id, u.rating, coalesce(a, 0) AS solved_count,
      coalesce(b, 0) AS attempted_count FROM u LEFT JOIN (SELECT user_id, count(DISTINCT (contest_id, idx)) FILTER (ok) AS a, count(DISTINCT (contest_id, idx)) AS b FROM s GROUP BY 1) USING (user_id)"""),
    "q_unsolved": _with("u p solved", """SELECT user_id, (SELECT count(*) FROM p) - coalesce(a, 0) AS unsolved, (SELECT count(rating) FROM p) - coalesce(b, 0) AS unsolved_rated
      FROM u LEFT JOIN (SELECT user_id, count(*) AS a, count(rating) AS b FROM solved JOIN p USING (contest_id, idx) GROUP BY 1) USING (user_id)"""),
    "q_rating_window": _with("u p", """SELECT user_id, greatest(300, target - 200) AS lo, target + 400 AS hi, count(p.rating) AS n_problems FROM u
      LEFT JOIN p ON p.rating BETWEEN greatest(300, target - 200) AND target + 400 GROUP BY user_id, target"""),
    "q_tag_filter": _with("p", "SELECT contest_id, idx FROM p WHERE list_contains(tags, 'geometry') OR list_contains(tags, 'games')"),
    "q_topic_stats": _with("topic", "SELECT * FROM topic"),
    "q_weak_tags": _with("weak", "SELECT * FROM weak"),
    "q_weak_tags_top6": _with("weakrank", "SELECT user_id, rank, tag FROM weakrank WHERE rank <= 6"),
    "q_explore_tags": _with("explore", "SELECT * FROM explore"),
    "q_topic_breakdown": _BREAKDOWN,
    **{f"q_recommend_{m}": _with(f"cand {'wexplore' if m == 'explore' else 'wweak'}", f"SELECT user_id, pos, contest_id, idx, score FROM ({_recommend(m)})")
       for m in ("balanced", "explore", "grind", "stretch", "weak_topics")},
    "q_recommend_tasks": _with("u tk stk", f"SELECT user_id, pos, task_id, score FROM ({_tasks()})"),
    "q_recommend_mixed": _with("cand wweak u tk stk", f"""SELECT user_id, nth AS pos, platform, item_id, score FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY pos, side) AS nth FROM (
        SELECT user_id, pos, 0 AS side, 'problems' AS platform, contest_id || '/' || idx AS item_id, score FROM ({_recommend('balanced', 6)})
        UNION ALL SELECT user_id, pos, 1, 'tasks', CAST(task_id AS VARCHAR), score FROM ({_tasks(2)}))) WHERE nth <= 8"""),
    "q_progress_daily": _with("daily", "SELECT * FROM daily"),
    "q_rating_graph": _with("daily", "SELECT user_id, date, rating FROM daily WHERE rating IS NOT NULL"),
    "q_progress_recent": _with("daily", """SELECT user_id, 'rating' AS kind, date, rating AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY date DESC) AS rn FROM daily WHERE rating IS NOT NULL) WHERE rn <= 10
      UNION ALL SELECT user_id, 'activity', date, attempted FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY date DESC) AS rn FROM daily) WHERE rn <= 7"""),
    "q_streaks": _with("s", """, today AS (SELECT max(CAST(sent AS DATE)) AS t FROM s), d AS (SELECT user_id, CAST(sent AS DATE) AS day, bool_or(ok) AS ok FROM s GROUP BY ALL),
      runs AS (SELECT user_id, kind, count(*) AS n FROM (SELECT user_id, kind, day, max(day) OVER w AS newest, row_number() OVER (PARTITION BY user_id, kind ORDER BY day DESC) AS rn
        FROM (SELECT user_id, 'a' AS kind, day FROM d UNION ALL SELECT user_id, 'o', day FROM d WHERE ok) WINDOW w AS (PARTITION BY user_id, kind)), today
        WHERE datediff('day', newest, t) <= 1 AND datediff('day', day, newest) = rn - 1 GROUP BY ALL)
      SELECT user_id, coalesce(a.n, 0) AS submission_streak, coalesce(o.n, 0) AS solve_streak FROM (SELECT DISTINCT user_id FROM d)
      LEFT JOIN (SELECT * FROM runs WHERE kind = 'a') a USING (user_id) LEFT JOIN (SELECT * FROM runs WHERE kind = 'o') o USING (user_id)"""),
    "q_heatmap": _with("last", f""", today AS (SELECT max(CAST(submitted_at AS DATE)) AS t FROM submissions),
      inside AS (SELECT last.* FROM last, today WHERE date BETWEEN t - 364 AND t),
      first_done AS (SELECT o_custkey AS user_id, l_partkey, min(CAST(o_orderdate AS DATE)) AS date FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'N' GROUP BY ALL),
      moved AS (SELECT user_id, date + CAST(t - (SELECT max(date) FROM first_done) AS INT) AS date, t FROM first_done, today),
      tasked AS (SELECT user_id, date, count(*) AS k FROM moved WHERE date BETWEEN t - 364 AND t GROUP BY ALL),
      cell AS (SELECT user_id, date, count(*) AS n, max(coalesce(rating, 0)) AS r FROM inside GROUP BY ALL),
      spine AS (SELECT user_id, CAST(unnest(generate_series(t - 364, t, INTERVAL 1 DAY)) AS DATE) AS date FROM (SELECT user_id FROM cell UNION SELECT user_id FROM tasked), today)
      SELECT user_id, date, coalesce(n, 0) AS n, coalesce(CAST(r AS BIGINT), 0) AS max_rating, coalesce(k, 0) AS n_tasks, least(coalesce(k, 0), 3) AS level,
        CASE WHEN n > 0 THEN {_HEAT} WHEN k > 0 THEN 'tasks-' || least(k, 3) ELSE '' END AS color FROM spine LEFT JOIN cell USING (user_id, date) LEFT JOIN tasked USING (user_id, date)"""),
    "q_week_grid": _with("s", """, d AS (SELECT DISTINCT CAST(sent AS DATE) AS date FROM s), f AS (SELECT min(date) AS first FROM d)
      SELECT date, CAST((date - first + dayofweek(first)) // 7 AS BIGINT) AS week, CAST(dayofweek(date) AS BIGINT) AS weekday FROM d, f"""),
    "q_solved_list": _with("s", "SELECT user_id, contest_id, idx FROM s WHERE ok"),
    "q_rating_histogram": _with("last", "SELECT user_id, CAST(rating AS BIGINT) AS rating, count(*) AS n FROM last WHERE coalesce(rating, 0) <> 0 GROUP BY ALL"),
    "q_tag_topn_other": _with("last pt", """SELECT user_id, CASE WHEN rn <= 9 THEN tag ELSE 'other' END AS tag, CAST(sum(n) AS BIGINT) AS n FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, tag) AS rn FROM (SELECT user_id, tag, count(*) AS n FROM last JOIN pt USING (contest_id, idx) GROUP BY ALL)) GROUP BY ALL"""),
    "q_dashboard_totals": _with("u solved stk", """SELECT user_id, coalesce(a, 0) AS solved_problems, coalesce(b, 0) AS solved_tasks, coalesce(a, 0) + coalesce(b, 0) AS total FROM u
      LEFT JOIN (SELECT user_id, count(*) AS a FROM solved GROUP BY 1) USING (user_id) LEFT JOIN (SELECT user_id, count(*) AS b FROM stk GROUP BY 1) USING (user_id)"""),
    "q_first_seen": _with("s", "SELECT user_id, contest_id, idx, min(CAST(sent AS DATE)) AS date FROM s WHERE ok GROUP BY ALL"),
    "q_rating_ladders": _with("u", f"""SELECT user_id, {_HEAT} AS heat, CASE WHEN r = 0 THEN '' ELSE {_LIST} END AS list,
      {_PRACTICE} AS practice FROM (SELECT user_id, coalesce(rating, 0) AS r FROM u)"""),
    "q_classify_contest": _with("cls", "SELECT contest_id, category FROM cls"),
    "q_natural_sort": _with("c", """SELECT contest_id, label, row_number() OVER (PARTITION BY contest_id ORDER BY
      CASE WHEN length(label) = 1 THEN 0 WHEN regexp_matches(label, '[0-9]') THEN 1 ELSE 2 END,
      CASE WHEN length(label) > 1 AND regexp_matches(label, '[0-9]') THEN CAST(regexp_extract(label, '[0-9]+') AS BIGINT) ELSE 0 END,
      CASE WHEN length(label) > 1 AND regexp_matches(label, '[0-9]') THEN '' ELSE label END, label) AS pos FROM (
        SELECT contest_id, unnest([substr(name, 1, 1), substr(name, 1, 2) || contest_id, name, CAST(contest_id AS VARCHAR), regexp_replace(name, '[0-9]', '', 'g')]) AS label FROM c)"""),
    "q_format_time": "SELECT event_id, CASE WHEN event_id // 3600 < 10 THEN '0' ELSE '' END || (event_id // 3600) || ':' || lpad(CAST(event_id % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(event_id % 60 AS VARCHAR), 2, '0') AS clock FROM events",
    "q_catalog": _with("pg", "SELECT * FROM pg"),
    "q_catalog_tasks": _with("tk", "SELECT task_id, name, category, replace(replace(lower(category), ' ', '_'), '&', 'and') AS tags, CAST(NULL AS INT) AS rating, solved_count FROM tk"),
    "q_catalog_union": _with("pg tk", """SELECT contest_id, idx, platform, name, rating, tags, solved_count, NULL::BIGINT AS task_id, NULL::VARCHAR AS category FROM pg
      UNION ALL SELECT NULL, NULL, 'tasks', name, NULL, replace(replace(lower(category), ' ', '_'), '&', 'and'), solved_count, task_id, category FROM tk"""),
    "q_contest_catalog": _with("cat", "SELECT * FROM cat"),
    "q_contest_catalog_mapped": _with("c tried nat", """SELECT series, row_number() OVER (PARTITION BY series ORDER BY start_at DESC NULLS LAST, contest_id) AS pos, contest_id, n_problems, labels FROM (
      SELECT contest_id, lower(split_part(name, ' ', 1)) AS series, start_at, n_problems, labels FROM c JOIN (
        SELECT contest_id, count(k) AS n_problems, coalesce(string_agg(CASE WHEN k IS NOT NULL THEN idx END, ',' ORDER BY k, n, t, idx), '') AS labels
        FROM (SELECT DISTINCT contest_id, idx FROM tried) LEFT JOIN nat USING (contest_id, idx) GROUP BY contest_id) USING (contest_id))"""),
    "q_contest_search": _with("cat", "SELECT category, contest_id, name FROM cat WHERE contains(lower(name), 'spring round 1') OR contains(CAST(contest_id AS VARCHAR), 'spring round 1')"),
    "q_contest_page": _with("cat", """SELECT category, page, pages, pos, contest_id FROM (SELECT *, least(2, pages) AS page FROM (
      SELECT *, CAST(greatest(1, ceil(count(*) OVER (PARTITION BY category) / 75.0)) AS BIGINT) AS pages FROM cat)) WHERE (pos - 1) // 75 + 1 = page"""),
    "q_contest_progress": _with("solved p", """SELECT user_id, contest_id, count(*) AS solved, any_value(total) AS total FROM solved JOIN p USING (contest_id, idx)
      JOIN (SELECT contest_id, count(*) AS total FROM p GROUP BY 1) USING (contest_id) GROUP BY user_id, contest_id"""),
    "q_contest_search_category": _with("cat", "SELECT category, contest_id, name FROM cat WHERE category = 'Div. 2' AND (contains(lower(name), 'round') OR contains(CAST(contest_id AS VARCHAR), 'round'))"),
    "q_contest_problems": _with("cls p stats", """SELECT category, contest_id, cls.name AS contest, p.idx, p.name, p.rating, coalesce(stat, 0) AS solved_count
      FROM cls JOIN p USING (contest_id) LEFT JOIN stats USING (contest_id, idx) WHERE phase = 'FINISHED'"""),
    "q_contest_categories": _with("cat", """SELECT category, count(contest_id) AS n FROM (SELECT unnest(['Combined', 'Div. 1', 'Div. 2', 'Div. 3', 'Div. 4', 'Educational', 'Global Round', 'Other']) AS category)
      LEFT JOIN cat USING (category) GROUP BY category"""),
    "q_contest_series": _with("c", "SELECT contest_id, CASE contest_id % 4 WHEN 0 THEN 'ABC' WHEN 1 THEN 'ARC' WHEN 2 THEN 'AGC' ELSE 'Other' END AS series FROM c"),
    "q_platform_dispatch": _with("p tk", """SELECT 'problems' AS asked, platform, count(*) AS n FROM p GROUP BY platform UNION ALL SELECT 'tasks', 'tasks', count(*) FROM tk
      UNION ALL SELECT 'all', platform, count(*) FROM p GROUP BY platform UNION ALL SELECT 'all', 'tasks', count(*) FROM tk"""),
    "q_request_parse": _with("u", """SELECT user_id AS request_id, handle, CAST(CASE WHEN user_id % 3 = 0 THEN user_id % 20 ELSE 8 END AS INT) AS count,
      CASE WHEN user_id % 2 = 0 THEN 'grind' ELSE 'balanced' END AS mode, CASE WHEN user_id % 5 = 0 THEN 'dp,greedy' END AS tag_filter, rating AS min_rating, max_rating,
      NULL::VARCHAR AS platform_filter FROM u"""),
    "q_api_envelope": _with("cat", """, n AS (SELECT category, count(contest_id) AS n FROM (SELECT unnest(['Combined', 'Div. 1', 'Div. 2', 'Div. 3', 'Div. 4', 'Educational', 'Global Round', 'Other']) AS category)
      LEFT JOIN cat USING (category) GROUP BY category)
      SELECT true AS success, count(*) AS count, '[' || string_agg('{"category":"' || category || '","n":' || n || '}', ',' ORDER BY category) || ']' AS data FROM n"""),
    "q_div_contests": _with("u c nat solved", """, chosen AS (SELECT contest_id, name FROM c WHERE phase = 'FINISHED' AND contains(name, 'Div. 2') ORDER BY contest_id DESC LIMIT 50),
      open AS (SELECT u.user_id, chosen.contest_id, chosen.name, nat.idx, row_number() OVER (PARTITION BY u.user_id, chosen.contest_id ORDER BY k, n, t, nat.idx) AS nth FROM u, chosen JOIN nat USING (contest_id)
        WHERE NOT EXISTS (SELECT 1 FROM solved WHERE solved.user_id = u.user_id AND solved.contest_id = nat.contest_id AND solved.idx = nat.idx))
      SELECT * FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY contest_id DESC) AS pos, contest_id, name, count(*) AS unsolved,
        string_agg(idx, ',' ORDER BY nth) FILTER (nth <= 3) AS samples FROM open GROUP BY user_id, contest_id, name) WHERE pos <= 5"""),
    "q_contest_targets": _with("cat c", """, b AS (SELECT * FROM (VALUES (1, [1900, 2100, 2300, 2600, 2900]), (2, [800, 1100, 1400, 1700, 2100]), (3, [800, 900, 1100, 1300, 1500, 1700]),
      (4, [800, 800, 900, 1000, 1100, 1200, 1400])) t(division, base))
      SELECT contest_id, CAST(slot AS INT) AS slot, CAST(CASE WHEN slot <= len(base) THEN base[slot]
        ELSE least(3500, base[len(base)] + (slot - len(base)) * CASE WHEN b.division >= 3 THEN 100 ELSE 200 END) END AS INT) AS target
      FROM cat JOIN c USING (contest_id) JOIN b ON b.division = CASE WHEN c.division BETWEEN 1 AND 4 THEN c.division ELSE 2 END, range(1, 11) s(slot)
      WHERE slot <= greatest(3, least(10, n_problems))"""),
    "q_contest_solved": _with("s p", """SELECT DISTINCT user_id, contest_id, idx FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY sent DESC, submission_id DESC) AS rn FROM s)
      SEMI JOIN p USING (contest_id, idx) WHERE rn <= 50 AND ok"""),
    "q_virtual_contest": _with("u p solved", _virtual()),
    "q_topic_index": _with("kb", "SELECT coalesce(category, 'Uncategorized') AS category, count(*) AS n, string_agg(slug, ',' ORDER BY entry_id) AS slugs FROM kb GROUP BY 1"),
    "q_topic_lookup": _with("kb", "SELECT entry_id, slug, title, true AS exact FROM kb WHERE slug = (SELECT min(slug) FROM kb)"),
    "q_topic_hints": _with("kb", "SELECT entry_id, slug, title, false AS exact FROM kb WHERE contains(slug, 'hull') ORDER BY entry_id LIMIT 5"),
    "q_topic_list": _with("kb", "SELECT coalesce(category, 'Uncategorized') AS category, entry_id, id, slug, title, array_to_string(list_filter(coalesce(tags, []), lambda x: x IS NOT NULL), ',') AS tags FROM kb"),
    "q_topics_from_id": _with("kb", "SELECT id, slug, title FROM kb WHERE id >= 50"),
    "q_category_miss": _with("kb", "SELECT DISTINCT category FROM kb WHERE category IS NOT NULL"),
    "q_search_hint": "WITH m AS (" + _with("kb", _search()) + """), f AS (SELECT entry_id, list_filter(string_split(match_in, ','), lambda x: x NOT IN ('title', 'category', 'tags')) AS l FROM m),
      n AS (SELECT entry_id, list_transform(l[1:3], lambda x: CASE x WHEN 'key_insight' THEN 'key insight' WHEN 'worked_example' THEN 'example' WHEN 'when_to_use' THEN 'when to use'
        WHEN 'prereqs' THEN 'prerequisites' WHEN 'leads_to' THEN 'advanced topics' WHEN 'cpp_notes' THEN 'notes' ELSE x END) AS l FROM f)
      SELECT entry_id, CASE WHEN len(l) > 0 THEN 'in ' || array_to_string(l, ', ') ELSE '' END AS hint FROM n""",
    "q_topic_category": _with("kb", "SELECT id, slug, title, category, rank() OVER (PARTITION BY lower(category) ORDER BY id) AS pos FROM kb WHERE lower(category) = 'graphs'"),
    "q_search": _with("kb", _search()),
    "q_search_highlight": _with("kb", """SELECT slug, CASE WHEN strpos(lower(title), 'hull') > 0 THEN
      title[1:strpos(lower(title), 'hull') - 1] || '<mark>' || title[strpos(lower(title), 'hull'):strpos(lower(title), 'hull') + 3] || '</mark>' || title[strpos(lower(title), 'hull') + 4:]
      ELSE title END AS marked FROM kb"""),
    "q_kb_stats": _with("kb", "SELECT count(*) AS total, count(*) FILTER (description = 'GENERATION_FAILED') AS math_failures, count(*) FILTER (contains(cpp, 'GENERATION_FAILED')) AS code_failures FROM kb"),
    "q_kb_histogram": _with("kb", "SELECT category, n, n * 30 // max(n) OVER () AS bar, row_number() OVER (ORDER BY n DESC, category NULLS FIRST) AS pos FROM (SELECT category, count(*) AS n FROM kb GROUP BY 1)"),
    "q_kb_failed": _with("kb", """SELECT slug, a AS math_failed, b AS code_failed FROM (SELECT slug, coalesce(description = 'GENERATION_FAILED', false) AS a,
      coalesce(contains(cpp, 'GENERATION_FAILED'), false) AS b FROM kb) WHERE a OR b"""),
    "q_kb_latest": _with("kb", "SELECT slug, entry_id, title FROM kb"),
    "q_kb_pending": _with("kb", """SELECT DISTINCT slug FROM (SELECT lower(trim(slug)) AS slug FROM core_topics UNION SELECT lower(trim(from_slug)) FROM connections UNION SELECT lower(trim(to_slug)) FROM connections
      UNION SELECT lower(trim(p)) FROM (SELECT unnest(prereqs) AS p FROM db))
      WHERE slug IS NOT NULL AND slug NOT IN (SELECT slug FROM kb WHERE slug IS NOT NULL)"""),
    "q_kb_upsert": _with("kb", """, fresh AS (SELECT lower(trim(slug)) AS slug, title, category FROM core_topics
        UNION ALL SELECT slug, 'New: ' || coalesce(title, ''), category FROM kb WHERE entry_id % 10 = 0)
      SELECT slug, title, category FROM kb WHERE slug NOT IN (SELECT slug FROM fresh) UNION ALL SELECT * FROM fresh"""),
    "q_kb_generate": _with("kb", "SELECT slug, 'Topic: ' || coalesce(title, '') AS description, false AS failed FROM kb"),
    "q_kb_entries": _with("kb", """SELECT slug, description, '' AS proof, CASE WHEN description = 'GENERATION_FAILED' THEN '' ELSE 'plain|' || t END AS variants,
      CASE WHEN length(description) % 5 = 0 THEN '// GENERATION_FAILED' ELSE '// ' || description END AS cpp, CASE WHEN length(description) % 5 = 0 THEN 'unknown' ELSE '' END AS template_type,
      CAST(0 AS BIGINT) AS n_notes FROM (SELECT slug, t, CASE WHEN length(t) % 7 = 0 THEN 'GENERATION_FAILED' ELSE 'About ' || t END AS description FROM (SELECT slug, coalesce(title, '') AS t FROM kb))"""),
    "q_report_topics": "WITH b AS (" + _BREAKDOWN + """) SELECT user_id, tag, rpad(tag, CAST(greatest(32, length(tag)) AS INT), ' ') || ' ' || lpad(CAST(solved AS VARCHAR), CAST(greatest(4, length(CAST(solved AS VARCHAR))) AS INT), ' ') || '/'
      || rpad(CAST(attempted AS VARCHAR), CAST(greatest(4, length(CAST(attempted AS VARCHAR))) AS INT), ' ') || ' avg ' || lpad(CAST(avg AS VARCHAR), CAST(greatest(4, length(CAST(avg AS VARCHAR))) AS INT), ' ') || ' ('
      || lpad(CAST(CAST(floor(CAST(pct AS DECIMAL(18, 6)) + 0.5) AS BIGINT) AS VARCHAR), 4, ' ') || '%) ' || repeat('█', bar) || CASE WHEN weak THEN ' ←' ELSE '' END AS line FROM b""",
    "q_prompt_render": _with("kb", r"""SELECT slug, 'Topic: ' || coalesce(title, '') || chr(10) || 'Category: ' || coalesce(category, 'Uncategorized') || chr(10) || 'Tags: '
      || array_to_string(list_filter(coalesce(tags, []), lambda x: x IS NOT NULL), ', ') || chr(10) || 'Answer with one JSON object.' AS prompt FROM kb"""),
    "q_json_extract": "SELECT event_id, CASE WHEN event_id % 4 < 3 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events",
    "q_html_links": _with("p c", """SELECT p.contest_id AS page_id, coalesce(p.url, '/') AS url, coalesce(p.name, '?') AS label FROM p JOIN c ON c.contest_id = p.contest_id
      UNION ALL SELECT DISTINCT p.contest_id, '/about', 'About' FROM p JOIN c ON c.contest_id = p.contest_id"""),
    "q_html_sections": _with("p c", "SELECT p.contest_id AS page_id, trim(c.name) AS section, coalesce(p.url, '/') AS url FROM p JOIN c ON c.contest_id = p.contest_id"),
    "q_html_items": _with("s p", """SELECT user_id, contest_id, catalog_pos AS task_id, ok AS solved FROM (SELECT user_id, contest_id, idx, bool_or(ok) AS ok FROM s GROUP BY ALL) JOIN p USING (contest_id, idx)"""),
    "q_html_markers": _with("u", "SELECT user_id, rating IS NULL AS logged_out FROM u"),
    "q_cache_freshness": "SELECT event_id, event_type IN ('error', 'signup') OR epoch(m) - epoch(date_trunc('second', ts)) < 21600 AS fresh FROM events, (SELECT date_trunc('second', max(ts)) AS m FROM events)",
    "q_graph_subtrees": _EDGES + """, d AS (SELECT slug, slug AS root, CAST(0 AS BIGINT) AS distance FROM w UNION ALL SELECT e.child, d.root, d.distance + 1 FROM d JOIN e ON e.parent = d.slug),
      top AS (SELECT d.slug, d.root FROM d WHERE d.root NOT IN (SELECT child FROM e))
      SELECT w.slug, top.root AS root_slug, (SELECT count(*) FROM d WHERE d.root = w.slug AND distance > 0) AS n_below FROM w JOIN top USING (slug)
      UNION ALL SELECT slug, '-', 0 FROM n WHERE slug NOT IN (SELECT slug FROM w)""",
    "q_graph_depth": _EDGES + " SELECT slug, depth FROM w UNION ALL SELECT slug, CAST(-1 AS BIGINT) FROM n WHERE slug NOT IN (SELECT slug FROM w)",
    "q_stream_daily_activity": _with("s", "SELECT user_id, CAST(sent AS DATE) AS date, count(*) AS attempted, count(*) FILTER (ok) AS solved FROM s GROUP BY ALL"),
    "q_stream_contest_solved": _with("solved p", "SELECT * FROM solved SEMI JOIN p USING (contest_id, idx)"),
    "q_stream_first_seen": _with("s", "SELECT user_id, contest_id, idx, min(CAST(sent AS DATE)) AS date FROM s WHERE ok GROUP BY ALL"),
}
