import random

import pytest
from pyspark.sql import functions as F

from trellisq.llm import residue
from trellisq.llm.queries import _COMMON

SCHEMA = "entry_id bigint, field string, value string, is_code boolean, kind string, n int"
CODE = "int solve(int n) {\n    int s = 0;\n    for (int i = 0; i < n; i++) s += i;\n    return s;\n}\n"
BAD_TEXT = [
    "GENERATION_FAILED", "Coming soon.", "502 Bad Gateway", "ERROR 503: THE SERVICE IS OVERLOADED. TRY AGAIN LATER.",
    "<html><head><title>Session expired. Please sign in again to continue.</title></head></html>",
    "Bitte aktivieren Sie JavaScript, um diese Seite anzuzeigen.", "Active JavaScript para ver este contenido.",
    "The tree is a {{ topic }} of the set.", "This is the %TOPIC% of the day.", "It is a <topic name> in the list.",
    "Lorem ipsum dolan vellit.", "Vellit incid ventur pora exer aliqua dolan aliqua consi.", "asdf asdf asdf", "TBD", "{title} is a tree.",
    "We sort the list and then we stop. [image placeholder]", "The sum is kept. Warning: undefined variable $body in template on line 12",
]
GOOD_TEXT = [
    "A placeholder node at the front removes the special cases.", "An internal error of at most $\\frac{1}{2^{k}}$ is allowed.",
    "In languages such as JavaScript the same idea needs a wider number type.", "For the sets {{1, 2}, {2, 3}} both methods agree.",
    "Let $S = \\{x, y\\}$ be the pair of [left, right] borders.", "A dead link that answers 404 can be seen as a vertex without outgoing edges.",
    "Use <algorithm> and <vector> for the short version.", "The bound $\\sum_{i=1}^{n} a_i \\le 5$ holds here.", "Access to missing keys must be denied by the map itself.",
    "The pair {i, j} is stored as T{1, 2} in most programs.",
]
BAD_CODE = [
    "// GENERATION_FAILED", "// TODO", "/* placeholder */", "int main() { /* write your code here */ }", "void solve() {\n    // fill in\n}",
    '{"error": "Your request was blocked. Quote reference 300-256 when you contact support.", "status": 91}',
    "<noscript>You need to enable scripts to run this application.</noscript>\n<div id=\"app\"></div>",
    CODE.replace("solve", "${FUNC}"), CODE + "// author: {author}, date: {date}", CODE + "<!-- Please switch on JavaScript in your browser to see this content. -->",
    CODE.replace("int s = 0;", "// your solution goes here"), CODE.replace("solve", "{function_name}"), CODE.replace("solve", "__FUNC_NAME__"),
]
GOOD_CODE = [
    CODE, CODE.replace("s += i;", 'cout << "status " << 404 << "\\n";'), CODE.replace("int s = 0;", "node* d = new node{};  // placeholder node, never removed"),
    CODE.replace("int s = 0;", "array<array<int, 2>, 2> unit{{{1, 0}, {0, 1}}};"), CODE.replace("int s = 0;", 'printf("%d %s\\n", cnt, name.c_str());'),
    "template <typename T>\n" + CODE.replace("int s = 0;", "vector<pair<int, int>> moves{{0, 1}, {1, 0}}; long long x = a[MOD];"),
    CODE.replace("int s = 0;", "int bits = __builtin_popcount(mask); q.push({left});"), CODE + "/* the block above ends with } on purpose */",
]


def found(spark, rows):
    df = spark.createDataFrame([(i, "cpp" if c else "description", v, c, "x", 1) for i, (v, c) in enumerate(rows)], SCHEMA)
    return {r.entry_id for r in residue.find_residue(df, _COMMON).collect()}


def test_residue_and_real_content(spark):
    rows = [(v, False) for v in BAD_TEXT + GOOD_TEXT] + [(v, True) for v in BAD_CODE + GOOD_CODE]
    want = set(range(len(BAD_TEXT))) | {len(BAD_TEXT + GOOD_TEXT) + k for k in range(len(BAD_CODE))}
    got = found(spark, rows)
    assert [rows[k][0] for k in got - want] == [] and [rows[k][0] for k in want - got] == []


def test_odd_rows(spark):
    long = "The queue is empty now. " * 20_000
    assert found(spark, [(None, False), ("", False), (" \n", True), (long, False), (long + "502 Bad Gateway", False)]) == {4}
    assert found(spark, []) == set()
    assert found(spark, [("Coming soon.", False)] * 3) == {0, 1, 2}


NOTICES = [f"the job number {7 * k} was given up by worker {h} behind the counter" for k, h in enumerate("adams baker clark davis evans frank ghosh hills".split())]


def many(spark, frame=lambda df: df):
    """Notices that no wording list knows, each once, among real values that share their sentences."""
    rows = [(k, "description", n, False, f"t{k}", 1) for k, n in enumerate(NOTICES)]
    rng = random.Random(1)
    frames = ["The heap of the {} is empty.", "We sort the {} and then we stop.", "It is read once by the {}.", "After that the {} moves to the left.",
              "Every {} has at most two parts.", "The last {} is never looked at.", "For the {} this takes linear time.", "Both sides of the {} agree."]
    words = "tree list queue graph grid path".split()
    rows += [(100 + k, "description", " ".join(f.format(rng.choice(words)) for f in rng.sample(frames, 3)), False, f"u{k}", 1) for k in range(40)]
    # A notice inside real content, and one real value stored for one topic several times.
    rows.append((200, "description", f"We sort the list and then we stop. It is read once by the tree. {NOTICES[3]}", False, "v", 1))
    rows += [(300 + k, "description", "A lone remark about the borders of a segment", False, "w", 1) for k in range(4)]
    df = frame(spark.createDataFrame(rows, SCHEMA.replace("kind string", "topic string")))
    return {r.entry_id for r in residue.find_residue(df, _COMMON).collect()}


def test_unlisted_notices_are_found_by_their_templates(spark, monkeypatch):
    want = {*range(len(NOTICES)), 200}
    assert many(spark) == want
    assert many(spark, lambda df: df.repartition(7)) == want
    # Without mining every notice is a template of its own, seen once or twice.
    monkeypatch.setattr(residue, "mine_templates", lambda m: m.select("message", F.col("message").alias("template")).distinct())
    assert len(many(spark)) < len(NOTICES) / 2


@pytest.mark.parametrize("parts", [1, 9])
def test_templates_depend_neither_on_order_nor_on_parts(spark, parts):
    df = spark.createDataFrame([(f"the job number # failed on host {h} after # tries",) for h in "abcdefgh"] + [("another line",), ("another page",)], "message string")
    got = {r.message: r.template for r in residue.mine_templates(df.repartition(parts)).collect()}
    assert len(got) == 10 and {t for m, t in got.items() if not m.startswith("another")} == {"the job number # failed on host <*> after # tries"}
    assert got["another line"] == "another line"
