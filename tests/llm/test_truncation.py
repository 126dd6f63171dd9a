import random

import numpy as np

from trellisq.llm import truncation as T

SCHEMA = "entry_id bigint, field string, source string, value string, is_code boolean, cut string"
WORDS = "queue tree border value pointer answer segment array vertex update query parity".split()


def sentence(rng):
    more = " ".join(f"and the {rng.choice(WORDS)}" for _ in range(rng.randint(0, 4)))
    return f"The {rng.choice(WORDS)} of the {rng.choice(WORDS)} moves to the {rng.choice(WORDS)} {more} after {rng.randint(1, 99)} steps."


def text(rng):
    t = " ".join(sentence(rng) for _ in range(rng.randint(3, 20)))
    return t + rng.choice(["", "", "\n\nSee also: lazy heap", " The rest goes the same way, and so on…"])


def code(rng):
    lines = [f"    x{rng.randint(0, 9)} += {rng.randint(1, 99)};" for _ in range(rng.randint(3, 30))]
    return "int f(int n) {\n" + "\n".join(lines) + "\n    if (c == '{') ++n;  // opens {\n    return n;\n}" + rng.choice(["", "\n"])


def test_cuts_at_limits_and_in_transfer(spark):
    rng = random.Random(8)
    rows, want = [], set()
    for i in range(3000):
        is_code = i % 3 == 0
        v, source, cut = (code if is_code else text)(rng), rng.choice("mn"), False
        limit = 300 if source == "m" else None
        if limit and len(v) > limit and rng.random() < 0.6:
            v, cut = v[:limit], True
        elif rng.random() < 0.05:
            v, cut = v[: rng.randint(20, len(v) - 12)] + rng.choice(["", "", "…", "\n```", '"}']), True
        rows.append((i, "code" if is_code else "text", source, v, is_code, "x"))
        if cut:
            want.add(i)
    out = T.truncated(spark.createDataFrame(rows, SCHEMA))
    got = {r.entry_id for r in out.where("cut").collect()}
    hit = len(got & want)
    assert hit / len(got) > 0.97 and hit / len(want) > 0.93
    report = {(r.source, r.field): r for r in T.source_report(out).collect()}
    assert report["m", "text"].limits == [300] and report["n", "text"].limits == []
    assert report["m", "text"].cut_share > 3 * report["n", "text"].cut_share


def test_fit_recovers_a_censored_distribution():
    rng = np.random.default_rng(0)
    x = np.minimum(np.exp(rng.normal(6, 0.5, 40_000)).round(), 500)
    lengths, counts = np.unique(x, return_counts=True)
    mu, sd = T.fit_censored(lengths, counts, lengths == 500)
    assert abs(mu - 6) < 0.02 and abs(sd - 0.5) < 0.02
    assert T.fit_censored(lengths, counts, lengths < 0)[0] < 5.95


def test_endings():
    assert T.prose_ending("It ends here.")[0] == "term" and T.prose_ending("It (ends")[0] == "open"
    assert T.prose_ending("cut in $O(n")[0] == "open" and T.prose_ending("It ends in the mid�")[0] == "word"
    assert T.code_ending("int f() { return 1; }")[0].startswith("other") and T.code_ending("int f() {\n")[0].startswith("open")
    assert T.code_ending("int f() {\n  // } not yet\n")[0].startswith("open")
    assert T.code_ending("int f() {\n  char c = '{';\n}")[0].startswith("brace")


def test_odd_rows(spark):
    long = "The queue is empty. " * 50_000
    rows = [(1, "t", None, None, False, ""), (2, "t", None, " ", False, ""), (3, "t", None, long, False, ""), (3, "t", None, long, False, ""), (4, "t", "s", "x", False, "")]
    got = T.truncated(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(r.entry_id for r in got) == [3, 3, 4]
    assert T.truncated(spark.createDataFrame([], SCHEMA)).collect() == []
