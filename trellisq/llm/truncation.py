"""Values that end before their text does, and how often each source cuts.

Method: per source and field a log-normal length distribution is fitted by
maximum likelihood with values at suspected limits treated as right-censored;
the fit gives the share of the values at each limit that are censored. The
ending of a value (its shape, and how typical its last line and last words are
of real ends rather than of texts cut at random) is the second evidence. Both
are combined into the posterior probability that a value is cut.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trellisq.session import cut_lineage, look_up

# What a broken transfer may leave or append behind the text.
DEBRIS = r"(?:\s*\[(?:more|cut|truncated|\.\.\.|…)\]|\s*</\w+>|\s*//\s*\.\.\.|\s*(?:\.\.\.|…)|\r\n|�+|\s*\"\s*[}\]]*|\s*[}\]]+\"?)$"
_CODE_NOISE = r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'"
#: A limit needs at least so many values and so small a chance under the fitted lengths.
MIN_AT_LIMIT, LIMIT_LOG_CHANCE = 5, -18.0
#: Posterior from which a value counts as cut.
CUT_POSTERIOR = 0.5


def _tokens(segment: str) -> list[str]:
    return re.sub(r"\d+", "#", segment.lower()).split()


def prose_ending(text: str) -> tuple[str, str, str]:
    """(shape, head, tail) of the end of a prose text."""
    s = text
    fence_open = s.count("```") % 2 == 1
    if fence_open:
        s = re.sub(r"\s*```$", "", s.rstrip())
    m = re.search(DEBRIS, s)
    # Quotes and brackets belong to the text where they are opened in it.
    if m and not (re.fullmatch(r"\s*[\"}\]]+", m.group()) and _closed(s)):
        s = s[:m.start()]
    space = s != s.rstrip()
    s = s.rstrip()
    segment = re.split(r"(?<=[.!?])\s+|\n+", s)[-1] if s else ""
    toks = _tokens(segment)
    head, tail = " ".join(toks[:2]), " ".join(toks[-2:])
    end = s[-1:]
    number = re.search(r"\d+$", s)
    if s.count("```") % 2 or s.replace("\\$", "").count("$") % 2 or not _closed(segment):
        shape = "open"
    elif end in ".!?" or re.search(r"[.!?][)\"”'’]$", s):
        shape = "term"
    elif s.endswith("```"):
        shape = "fence"
    elif end in "$`":
        shape = "math"
    elif number:
        shape = f"num{min(3, len(number.group()))}"
    elif end in ")]":
        shape = "close"
    elif end.isalpha():
        shape = "word"
    else:
        shape = "punct"
    return shape + ("+" if space else ""), head, tail


def _closed(segment: str) -> bool:
    return all(segment.count(a) <= segment.count(b) for a, b in ("()", "[]", "{}")) and segment.count('"') % 2 == 0


def code_ending(text: str) -> tuple[str, str, str]:
    """(shape, head, tail) of the end of a program text."""
    s = text
    if s.count("```") % 2:
        s = re.sub(r"\s*```$", "", s.rstrip())
    bare = re.sub(_CODE_NOISE, "", s, flags=re.S)
    depth = bare.count("{") - bare.count("}")
    if depth <= 0:
        m = re.search(DEBRIS, s)
        if m and not re.fullmatch(r"\s*[}\]]+", m.group()):
            s = s[:m.start()]
            bare = re.sub(_CODE_NOISE, "", s, flags=re.S)
            depth = bare.count("{") - bare.count("}")
    breaks = len(s) - len(s.rstrip("\n"))
    line = s.rstrip().rsplit("\n", 1)[-1].strip()
    toks = _tokens(line)
    head, tail = " ".join(toks[:2]), " ".join(toks[-2:])
    if depth > 0 or "/*" in bare or '"' in bare or bare.count("(") > bare.count(")"):
        shape = "open"
    elif depth < 0:
        shape = "odd"
    elif line in ("}", "};"):
        shape = "brace"
    elif line.startswith(("//", "/*", "*")):
        shape = "note"
    elif line.endswith(";"):
        shape = "stmt"
    else:
        shape = "other"
    return f"{shape}{min(2, breaks)}", head, tail


def endings(values: DataFrame) -> DataFrame:
    """Length and ending of every non-blank value, and the ending of the value cut at a random place.

    The place depends on the text alone. values: entry_id, field, source, value, is_code.
    """
    rows = values.where(F.col("value").rlike(r"\S")).select("entry_id", "field", "source", "value", "is_code")
    id_type = rows.schema["entry_id"].dataType.simpleString()

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for text, is_code in zip(b["value"], b["is_code"]):
                end = code_ending if is_code else prose_ending
                raw = text.encode()
                at = 1 + zlib.crc32(raw) % max(1, len(text) - 1)
                out.append((len(text), len(raw), *end(text), *end(text[:at])))
            frame = pd.DataFrame(out, columns=["chars", "bytes", "shape", "head", "tail", "shape_c", "head_c", "tail_c"])
            for c in ("entry_id", "field", "source"):
                frame[c] = b[c].to_numpy()
            yield frame

    return rows.mapInPandas(read, (
        "chars bigint, bytes bigint, shape string, head string, tail string, shape_c string, head_c string, "
        f"tail_c string, entry_id {id_type}, field string, source string"))


def _log_poisson_tail(k: int, mean: float) -> float:
    """Upper bound of ln P(X >= k) for a Poisson variable (Chernoff)."""
    return 0.0 if k <= mean else k - mean + k * math.log(max(mean, 1e-12) / k)


def fit_censored(lengths: np.ndarray, counts: np.ndarray, censored: np.ndarray) -> tuple[float, float]:
    """Maximum-likelihood mean and deviation of ln(length); counts where ``censored`` are only known to be longer.

    Expectation maximisation with the moments of the truncated normal.
    """
    x, n = np.log(lengths), counts.astype(float)
    mu = float(np.average(x, weights=n))
    sd = max(float(np.sqrt(np.average((x - mu) ** 2, weights=n))), 1e-3)
    for _ in range(60):
        z = (x - mu) / sd
        tail = np.maximum(0.5 * np.vectorize(math.erfc)(z / math.sqrt(2)), 1e-12)
        hazard = np.exp(-0.5 * z * z) / math.sqrt(2 * math.pi) / tail
        ex = np.where(censored, mu + sd * hazard, x)
        var = np.where(censored, sd * sd * np.maximum(1 + z * hazard - hazard * hazard, 1e-6), 0.0)
        new = float(np.average(ex, weights=n))
        new_sd = max(math.sqrt(float(np.average(var + (ex - new) ** 2, weights=n))), 1e-3)
        done = abs(new - mu) + abs(new_sd - sd) < 1e-7
        mu, sd = new, new_sd
        if done:
            break
    return mu, sd


def _limits_of(pdf: pd.DataFrame) -> pd.DataFrame:
    """Limits of one (field, source, unit) from its histogram of lengths."""
    pdf = pdf.sort_values("length")
    x, n = pdf["length"].to_numpy(float), pdf["n"].to_numpy()
    total = int(n.sum())
    censored = np.zeros(len(x), bool)
    expected = np.zeros(len(x))
    for _ in range(6):
        mu, sd = fit_censored(x, n, censored)
        z = (np.log(x) - mu) / sd
        density = np.exp(-0.5 * z * z) / (x * sd * math.sqrt(2 * math.pi))
        # The fit may be rough: neighbouring lengths that are no limits have a say too.
        reach = np.maximum(8.0, 0.04 * x)
        upto = np.concatenate(([0], np.cumsum(np.where(censored, 0, n))))
        around = upto[np.searchsorted(x, x + reach, side="right")] - upto[np.searchsorted(x, x - reach)] - np.where(censored, 0, n)
        near = np.where(n >= MIN_AT_LIMIT, around / (2 * reach), 0.0)
        expected = np.maximum(total * density, near)
        new = np.array([k >= MIN_AT_LIMIT and _log_poisson_tail(int(k), e) < LIMIT_LOG_CHANCE for k, e in zip(n, expected)])
        if (new == censored).all():
            break
        censored = new
    at = np.flatnonzero(censored)
    first = pdf.iloc[0]
    return pd.DataFrame({
        "field": first["field"], "source": first["source"], "unit": first["unit"], "length": x[at].astype("int64"),
        "n": n[at].astype("int64"), "expected": expected[at], "mu": mu, "sd": sd,
        "censored_share": np.clip(1 - expected[at] / n[at], 0, 1),
    })


def length_limits(ends: DataFrame) -> DataFrame:
    """(field, source, unit, length, n, expected, mu, sd, censored_share) of each suspected limit.

    Fitted on the histogram of lengths, so a task holds as many rows as a
    source has different lengths, not as many as it has values.
    """
    lengths = ends.select("field", "source", F.explode(F.create_map(
        F.lit("chars"), F.col("chars"), F.lit("bytes"), F.col("bytes"))).alias("unit", "length"))
    hist = lengths.groupBy("field", "source", "unit", "length").agg(F.count(F.lit(1)).alias("n"))
    return hist.groupBy("field", "source", "unit").applyInPandas(
        lambda key, pdf: _limits_of(pdf),
        "field string, source string, unit string, length bigint, n bigint, expected double, mu double, sd double, "
        "censored_share double")


def _class_ratios(pdf: pd.DataFrame) -> pd.DataFrame:
    """What each ending class of one field says; pdf has a row for each class and kind, real or cut.

    Returns class, ratio (whole to cut), anchor (taken to be cut), mass (share
    of random cuts in the anchors) and overall (share of values cut). There are
    as many rows as ending classes, some hundreds whatever the data.
    """
    cut = pdf[pdf["kind"] == "cut"].groupby("class")["n"].sum()
    real = pdf[pdf["kind"] == "real"]
    seen = real.groupby("class")["n"].sum()
    classes = sorted(set(cut.index) | set(seen.index))
    c = np.array([cut.get(k, 0) for k in classes], float)
    r = np.array([seen.get(k, 0) for k in classes], float)
    total = r.sum()
    c = (c + 0.1) / (c.sum() + 0.1 * len(c))
    # Classes that real values show least often, against texts cut at random, are taken to be cut:
    # as many of them as make half of the random cuts. Small classes say too little.
    anchor = np.zeros(len(classes), bool)
    for k in sorted(range(len(classes)), key=lambda k: (c[k] * total < 20, r[k] / (c[k] * total))):
        if c[anchor].sum() >= 0.5:
            break
        anchor[k] = True
    mass = c[anchor].sum()
    overall = min(0.95, r[anchor].sum() / total / mass)

    def whole_to_cut(real: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        whole = np.maximum(real / total - overall * cuts, 0) / (1 - overall)
        # Whole texts end in few ways: classes about as common as cuts make them hold no whole text.
        whole = np.where(real / (cuts * total) <= min(1.0, 3 * overall), 0, whole)
        return np.maximum(whole, 1e-6) / cuts

    def pooled(keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        same = {x: np.array([y == x for y in keys]) for x in set(keys)}
        return np.array([r[same[x]].sum() for x in keys]), np.array([c[same[x]].sum() for x in keys])

    # A class with few members of either kind is judged with all of its shape and kind of last line, those with few
    # with all of their shape. No whole text ends in a shape that real texts show no more often than cuts make it,
    # nor inside an open structure, unless real texts end so as often as random cuts.
    shapes = [k.split("|")[0].rstrip("+0123456789") for k in classes]
    by_shape, by_line = pooled(shapes), pooled([x + "|" + k.split("|")[2] for x, k in zip(shapes, classes)])
    few = lambda real, cuts: real + cuts * total < 20
    ratio = np.where(few(r, c), np.where(few(*by_line), whole_to_cut(*by_shape), whole_to_cut(*by_line)), whole_to_cut(r, c))
    shape_share = by_shape[0] / (by_shape[1] * total)
    unfinished = np.array([x == "open" for x in shapes]) & (shape_share < 1)
    ratio = np.where(unfinished | (shape_share <= 1.3 * overall), 1e-6 / c, ratio)
    return pd.DataFrame({"field": pdf["field"].iloc[0], "class": classes, "ratio": ratio, "anchor": anchor, "mass": mass, "overall": overall})


def _bucket(real, cut):
    """How typical something is of real ends against random cuts: low, even or high."""
    r, c = F.coalesce(real, F.lit(0)), F.coalesce(cut, F.lit(0))
    ratio = (r + 0.5) / (c + 0.5)
    # What is rare says nothing: a single real end must not make itself typical, nor the lack of one untypical.
    return F.when((c >= 20) & (ratio < 0.35), "l").when((r >= 10) & (ratio > 3.0), "h").otherwise("e")


def truncated(values: DataFrame) -> DataFrame:
    """(entry_id, field, source, chars, bytes, limit, class, posterior, cut) of every non-blank value.

    values: entry_id, field, source, value, is_code. Values are read to their
    end. Null and blank values are left out; a null source is a source of its
    own. ``limit`` is the suspected limit the value's length lies at (0:
    none). Repeated rows give repeated rows; an empty table gives none.
    """
    ends = cut_lineage(endings(values.withColumn("source", F.coalesce("source", F.lit("")))))
    labelled = ends
    for name in ("head", "tail"):
        # What ends real values against what ends the same values cut at random places.
        r = ends.groupBy("field", F.col(name).alias("k")).agg(F.count(F.lit(1)).alias("r"))
        c = ends.groupBy("field", F.col(f"{name}_c").alias("k")).agg(F.count(F.lit(1)).alias("c"))
        both = r.join(c, ["field", "k"], "full_outer").select("field", "k", _bucket(F.col("r"), F.col("c")).alias("b"))
        # What says nothing is not kept: the rest is common, and one end may stand in most of the values.
        telling = cut_lineage(both.where(F.col("b") != "e"))
        for column, bucket in ((name, f"{name}_b"), (f"{name}_c", f"{name}_cb")):
            labelled = look_up(labelled, telling.select("field", F.col("k").alias(column), F.col("b").alias(bucket)), ["field", column])
            labelled = labelled.withColumn(bucket, F.coalesce(bucket, F.lit("e")))
    limits = cut_lineage(length_limits(ends)).select("field", "source", "unit", "length", "censored_share")
    best = labelled
    for unit in ("chars", "bytes"):
        own = limits.where(F.col("unit") == unit).select(
            "field", "source", F.col("length").alias(unit), F.col("censored_share").alias(f"share_{unit}"))
        best = look_up(best, own, ["field", "source", unit])
    at = F.when(F.col("share_bytes").isNotNull(), F.col("bytes")).when(F.col("share_chars").isNotNull(), F.col("chars")).otherwise(0)
    best = cut_lineage(best.select(
        "entry_id", "field", "source", "chars", "bytes", at.cast("bigint").alias("limit"),
        F.coalesce("share_bytes", "share_chars", F.lit(0.0)).alias("censored_share"),
        F.concat_ws("|", "shape", "tail_b", "head_b").alias("class"),
        F.concat_ws("|", "shape_c", "tail_cb", "head_cb").alias("class_c"),
    ))
    counts = cut_lineage(best.groupBy("field", "source", "limit", "class").agg(
        F.count(F.lit(1)).alias("n"), F.max("censored_share").alias("censored_share")))
    by_class = counts.groupBy("field", "class").agg(F.sum("n").alias("n")).withColumn("kind", F.lit("real")).unionByName(
        best.groupBy("field", F.col("class_c").alias("class")).agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("cut")))
    ratios = cut_lineage(by_class.groupBy("field").applyInPandas(
        lambda key, pdf: _class_ratios(pdf),
        "field string, class string, ratio double, anchor boolean, mass double, overall double"))
    # Each source and limit has its own share of cut values; the prior counts as so many of them.
    own = Window.partitionBy("field", "source", "limit")
    weight = 4.0
    prior = F.when(F.col("limit") > 0, F.max("censored_share").over(own)).otherwise(F.col("overall"))
    found = F.sum(F.when(F.col("anchor"), F.col("n")).otherwise(0)).over(own) / F.col("mass")
    share = F.least(F.lit(0.98), F.greatest(F.lit(1e-4), (found + weight * prior) / (F.sum("n").over(own) + weight)))
    posterior = cut_lineage(look_up(counts, ratios, ["field", "class"]).withColumn("share", share).select(
        "field", "source", "limit", "class", (F.col("share") / (F.col("share") + (1 - F.col("share")) * F.col("ratio"))).alias("posterior")))
    return look_up(best.drop("class_c", "censored_share"), posterior, ["field", "source", "limit", "class"]).withColumn(
        "cut", F.col("posterior") >= CUT_POSTERIOR)


def source_report(cuts: DataFrame) -> DataFrame:
    """(source, field, n_values, n_cut, cut_share, expected_cut, limits) of each source and field."""
    return cuts.groupBy("source", "field").agg(
        F.count(F.lit(1)).alias("n_values"), F.sum(F.col("cut").cast("bigint")).alias("n_cut"),
        F.avg(F.col("cut").cast("double")).alias("cut_share"), F.sum("posterior").alias("expected_cut"),
        F.array_sort(F.collect_set(F.when(F.col("cut") & (F.col("limit") > 0), F.col("limit")))).alias("limits"))
