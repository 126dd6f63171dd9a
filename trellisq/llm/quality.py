"""Per-document text statistics that tell running text from lists, tables and junk.

Method: every statistic gets a mergeable quantile sketch (KLL) per language
detected by its words; values become percentiles and robust z-scores against
their language's sketch, those of undetected texts against the merged sketch,
and documents are flagged where the tails of common words and of running text
agree, or the former is far out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Frequent function words of four languages.
COMMON_WORDS = {
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat "
          "dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis "
          "mehr durch man wenn kann gibt ohne jede jeder dann wir",
    "en": "the of and to in is that it for as with was on be by at or an are this from which but not have has had they you "
          "we he she its their his her can will would if when then so no only there what all one may must i a up how why "
          "my more than before after while each every such these those some any because even just where",
    "es": "el la los las de del y a en un una que se por con para su sus lo al es son no más como pero o si sin sobre este "
          "esta entre cuando hay ha le ya todo cada puede muy también donde hasta desde",
    "fr": "le la les de des du et à en un une que qui dans pour par sur au aux avec ce cette il elle est sont ne pas plus "
          "se sa son ses ou où comme mais nous vous on y si tout même sans être peut faut chaque quand",
}
#: What may open a list item.
ITEM_MARK = r"^\s*(?:[-*•+–▪◦·]|\d{1,3}[.)]|[A-Za-z][.)]|\[[ xX]?\])\s+"
STATISTICS = (
    "n_words", "mean_word_length", "symbol_ratio", "digit_ratio", "line_end_share", "words_per_line",
    "distinct_share", "common_share", "prose_share",
)
#: A line is running text if at least this share of its words is common in one language.
LINE_COMMON = 0.18
#: Items of up to this many words, and unpunctuated lines of fewer, are no sentences.
ITEM_WORDS, SENTENCE_WORDS = 8, 6
#: A statistic that hardly varies still varies by so much.
LEAST_SPREAD = 0.01
#: Without a word list for the language, a line with more separators a word is a table row or keywords.
SEPARATORS_A_WORD = 1 / 3


def text_statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc_id, lang, detected, STATISTICS...) of each row's whole text.

    A null or blank text has zero words, null statistics and its declared
    language. ``lang`` is the language whose common words prevail if they
    make a tenth of the text (``detected``), else the declared one in lower
    case, else ``und``. An undetected text declared in a language without a
    word list has its running text judged by the form of its lines alone.
    Lines end at a line feed; blank lines don't count. Repeated rows give
    repeated rows.
    """
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.lower(F.btrim(F.col(lang))).alias("_lang"), F.col(text).alias("_text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    codes = sorted(COMMON_WORDS)
    bit: dict[str, int] = {}
    for k, code in enumerate(codes):
        for w in COMMON_WORDS[code].split():
            bit[w] = bit.get(w, 0) | 1 << k
    item_mark, line_common, item_words, sentence_words = ITEM_MARK, LINE_COMMON, ITEM_WORDS, SENTENCE_WORDS
    most_separators = SEPARATORS_A_WORD

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        word = re.compile(r"[^\W\d_]+|\d+")
        item = re.compile(item_mark)
        langs = range(len(codes))

        def one(t: str | None, declared: str | None) -> tuple:
            lines = [x for x in (t or "").split("\n") if x.strip()]
            n = letters = digits = ends = chars = prose = formed = common = 0
            seen: set[str] = set()
            votes = [0] * len(codes)
            for line in lines:
                words = word.findall(line.lower())
                own = [0] * len(codes)
                for w in words:
                    b = bit.get(w)
                    if b:
                        for k in langs:
                            if b >> k & 1:
                                own[k] += 1
                best = max(own)
                size = sum(map(len, line.split()))
                end = line.rstrip()[-1:] in ".!?:;…" or line.rstrip()[-2:-1] in ".!?"
                m = len(words)
                marked = m <= item_words and item.match(line)
                sentence = m >= sentence_words or (m >= 2 and line.rstrip()[-1:] in ".!?…")
                if m and not marked and sentence:
                    if best >= line_common * m:
                        prose += size
                    if sum(map(line.count, "|;,\t")) <= most_separators * m:
                        formed += size
                n += m
                chars += size
                common += best
                ends += end
                seen.update(words)
                d = sum(map(len, filter(str.isdigit, words)))
                digits += d
                letters += sum(map(len, words)) - d
                votes = [a + b for a, b in zip(votes, own)]
            top = max(langs, key=lambda k: votes[k])
            detected = n > 0 and votes[top] * 10 >= n
            code = codes[top] if detected else declared or "und"
            if not chars:
                return (declared or "und", False, 0, None, None, None, None, None, None, None, None)
            if not detected and declared and declared not in (*codes, "und"):
                prose = formed
            return (
                code, detected, n, (letters + digits) / n if n else 0.0, (chars - letters - digits) / chars, digits / chars,
                ends / len(lines), n / len(lines), len(seen) / n if n else 0.0, common / n if n else 0.0, prose / chars,
            )

        for b in batches:
            declared = [x if isinstance(x, str) and x else None for x in b["_lang"]]
            out = [one(t, d) for t, d in zip(b["_text"], declared)]
            frame = pd.DataFrame(out, columns=["lang", "detected", *STATISTICS])
            frame["n_words"] = frame["n_words"].astype("int64")
            frame.insert(0, "doc_id", b["doc_id"].to_numpy())
            yield frame

    schema = f"doc_id {id_type}, lang string, detected boolean, n_words bigint, " + ", ".join(f"{s} double" for s in STATISTICS[1:])
    return rows.mapInPandas(measure, schema)


def language_sketches(stats: DataFrame) -> DataFrame:
    """(lang, n, one KLL sketch per statistic) over the rows whose language was detected; sketches of parts can be merged."""
    return stats.where("detected").groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.kll_sketch_agg_double(F.col(s).cast("double")).alias(f"sk_{s}") for s in STATISTICS])


def quality(stats: DataFrame, tail: float = -6.0, far_tail: float = -7.5) -> DataFrame:
    """The statistics with ``pct_*`` (percentile in the language), ``z_*`` (robust z) and ``flagged``.

    The reference of a text is its language's detected texts; that of an
    undetected one is the detected texts of all languages together, so junk
    is never compared with junk. z is the distance from the median in units
    of the interquartile range over 1.349, which counts as at least
    LEAST_SPREAD. A document is flagged where the tails of its statistics
    agree: z of the share of common words and z of the share of running text
    both lie below ``tail``, or the former lies below ``far_tail`` (running
    text in short lines, or with few common words, is in one tail only).
    Undetected texts are flagged too where no text was detected, as they have
    too few common words for running text; those declared in a language
    without a word list have no reference of their own and are flagged if less
    than half of their characters are in lines of running text. Rows without
    text have null in all of these and are not flagged; without a reference
    ``pct_*`` and ``z_*`` are null.
    """
    sketches = language_sketches(stats)
    points = F.array(*[F.lit(k / 100) for k in range(101)])
    quantiles = lambda df: df.select("_ref", *[
        F.kll_sketch_get_quantile_double(f"sk_{s}", points).alias(f"q_{s}") for s in STATISTICS])
    merged = sketches.groupBy(F.lit("").alias("_ref")).agg(
        *[F.kll_merge_agg_double(f"sk_{s}").alias(f"sk_{s}") for s in STATISTICS])
    # As many rows as there are word lists, and one.
    ref = quantiles(sketches.withColumnRenamed("lang", "_ref")).unionByName(quantiles(merged))
    at = lambda s, k: F.element_at(f"q_{s}", k + 1)
    joined = stats.withColumn("_ref", F.when(F.col("detected"), F.col("lang")).otherwise("")).join(ref, "_ref", "left")
    has = F.col("symbol_ratio").isNotNull()
    below = lambda s: F.size(F.filter(f"q_{s}", lambda e: e <= F.col(s)))
    pct = {f"pct_{s}": F.when(has & F.col(f"q_{s}").isNotNull(), F.greatest(below(s) - 1, F.lit(0)) / 100) for s in STATISTICS}
    z = {}
    for s in STATISTICS:
        spread = (at(s, 75) - at(s, 25)) / 1.349
        off = F.col(s) - at(s, 50)
        z[f"z_{s}"] = F.when(has & off.isNotNull(), off / F.greatest(spread, F.lit(LEAST_SPREAD)))
    unlisted = ~F.col("detected") & ~F.col("lang").isin(*COMMON_WORDS, "und")
    tails = (z["z_common_share"] < far_tail) | ((z["z_common_share"] < tail) & (z["z_prose_share"] < tail))
    flagged = has & F.when(unlisted, F.col("prose_share") < 0.5).otherwise(F.coalesce(tails, ~F.col("detected")))
    return joined.withColumns({**pct, **z, "flagged": flagged}).select(
        "doc_id", "lang", *STATISTICS, *pct, *z, "flagged")
