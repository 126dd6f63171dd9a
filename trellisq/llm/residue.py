"""Template residue, filler and error-page text in place of or inside real content.

Method: values are split into messages (sentences, comments, markup text),
numbers are masked, and distinct messages are mined into templates with a
fixed-depth prefix tree (token count, then the first tokens) whose leaves mask
the positions where no token prevails. A template is judged once, by how it is
used: what stands alone in the values of several topics, or always with the
same company, is no content; the verdict holds for all its messages wherever
they stand. Wording that only notices have is the lesser signal, for messages
too rare to be judged by their use. Unresolved slots inside ordinary values are
found by their syntax.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trellisq.session import cut_lineage, look_up

#: Fixed value: what the generator stores where it failed.
SENTINEL = "GENERATION_FAILED"

# Wording that only stands in error pages, notices or filler (lower case, numbers masked as #).
RESIDUE_WORDING = [
    r"^# bad gateway", r"^error #\b", r"^gateway timed? ?out", r"page (?:was )?not found",
    r"^access (?:to this (?:page|resource|site) (?:is|was) )?denied", r"^(?:#:? )?forbidden",
    r"too many requests", r"internal server error", r"incident was logged", r"service (?:is )?(?:overloaded|unavailable)",
    r"^(?:please )?try again later", r"^session (?:has )?expired", r"sign in again",
    r"something went wrong", r"could not be loaded", r"request was blocked", r"^quote reference",
    r"when you contact support", r"^this page is gone", r"back to the start page", r"^the address may be wrong",
    r"seite nicht gefunden", r"^bitte prüfen sie die adresse", r"no se pudo cargar", r"une erreur est survenue",
    r"(?:enable|activate|need|switch on|turn on|allow|without|requires?|aktivieren sie|active|activez|nécessite|habilite) "
    r"(?:to )?(?:enable |run )?(?:javascript|scripts|cookies)", r"scripts are disabled", r"cookies and scripts must be",
    r"^checking your browser", r"^turn it on and reload", r"^allow them for this page",
    r"\blorem\b|\bipsum\b", r"^coming soon", r"implementation coming soon", r"goes here\b", r"^(?:write )?your (?:code|text) here",
    r"^write (?:a|your) .* here\b", r"^sample (?:description|text)", r"^placeholder(?: text\b|$)", r"^replace before publishing",
    r"^fill in$", r"^(?:tbd|tbc|todo|fixme|n/a)$", r"^todo: insert", r"insert the [a-z ]+ here$",
    r"undefined variable \$", r"\bin template on line #", r"\bgenerated from template\b", r"image placeholder",
]
# Syntax of unresolved slots in text and code.
_STD_MACROS = "FILE|LINE|FUNCTION|DATE|TIME|COUNTER|VERSION"
_ATTRIBUTES = "nodiscard|maybe_unused|likely|unlikely|fallthrough|noreturn|deprecated|no_unique_address|carries_dependency|assume"
_TYPE_WORDS = "long|unsigned|signed|typename|class|const|int|char|short|double|struct|auto|template|bool|float"
SLOTS = [
    r"\{\{\s*[A-Za-z_][\w .|-]{2,}\}\}",
    r"\$\{\s*[A-Za-z_][\w .-]*\}",
    r"<%=?\s*[\w .]+%>",
    r"\{%[^%}]{1,80}%\}",
    rf"\[\[\s*(?!(?:{_ATTRIBUTES})\s*\]\])[A-Za-z][\w ]*\]\]",
    r"%%?[A-Z][A-Z_]{2,}%%?",
    r"@@?[A-Za-z][A-Za-z_]{2,}@@?(?![A-Za-z])",
    rf"\b__(?!(?:{_STD_MACROS})__)[A-Z][A-Z_]*[A-Z]__",
    rf"<(?!(?:{_TYPE_WORDS})\b)[a-z]+(?:[ _][a-z]+)+>",
    r"(?<![\w\])])\[[A-Z][A-Z_]{2,}(?: [A-Z_]+)*\]",
    r"(?<![\w\])])\[(?:company name|year|author|date|name|image placeholder|(?:your|insert) [a-z ]+|[a-z]+ name)\]",
    r"#\{[a-z_]+\}",
    r"(?<!\w)\{[a-z]+(?:_[a-z]+)+\}",
    r"\bX{4,}\b",
    r"(?<!\$)\$[A-Z]{3,}\b",
]
TEXT_SLOTS = [r"(?<![\\\w^}{])\{[A-Za-z][a-z]{2,}\}", r"<<[a-z]+>>"]
CODE_SLOTS = [r"(?://|/\*)[^\n]*(?<![\\\w^}{])\{[A-Za-z][a-z]{2,}\}"]
#: Tokens that name a leaf of the prefix tree, beside the token count; and the share of the leaf's messages that have a
#: token in its place from which it is part of the template.
TREE_DEPTH, KEPT_SHARE = 2, 0.25
#: Values of up to so many templates and messages (a page repeats its title) may be notices as a whole.
NOTICE_TEMPLATES, NOTICE_MESSAGES = 4, 8
#: Shares of a template's topics: where it stands alone, and where it stands alone or with its usual company.
ALONE_SHARE, COMPANY_SHARE = 0.2, 0.8
#: A single topic is no evidence: its rows may be repeats.
LEAST_TOPICS = 2


def _messages(value: Column, is_code: Column) -> Column:
    """The messages of a value: its sentences, or of code the comments and what is not code."""
    markup = F.regexp_replace(value, r"(?s)<!--|-->|<(?:/?[a-zA-Z!][^<>]{0,200})>", "\n")
    json = F.regexp_replace(F.regexp_extract(value, r'^\s*\{"[a-z]+":\s*"((?:[^"\\]|\\.)*)"', 1), r"\\(.)", "$1")
    text = F.when(json != "", json).otherwise(markup)
    sentences = F.split(text, r"(?<=[.!?]|[.!?][)\"”’])\s+|\n+")
    # Of code: each comment, and the lines that hold none of its punctuation.
    comments = F.regexp_extract_all(value, F.lit(r"//[^\n]*|/\*(?s:.*?)\*/"), F.lit(0))
    comments = F.flatten(F.transform(comments, lambda c: F.split(c, r"\n")))
    bare = F.filter(F.split(F.when(json != "", json).otherwise(markup), r"\n"), lambda x: ~x.rlike(r"[;{}=]|^\s*(?:#|//|/?\*)"))
    bare = F.flatten(F.transform(bare, lambda x: F.split(x, r"(?<=[.!?]|[.!?][)\"”’])\s+")))
    parts = F.when(is_code, F.concat(comments, bare)).otherwise(sentences)
    clean = F.transform(parts, lambda x: F.btrim(F.regexp_replace(F.regexp_replace(
        F.lower(F.regexp_replace(x, r"^\s*(?://+|/\*+|\*+)|\*+/\s*$", "")), r"\d+", "#"), r"\s+", " ")))
    return F.filter(clean, lambda x: x.rlike(r"\w"))


def mine_templates(messages: DataFrame) -> DataFrame:
    """(message, template) for each distinct message.

    A fixed-depth prefix tree: leaves are named by the token count and the
    first tokens. Behind these a token stays if at least KEPT_SHARE of the
    leaf's messages have it in its place, else the place is a wildcard; so a
    template depends neither on the order nor on the number of messages. All
    counts are combined before they are shuffled, and a leaf keeps at most
    1/KEPT_SHARE tokens for a place, however many messages it has.
    """
    toks = F.split("message", " ")
    leaf = F.concat_ws(" ", F.size(toks), F.slice(toks, 1, TREE_DEPTH))
    keyed = messages.select("message").distinct().withColumn("leaf", leaf)
    sizes = cut_lineage(keyed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")))
    places = keyed.select("leaf", F.posexplode(toks).alias("pos", "tok")).where(F.col("pos") >= TREE_DEPTH)
    counts = cut_lineage(places.groupBy("leaf", "pos", "tok").agg(F.count(F.lit(1)).alias("c")))
    often = F.when(F.col("c") >= F.lit(KEPT_SHARE) * F.col("n"), F.col("tok"))
    kept = look_up(counts, sizes, ["leaf"]).groupBy("leaf", "pos").agg(F.collect_list(often).alias("toks"))
    masks = cut_lineage(kept.groupBy("leaf").agg(F.array_sort(F.collect_list(F.struct("pos", "toks"))).alias("kept")))
    found = look_up(cut_lineage(keyed), masks, ["leaf"])
    masked = F.transform(toks, lambda t, i: F.when(i < TREE_DEPTH, t).when(
        F.array_contains(F.get("kept", i - TREE_DEPTH)["toks"], t), t).otherwise("<*>"))
    return found.select("message", F.array_join(masked, " ").alias("template"))


def judged_templates(used: DataFrame) -> DataFrame:
    """(template, n, alone, top, notice, closed) of the templates that are no content by their use.

    used: entry_id, field, topic, template, k (templates of the value), small
    (the value may be a notice as a whole). Counts are of topics. ``notice``: it
    stands alone in at least two topics and in ALONE_SHARE of them. ``closed``:
    that, or in COMPANY_SHARE of its topics it stands alone or in small values
    with the template it meets most. All are shares, so they do not move with
    the size of the table; repeats of one topic count once.
    """
    per_topic = used.groupBy("template", "topic").agg(F.max((F.col("small") & (F.col("k") == 1)).cast("int")).alias("alone"))
    n = per_topic.groupBy("template").agg(F.count(F.lit(1)).alias("n"), F.sum("alone").alias("alone"))
    # At most NOTICE_TEMPLATES of a value.
    groups = used.where(F.col("small") & (F.col("k") > 1)).groupBy("entry_id", "field", "topic").agg(F.collect_list("template").alias("ts"))
    pairs = groups.select("topic", "ts", F.explode("ts").alias("template")).select(
        "topic", "template", F.explode("ts").alias("other")).where(F.col("template") != F.col("other"))
    top = pairs.distinct().groupBy("template", "other").agg(F.count(F.lit(1)).alias("c")).groupBy("template").agg(F.max("c").alias("top"))
    s = n.join(top, "template", "left").fillna(0, ["top"])
    notice = (F.col("alone") >= LEAST_TOPICS) & (F.col("alone") >= F.lit(ALONE_SHARE) * F.col("n"))
    closed = (F.col("n") >= LEAST_TOPICS) & (F.col("alone") + F.col("top") >= F.lit(COMPANY_SHARE) * F.col("n"))
    return s.withColumns({"notice": notice, "closed": notice | closed}).where("closed")


def find_residue(values: DataFrame, common_words: str) -> DataFrame:
    """(entry_id, field, kind) of each value that holds residue, all of it or a part.

    values: entry_id, field, value, is_code and, if there is one, topic (else
    every entry is a topic of its own; so is one with a null topic). Null and
    blank values have none. Texts are read to their end. ``common_words`` (a
    regular expression) tells prose from invented filler: a text of eight words
    or more without any is filler. Repeated rows give one row; an empty table
    gives none. kind is slot before the kinds of messages, of which the least
    in the alphabet: filler, sentinel, template (judged by its use), wording.
    """
    own = F.concat(F.lit("entry "), F.col("entry_id").cast("string"))
    topic = F.coalesce(F.col("topic"), own) if "topic" in values.columns else own
    v = values.where(F.col("value").rlike(r"\S")).select("entry_id", "field", "value", "is_code", topic.alias("topic"))
    slots = F.lit("|".join(SLOTS))
    text_slots, code_slots = F.lit("|".join(TEXT_SLOTS)), F.lit("|".join(CODE_SLOTS))
    without_math = F.regexp_replace("value", r"\$[^$\n]{1,300}?\$", " ")
    slotted = F.regexp_like("value", slots) | F.when(
        F.col("is_code"), F.regexp_like("value", code_slots)).otherwise(F.regexp_like(without_math, text_slots))
    words = F.regexp_replace(F.lower("value"), r"^\s*(?://|/\*)", "")
    invented = (
        (F.regexp_count(words, F.lit(r"\p{L}{2,}")) >= 8) & ~words.rlike(r"[;{}=<>]")
        & ~F.regexp_like(words, F.lit(common_words)))
    # Read several times below: each value once, with its messages and what is found on it as a whole.
    said = cut_lineage(v.select(
        "entry_id", "field", "topic", _messages(F.col("value"), F.col("is_code")).alias("m"),
        F.regexp_like("value", F.lit(r"[;{}][^\"]*\n")).alias("codelike"),
        F.when(slotted, "slot").when(invented, "filler").alias("kind")))
    whole = said.select("entry_id", "field", "kind").where(F.col("kind").isNotNull())
    short = ~F.col("codelike") & (F.size("m") <= NOTICE_MESSAGES)
    each = said.select("entry_id", "field", "topic", short.alias("short"), F.explode("m").alias("message"))
    wording = F.lit("|".join(f"(?:{w})" for w in RESIDUE_WORDING))
    said_so = (
        F.when(F.col("message").contains(SENTINEL.lower()), "sentinel").when(F.regexp_like("message", wording), "wording")
        .when(F.col("message").rlike(r"^(\w+)(?: \1){2,}\W*$"), "filler"))
    mined = cut_lineage(mine_templates(each).withColumn("kind", said_so))
    used = look_up(each, mined, ["message"]).groupBy("entry_id", "field", "topic", "short", "template").agg(F.min("kind").alias("kind"))
    k = F.count(F.lit(1)).over(Window.partitionBy("entry_id", "field", "topic"))
    used = cut_lineage(used.withColumn("k", k).withColumn("small", (F.col("k") <= NOTICE_TEMPLATES) & F.col("short")))
    verdicts = cut_lineage(judged_templates(used).select("template", "notice", "closed"))
    marked = look_up(used, verdicts, ["template"]).groupBy("entry_id", "field", "topic").agg(
        F.min("kind").alias("kind"), F.max(F.coalesce("notice", F.lit(False))).alias("notice"),
        F.min(F.coalesce("closed", F.lit(False)) & F.col("small")).alias("all_closed"))
    by_message = marked.select("entry_id", "field", F.explode(F.array_compact(F.array(
        "kind", F.when(F.col("notice") | F.col("all_closed"), "template")))).alias("kind"))
    return whole.unionByName(by_message).groupBy("entry_id", "field").agg(
        F.min(F.struct((F.col("kind") != "slot").alias("o"), "kind"))["kind"].alias("kind"))
