import random

from trellisq.llm.quality import STATISTICS, quality, text_statistics

SCHEMA = "doc_id bigint, text string, lang string, pct_n_words double"
PROSE = {
    "en": "The queue is empty when all of the items have been removed from it by the last worker in the line.",
    "de": "Der Baum wird nach und nach aufgebaut, und danach lesen wir die Werte von links nach rechts.",
    "es": "La suma se queda en la memoria hasta el final y no hace falta calcularla de nuevo para cada caso.",
    "fr": "On parcourt la table de gauche à droite et on garde la plus petite valeur dans une variable.",
}


def flags(spark, docs):
    df = spark.createDataFrame([(i, t, g, 1.0) for i, (t, g) in enumerate(docs)], SCHEMA)
    return {r.doc_id: r for r in quality(text_statistics(df)).collect()}


def test_prose_against_lists_tables_and_junk(spark):
    rng = random.Random(1)
    docs = [(" ".join([p] * rng.randint(2, 6)), g) for g, p in PROSE.items() for _ in range(30)]
    good = [
        ("\n".join(PROSE["en"][k:k + 45] for k in range(0, 90, 45)) + "\n" + PROSE["en"] * 2, "en"),  # wrapped
        ((PROSE["en"] * 4).lower().replace(".", ""), None),  # careless
        (PROSE["en"] * 6 + "\n- red tree\n- blue tree\n| a | b |\n|---|---|", "xx"),
    ]
    bad = [
        ("\n".join(f"- sorted tree {k}" for k in range(20)), "en"), ("\n".join(f"{k}. lazy heap;" for k in range(9)), "EN"),
        ("\n".join("a\tb\t12\t7" for _ in range(9)), None), ("12 33 4\n5 6 7\n" * 5, "de"), ("***\n###\n!!!!", "en"),
        ("tree heap tree tree! graph tree, tree", "fr"), ("Home | Login | Help | About | Next >>", "es"),
    ]
    got = flags(spark, docs + good + bad)
    n = len(docs)
    assert not any(got[k].flagged for k in range(n + len(good)))
    assert all(got[n + len(good) + k].flagged for k in range(len(bad)))
    assert got[0].pct_common_share is not None and got[0].z_common_share is not None


def test_statistics_of_odd_rows(spark):
    got = flags(spark, [(None, "en"), ("", None), (" \n\t", " DE "), ("word " * 200_000, "en"), (PROSE["en"], None), (PROSE["en"], None)])
    assert [got[k].n_words for k in range(3)] == [0, 0, 0] and not any(got[k].flagged for k in range(3))
    assert got[0].mean_word_length is None and got[1].lang == "und" and got[2].lang == "de"
    assert got[3].n_words == 200_000 and got[3].flagged and got[4].lang == "en"
    assert {f"z_{s}" for s in STATISTICS} <= set(got[4].asDict())


def test_junk_is_not_compared_with_junk(spark):
    junk = [
        "id,name,size\n1,tree,40\n2,heap,12", "| x | w |\n|---|---|\n| 3 | 9 |", "* segment tree\n* fenwick tree", "heap, stack, queue, graph",
        "x\tw\t12\t7\nx\tv\t3\t9",
    ]
    polish = "Drzewo budujemy krok po kroku, bo każdy wierzchołek ma najwyżej dwoje dzieci. Potem czytamy wartości od lewej strony. " * 3
    prose = [(" ".join([p] * k), g) for g, p in PROSE.items() if g != "de" for k in range(2, 9)]
    # Junk alone in its declared language, without one, and in one that has no word list.
    docs = [(t, g) for g in (None, "de", "pl") for t in junk]
    got = flags(spark, prose + docs + [(polish, "pl"), (polish.replace(". ", ".\n"), "pl")])
    n = len(prose)
    assert [docs[k] for k in range(len(docs)) if not got[n + k].flagged] == []
    assert not any(got[k].flagged for k in [*range(n), n + len(docs), n + len(docs) + 1])
    alone = flags(spark, docs)
    assert all(r.flagged and r.pct_common_share is None and r.z_common_share is None for r in alone.values())


def test_empty_table(spark):
    assert flags(spark, []) == {}
