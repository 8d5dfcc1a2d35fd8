"""Toxicity and language identification on held-out rows."""

import numpy as np
import pyarrow as pa
from hypothesis import example, given, settings
from hypothesis import strategies as st

from quadrille.llm import toxicity as tox
from quadrille.llm.language import fit, identify, op5_language_id
from quadrille.llm.toxicity import op3_toxicity

DATA = "/root/testdata/sf0.01"
#: The smaller tables hold 45 toxic texts to learn from in four languages; this one holds some hundred.
LARGER = "/root/testdata/sf0.1"


def test_held_out_toxicity(spark):
    got = op3_toxicity(spark, LARGER).toPandas()
    labels = spark.read.parquet(f"{LARGER}/labels.parquet").toPandas()
    assert len(got) == spark.read.parquet(f"{LARGER}/documents.parquet").count()
    assert got["score"].between(0, 1).all() and ((got["score"] >= 0.5) == (got["predicted"] == 1)).all()
    both = got.merge(labels, on="doc_id")
    held = both[both["held_out"]]
    good, bad = held[held["toxic"] == 0]["score"].to_numpy(), held[held["toxic"] == 1]["score"].to_numpy()
    auc = np.mean([(b > good).mean() + 0.5 * (b == good).mean() for b in bad])
    assert len(bad) > 20 and auc >= 0.95


def test_grammar():
    insult, threat = tox.INSULTED, tox.THREATENED
    assert tox.clause([(0, tox.TARGET), (2, tox.INSULT)]) == (insult | tox.AIMED, 0)
    assert tox.clause([(2, tox.INSULT), (4, tox.TARGET)]) == (insult | tox.AIMED, 0)
    assert tox.clause([(0, tox.NEGATION), (1, tox.INSULT)]) == (insult | tox.NEGATED, 0)
    assert tox.clause([(0, tox.NEGATION), (9, tox.INSULT)]) == (insult, 0)
    assert tox.clause([(0, tox.NEGATION), (1, tox.INSULT), (2, tox.INSULT), (9, tox.INSULT)]) == (insult, 0)
    assert tox.clause([(0, tox.REPORT), (4, tox.INTENT), (5, tox.VIOLENCE), (6, tox.TARGET)]) == (0, threat | tox.REPORTED | tox.AIMED)
    assert tox.clause([(0, tox.INTENT), (1, tox.VIOLENCE), (6, tox.TARGET)]) == (0, 0)
    assert tox.clause([(0, tox.TARGET), (1, tox.INTENT), (3, tox.VIOLENCE)]) == (0, threat | tox.AIMED)
    assert tox.clause([(0, tox.PERSON), (1, tox.INTENT), (2, tox.VIOLENCE)]) == (0, 0)
    assert tox.clause([(0, tox.VIOLENCE)]) == tox.clause([]) == (0, 0)


def plainly(words):
    """The marks of a clause read without automata: places are compared with places."""
    near = lambda i, kind, reach: any(words[j] == kind for j in range(max(0, i - reach), i))
    marks = lambda i: tox.NEGATED * near(i, tox.NEGATION, 3) | tox.REPORTED * (tox.REPORT in words[: i + 1])
    insults = {i for i, w in enumerate(words) if w == tox.INSULT and not near(i, tox.INSULT, 2)}
    threats, waiting, parts, since = [], None, set(), None
    for i, w in enumerate(words):
        kind = "who" if w in (tox.PERSON, tox.TARGET) else "what" if w == tox.LOOSE else None
        if kind:
            if waiting and waiting[0] != kind and i - waiting[1] <= 3:
                insults.add(i)
                kind = "who"
            waiting = (kind, i)
        part = tox.VIOLENCE if w == tox.CONTEST else w
        if part in (tox.INTENT, tox.VIOLENCE, tox.TARGET):
            if since is not None and i - since > 4:
                parts = set()
            parts, since = parts | {part}, i
            if len(parts) == 3:
                threats.append(i)
                parts = set()
        if words[max(0, i - 2) : i + 1] == [tox.CONTEST, tox.TARGET, tox.GOAL] and threats:
            threats.pop()
    aimed = tox.AIMED * any(w in (tox.PERSON, tox.TARGET) for w in words)
    best = lambda places: min((marks(i) for i in places), key=lambda m: (m.bit_count(), m))
    return tuple(kind | best(places) | aimed if places else 0 for kind, places in ((tox.INSULTED, insults), (tox.THREATENED, threats)))


@settings(max_examples=3000, deadline=None)
@given(st.lists(st.sampled_from([tox.OTHER] * 4 + list(tox.SYMBOLS)), max_size=24))
@example([tox.PERSON, tox.INTENT, tox.CONTEST, tox.TARGET, tox.GOAL])
@example([tox.TARGET, tox.OTHER, tox.OTHER, tox.LOOSE, tox.LOOSE])
def test_grammar_equals_a_plain_reader(words):
    assert tox.clause(list(enumerate(words))) == plainly(words)
    # Words of no class need not be told.
    last = len(words) - 1
    assert tox.clause([(i, w) for i, w in enumerate(words) if w != tox.OTHER or i == last]) == plainly(words)


def test_words_that_only_look_toxic(spark):
    """By the model of the larger tables, and by the grammar alone."""
    docs, labels = (spark.read.parquet(f"{LARGER}/{t}.parquet") for t in ("documents", "labels"))
    for model in (tox.fit(docs, labels), tox.fit(docs, labels.limit(0))):
        clean = scores(model, "clown fish", "A clown fish swims by the reef.", "Take out the trash.", "They will beat you to the shop.", "We will beat him at chess.")
        toxic = scores(model, "You clown.", "What a clown you are!", "I will beat you.")
        assert max(clean) < 0.5 <= min(toxic)


def scores(model, *texts):
    x = tox.features(model, pa.array(texts))
    return (1 / (1 + np.exp(-(x @ model.weights[:-1] + model.weights[-1])))).tolist()


def test_clauses_not_words_decide(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    for model in (tox.fit(docs, labels.limit(0)), tox.fit(docs, labels)):
        aimed, plain, negated, reported, calm = scores(model, "You are an idiot.", "What an idiot.", "You are not an idiot.", "They said you are an idiot.", "A calm day.")
        assert aimed > plain > max(negated, reported) > calm and aimed >= 0.5 > max(negated, reported)
        threat, negated, reported, server, time = scores(model, "I will kill you.", "I will not kill you.", "They wrote I will kill you.", "The process will kill the server.", "We kill time, you see.")
        assert threat >= 0.5 > max(negated, reported) and server == time == calm


def test_toxicity_edges(spark, make):
    docs = make([(i, f"you are a grumblefrotz {i}" if i % 2 else f"a calm day by the river {i}") for i in range(60)] + [(100, None), (101, ""), (102, "fine " * 40_000)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (7, None)], "doc_id long, toxic int")
    model = tox.fit(docs, labels)
    made = tox.toxicity(docs, model)
    got = {r["doc_id"]: r for r in made.collect()}
    twice = tox.toxicity(docs.union(docs), model).groupBy("doc_id").agg({"score": "min", "predicted": "max", "*": "count"}).collect()
    assert all(r["min(score)"] == got[r["doc_id"]]["score"] and r["count(1)"] == 2 for r in twice)
    assert len(got) == 63 and got[1]["score"] > 0.5 > got[0]["score"] and got[100]["predicted"] == 0
    assert made.columns.count("score") == 1
    none = tox.fit(docs, labels.limit(0))
    assert {r["predicted"] for r in tox.toxicity(docs, none).collect()} <= {0, 1}
    assert tox.toxicity(docs.limit(0), model).count() == 0


def test_held_out_language(spark):
    got = op5_language_id(spark, DATA).toPandas()
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang").toPandas()
    held = got.merge(docs, on="doc_id")
    held = held[held["held_out"] & held["lang"].notna()]
    assert len(got) == len(docs) and (held["lang"] == held["lang_pred"]).mean() >= 0.97


def test_language_edges(spark, make):
    rows = [(i, "the house on the hill and the river" if i % 2 else "das haus auf dem berg und der fluss") for i in range(40)]
    labelled = spark.createDataFrame([(t, "en" if i % 2 else "de") for i, t in rows] + [(None, "en"), ("x", None)], "text string, lang string")
    model = fit(labelled)
    docs = make(rows + [(100, None), (101, ""), (102, "12 34 !!"), (103, "the river " * 20_000)])
    got = {r["doc_id"]: r for r in identify(docs, model).collect()}
    assert all(got[i]["lang_pred"] == ("en" if i % 2 else "de") for i in range(40))
    assert all(got[i]["lang_pred"] == "und" and got[i]["rejected"] and got[i]["score"] == 0 for i in (100, 101, 102)) and got[103]["lang_pred"] == "en"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    blank = fit(labelled.limit(0))
    assert {r["lang_pred"] for r in identify(docs, blank).collect()} == {"und"}
    assert identify(docs.limit(0), model).count() == 0


def test_many_languages_and_a_language_of_copies(spark, make):
    rows = [(f"{chr(0x4E00 + 9 * i)}{chr(0x4E01 + 9 * i)}{chr(0x4E02 + 9 * i)} {j * 'x'}", f"l{i:03}") for i in range(210) for j in range(1 + (i < 209))]
    model = fit(spark.createDataFrame(rows, "text string, lang string"))
    assert len(model.languages) == 210
    got = identify(spark.createDataFrame(rows, "text string, lang string"), model).select("lang", "lang_pred").toPandas()
    assert (got["lang"] == got["lang_pred"]).mean() >= 0.99
    copies = spark.range(100_000).selectExpr("'the house on the hill' as text", "'en' as lang")
    letters = "translate(cast(1000 + id as string), '0123456789', 'abcdefghij')"
    others = spark.range(1000).selectExpr(f"concat('zwölf große flüsse ', {letters}) as text", "'en' as lang")
    german = spark.range(50).selectExpr(f"concat('das haus auf dem berg ', {letters}) as text", "'de' as lang")
    model = fit(copies.union(others).union(german))
    docs = make([(1, "zwölf große flüsse"), (2, "das haus auf dem berg")])
    assert [r["lang_pred"] for r in identify(docs, model).orderBy("doc_id").collect()] == ["en", "de"]
