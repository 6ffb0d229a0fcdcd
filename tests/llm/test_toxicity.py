"""Toxicity: the automaton against edit distances, contexts, held-out accuracy, edge rows."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trackweave.llm import toxicity as tox

from .conftest import edge_rows, prose

SF = "/root/testdata/sf0.1"
LABELS = "doc_id long, quality int, toxic int"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (x != y))
    return row[-1]


def nearest(terms, word):
    found = []
    for k, t in enumerate(terms):
        d = min(distance(t.text, word[:n]) for n in range(len(word) + 1)) if t.open else distance(t.text, word)
        if d <= t.edits:
            found.append((d, -t.evidence, k))
    return min(found) if found else None


TERM = st.builds(tox.Term, st.text("abc", min_size=1, max_size=11), st.booleans(), st.integers(0, 3).map(float))


@settings(max_examples=400, deadline=None)
@given(st.lists(TERM, min_size=1, max_size=6), st.lists(st.text("abcd", max_size=14), max_size=6))
def test_automaton_is_edit_distance(terms, words):
    lexicon = tox.Lexicon(terms)
    lexicon.WORDS_HELD = 3  # forgets on the way
    for word in words:
        got, want = lexicon.find(word), nearest(terms, word)
        assert (got is None) == (want is None)
        if got:
            assert got[0] == want[0] and any(got[1] == k for k, t in enumerate(terms) if nearest([t], word) and nearest([t], word)[0] == got[0])


def test_contexts():
    lexicon = tox.Lexicon([tox.Term("idiot", False, 5.0), tox.Term("dummk", True, 4.0)])
    told = lambda text: [(text.lower()[a:b], edits, context) for a, b, edits, _, context in tox.hits(lexicon, text)]
    assert told("An idiot there") == [("idiot", 0, tox.PLAIN)]
    assert told("you IDIOTT there") == [("idiott", 1, tox.ATTACK)]
    assert told('The word “idiot” is old') == [("idiot", 0, tox.QUOTED)]
    assert told('he wrote: idiot.') == [("idiot", 0, tox.QUOTED)]
    assert told("Der Dummkopf! ist weg") == [("dummkopf", 0, tox.ATTACK)]
    assert told("id10t i.d.i.o.t") == [] and told("") == [] and told("***") == []


@pytest.fixture(scope="module")
def labelled(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_held_out_accuracy(labelled):
    """English terms are learned whole; stems of other languages as far as their texts tell."""
    docs, labels = labelled
    rows = tox.toxicity_report(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    hit = (rows.predicted == 1) & (rows.toxic == 1)
    assert hit.sum() / (rows.predicted == 1).sum() > 0.88 and hit.sum() / (rows.toxic == 1).sum() > 0.85
    assert ((rows.score >= tox.LIMIT) == (rows.predicted == 1)).all() and rows.score.between(0, 1).all()


def insulting(spark):
    """Insults in two of five texts, known from labels; copies of one text with a rare word of its own."""
    rows = [(k, f"{prose(k, 60)} {('blockhead', 'nitwit')[k % 2] if k % 5 < 2 else 'friend'} {prose(k + 900, 40)}", "en", 1.5) for k in range(400)]
    copies = [(1000 + k, f"{prose(5000, 80)} rareword blockhead {prose(5001, 80)}", "en", 1.5) for k in range(60)]
    labels = [(r[0], 1, int(r[0] % 5 < 2 or r[0] >= 1000)) for r in rows + copies]
    return spark.createDataFrame(rows + copies, "doc_id long, text string, lang string, score double"), spark.createDataFrame([*labels, (3, 1, None), (None, 1, 1)], LABELS)


def test_lexicon_and_misspellings(spark):
    docs, labels = insulting(spark)
    model = tox.fit(docs, labels)
    assert sorted(t.text for t in model.terms) == ["blockhead", "nitwit"]  # not the word that copies share
    score = lambda text: model.score(text)[0]
    assert score("what a blockhed, you nitwit") > 0.5 > score("a friend of prose") and score("you blokchead") > score("") == score(None)
    assert score('the word "nitwit" is rare') < score("you are a nitwit")
    held = {r.doc_id: r for r in tox.toxicity_report(docs, labels).collect()}
    assert all(r.held_out == (tox_part(k) == tox.HELD_OUT) and r.predicted == int(k % 5 < 2 or k >= 1000) for k, r in held.items())
    kept = tox.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {k for k in range(400) if k % 5 >= 2}


def tox_part(k):
    import zlib

    return zlib.crc32(str(k).encode()) % 4


def test_held_out_labels_are_not_read(spark):
    docs, labels = insulting(spark)
    turned = labels.withColumn("toxic", F.when(tox.part(F.col("doc_id")) == tox.HELD_OUT, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert tox.fit(docs, turned).weights == pytest.approx(tox.fit(docs, labels).weights)


def test_edges(spark, docs, no_docs):
    _, labels = insulting(spark)
    rows = tox.toxicity_report(docs, labels).collect()
    assert len(rows) == len(edge_rows()) and all(0 <= r.score <= 1 for r in rows)
    assert tox.toxicity_report(no_docs, labels).count() == 0
    none = tox.toxicity_report(docs, labels.limit(0)).collect()
    assert len(none) == len(rows) and {round(r.score, 6) for r in none} == {tox.PRIOR_RATE}
