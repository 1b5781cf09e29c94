"""Toxicity: the grammar clause by clause, the lexicon on planted words, held-out accuracy."""

from __future__ import annotations

import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from terrane.llm import toxicity
from terrane.session import table

PLAIN = toxicity.Model(dict.fromkeys(toxicity.INSULTS, 1.0))


def kinds(text):
    return {k: s for k, s in zip(toxicity.KINDS, PLAIN.reader().sums(text), strict=True) if s}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("The idiot went home.", {"insult": 1}), ("You are an idiot.", {"insult_aimed": 1}), ("An idiot, that is what you are", {"insult_aimed": 1}), ("He is not an idiot.", {"insult_negated": 1}),
        ("She said he was an idiot.", {"insult_reported": 1}), ('The word "idiot" is old.', {"insult_reported": 1}), ("I will kill you.", {"threat_aimed": 1}), ("I will never hurt you.", {"threat_negated": 1}), ("They kill time.", {"threat_aimed": 1}),
        ("Stop. You. Idiot.", {"insult": 1}), ("idiot stupid moron you", {"insult_aimed": 3}), ("you one two three four five six seven idiot", {"insult": 1}), ("He is not at all really an idiot", {"insult": 1}), ("", {}), ("Clean words only.", {}), ("1d1ot and st0pid", {"insult": 1}),
        ("IDIOT! idiot? Idiot", {"insult": 3}),
    ],
)
def test_clauses(text, want):
    assert kinds(text) == pytest.approx(want)


def test_composition_equals_one_after_the_other():
    rng = random.Random(5)
    for _ in range(300):
        symbols = rng.choices("oooithnrq", k=rng.randrange(1, 25))
        step = list(symbols)
        for machine in (toxicity.quotes(), toxicity.reports(), toxicity.negations(), toxicity.targets()):
            state, out = machine.start, []
            for x in step:
                state, written = machine.step(state, x)
                out += written
            step = out
        state, whole = toxicity.GRAMMAR.start, []
        for x in symbols:
            state, written = toxicity.GRAMMAR.step(state, x)
            whole += written
        assert whole == step


def planted(n=1200):
    """Labelled texts with made-up insults, one text with hundreds of copies, and words that mean nothing."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("aeioubdklmnrst", k=rng.randrange(3, 8)))
    vocabulary = [word() for _ in range(800)]
    docs, labels = [], []
    copy = " ".join(rng.choices(vocabulary, k=40)) + " grumpf rarewordone rarewordtwo"
    for i in range(n):
        toxic = i % 8 == 0
        text = rng.choices(vocabulary, k=40)
        if toxic:
            text.insert(rng.randrange(40), rng.choice(["grumpf", "blargo", "xylqu" + word()]))
        docs.append((i, copy + " " * (i % 50) if i % 24 == 0 else " ".join(text)))
        labels.append((i, None, int(toxic)))
    return docs, labels


def test_lexicon_finds_words_and_stems(spark):
    docs, labels = planted()
    model = toxicity.fit(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    learned = {t: w for t, w in model.terms.items() if t not in toxicity.INSULTS}
    assert any("grumpf".startswith(t.rstrip("*")) for t in learned) and any("blargo".startswith(t.rstrip("*")) for t in learned) and any(t.startswith("xylqu") and t.endswith("*") for t in learned)
    got = {r["doc_id"]: r for r in toxicity.score(spark.createDataFrame(docs, "doc_id long, text string"), model).collect()}
    wrong = sum(got[i]["predicted"] != y for i, _, y in labels)
    assert wrong <= 0.01 * len(labels)


def test_held_out_rows_of_the_test_tables(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    rows = toxicity.digest(docs, labels).join(labels, "doc_id").where("held_out AND toxic IS NOT NULL").select("score", "predicted", "toxic").collect()
    found = [r for r in rows if r["predicted"]]
    hit = sum(r["toxic"] for r in found)
    assert hit / len(found) >= 0.85 and hit / sum(r["toxic"] for r in rows) >= 0.85 and len(rows) > 900


def test_nulls_repeats_clashing_names_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "You idiot", 9, "k"), (1, "You idiot", 9, "k"), (2, None, 9, "k"), (None, "fine", 9, "k"), (3, "word " * 200_000 + "idiot", 9, "k")], "doc_id long, text string, score int, term string")
    for c in ("toxic", "id", "h", "own", "held_out", "predicted", "insult"):
        docs = docs.withColumn(c, F.lit("?"))
    labels = spark.createDataFrame([(1, 1, 1), (1, 0, 0), (2, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.digest(docs, labels).collect()
    assert len(got) == 5 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    by = {r["doc_id"]: r["score"] for r in got}
    assert by[1] > 0.3 > by[2] and by[3] > by[2]
    assert {r["doc_id"]: r["held_out"] for r in got}[1] == (zlib.crc32(b"1") % 4 == 2)
    assert toxicity.digest(docs.limit(0), labels).collect() == [] and toxicity.digest(docs, labels.limit(0)).count() == 5


def test_curve_stays_near_what_is_expected_without_rows():
    import numpy as np

    base, curve = toxicity.curve_of(np.zeros((0, 8)), np.zeros(0))
    assert math.isclose(base, toxicity.PRIOR_BASE) and curve == toxicity.PRIOR
