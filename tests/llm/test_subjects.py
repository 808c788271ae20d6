import random

import numpy as np
from pyspark.sql import functions as F

from listweave.llm import subjects as S

TERMS = {"food": ["salad", "garlic", "oven", "spice", "broth", "pastry"], "law": ["judge", "tribunal", "notary", "clause", "verdict", "appeal"], "sport": ["goal", "coach", "sprint", "league", "medal", "penalty"]}
FRAMES = ["Most readers ask about the {0}; fewer know the {1}.", "Without the {0}, the {1} would make little sense.", "Here the {0} and the {1} belong together."]
FILLER = ["Nothing much changed since then.", "A reader sent us a note.", "That was years ago."]


def page(rnd, subjects, mention=None):
    parts = ["Food | Law | Sport | Contact"]
    for s in subjects:
        parts += [rnd.choice(FRAMES).format(*rnd.sample(TERMS[s], 2)) for _ in range(rnd.randint(3, 5))]
    if mention:
        parts.append(rnd.choice(FRAMES).format(*rnd.sample(TERMS[mention], 2)))
    return "\n".join([*parts, *rnd.sample(FILLER, 2), "Imprint · Terms · Privacy"])


def corpus(seed, n):
    rnd, rows = random.Random(seed), []
    for i in range(n):
        own = rnd.sample(sorted(TERMS), rnd.choice([0, 1, 1, 2]))
        other = [s for s in TERMS if s not in own]
        rows.append((i, page(rnd, own, rnd.choice(other) if rnd.random() < 0.3 else None), set(own)))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus(1, 1200)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(9000, None), (9001, ""), (9002, " \n ")], "doc_id bigint, text string").withColumn("mask", F.lit(1)).withColumn("subject", F.lit("x"))
    labels = [(i, f" {s.upper()} ", "r") for i, _, own in rows[:400] for s in own] + [(i, None, "r") for i, _, own in rows[:400] if not own] + [(0, "unlisted", "r"), (None, "law", "r")]
    table = spark.createDataFrame(labels + labels[:20], "doc_id bigint, subject string, labelled_by string")
    found = S.subject_units(docs, table, sorted(TERMS)).where("units >= 3").collect()
    pairs = {(r["doc_id"], r["subject"]) for r in found}
    assert len(pairs) == len(found)
    truth = {(i, s) for i, _, own in rows[400:] for s in own}
    got = {p for p in pairs if p[0] >= 400}
    assert len(got & truth) / len(got) > 0.97 and len(got & truth) / len(truth) > 0.97
    assert all(0 <= r["weight"] <= 1 for r in found)


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "The judge and the notary.")], "doc_id bigint, text string")
    labels = spark.createDataFrame([], "doc_id bigint, subject string, labelled_by string")
    assert S.subject_units(docs, labels, ["law"]).count() == 0
    assert S.subject_units(docs.limit(0), labels, ["law"]).count() == 0


def test_units():
    text = "A · B · C\nHeading here\nOne thing. Two things! “Three,” he said. City pass? Yes, and more.\n- item one\nplain item\n日本。語学が"
    assert [(w[0], k) for w, k in S.units(text)] == [
        ("heading", S._SHORT), ("one", S._SENTENCE), ("two", S._SENTENCE), ("three", S._SENTENCE), ("city", S._SENTENCE),
        ("item", S._ITEM), ("plain", S._SHORT), ("日本", S._SENTENCE), ("語学", S._SHORT)]
    assert list(S.units("?!\n \n...")) == []
    assert sum(len(w) for w, _ in S.units("word " * 300_000)) == 300_000


def block(docs):
    """Documents as lists of units, these as lists of buckets."""
    tok = [t for d in docs for u in d for t in u]
    lens, per_doc = [len(u) for d in docs for u in d], [len(d) for d in docs]
    return S.Block(len(docs), np.array(tok), np.repeat(np.arange(len(lens)), lens), np.repeat(np.arange(len(docs)), per_doc), np.zeros(len(lens), np.int8))


def test_mixtures_against_plain_updates():
    rnd = np.random.default_rng(0)
    docs = [[list(rnd.integers(0, 40, rnd.integers(1, 6))) for _ in range(rnd.integers(1, 5))] for _ in range(30)] + [[]]
    b = block(docs)
    model = S.Model(np.arange(5, 20), rnd.random((4, 15)), np.array([1.0, 2.0, 3.0, 9.0]), np.arange(25))
    H, index = model.columns("open")
    allowed = (rnd.random((3, len(docs))) < 0.7).astype(np.float32)
    got = S.mixtures(b, H, index[b.tok], allowed, steps=4)
    acc = np.zeros((4, S.BUCKETS + 1))
    S._sums(b, H, index[b.tok], got, acc)
    numerator = np.zeros((4, 40))
    for d, units in enumerate(docs):
        words = [t for u in units for t in u]
        h, w = H[:, index[words]].astype(float), np.ones(4)
        for _ in range(4):
            w[:3] *= allowed[:, d]
            w = (h * w[:, None] / ((h * w[:, None]).sum(0) + 1e-30)).sum(1) if words else np.zeros(4)
        assert np.allclose(got[:, d], w, atol=1e-4)
        for t in words:
            r = H[:, index[t]] * w
            numerator[:, t] += r / (r.sum() + 1e-30)
    common = list(range(5)) + list(range(20, 25))  # placed, but speak for no subject: only their number counts
    assert acc[3, -1] == sum(t in common for u in docs for x in u for t in x)
    rest = [t for t in range(40) if t not in common]
    assert np.allclose(acc[:, rest], numerator[:, rest], atol=1e-3) and not acc[:, common].any()


def test_what_subjects_share_becomes_common():
    N = np.array([[9.0, 5.0, 3.0, 1.0], [0.0, 5.0, 1.0, 0.0], [1.0, 0.0, 0.0, 0.0]])
    out = S.apart(N, np.ones(3), 0.0)
    assert np.allclose(out.sum(0), N.sum(0)) and out[0, 0] == 9 and not out[:2, 1].any()
    assert out[0, 2] == 3 * 0.5 and out[1, 2] == 0
    assert S.apart(N, np.array([81.0, 3.0, 1.0]), 0.0)[0, 2] == 0  # no more than its size lets expect
    assert S.apart(N, np.ones(3), S.DOUBT)[0, 3] == 0  # once is too rare to tell


def found(matrix, names, mixed=True, **passes):
    out = S.judged(matrix, S.fit(matrix, names, **passes), names, mixed).where("units >= 3").collect()
    return {(r["doc_id"], r["subject"]) for r in out}


def f1(got, truth):
    return 2 * len(got & truth) / max(len(got) + len(truth), 1)


def test_rows_come_from_the_factorisation(spark):
    """Without updates nothing is found; few labels need the corpus; without
    mixtures shared words are taken for the wrong subject."""
    shared = ["court", "press", "roll", "charge"]  # mostly about food, as most documents are
    rnd, rows = random.Random(7), []
    for i in range(900):
        own = rnd.choices(sorted(TERMS), [5, 2, 2])[0]
        sentences = [rnd.choice(FRAMES).format(*rnd.sample(shared, 2)) for _ in range(3)] + [rnd.choice(FRAMES).format(*rnd.sample(TERMS[own], 2)) for _ in range(3)]
        rows.append((i, "\n".join(sentences) + "\n" + rnd.choice(FILLER), own))
    docs, names = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string"), sorted(TERMS)
    truth = {(i, s) for i, _, s in rows}
    matrix = S.document_terms(docs, spark.createDataFrame([(i, s, "r") for i, _, s in rows[:60]], "doc_id bigint, subject string, labelled_by string"), names)
    whole = f1(found(matrix, names), truth)
    assert whole > 0.97
    assert found(matrix, names, anchoring=0, passes=0) == set()
    few = S.document_terms(docs, spark.createDataFrame([(i, s, "r") for i, _, s in rows[:30]], "doc_id bigint, subject string, labelled_by string"), names)
    some = f1(found(few, names), truth)
    assert some > 0.9
    assert f1(found(few, names, passes=0), truth) < some - 0.03
    assert f1(found(few, names, mixed=False), truth) < some - 0.03


def test_garbled_text_is_restored():
    text = "“The café isn’t.” When é 日本語 ü x."
    for wrong in (text.encode().decode("latin-1"), "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in text.encode())):
        assert list(S.units(wrong)) == list(S.units(text))
    assert S._GARBLED.sub(S._restored, "â la carte, Ã, Â ") == "â la carte, Ã, Â "
