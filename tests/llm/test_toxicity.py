"""Toxicity: held-out recall and precision, gradients, misspellings, odd texts."""

import numpy as np

from pricetide.llm import toxicity
from pricetide.llm.queries import op11_subword_toxicity

SF = "/root/testdata/sf0.1"
CALM = "the river runs past the old mill and the green field where people walk in the morning sun"
WORDS = ["idiot", "moron", "loser"]


def small_model(n=120):
    draw = np.random.default_rng(2)
    words = CALM.split()
    texts = [" ".join(draw.choice(words, 30)) for _ in range(n)]
    toxic = [i % 2 for i in range(n)]
    texts = [f"{t} {WORDS[i % 3]} {t}" if y else t for i, (t, y) in enumerate(zip(texts, toxic))]
    return toxicity.train(texts, toxic, 0.2), texts, toxic


def scored(model, *texts):
    evidence, bias = model.evidence(), float(model.bias[1] - model.bias[0])
    return [toxicity.score_text(t, evidence, bias) for t in texts]


def test_held_out_rows(spark):
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = op11_subword_toxicity(spark, SF).collect()
    assert len(rows) == 10_000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    caught = [r.predicted for r in held if truth[r.doc_id]]
    false = [r.predicted for r in held if not truth[r.doc_id]]
    assert len(caught) > 80 and np.mean(caught) > 0.7 and np.mean(false) < 0.02  # some 330 toxic rows to learn from; see the README for larger tables


def test_misspellings_share_subwords():
    model, texts, toxic = small_model()
    assert np.mean([(s >= 0.3) == y for s, y in zip(scored(model, *texts), toxic)]) > 0.98
    calm, *bad = scored(model, CALM, f"{CALM} idiots", f"{CALM} IDIOTT", f"{CALM} mooron", f"{CALM} losers!")
    assert calm < 0.3 and all(b > 0.5 for b in bad)


def test_averaged_embeddings_through_the_softmax():
    model, *_ = small_model(40)
    text = "Some idiot, some River! some"
    found = toxicity._bag(text)
    mean = found[1] @ model.embeddings[found[0]]
    logits = mean @ model.weights + model.bias
    assert abs(scored(model, text)[0] - np.exp(logits[1]) / np.exp(logits).sum()) < 1e-6


def test_subwords_of_words():
    grams = lambda text: {b: w for buckets, weights in toxicity.subwords(text) for b, w in zip(buckets.tolist(), weights.tolist())}
    assert grams("idiot") == grams("  IDIOT!") and set(grams("ab idiot")) == set(grams("ab")) | set(grams("idiot"))
    assert set(grams("idiot").values()) == {1.0} and set(grams("idiot " * 9).values()) == {3.0}
    assert len(grams("ab")) == 3 and not grams("") and not grams(None) and not grams(" .,! ")  # _ab, ab_, _ab_


def test_pieces_change_nothing(monkeypatch):
    text = " ".join(f"word{i % 17} idiot" for i in range(300))
    whole = toxicity._bag(text)
    monkeypatch.setattr(toxicity, "PIECE", 11)
    parts = toxicity._bag(text)
    assert whole[0].tolist() == parts[0].tolist() and np.allclose(whole[1], parts[1])


def test_odd_rows_and_tables(spark, make_docs):
    model, *_ = small_model()
    docs = make_docs([(1, None), (2, ""), (3, "idiot idiot"), (3, "idiot idiot"), (None, "idiot " * 50_000), (5, "é" * 100_000), (6, "\x00 ½ 12")])
    docs = docs.withColumn("toxic_score", docs.text).withColumn("toxic_pred", docs.text)
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == 7 and len(rows[0]) == len(docs.columns) and all(0 <= r.toxic_score <= 1 for r in rows)
    by = {r.doc_id: r for r in rows}
    assert by[1].toxic_score == by[2].toxic_score < 0.3 and by[3].toxic_pred == 1 and by[None].toxic_pred == 1
    assert {r.toxic_score for r in toxicity.score(docs, None).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_sample_is_bounded_and_labels_agree(spark, make_docs):
    docs = make_docs([(i, f"text {i} " * 5) for i in range(200)] + [(7, "another text of id 7"), (300, None)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(4, 1), (300, 1), (999, 1), (8, None), (None, 1)], "doc_id long, toxic int")
    sample, share = toxicity.sample_labelled(docs, labels, rows=30, size=1 << 20)
    rows = sample.collect()
    assert len(rows) == 60 and len({r.doc_id for r in rows}) == 60 and share == 101 / 200
    assert {r.toxic for r in rows if r.doc_id == 4} <= {1}
    few, _ = toxicity.sample_labelled(docs, labels, rows=30, size=200)
    assert 2 <= few.count() < 20
    assert toxicity.fit(docs.limit(0), labels) is None and toxicity.fit(docs, labels.limit(0)) is None
