"""Language identification: held-out accuracy, the kernel, odd texts."""

import numpy as np

from pricetide.llm import langid
from pricetide.llm.queries import op4_string_kernel_language

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op4_string_kernel_language(spark, SF).collect()
    assert len(rows) == len(truth)
    held = [r for r in rows if r.held_out]
    assert len(held) > 150 and all(0 <= r.score <= 1 for r in rows)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.98


def test_spectrum_is_the_set_of_grams():
    spectrum = langid.Spectrum()
    text = "Abca É9 " * 3
    c = langid._CLASS[np.frombuffer(text.lower().encode(), np.uint8)].tolist()
    want = {x for x in c} | {64 + a * 64 + b for a, b in zip(c, c[1:])} | {64 + 4096 + a * 4096 + b * 64 + d for a, b, d in zip(c, c[1:], c[2:])}
    assert spectrum.codes(text).tolist() == sorted(want) and spectrum.codes("").tolist() == [] and not spectrum.held.any()


def test_pieces_join_without_a_seam(monkeypatch):
    text = "the quick brown fox jumps" * 9
    whole = langid.Spectrum().codes(text).tolist()
    monkeypatch.setattr(langid, "PIECE", 7)
    assert langid.Spectrum().codes(text).tolist() == whole


def docs(spark, rows):
    return spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, lang string, score int")


TRAIN = [(i, "the cat and the dog with this thing " * (1 + i % 3), "en") for i in range(30)] + [
    (100 + i, "der hund und die katze mit dem ding " * (1 + i % 3), "de") for i in range(30)]


def test_odd_texts_and_clashing_columns(spark):
    model = langid.fit(docs(spark, TRAIN))
    odd = docs(spark, [(1, None, "en"), (2, "", None), (3, " 12 + !! \n", "en"), (None, "the dog and the cat", "de"), (4, "und die katze " * 90_000, None), (4, "ß", "x")])
    out = langid.identify(odd, model)
    assert sorted(out.columns) == ["doc_id", "lang", "lang_pred", "score", "text"]
    got = [(r.doc_id, r.lang_pred) for r in out.collect()]
    assert got[:3] == [(1, "und"), (2, "und"), (3, "und")] and got[3] == (None, "en") and got[4] == (4, "de") and got[5][1] in ("en", "de")
    assert all(r.score == 0 for r in out.collect()[:3])


def test_neither_labels_nor_rows(spark):
    unlabelled = docs(spark, [(1, "some text", None)])
    assert langid.fit(unlabelled) is None and [r.lang_pred for r in langid.identify(unlabelled, None).collect()] == ["und"]
    assert langid.identify(docs(spark, []), langid.fit(docs(spark, TRAIN))).count() == 0


def test_sample_is_bounded_and_stable(spark):
    many = docs(spark, [(i, f"text {i}", "abc"[i % 3]) for i in range(300)] + [(0, "text 0", "a")] * 50)
    first, second = (sorted(map(tuple, langid.sample_labelled(many, 20, 45).collect())) for _ in range(2))
    assert first == second and len(first) <= 45
    assert {r[1] for r in first} == {"a", "b", "c"}


def test_one_language(spark):
    model = langid.fit(docs(spark, TRAIN[:5]))
    assert [r.lang_pred for r in langid.identify(docs(spark, [(1, "zz", None)]), model).collect()] == ["en"]


def test_letters_decide_what_is_undetermined(spark):
    model = langid.fit(docs(spark, TRAIN))
    rows = [(1, "½ ² 12", None), (2, "① Ⅷ", None), (3, "_ 9 \t", None), (4, "9 é", None), (5, "字", None), (6, None, None)]
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs(spark, rows), model).collect()}
    assert [got[i] for i in (1, 2, 3, 6)] == [("und", 0.0)] * 4 and got[4][0] != "und" and got[5][0] != "und"


def test_against_plain_kernel_ridge(spark):
    """With every text a landmark the Nyström map loses nothing: the scores are those of plain kernel ridge regression."""
    texts = [r for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").where("text is not null and length(text) < 3000").orderBy("doc_id").limit(240).collect()]
    train, test = texts[:200], texts[200:]
    ridge, spectrum = 1e-2, langid.Spectrum()
    model = langid.fit(docs(spark, train), landmarks=200, ridge=ridge)
    sets = {r.doc_id: set(spectrum.codes(r.text).tolist()) for r in texts}
    kernel = lambda a, b: np.array([[len(sets[x.doc_id] & sets[y.doc_id]) / (len(sets[x.doc_id]) * len(sets[y.doc_id])) ** 0.5 for y in b] for x in a])
    langs = np.array([r.lang for r in train])
    number = {lang: int((langs == lang).sum()) for lang in model.languages}
    weight = np.array([len(train) / len(number) / number[lang] for lang in langs])
    target = np.where(langs[:, None] == np.array(model.languages)[None, :], 1.0, -1.0)
    dual = np.linalg.solve(kernel(train, train) + ridge * np.diag(1 / weight), target)
    want = kernel(test, train) @ dual
    got = model.score([spectrum.codes(r.text) for r in test])
    assert np.abs(want - got).max() < 0.02 and (want.argmax(axis=1) == got.argmax(axis=1)).all()
