"""Fill-in-middle against a plain version over token lists; the round trip; odd texts."""

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import compare, engine

from pricetide.llm import infill
from pricetide.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
NAME = "op13_piece_table_infill"


def plain(text, doc_id, fim=90, spm=20, seed=1):
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    hexed = hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()
    h = [int(hexed[8 * i : 8 * i + 8], 16) for i in range(4)]
    low, high = sorted((h[0] % (len(tokens) + 1), h[1] % (len(tokens) + 1)))
    p, m, s = ("".join(x) for x in (tokens[:low], tokens[low:high], tokens[high:]))
    if not text or any(x in text for x in infill.SENTINELS) or h[2] % 100 >= fim:
        return len(tokens), "plain", None, None, text
    if h[3] % 100 < spm:
        return len(tokens), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(tokens), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_odd_texts(spark, make_docs):
    texts = ["", None, "a", "a b", "<P>x", "x<M>", "a<S", "é" * 40, "Zürich, 東京! " * 9, "\x00\t\n\r", "aB" * 3000, "x" * 5000, "😀a😀", "same text here", "same text here"]
    docs = make_docs([(i, t) for i, t in enumerate(texts)] + [(None, "no id"), (None, "no id"), (13, texts[13])])
    got = infill.restore(infill.fill_in_middle(docs)).collect()
    assert len(got) == len(texts) + 3
    for r in got:
        text = r.text or ""
        if r.doc_id is not None:
            assert (r.n_tokens, r.form, r.prefix_chars, r.middle_chars, r.fim_text) == plain(text, r.doc_id)
        assert r.restored_text == text and r.restored_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert r.fim_sha256 == hashlib.sha256(r.fim_text.encode()).hexdigest()
        buffers = text.encode(), "".join(infill.SENTINELS).encode()
        assert b"".join(buffers[p.buffer][p.start : p.end] for p in r.fim_pieces).decode() == r.fim_text
    assert len({r.fim_text for r in got if r.doc_id is None}) == 1 and len({r.fim_text for r in got if r.doc_id == 13}) == 1


def test_other_parameters_and_an_empty_table(spark, make_docs):
    docs = make_docs([(i, "some words [A] in a row") for i in range(60)])
    marks = ("{p}", "{s}", "{m}")
    got = infill.restore(infill.fill_in_middle(docs, marks, fim_percent=100, spm_percent=50, seed=7), sentinels=marks).collect()
    assert {r.form for r in got} == {"psm", "spm"} and all(r.restored_text == r.text and r.fim_text.count("{") == 3 for r in got)
    assert infill.fill_in_middle(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        infill.fill_in_middle(docs, ("<P>", "<P<", "<M>"))
    replaced = infill.fill_in_middle(docs.withColumn("form", docs.text).withColumn("fim_text", docs.text))
    assert len(replaced.columns) == len(set(replaced.columns)) and {r.form for r in replaced.collect()} <= {"psm", "spm", "plain"}


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abZ .<PSM>é東😀\n", max_size=40), st.integers(1, 9), st.data())
def test_cuts_fall_on_tokens_whatever_the_piece(text, piece, data):
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    before = infill.PIECE
    infill.PIECE = piece
    try:
        found = infill.Tokens(text.encode())
        assert found.n == len(tokens)
        k = data.draw(st.integers(0, len(tokens)))
        at = found.offset(k)
        assert text.encode()[:at].decode() == "".join(tokens[:k]) and found.characters(0, at) == len("".join(tokens[:k]))
    finally:
        infill.PIECE = before


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab<>PSM", max_size=30), st.integers(0, 30), st.integers(0, 30), st.sampled_from(["psm", "spm"]))
def test_round_trip_of_any_cut(text, a, b, form):
    if any(s in text for s in infill.SENTINELS):
        return
    low, high = sorted((min(a, len(text)), min(b, len(text))))
    out = infill.natural(text.encode(), infill.SENTINELS, low, high).permuted(infill.ARRANGEMENTS[form])
    assert infill.restored(out.bytes(), form, infill.SENTINELS).bytes().decode() == text


def test_query(spark):
    assert compare(QUERIES[NAME](spark, SF), engine(SF), ORACLES[NAME]) == ""
