"""Language identification by string kernels: blended-spectrum n-gram presence, Nyström landmarks, kernel ridge regression."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricetide.llm import common

UNDETERMINED = "und"
# Bounds of the labelled sample a model is fitted on: rows per language, and in all.
SAMPLE_PER_LANGUAGE = 500
SAMPLE_ROWS = 4_000
DEALS = 32
LANDMARKS = 160
RIDGE = 1e-2
# Texts scored together; bytes of a text looked at together.
BATCH = 256
PIECE = 1 << 20
# A text is foreign where its share of known 3-grams is below this part of a low quantile of labelled texts' shares.
KNOWN_QUANTILE, KNOWN_PART = 0.05, 0.75

# Bytes of lower-cased UTF-8 fall into 64 classes: 0 white space and signs, 1-26 letters, 27 digits, the rest by value.
_CLASS = np.zeros(256, np.int32)
_CLASS[np.arange(ord("a"), ord("z") + 1)] = np.arange(1, 27)
_CLASS[np.arange(ord("0"), ord("9") + 1)] = 27
_CLASS[128:] = 28 + np.arange(128) % 64 % 36
# Codes of n-grams of one to three classes, one range each.
CODES = 64 + 64**2 + 64**3
# The 3-grams without a digit: ids, sums and keys are no evidence of a language.
_WORDLY = np.zeros(CODES, bool)
_WORDLY[64 + 64**2 :] = np.all(np.indices((64, 64, 64)) != 27, axis=0).ravel()


class Spectrum:
    """Marks which n-grams a text holds; one bitmap is used again for text after text."""

    def __init__(self):
        self.held = np.zeros(CODES, bool)

    def codes(self, text: str) -> np.ndarray:
        """Sorted codes of the distinct 1-, 2- and 3-grams of the whole text."""
        data = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)
        for at in range(0, len(data), PIECE):
            c = _CLASS[data[at : at + PIECE + 2]]
            self.held[c] = True
            pair = c[:-1] * 64 + c[1:]
            self.held[64 + pair] = True
            self.held[64 + 64**2 + pair[:-1] * 64 + c[2:]] = True
        found = np.flatnonzero(self.held)
        self.held[found] = False
        return found.astype(np.int32)


@dataclass
class LanguageModel:
    """One weight per (n-gram of the landmarks, language): the normalised landmark matrix times the dual coefficients."""

    languages: list[str]
    column: np.ndarray  # code -> column of the landmark vocabulary, -1 outside it
    weights: np.ndarray  # vocabulary x languages
    common: np.ndarray | None = None  # code -> whether two sampled texts or more hold it
    limits: np.ndarray | None = None  # least share of common 3-grams, by language

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        """Regression value of every text and language: presence rows times weights, over the text's own norm."""
        present = np.zeros((len(texts), len(self.weights)), np.float32)
        norm = np.ones(len(texts))
        for row, codes in enumerate(texts):
            columns = self.column[codes]
            present[row, columns[columns >= 0]] = 1
            norm[row] = max(1.0, len(codes)) ** 0.5
        return present @ self.weights / norm[:, None]

    def familiar(self, codes: np.ndarray, language: int) -> bool:
        """Whether the text's 3-grams are common enough for a text of the language."""
        return _share(self.common[codes[_WORDLY[codes]]]) >= self.limits[language]


def _share(common: np.ndarray) -> float:
    """One common 3-gram is added, so a few rare ones do not decide on a short text."""
    return (common.sum() + 1) / (len(common) + 1)


def _evidence(codes: list[np.ndarray], langs: list[str], languages: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """``common`` and ``limits`` of a model. Equal texts count once, and each text is judged by the other ones,
    as if it were held out, so a language with few labelled texts has a low limit."""
    distinct = {(lang, c.tobytes()): c for lang, c in zip(langs, codes)}
    held = np.zeros(CODES, np.int32)
    for c in {c.tobytes(): c for c in codes}.values():
        held[c] += 1
    shares = {lang: [] for lang in languages}
    for (lang, _), c in distinct.items():
        shares[lang].append(_share(held[c[_WORDLY[c]]] - 1 >= 2))
    return held >= 2, np.array([KNOWN_PART * np.quantile(shares[lang], KNOWN_QUANTILE) for lang in languages])


def sample_labelled(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, rows: int = SAMPLE_ROWS) -> DataFrame:
    """A bounded sample ``doc_id, lang, text``: the rows of least id hash of each language, and ``rows`` in all at most."""
    ranked = (
        docs.where("doc_id is not null and lang is not null and text is not null").select("doc_id", "lang").withColumn("_h", F.xxhash64("doc_id"))
        .withColumn("_deal", F.pmod("_h", F.lit(DEALS)))  # a language's rows are ranked in parts first
        .withColumn("_rank", F.row_number().over(Window.partitionBy("lang", "_deal").orderBy("_h", "doc_id"))).where(F.col("_rank") <= per_language)
        .withColumn("_rank", F.row_number().over(Window.partitionBy("lang").orderBy("_h", "doc_id"))).where(F.col("_rank") <= per_language)
        .orderBy("_rank", "lang").limit(rows)  # the languages' first rows come first
    )
    chosen = F.broadcast(ranked.select("doc_id", "lang").distinct())  # at most ``rows`` rows
    return docs.select("doc_id", "lang", "text").join(chosen, ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))


def _coder():
    @F.arrow_udf("array<int>")
    def codes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        spectrum = Spectrum()
        for batch in batches:
            yield pa.array([spectrum.codes(t.as_py() or "") for t in batch], pa.list_(pa.int32()))
    return codes


def fit(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, rows: int = SAMPLE_ROWS, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> LanguageModel | None:
    """Fits on the labelled rows of ``docs``; None where no row is labelled.

    The tasks turn the sampled texts into n-gram codes; the driver gets at most ``rows`` lists of codes, solves a
    landmark-sized eigenproblem for the Nyström map and one ridge regression per language on it.
    """
    sample = sample_labelled(docs, per_language, rows).select("lang", F.xxhash64("doc_id").alias("h"), "doc_id", _coder()("text").alias("codes")).toArrow()
    order = np.lexsort((sample.column("doc_id").to_numpy(), sample.column("h").to_numpy()))
    langs = [sample.column("lang")[int(i)].as_py() for i in order]
    codes = [np.asarray(sample.column("codes")[int(i)].as_py(), np.int32) for i in order]
    if not langs:
        return None
    languages = sorted(set(langs))
    seen = {lang: 0 for lang in languages}
    turn = []
    for lang in langs:
        turn.append(seen[lang])
        seen[lang] += 1
    marks = sorted(range(len(langs)), key=lambda i: (turn[i], i))[:landmarks]  # languages take turns
    vocabulary = np.unique(np.concatenate([codes[i] for i in marks]))
    column = np.full(CODES, -1, np.int32)
    column[vocabulary] = np.arange(len(vocabulary))
    landmark = np.zeros((len(vocabulary), len(marks)), np.float32)
    for j, i in enumerate(marks):
        landmark[column[codes[i]], j] = max(1, len(codes[i])) ** -0.5
    near = LanguageModel(languages, column, landmark)
    kernel = np.concatenate([near.score(codes[i : i + BATCH]) for i in range(0, len(codes), BATCH)]).astype(float)
    value, vector = np.linalg.eigh(kernel[marks])
    good = value > 1e-6 * value.max()
    to_features = vector[:, good] / np.sqrt(value[good])
    features = kernel @ to_features
    target = np.where(np.array(langs)[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    # every language weighs the same, however many rows it has
    weight = np.array([1.0 / seen[lang] for lang in langs])[:, None] * len(langs) / len(languages)
    gram = features.T @ (weight * features) + ridge * np.eye(features.shape[1])
    dual = to_features @ np.linalg.solve(gram, features.T @ (weight * target))
    return LanguageModel(languages, column, (landmark @ dual).astype(np.float32), *_evidence(codes, langs, languages))


def _predictor(model: LanguageModel | None):
    @F.arrow_udf("struct<lang: string, score: double, familiar: boolean>")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        spectrum = Spectrum()
        for batch in batches:
            langs, scores, familiar = [], [], []
            for at in range(0, len(batch), BATCH):
                texts = [t.as_py() or "" for t in batch[at : at + BATCH]]
                lettered = [model is not None and any(map(str.isalpha, t)) for t in texts]
                if not any(lettered):
                    langs += [UNDETERMINED] * len(texts)
                    scores += [0.0] * len(texts)
                    familiar += [False] * len(texts)
                    continue
                codes = [spectrum.codes(t) if has else np.zeros(0, np.int32) for t, has in zip(texts, lettered)]
                found = model.score(codes)
                best = found.argmax(axis=1)
                top = np.clip((found[np.arange(len(texts)), best] + 1) / 2, 0, 1)
                langs += [model.languages[b] if has else UNDETERMINED for b, has in zip(best, lettered)]
                scores += [float(s) if has else 0.0 for s, has in zip(top, lettered)]
                familiar += [has and bool(model.familiar(c, b)) for c, b, has in zip(codes, best, lettered)]
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(familiar, pa.bool_())], names=["lang", "score", "familiar"])
    return predict


def held_out(doc_id: Column) -> Column:
    """Rows kept apart from training: crc32 of the id's text leaves 2 on division by 4; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, model: LanguageModel | None, familiar: str | None = None) -> DataFrame:
    """Adds ``lang_pred`` and ``score`` (0 to 1; one half is the border of a language's regression) to every row.

    Only the text decides, by the 1- to 3-grams of its lower-cased UTF-8 bytes folded into 64 classes. Texts that are null
    or without a letter (Unicode category L), and all texts where the model is None, give ``und`` and 0. Whole texts count, in pieces of bounded size; repeated rows agree; ties go to the first language
    in order. Other columns are kept, columns of the output names replaced; an empty table stays empty.

    The best language of a text in none of them may score about one half. A column named ``familiar`` tells such
    texts: false where the share of the text's distinct 3-grams that two labelled texts or more hold is below
    ``KNOWN_PART`` of the ``KNOWN_QUANTILE`` quantile of that share over the language's labelled texts, and for ``und``.
    """
    added = ["lang_pred", "score", *([familiar] if familiar else [])]
    docs = common.without(docs, *added)
    names = docs.columns
    return docs.withColumn("_pred", _predictor(model)("text")).select(
        *names, *[F.col(f"_pred.{field}").alias(name) for field, name in zip(("lang", "score", "familiar"), added)])
