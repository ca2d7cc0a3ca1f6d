"""Toxicity: bags of subword embeddings averaged into a linear softmax, both trained jointly in numpy."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetide.llm import common
from pricetide.llm.shingles import BASE, mix
from pricetide.session import stage

# Bounds of the labelled sample a model is fitted on, for each label: rows, and bytes of their texts.
SAMPLE_ROWS = 3_000
SAMPLE_BYTES = 8 << 20
BUCKET_BITS = 18
LENGTHS = (3, 4, 5, 6)  # bytes of an n-gram, the marks at a word's ends included
WIDTH = 8  # numbers of an embedding
STEPS, TOGETHER, RATE, SLOPE_RATE = 3_000, 64, 1.0, 0.05  # batches in all, texts of a batch
START = 1e-8  # of the squared steps of an embedding: rare subwords move little
LEAST_TEXTS = 5  # sampled texts that hold a subword
# The average of a text counts subwords of no meaning with this weight, so a few words of chance weigh little.
PADDING = 300.0
PREDICTED = 0.3
PIECE = 1 << 20  # bytes of a text looked at together
SEED = 11

# Bytes of lower-cased UTF-8 that stand in words: letters, digits, signs that replace letters, and all above ASCII.
# Every other byte is the blank that marks where words end.
_WORD = bytes(b if chr(b).isalnum() and b < 128 or b > 127 or chr(b) in "@$*'-_" else 32 for b in range(256))


def words(text: str | None) -> dict[bytes, int]:
    """The text's lower-cased words and how often each occurs."""
    data = (text or "").lower().encode("utf-8", "surrogatepass").translate(_WORD)
    found, at = Counter(), 0
    while at < len(data):
        stop = data.find(b" ", at + PIECE) if len(data) - at > PIECE else -1
        stop = len(data) if stop < 0 else stop
        found.update(data[at:stop].split())
        at = stop
    return found


def subwords(text: str | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of the n-grams of a text's words, in pieces, and their weights: the root of the word's number."""
    found = words(text)
    names, at = list(found), 0
    while at < len(names):
        part, size = [], 0
        while at < len(names) and size <= PIECE:
            part.append(names[at])
            size += len(names[at]) + 1
            at += 1
        weight = np.sqrt(np.repeat(np.array([found[w] for w in part], np.float32), [len(w) + 1 for w in part]))
        yield _grams(np.frombuffer(b" " + b" ".join(part) + b" ", np.uint8), weight)


def _grams(data: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``data``: words between single blanks; ``weight``: of each byte but the last, that of the word it begins or belongs to."""
    blank = data == 32
    value = data.astype(np.uint64) + np.uint64(1)
    hashed, factor, inner = value, 1, None  # inner: whether a blank stands between a window's ends
    buckets, weights = [np.zeros(0, np.int32)], [np.zeros(0, np.float32)]
    for n in range(2, max(LENGTHS) + 1):
        if len(data) < n:
            break
        factor = factor * int(BASE) % (1 << 64)
        hashed = hashed[:-1] + value[n - 1 :] * np.uint64(factor)
        inner = np.zeros(len(hashed), bool) if n == 2 else inner[:-1] | blank[n - 2 : len(data) - 1]
        if n in LENGTHS:
            whole = np.flatnonzero(~inner)
            buckets.append((mix(hashed[whole] + np.uint64(n)) >> np.uint64(64 - BUCKET_BITS)).astype(np.int32))
            weights.append(weight[whole])
    return np.concatenate(buckets), np.concatenate(weights)


@dataclass
class ToxicityModel:
    """Embeddings, and the softmax over the average of a text's subword embeddings."""

    embeddings: np.ndarray  # buckets x WIDTH
    weights: np.ndarray  # WIDTH x 2
    bias: np.ndarray  # 2

    def evidence(self) -> np.ndarray:
        """Per bucket what it adds to the log-odds: the average is linear, so scoring needs this product alone."""
        return (self.embeddings @ (self.weights[:, 1] - self.weights[:, 0])).astype(np.float32)


def score_text(text: str | None, evidence: np.ndarray, bias: float) -> float:
    total, size = 0.0, PADDING
    for bucket, weight in subwords(text):
        total += float(np.dot(evidence[bucket], weight))
        size += float(weight.sum())
    return float(1 / (1 + np.exp(-np.clip(bias + total / size, -50, 50))))


def _bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their shares of the average."""
    found, total = np.zeros(0, np.int32), np.zeros(0)
    for bucket, weight in subwords(text):
        found, where = np.unique(np.concatenate([found, bucket]), return_inverse=True)
        total = np.bincount(where, np.concatenate([total, weight]), len(found))
    return found.astype(np.int32), (total / (PADDING + total.sum())).astype(np.float32)


def train(texts: list[str], toxic: list[int], share: float, steps: int = STEPS, width: int = WIDTH, seed: int = SEED) -> ToxicityModel:
    """Joint training of embeddings and softmax by AdaGrad on batches of texts.

    A softmax over two labels depends on the difference of its weight columns alone, so both gradients follow from one
    number per subword: its shares in the batch's texts times the texts' errors. The two labels weigh the same in
    training; the bias is then moved to ``share``, the toxic part of all labelled rows. Subwords that fewer than
    ``LEAST_TEXTS`` texts hold keep a zero embedding.
    """
    random = np.random.default_rng(seed)
    order = random.permutation(len(texts))
    bags = [_bag(texts[i]) for i in order]
    label = np.asarray(toxic, float)[order]
    held = np.zeros(1 << BUCKET_BITS, np.int32)
    for found, _ in bags:
        held[found] += 1
    known = np.flatnonzero(held >= LEAST_TEXTS)
    number = np.full(1 << BUCKET_BITS, -1, np.int32)
    number[known] = np.arange(len(known))
    batches = []
    for at in range(0, len(bags), TOGETHER):
        part = bags[at : at + TOGETHER]
        bags[at : at + TOGETHER] = [None] * len(part)
        bucket, shares = (np.concatenate([b[i] for b in part]) for i in (0, 1))
        rows = np.repeat(np.arange(len(part), dtype=np.int32), [len(found) for found, _ in part])
        use = held[bucket] >= LEAST_TEXTS
        batches.append((slice(at, at + len(part)), rows[use], number[bucket[use]], shares[use]))
    vectors = random.uniform(-1 / width, 1 / width, (len(known), width)).astype(np.float32)
    slope, bias = random.normal(0, 1, width).astype(np.float32), 0.0  # toxic weights minus the others
    weight = np.where(label == 1, 0.5 / max(1.0, label.sum()), 0.5 / max(1.0, len(label) - label.sum())) * len(label)
    squares, slope_squares, bias_square = np.full(len(known), START, np.float32), np.full(width, 1e-8, np.float32), 1e-8
    for _ in range(-(-steps // max(1, len(batches)))):
        for docs, rows, bucket, shares in batches:
            n = docs.stop - docs.start
            logit = np.bincount(rows, shares * (vectors @ slope)[bucket], n) + bias
            error = (1 / (1 + np.exp(-logit)) - label[docs]) * weight[docs] / n
            pull = np.bincount(bucket, shares * error[rows], len(known)).astype(np.float32)
            slope_step, bias_step = pull @ vectors, error.sum()
            hit = np.flatnonzero(pull)
            step = pull[hit, None] * slope
            squares[hit] += (step**2).mean(axis=1)
            vectors[hit] -= RATE * step / np.sqrt(squares[hit, None])
            slope_squares += slope_step**2
            slope -= SLOPE_RATE * slope_step / np.sqrt(slope_squares)
            bias_square += bias_step**2
            bias -= SLOPE_RATE * bias_step / bias_square**0.5
    share = min(max(share, 1e-6), 1 - 1e-6)
    embeddings = np.zeros((1 << BUCKET_BITS, width), np.float32)
    embeddings[known] = vectors
    return ToxicityModel(embeddings, np.stack([-slope / 2, slope / 2], axis=1), np.array([0, bias + np.log(share / (1 - share))]))


def sample_labelled(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES) -> tuple[DataFrame | None, float]:
    """The sampled ``doc_id, toxic, text``, and the toxic part of all labelled documents.

    Of each label the documents of least id hash, ``rows`` at most, as long as their texts have ``size`` bytes together
    (the first one stays in any case). Ids labelled twice count as toxic if one label says so; of rows with one id the
    least text is taken.
    """
    marks = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    texts = docs.where("text is not null").select("doc_id", F.octet_length("text").alias("size"))
    found = stage(texts.join(marks, "doc_id").groupBy("doc_id").agg(F.first("toxic").alias("toxic"), F.min("size").alias("size")))
    counts = {r.toxic: r.n for r in found.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    chosen = []
    for toxic in sorted(counts):
        first = found.where(F.col("toxic") == toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).collect()
        room = size
        for r in first:
            room -= r["size"]
            if chosen and chosen[-1][1] == toxic and room < 0:
                break
            chosen.append((r.doc_id, toxic))
    if not chosen:
        return None, 0.0
    ids = docs.sparkSession.createDataFrame(chosen, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, toxic int")
    sample = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(ids), "doc_id")  # at most 2 * rows ids
    return sample.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")), counts.get(1, 0) / sum(counts.values())


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES) -> ToxicityModel | None:
    """Trains on a bounded sample (``sample_labelled``) of ``docs`` (``doc_id, text``) that ``labels`` (``doc_id, toxic``)
    mark; None where no document is labelled. The driver holds the sample only, and the same rows give the same model."""
    sample, share = sample_labelled(docs, labels, rows, size)
    if sample is None:
        return None
    got = sorted(((r.doc_id, r.toxic, r.text) for r in sample.toLocalIterator()), key=lambda r: r[0])
    return train([r[2] for r in got], [r[1] for r in got], share)


def _scorer(model: ToxicityModel | None):
    evidence, bias = (model.evidence(), float(model.bias[1] - model.bias[0])) if model else (None, 0.0)

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        if evidence is None:
            return pa.array([0.0] * len(texts), pa.float64())
        return pa.array([score_text(t.as_py(), evidence, bias) for t in texts], pa.float64())
    return run


def score(docs: DataFrame, model: ToxicityModel | None) -> DataFrame:
    """Adds ``toxic_score`` (0 to 1) and ``toxic_pred`` (1 from a score of ``PREDICTED`` on) to every row.

    Only the text decides. Null and empty texts, and texts without a word, get the score of an average of nothing, near
    the toxic part of the labelled documents; all rows get 0 where the model is None. A word's n-grams count with the
    root of the word's number in the text, and ``PADDING`` units of nothing are averaged in. Whole texts count, in
    pieces of bounded size; repeated rows agree. Other columns are kept, columns of the output names replaced; an empty
    table stays empty.
    """
    docs = common.without(docs, "toxic_score", "toxic_pred")
    scored = docs.withColumn("toxic_score", _scorer(model)("text"))
    return scored.withColumn("toxic_pred", F.when(F.col("toxic_score") >= PREDICTED, 1).otherwise(0))
