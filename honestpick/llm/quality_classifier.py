"""Quality classifier: ordinal cumulative-link regression on hashed text.

P(grade <= k) = sigmoid(threshold_k - score), one score per document shared by all grades, with
thresholds in increasing order.  The score is a mean over the document's words of two learned
weights each, of the word and of its outline (letters, capitals, digits and other signs, runs
shortened), plus the weights of the share of words equal to the word before and of the length.
Training uses at most `max_labelled` labelled rows, those with the smallest hash of their id, so
what reaches the driver is bounded; scoring is one pass over all documents.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from honestpick.llm.text import text_pieces, words_of

WORD_SLOTS, OUTLINE_SLOTS = 1 << 16, 1 << 12
EXTRA = WORD_SLOTS + OUTLINE_SLOTS          # slots of: repeats, then ten lengths
SLOTS = EXTRA + 11
_KIND = bytes(ord("a") if 97 <= b <= 122 or b >= 128 else ord("A") if 65 <= b <= 90
              else ord("0") if 48 <= b <= 57 else b for b in range(256))


def outline(word: bytes) -> bytes:
    """b"Then&&&" -> b"Aa&": classes of the bytes, equal neighbours once."""
    shape = word.translate(_KIND)
    return bytes(b for i, b in enumerate(shape) if not i or b != shape[i - 1])


def slots_of(word: bytes) -> tuple[int, int]:
    return zlib.crc32(word) % WORD_SLOTS, WORD_SLOTS + zlib.crc32(outline(word)) % OUTLINE_SLOTS


def extras(words: list[bytes]) -> list[tuple[int, float]]:
    """(slot, value) of the features that are not means over words."""
    n = len(words)
    length = min(9, int(np.log2(n))) if n else 0
    return [(EXTRA, sum(map(eq, words, words[1:])) / max(1, n - 1)), (EXTRA + 1 + length, 0.1)]


def features(text: str | None) -> tuple[list[int], list[float]]:
    """Sparse features of a text; none without words."""
    words = words_of(text)
    total: dict[int, float] = {}
    for w in words:
        for s in slots_of(w):
            total[s] = total.get(s, 0.0) + 1 / len(words)
    if words:
        total |= dict(extras(words))
    return list(total), list(total.values())


@dataclass(frozen=True)
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray       # increasing, one fewer than grades

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k), one column for each threshold."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -500, 500)))


def fit(rows: list[tuple[int, list[int], list[float]]], grades: int, penalty: float = 1e-6,
        steps: int = 250, rate: float = 0.5) -> OrdinalModel:
    """Maximum likelihood with a quadratic penalty, by Adam on all rows; deterministic.

    rows: (grade, slots, values).  Grades without a row keep a threshold beside the next.
    """
    y = np.array([r[0] for r in rows], dtype=np.int64)
    sizes = [len(r[1]) for r in rows]
    row = np.repeat(np.arange(len(rows)), sizes)
    idx = np.concatenate([np.asarray(r[1], dtype=np.int64) for r in rows]) if rows else row
    val = np.concatenate([np.asarray(r[2]) for r in rows]) if rows else np.zeros(0)
    share = [(np.sum(y <= k) + 1) / (len(y) + 2) for k in range(grades - 1)]
    start = np.log(np.array(share) / (1 - np.array(share)))
    gaps = np.log(np.maximum(np.diff(start), 1e-3))     # thresholds: a first one, then log gaps
    params = np.concatenate([np.zeros(SLOTS), start[:1], gaps])
    m, v = np.zeros_like(params), np.zeros_like(params)

    def thresholds(p):
        return p[SLOTS] + np.concatenate([[0.0], np.cumsum(np.exp(p[SLOTS + 1:]))])

    def sig(x):
        return 1 / (1 + np.exp(-np.clip(x, -500, 500)))

    n = max(1, len(rows))
    for step in range(1, steps + 1):
        cut = np.concatenate([[-np.inf], thresholds(params), [np.inf]])
        s = np.bincount(row, val * params[idx], minlength=len(rows))
        up, low = sig(cut[y + 1] - s), sig(cut[y] - s)
        p = np.maximum(up - low, 1e-12)
        d_up, d_low = up * (1 - up) / p, low * (1 - low) / p
        g = np.zeros_like(params)
        g[:SLOTS] = np.bincount(idx, val * (d_up - d_low)[row], minlength=SLOTS) / n
        g[:SLOTS] += penalty * params[:SLOTS]
        by_cut = np.array([-(d_up[y == k].sum() - d_low[y == k + 1].sum()) / n
                           for k in range(grades - 1)])
        g[SLOTS] = by_cut.sum()
        widths = np.exp(params[SLOTS + 1:])
        g[SLOTS + 1:] = [w * by_cut[k + 1:].sum() for k, w in enumerate(widths)]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        params = params - rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step))
                                                            + 1e-8)
    return OrdinalModel(params[:SLOTS], thresholds(params))


def _featurize(batches):
    for batch in batches:
        for i, texts in text_pieces(batch.column(1)):
            found = [features(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, len(texts)),
                 pa.array([f[0] for f in found], pa.list_(pa.int32())),
                 pa.array([f[1] for f in found], pa.list_(pa.float32()))],
                ["grade", "slots", "weights"])


def grade_of(quality: Column, toxic: Column) -> Column:
    """0 poor, 1 good but toxic, 2 good; null without a quality label."""
    return F.when(quality == 0, 0).when(toxic == 1, 1).when(quality == 1, 2)


def train(docs: DataFrame, graded: DataFrame, grades: int = 3, max_labelled: int = 6_000,
          doc_id: str = "doc_id", text: str = "text") -> OrdinalModel:
    """Fit on `graded` (doc_id, grade) rows that have a document.

    Rows with a null id or grade, or a grade outside 0..grades-1, are not used.  Without any row
    the model has zero weights and grades equally likely.
    """
    few = (graded.select(F.col(f"`{doc_id}`").alias("_id"), F.col("grade").cast("int"))
           .where(F.col("_id").isNotNull() & F.col("grade").between(0, grades - 1))
           .orderBy(F.xxhash64("_id"), "_id", "grade").limit(max_labelled))
    slim = docs.select(F.col(f"`{doc_id}`").alias("_id"),
                       F.col(f"`{text}`").cast("string").alias("text"))
    # at most max_labelled rows of two numbers are broadcast
    rows = (slim.join(F.broadcast(few), "_id").select("grade", "text")
            .mapInArrow(_featurize, "grade int, slots array<int>, weights array<float>")
            .toArrow())
    found = sorted((g, s, w) for g, s, w in zip(
        rows["grade"].to_pylist(), rows["slots"].to_pylist(), rows["weights"].to_pylist(),
        strict=True) if s)
    return fit(found, grades)


class _WordWeights(dict):
    def __init__(self, weights: np.ndarray, room: int = 400_000):
        super().__init__()
        self.weights, self.room = weights, room

    def __missing__(self, word):
        if len(self) >= self.room:
            self.clear()
        a, b = slots_of(word)
        w = self[word] = float(self.weights[a] + self.weights[b])
        return w


def _score(model: OrdinalModel):
    def run(batches):
        weight = _WordWeights(model.weights)
        for batch in batches:
            for i, texts in text_pieces(batch.column(batch.num_columns - 1)):
                sizes, scores = [], []
                for t in texts:
                    words = words_of(t)
                    sizes.append(len(words))
                    if not words:
                        scores.append(0.0)
                        continue
                    s = sum(map(weight.__getitem__, words)) / len(words)
                    scores.append(s + sum(v * model.weights[k] for k, v in extras(words)))
                tail = model.tails(np.array(scores))
                cols = [batch.column(c).slice(i, len(texts))
                        for c in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays(
                    [*cols, pa.array(sizes, pa.int64()), pa.array(tail.sum(axis=1)),
                     *[pa.array(tail[:, k]) for k in range(tail.shape[1])]],
                    [*batch.schema.names[:-1], "n_words", "expected_grade",
                     *[f"p_over_{k}" for k in range(tail.shape[1])]])
    return run


def score(docs: DataFrame, model: OrdinalModel, doc_id: str = "doc_id",
          text: str = "text") -> DataFrame:
    """doc_id, n_words, expected_grade, p_over_0, p_over_1 ... for every row.

    A text without words (null, empty, blank) scores 0 with n_words 0; select() rejects it.
    """
    slim = docs.select(F.col(f"`{doc_id}`").alias("doc_id"),
                       F.col(f"`{text}`").cast("string").alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    tails = "".join(f", p_over_{k} double" for k in range(len(model.thresholds)))
    return slim.mapInArrow(_score(model), f"doc_id {kind}, n_words bigint, "
                           f"expected_grade double{tails}")


def accepted(min_tail: float = 0.5, over: int = 0) -> Column:
    """Condition on score()'s columns: it has words and is likely enough above a grade."""
    return (F.col("n_words") > 0) & (F.col(f"p_over_{over}") >= min_tail)


def _keep(model: OrdinalModel, min_tail: float, over: int):
    run = _score(model)

    def keep(batches):
        for batch in batches:
            last = batch.num_columns - 1
            pos = pa.array(range(batch.num_rows), pa.int64())
            slim = pa.RecordBatch.from_arrays([pos, batch.column(last)], ["i", "text"])
            for scored in run([slim]):
                ok = np.asarray(scored.column(f"p_over_{over}")) >= min_tail
                ok &= np.asarray(scored.column("n_words")) > 0
                at = np.asarray(scored.column("i"))[ok]
                if len(at):
                    yield batch.take(pa.array(at))
    return keep


def select(docs: DataFrame, model: OrdinalModel, min_tail: float = 0.5, over: int = 0,
           text: str = "text") -> DataFrame:
    """The rows of `docs` that accepted() would keep, with all their columns unchanged."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    slim = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names,
                                                                  strict=True)],
                       F.col(f"`{text}`").cast("string").alias("scored"))
    out = slim.mapInArrow(_keep(model, min_tail, over), slim.schema)
    return out.select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)])
