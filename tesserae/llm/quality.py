"""Quality classifier: naive Bayes features with a linear support vector machine (NBSVM).

Indicators of n-grams (bytes in threes, words, and pairs of neighbouring words' shapes) are scaled by each class's smoothed
log-count ratio; a linear hinge-loss model is fitted to them by dual coordinate descent, and its margin is mapped to 0 to 1
by a logistic fitted on rows set aside from learning.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Kept, id_remainder

BITS = 17
#: Learning reads at most about this many labelled rows of each class, picked by a hash of doc_id.
TRAIN_ROWS = 6000
THRESHOLD = 0.3
#: Bytes of a text that are read at a time.
_PIECE = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Classes of bytes for word shapes: lower case, upper case, digit, other ASCII, beyond ASCII.
_CLASS = np.full(256, 3, np.uint64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 0, 1, 2, 4
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _bucket(h: np.ndarray, kind: int) -> np.ndarray:
    return (((h + np.uint64(kind)) * _MIX) >> np.uint64(64 - BITS)).astype(np.int32)


_POWER = np.cumprod(np.full(64, 0x100000001B3, np.uint64))


def _words(b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each word of some bytes: a hash, its shape (classes of its first, second and last byte), its length (to 15), and where it ends. A word's bytes beyond the 64th weigh alike."""
    gap = _SPACE[b]
    inside = ~gap
    start = np.flatnonzero(inside & np.concatenate([[True], gap[:-1]]))
    if not len(start):
        return (np.zeros(0, np.uint64),) * 3 + (start,)
    end = np.flatnonzero(inside & np.concatenate([gap[1:], [True]])) + 1
    place = np.arange(len(b))
    place[start[0] :] -= np.repeat(start, np.diff(np.append(start, len(b))))
    term = (b.astype(np.uint64) + np.uint64(1)) * _POWER[np.minimum(place, len(_POWER) - 1)]
    term[gap] = 0
    shape = (_CLASS[b[start]] * np.uint64(5) + _CLASS[b[np.minimum(start + 1, end - 1)]]) * np.uint64(5) + _CLASS[b[end - 1]]
    return np.add.reduceat(term, start), shape, np.minimum(end - start, 15).astype(np.uint64), end


def features(text: bytes | None, flags: np.ndarray, piece: int = _PIECE) -> np.ndarray:
    """Sorted buckets of the whole text's n-grams. flags: 2**BITS falses, left so.

    Long texts are read in pieces that end behind a word, a longer word making its piece longer; the last two bytes and the last word go along to the next, so the pieces don't show.
    """
    if not text:
        return np.zeros(0, np.int64)
    whole, at, last = np.frombuffer(text, np.uint8), 0, None
    while at < len(whole):
        end = min(len(whole), at + piece)
        while end < len(whole) and not _SPACE[whole[end]]:
            step = _SPACE[whole[end : end + 4096]]
            end += int(step.argmax()) if step.any() else len(step)
        w = whole[max(0, at - 2) : end].astype(np.uint64)
        if len(w) >= 3:
            flags[_bucket((w[:-2] << np.uint64(16)) | (w[1:-1] << np.uint64(8)) | w[2:], 1)] = True
        word, shape, size, _ = _words(whole[at:end])
        if len(word):
            flags[_bucket(word, 2)] = True
            flags[_bucket(shape * np.uint64(16) + size, 3)] = True
            if last is not None:
                word, shape = np.append(last[0], word), np.append(last[1], shape)
            if len(word) > 1:
                same = (word[1:] == word[:-1]).astype(np.uint64)
                flags[_bucket((shape[:-1] * np.uint64(125) + shape[1:]) * np.uint64(2) + same, 4)] = True
            last = word[-1:], shape[-1:]
        at = end
    found = np.flatnonzero(flags)
    flags[found] = False
    return found


def pack(found: np.ndarray) -> bytes:
    """Sorted buckets as bytes: their differences, or a bit for each bucket where that is less. No more than 2**BITS / 8 bytes."""
    if len(found) >= 1 << (BITS - 4):
        flags = np.zeros(1 << BITS, bool)
        flags[found] = True
        return b"\1" + np.packbits(flags).tobytes()
    steps = np.diff(found, prepend=0)
    # A difference beyond 65534 is written in parts.
    wide = np.repeat(np.minimum(steps, 65535), 1 + steps // 65535)
    if (steps >= 65535).any():
        wide = np.array([x for s in steps.tolist() for x in [*[65535] * (s // 65535), s % 65535]])
    return b"\0" + wide.astype(np.uint16).tobytes()


def unpack(packed: bytes) -> np.ndarray:
    if packed[0]:
        return np.flatnonzero(np.unpackbits(np.frombuffer(packed, np.uint8, offset=1)))
    steps = np.frombuffer(packed, np.uint16, offset=1).astype(np.int64)
    return np.cumsum(steps)[steps < 65535]


@dataclass
class NbSvm:
    """Weights by bucket (the log-count ratio times the fitted weight), bias, and the logistic from margins to scores."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, found: np.ndarray) -> float:
        return float(self.weights[found].sum() / np.sqrt(len(found)) + self.bias) if len(found) else self.bias

    def score(self, found: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(found) + self.shift, -500, 500))))

    @classmethod
    def fit(cls, rows: list[np.ndarray], labels: np.ndarray, c: float = 1.0, epochs: int = 12) -> "NbSvm":
        """Labels are 0 or 1. Every fifth row is set aside for the logistic."""
        aside = np.arange(len(rows)) % 5 == 4
        learn = np.flatnonzero(~aside) if aside.any() else np.arange(len(rows))
        p, q = np.ones(1 << BITS), np.ones(1 << BITS)
        for i in learn:
            (p if labels[i] else q)[rows[i]] += 1
        ratio = np.log((p / p.sum()) / (q / q.sum()))
        y = np.where(labels > 0, 1.0, -1.0)
        x = [ratio[r] / np.sqrt(max(1, len(r))) for r in rows]
        w, bias = _dual_descent([rows[i] for i in learn], [x[i] for i in learn], y[learn], c, epochs)
        model = cls(ratio * w, bias, 1.0, 0.0)
        held = np.flatnonzero(aside) if aside.any() else learn
        m = np.array([model.margin(rows[i]) for i in held])
        model.slope, model.shift = _logistic(m, labels[held])
        return model


def _dual_descent(rows, values, y, c: float, epochs: int) -> tuple[np.ndarray, float]:
    """L2-regularised hinge loss by dual coordinate descent; the rarer class weighs as much in all as the commoner one. The bias is a feature of value 1."""
    w, bias = np.zeros(1 << BITS), 0.0
    alpha = np.zeros(len(rows))
    ahead = max(1, (y > 0).sum())
    upper = np.where(y > 0, c, c * min(10.0, ahead / max(1, (y < 0).sum())))
    square = np.array([v @ v + 1.0 for v in values])
    rng = np.random.default_rng(0)
    for _ in range(epochs):
        most = 0.0
        for i in rng.permutation(len(rows)):
            g = y[i] * (w[rows[i]] @ values[i] + bias) - 1
            a = min(max(alpha[i] - g / square[i], 0.0), upper[i])
            if a != alpha[i]:
                step = (a - alpha[i]) * y[i]
                w[rows[i]] += step * values[i]
                bias += step
                most = max(most, abs(a - alpha[i]))
                alpha[i] = a
        if most < 1e-3:
            break
    return w, bias


def _logistic(m: np.ndarray, t: np.ndarray) -> tuple[float, float]:
    """Newton steps for P(label 1) = 1 / (1 + exp(-(a m + b))), with smoothed targets."""
    n1, n0 = (t > 0).sum(), (t <= 0).sum()
    target = np.where(t > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        r, v = p - target, np.maximum(p * (1 - p), 1e-9)
        g = np.array([(r * m).sum() + 1e-3 * (a - 1), r.sum()])
        h = np.array([[(v * m * m).sum() + 1e-3, (v * m).sum()], [(v * m).sum(), v.sum() + 1e-9]])
        d = np.linalg.solve(h, g)
        a, b = a - d[0], b - d[1]
        if np.abs(d).max() < 1e-8:
            break
    return float(max(a, 1e-3)), float(b)


def _featurise(batches):
    flags = np.zeros(1 << BITS, bool)
    for batch in batches:
        found = [pack(features(t, flags)) for t in batch.column("_text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("_h"), batch.column("_label"), pa.array(found, pa.binary())], names=["h", "label", "found"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality", train_rows: int = TRAIN_ROWS) -> NbSvm | None:
    """A model from the labelled rows of docs, at most about train_rows of each class; None unless both classes occur.

    Their n-grams come to the driver packed, at most 2**BITS / 8 bytes a row (16 KB), so no more than that times the rows of both classes, whatever the input's size.
    """
    own = labels.where(F.col(label).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label).cast("int")).alias("_label"))
    sizes = {r[0]: r[1] for r in own.groupBy("_label").count().collect()}
    if not {0, 1} <= set(sizes):
        return None
    steps = 1 << 20
    share = F.create_map(*[x for k, n in sorted(sizes.items()) for x in (F.lit(k), F.lit(min(steps, max(1, steps * train_rows // n))))])
    few = own.where(F.pmod(F.xxhash64("_id", F.lit("quality")), F.lit(steps)) < share[F.col("_label")])
    # At most about train_rows ids of each class, whatever the input's size: they are sent to the documents, not the documents to them.
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text).cast("binary").alias("_text")).join(F.broadcast(few), "_id")
    got = rows.select(F.xxhash64("_id").alias("_h"), "_label", "_text").mapInArrow(_featurise, "h long, label int, found binary").toArrow()
    order = np.lexsort((got.column("label").to_numpy(), got.column("h").to_numpy()))
    packed = got.column("found")
    sets = [unpack(packed[int(i)].as_py()).astype(np.int32) for i in order]
    y = got.column("label").to_numpy()[order]
    return NbSvm.fit(sets, y) if len(set(y.tolist())) == 2 else None


def score(docs: DataFrame, model: NbSvm | None, keep: list[str], text: str = "text") -> DataFrame:
    """The columns in keep with quality_score (0 to 1) of each row's whole text.

    Null and empty texts score as a text without n-grams (the bias alone); without a model every score is 0.5. Repeated
    rows get equal scores, an empty table gives an empty table, and other columns are not read. A kept column named `quality_score` gives way to the result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = Kept(docs, keep, ["quality_score"])

    def run(batches):
        m, flags = shared.value, np.zeros(1 << BITS, bool)
        for batch in batches:
            got = [0.5 if m is None else m.score(features(t, flags)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("kept"), pa.array(got, pa.float64())], names=["kept", "quality_score"])

    return kept.out(docs.select(kept.column, F.col(text).cast("binary").alias("text")).mapInArrow(run, kept.schema("quality_score double")))


def learnable(df: DataFrame, modulus: int = 5, id_col: str = "doc_id") -> DataFrame:
    """The rows whose labels may be learned: the id's remainder is not 0."""
    return df.where(id_remainder(F.col(id_col), modulus) != 0)
