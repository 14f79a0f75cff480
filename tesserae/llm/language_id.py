"""Language identification by prediction by partial matching (PPM).

For each language a variable-order tree of byte contexts is kept: the counts of each byte after each context of
0 to ORDER bytes. Statistics are frozen after learning. The code length of a byte is exact: in the longest context that
the language has seen, a seen byte of count n costs -log2(n / (N + D)), N being the context's total and D its distinct bytes;
an unseen byte costs the escape -log2(D / (N + D)) and is coded in the next shorter context, down to order -1,
where each of 256 bytes costs 8 bits. The language with the shortest whole-text code wins; the score is its posterior
under equal priors, with code lengths per sixteenth of a byte so that short texts stay uncertain.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Kept, blocks

ORDER = 3
#: Learning reads at most about this many labelled documents a language, picked by a hash of doc_id.
TRAIN_DOCS = 3000
_START = b"\n" * ORDER
_BLOCK = 1 << 18
_EVIDENCE = 1 / 16


def _grams(buf: np.ndarray, n: int) -> np.ndarray:
    """Big-endian n-byte grams, one for each position from ORDER on."""
    out = buf[ORDER:].astype(np.uint32)
    for j in range(1, n):
        out |= buf[ORDER - j : len(buf) - j].astype(np.uint32) << np.uint32(8 * j)
    return out


def _count_grams(batches):
    for batch in batches:
        langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lang in sorted(set(langs)):
            own = [t for k, t in zip(langs, texts) if k == lang]
            for a, b in blocks(own, _BLOCK):
                grams = np.concatenate([_grams(np.frombuffer(_START + t, np.uint8), ORDER + 1) for t in own[a:b]])
                keys, n = np.unique(grams, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array(keys.astype(np.int64)), pa.array(n)], names=["lang", "gram", "n"])


@dataclass
class PpmModel:
    """langs; level n (0 to ORDER): sorted keys of seen (n + 1)-grams, their cost by language, and of contexts of n bytes, their escape cost."""

    langs: list[str]
    keys: list[np.ndarray]
    cost: list[np.ndarray]
    contexts: list[np.ndarray]
    escape: list[np.ndarray]

    @classmethod
    def from_counts(cls, counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> "PpmModel":
        """counts: for each language the seen (ORDER + 1)-grams and their counts."""
        langs = sorted(counts)
        keys, cost, contexts, escape = [], [], [], []
        for n in range(ORDER + 1):
            own = []
            for lang in langs:
                grams, c = counts[lang]
                k, at = np.unique(grams & np.uint32((1 << (8 * (n + 1))) - 1), return_inverse=True)
                own.append((k, np.bincount(at, weights=c, minlength=len(k))))
            all_keys = np.unique(np.concatenate([k for k, _ in own])) if own else np.zeros(0, np.uint32)
            all_contexts = np.unique(all_keys >> np.uint32(8))
            esc = np.zeros((len(all_contexts), len(langs)))
            total, distinct, seen = np.zeros_like(esc), np.zeros_like(esc), np.zeros((len(all_keys), len(langs)))
            for j, (k, c) in enumerate(own):
                at = np.searchsorted(all_contexts, k >> np.uint32(8))
                total[:, j] = np.bincount(at, weights=c, minlength=len(all_contexts))
                distinct[:, j] = np.bincount(at, minlength=len(all_contexts))
                seen[np.searchsorted(all_keys, k), j] = c
            with np.errstate(divide="ignore", invalid="ignore"):
                esc = np.where(total > 0, -np.log2(distinct / (total + distinct)), 0.0)
                at = np.searchsorted(all_contexts, all_keys >> np.uint32(8))
                coded = -np.log2(seen / (total + distinct)[at])
            keys.append(all_keys)
            contexts.append(all_contexts)
            escape.append(esc.astype(np.float32))
            model = cls(langs, keys, cost, contexts, escape)
            lower = model.lengths(all_keys & np.uint32((1 << (8 * n)) - 1), n - 1) if len(all_keys) else coded
            cost.append(np.where(seen > 0, coded, esc[at] + lower).astype(np.float32))
        return cls(langs, keys, cost, contexts, escape)

    def lengths(self, grams: np.ndarray, n: int) -> np.ndarray:
        """Bits of the last byte of each (n + 1)-gram, by language."""
        if n < 0:
            return np.full((len(grams), len(self.langs)), 8.0, np.float32)
        at = np.minimum(np.searchsorted(self.keys[n], grams), len(self.keys[n]) - 1)
        out = self.cost[n][at]
        missing = np.flatnonzero(self.keys[n][at] != grams)
        if len(missing):
            rest = grams[missing]
            bits = self.lengths(rest & np.uint32((1 << (8 * n)) - 1), n - 1)
            context = rest >> np.uint32(8)
            c = np.minimum(np.searchsorted(self.contexts[n], context), len(self.contexts[n]) - 1)
            out[missing] = bits + np.where((self.contexts[n][c] == context)[:, None], self.escape[n][c], 0)
        return out

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Code length in bits of each whole text, by language."""
        out = np.zeros((len(texts), len(self.langs)))
        for a, b in blocks(texts, _BLOCK):
            if b - a == 1:
                whole = np.frombuffer(_START + texts[a], np.uint8)
                for i in range(0, len(texts[a]), _BLOCK):
                    out[a] += self.lengths(_grams(whole[i : i + _BLOCK + ORDER], ORDER + 1), ORDER).sum(axis=0, dtype=np.float64)
                continue
            grams = [_grams(np.frombuffer(_START + t, np.uint8), ORDER + 1) for t in texts[a:b]]
            bits = self.lengths(np.concatenate(grams), ORDER)
            end = 0
            for i, g in enumerate(grams):
                out[a + i] = bits[end : end + len(g)].sum(axis=0, dtype=np.float64)
                end += len(g)
        return out


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", id_col: str = "doc_id", train_docs: int = TRAIN_DOCS) -> PpmModel | None:
    """A model from rows with a text and a language; None if there are none. Reads at most about train_docs rows a language."""
    rows = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    rows = rows.select(F.col(lang).alias("_lang"), F.col(text).cast("binary").alias("_text"), F.xxhash64(F.col(id_col), F.lit("language id")).alias("_h"))
    sizes = {r[0]: r[1] for r in rows.groupBy("_lang").count().collect()}
    if not sizes:
        return None
    steps = 1 << 20
    share = F.create_map(*[x for k, n in sorted(sizes.items()) for x in (F.lit(k), F.lit(min(steps, max(1, steps * train_docs // n))))])
    few = rows.where(F.pmod("_h", F.lit(steps)) < share[F.col("_lang")]).select("_lang", "_text")
    counted = few.mapInArrow(_count_grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    if not counted.num_rows:
        return None
    names, grams, n = np.array(counted.column("lang").to_pylist(), object), counted.column("gram").to_numpy().astype(np.uint32), counted.column("n").to_numpy()
    return PpmModel.from_counts({k: (grams[names == k], n[names == k]) for k in sorted(set(names))})


def predict(docs: DataFrame, model: PpmModel | None, keep: list[str], text: str = "text") -> DataFrame:
    """The columns in keep, with lang_pred, score and bits_per_byte for each row's whole text.

    lang_pred is `und`, with score 0, for a null text, one without letters, or where nothing was learned. Ties go to the first
    language by code point. Repeated rows get equal results; an empty table gives an empty table. A kept column named like one of the results gives way to it.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    kept = Kept(docs, keep, ["lang_pred", "score", "bits_per_byte"])
    rows = docs.select(kept.column, F.col(text).cast("binary").alias("text"), F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("letters"))

    def run(batches):
        m = shared.value
        for batch in batches:
            texts, letters = batch.column("text").to_pylist(), batch.column("letters").to_pylist()
            names, scores, rates = ["und"] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
            at = [i for i, ok in enumerate(letters) if ok and m is not None]
            if at:
                bits = m.score([texts[i] for i in at])
                best = bits.argmin(axis=1)
                post = 1 / np.exp2(-_EVIDENCE * (bits - bits.min(axis=1, keepdims=True))).sum(axis=1)
                for i, k, p, low in zip(at, best, post, bits.min(axis=1)):
                    names[i], scores[i], rates[i] = m.langs[k], float(p), float(low) / len(texts[i])
            yield pa.RecordBatch.from_arrays([batch.column("kept"), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rates, pa.float64())], names=["kept", "lang_pred", "score", "bits_per_byte"])

    return kept.out(rows.mapInArrow(run, kept.schema("lang_pred string, score double, bits_per_byte double")))
