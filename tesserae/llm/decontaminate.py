"""Benchmark decontamination by winnowing.

Texts are read as words (A-Z lower-cased; runs of 0-9, a-z and all beyond ASCII). Of every WINDOW consecutive k-grams of
GRAM words the smallest hash is a fingerprint, so any span of GRAM + WINDOW - 1 words that two texts share has a fingerprint
in common. Fingerprints of documents are joined to those of the test items; a hit is extended by the words about it to every span of that length that holds it, and a
span that an item has too, word by word, is contamination. Items of fewer words are looked for whole, by a hash of as many words.

The items' fingerprints and spans are tables of their own, whatever their number. Documents are read once and are never shuffled: a Bloom filter of the items' fingerprints, of bounded size, tells
which of a document's are worth joining, and only those leave it, with the words about them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Kept, content_key, maybe_broadcast, written

GRAM, WINDOW = 5, 6
SPAN = GRAM + WINDOW - 1
#: The Bloom filter has BLOOM_BITS bits a fingerprint, in 2 ** MAX_BLOOM bits (16 MB) at most; beyond that it lets more through, which the join sorts out.
BLOOM_BITS, MAX_BLOOM = 16, 27
#: Bytes of text that are hashed at a time.
_PIECE = 1 << 20
#: Lower-cases A-Z and turns bytes outside words into spaces.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_MUL = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.full(256, 0x100000001B3, np.uint64))
#: A word, A-Z not yet being lower-cased.
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: bytes | None) -> list[bytes]:
    return text.translate(_WORDS).split() if text else []


def word_hashes(text: bytes | None) -> np.ndarray:
    """A hash of each word of a text; equal words have equal ones. Works on pieces that end between words, a very long word being a piece of its own."""
    norm = text.translate(_WORDS) if text else b""
    out, at = [np.zeros(0, np.uint64)], 0
    while at < len(norm):
        end = norm.find(b" ", min(len(norm), at + _PIECE))
        end = len(norm) if end < 0 else end
        b = np.frombuffer(norm, np.uint8, end - at, at)
        inside = b != 32
        start = np.flatnonzero(inside & np.concatenate([[True], ~inside[:-1]]))
        if len(start):
            place = np.arange(len(b)) - np.repeat(start, np.diff(np.append(start, len(b)))) if start[0] == 0 else np.concatenate([np.zeros(start[0], np.int64), np.arange(start[0], len(b)) - np.repeat(start, np.diff(np.append(start, len(b))))])
            # Places beyond the table of powers weigh alike again; words that clash for it are told apart when spans are compared.
            term = (b.astype(np.uint64) + np.uint64(1)) * _POWERS[place & 255]
            term[~inside] = 0
            h = np.add.reduceat(term, start) * _MUL
            out.append(h ^ (h >> np.uint64(31)))
        at = end
    return np.concatenate(out)


def gram_hashes(word: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-word grams of words given by their hashes, n being part of the hash."""
    count = len(word) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(count, n, np.uint64)
    for j in range(n):
        h = (h ^ word[j : j + count]) * _MUL
        h ^= h >> np.uint64(29)
    return h


def selected(h: np.ndarray) -> np.ndarray:
    """Positions of all k-grams that are the smallest of some window (ties: all of them)."""
    count = len(h) - WINDOW + 1
    if count <= 0:
        return np.zeros(0, np.int64)
    least = h[:count].copy()
    for j in range(1, WINDOW):
        np.minimum(least, h[j : j + count], out=least)
    chosen = np.zeros(len(h), bool)
    for j in range(WINDOW):
        chosen[j : j + count] |= h[j : j + count] == least
    return np.flatnonzero(chosen)


def _item_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each item its fingerprints (kind 0: hash) and its spans (kind 1: words, as text)."""
    for batch in batches:
        for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist()):
            own = words(text)
            if not own:
                continue
            n = min(SPAN, len(own))
            h = word_hashes(text)
            prints = gram_hashes(h, GRAM)[selected(gram_hashes(h, GRAM))] if n == SPAN else gram_hashes(h, n)
            prints = np.unique(prints).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([0] * len(prints), pa.int32()), pa.array([n] * len(prints), pa.int32()), pa.array(prints), pa.nulls(len(prints), pa.string()), pa.nulls(len(prints), pa.string())], names=["kind", "n", "hash", "words", "item"])
            for i in range(0, len(own) - n + 1, 4096):
                spans = list({b" ".join(own[p : p + n]).decode("utf-8", "replace") for p in range(i, min(i + 4096, len(own) - n + 1))})
                yield pa.RecordBatch.from_arrays([pa.array([1] * len(spans), pa.int32()), pa.array([n] * len(spans), pa.int32()), pa.nulls(len(spans), pa.int64()), pa.array(spans), pa.array([item] * len(spans), pa.string())], names=["kind", "n", "hash", "words", "item"])


class Bloom:
    """A filter of hashes: bits is an array of 64-bit words, their number a power of two."""

    def __init__(self, log2_bits: int):
        self.log2_bits = log2_bits
        self.bits = np.zeros(1 << (log2_bits - 6), np.uint64)

    @staticmethod
    def columns(h: Column, log2_bits: int) -> list[Column]:
        """The three bits' places of a hash (signed long)."""
        return [F.shiftrightunsigned(h, s).bitwiseAND(F.lit((1 << log2_bits) - 1)) for s in (0, 18, 36)]

    def has(self, h: np.ndarray) -> np.ndarray:
        found = np.ones(len(h), bool)
        for s in (0, 18, 36):
            at = (h >> np.uint64(s)) & np.uint64((1 << self.log2_bits) - 1)
            found &= (self.bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) != 0
        return found


def _bloom(prints: DataFrame) -> Bloom:
    """Bits are set by the executors; the driver gets the words that have any, of which there are 2 ** (MAX_BLOOM - 6) at most."""
    made = Bloom(min(MAX_BLOOM, max(12, (BLOOM_BITS * prints.count()).bit_length())))
    at = prints.select(F.explode(F.array(*Bloom.columns(F.col("hash"), made.log2_bits))).alias("b"))
    by = at.groupBy(F.shiftright("b", 6).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("b").bitwiseAND(F.lit(63)).cast("int"))).alias("bits")).toArrow()
    made.bits[by.column("w").to_numpy()] = by.column("bits").to_numpy().view(np.uint64)
    return made


def _candidates(shared, short: list[int]):
    """For each row the hits of the filter: the gram's hash, and the words about it as far as a span through it can reach."""

    def run(batches):
        for batch in batches:
            rows: list[tuple] = []
            for k1, k2, text in zip(batch.column("k1").to_pylist(), batch.column("k2").to_pylist(), batch.column("text").to_pylist()):
                h, own = word_hashes(text), None
                for n in (GRAM, *short):
                    whole = n != GRAM or len(h) < SPAN  # items of fewer words than a span have no fingerprint chosen from windows
                    for grams, at, reach in _looked_up(h, n, whole, n in short):
                        for p in at[shared.value.has(grams[at])].tolist():
                            own = words(text) if own is None else own
                            first = max(0, p - reach)
                            about = b" ".join(own[first : p + n + reach]).decode("utf-8", "replace")
                            rows.append((k1, k2, p, n if not reach else SPAN, grams[p : p + 1].view(np.int64)[0], first, about))
                if len(rows) > 20_000:
                    yield _hit_batch(rows)
                    rows = []
            yield _hit_batch(rows)

    return run


def _looked_up(h: np.ndarray, n: int, whole: bool, is_short: bool):
    """(hashes, places to look up, reach) for grams of n words: the fingerprints, and all grams where there are items of n words."""
    grams = gram_hashes(h, n)
    if not whole:
        yield grams, selected(grams), SPAN - n
    if is_short:
        yield grams, np.arange(len(grams)), 0


def _hit_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["k1", "k2", "p", "n", "hash", "first", "about"])


def _hits(docs: DataFrame, items: DataFrame, text: str, item_id: str, item_text: str) -> DataFrame | None:
    """(k1, k2, hits, n_hit, items) for the texts with hits, by 128 bits of hash of the text; None if there is no item with words."""
    own = items.where(F.col(item_text).isNotNull()).select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.col(item_text).cast("binary").alias("text"))
    found = written(own.mapInArrow(_item_rows, "kind int, n int, hash long, words string, item string"), "items")
    prints = written(found.where("kind = 0").groupBy("n", "hash").agg(F.lit(1).alias("one")).select("n", "hash"), "item-prints")
    short = sorted(r["n"] for r in prints.where(F.col("n") < SPAN).select("n").distinct().collect())
    if prints.isEmpty():
        return None
    shared = docs.sparkSession.sparkContext.broadcast(_bloom(prints))
    k1, k2 = content_key(F.col(text))
    read = docs.where(F.col(text).isNotNull()).select(k1.alias("k1"), k2.alias("k2"), F.col(text).cast("binary").alias("text"))
    near = read.mapInArrow(_candidates(shared, short), "k1 long, k2 long, p long, n int, hash long, first long, about string")
    # Equal texts have equal hits. The join of fingerprints leaves no more rows of a text than it has.
    near = near.join(maybe_broadcast(prints), ["n", "hash"], "left_semi")
    parts = F.split("about", " ")
    starts = F.sequence(F.lit(0), F.size(parts) - F.col("n"))
    near = near.where(F.size(parts) >= F.col("n")).select("k1", "k2", "n", "first", parts.alias("about"), F.explode(starts).alias("s"))
    spans = near.select("k1", "k2", (F.col("first") + F.col("s")).alias("p"), F.col("n").cast("long").alias("n"), F.array_join(F.slice("about", F.col("s") + 1, F.col("n")), " ").alias("words")).distinct()
    known = found.where("kind = 1")
    spans = written(spans.join(maybe_broadcast(written(known.select("words").distinct(), "item-spans")), "words", "left_semi"), "spans")
    # A run of words is hit where a span begins no later than all before it end; its spans are one.
    ends = spans.groupBy("k1", "k2").agg(F.array_sort(F.collect_set(F.struct(F.col("p").alias("first"), (F.col("p") + F.col("n")).alias("end")))).alias("spans"))
    kind = "array<struct<first: bigint, end: bigint>>"
    join_on = F.aggregate(
        "spans", F.array().cast(kind),
        lambda done, x: F.when((F.size(done) > 0) & (F.element_at(done, -1)["end"] >= x["first"]), F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["first"].alias("first"), F.greatest(F.element_at(done, -1)["end"], x["end"]).alias("end"))))).otherwise(F.concat(done, F.array(x))),
    )
    ends = ends.select("k1", "k2", join_on.alias("hits"))
    names = spans.select("k1", "k2", "words").distinct().join(known.select("words", "item").distinct(), "words").groupBy("k1", "k2").agg(F.array_sort(F.collect_set("item")).alias("items"))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["first"])
    return written(ends.join(names, ["k1", "k2"]).select("k1", "k2", "hits", n_hit.alias("n_hit"), "items"), "hits")


def find_hits(docs: DataFrame, items: DataFrame, keep: list[str], text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each row of docs: the columns in keep, n_words, hits (spans [first, end) of words, merged), n_hit and items (sorted ids).

    A null text (or one without words) has no words and no hits; an item with a null text or without words never hits; a null item id
    counts as the empty string, and items of one id are one to the result. Repeated rows get equal results. Empty tables on either side give no hits. A kept column named like one of
    the results gives way to it.
    """
    kept = Kept(docs, keep, ["n_words", "hits", "n_hit", "items"])
    found = _hits(docs, items, text, item_id, item_text)
    k1, k2 = content_key(F.col(text))
    n_words = F.coalesce(F.regexp_count(F.col(text), F.lit(_WORD)), F.lit(0)).cast("long")
    rows = docs.select(kept.column, n_words.alias("n_words"), k1.alias("k1"), k2.alias("k2"))
    none = {"hits": F.array().cast("array<struct<first: bigint, end: bigint>>"), "n_hit": F.lit(0).cast("long"), "items": F.array().cast("array<string>")}
    if found is None:
        return kept.out(rows.withColumns(none))
    rows = rows.join(maybe_broadcast(found), ["k1", "k2"], "left")
    return kept.out(rows.withColumns({c: F.coalesce(F.col(c), v) for c, v in none.items()}))
