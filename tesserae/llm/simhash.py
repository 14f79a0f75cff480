"""SimHash near-duplicates with Golay-code fuzzy hashing.

A fingerprint has a bit for each bit that is set in over half the XXH64 values of a text's word shingles. Its 64 bits are cut into
three segments. A segment, padded to 23 bits, is decoded to the codewords of the binary Golay code within distance 4: one
to six of them, and two segments that differ in at most 2 bits always have one in common (the word between them lies within
3 of a codeword, the code being perfect). Of up to 4 differing bits over three segments,

* either some segment has none: then one of the two others has at most 2. Keys: a whole segment with a codeword of another;
* or each has at least one: then two have exactly one, so a half of each is equal, and the third has at most 2. Keys: a
  half of each of two segments with a codeword of the third.

So every linked pair shares a key of 33 bits or so; pairs that share a key are verified, and components follow.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Kept, discard, maybe_broadcast, popcount, written
from .components import components

SHINGLE = 4
MAX_BITS = 4
SEED = 42
#: First bit and width of each segment, and the width of its first half.
SEGMENTS = ((0, 21, 10), (21, 21, 10), (42, 22, 11))
#: A key of more fingerprints than this is compared in tiles of this size.
TILE = 2048
#: The generator polynomial of the binary Golay code (23, 12).
GENERATOR = 0b101011100011
_CHUNK = 1 << 16


def hashes(text: bytes | None):
    """XXH64 of the word shingles of a text, in pieces of bounded size."""
    norm = (text or b"").lower().split()
    if not norm:
        return
    if len(norm) <= SHINGLE:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(norm), SEED)], np.uint64)
        return
    for i in range(0, len(norm) - SHINGLE + 1, _CHUNK):
        part = norm[i : i + _CHUNK + SHINGLE - 1]
        line = b" ".join(part)
        ends = np.cumsum([len(w) + 1 for w in part])
        starts = [0, *(ends[:-1]).tolist()]
        digest = xxhash.xxh64_intdigest
        yield np.array([digest(line[a:b], SEED) for a, b in zip(starts, (ends[SHINGLE - 1 :] - 1).tolist())], np.uint64)


def fingerprint(text: bytes | None) -> int:
    """The fingerprint of a whole text; 0 where there are no words."""
    ones, total = np.zeros(64, np.int64), 0
    for h in hashes(text):
        bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
        total += len(h)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


def _syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words by the generator polynomial."""
    r = words.astype(np.int64)
    for i in range(22, 10, -1):
        r = np.where(r >> i & 1, r ^ (GENERATOR << (i - 11)), r)
    return r


class Golay:
    """Error patterns of weight up to 4 by syndrome, and keys of fingerprints."""

    def __init__(self):
        masks = [0]
        level = [(0, -1)]
        for _ in range(4):
            level = [(m | 1 << b, b) for m, last in level for b in range(last + 1, 23)]
            masks += [m for m, _ in level]
        masks = np.array(masks, np.int64)
        syndrome = _syndromes(masks)
        order = np.argsort(syndrome, kind="stable")
        counts = np.bincount(syndrome, minlength=2048)
        first = np.cumsum(counts) - counts
        width = counts.max()
        self.patterns = np.full((2048, width), -1, np.int64)
        for j in range(width):
            has = counts > j
            self.patterns[has, j] = masks[order[first[has] + j]]
        low = np.arange(1 << 12, dtype=np.int64)
        self._low, self._high = _syndromes(low), _syndromes(np.arange(1 << 11, dtype=np.int64) << 12)

    def codewords(self, words: np.ndarray) -> np.ndarray:
        """Message numbers (12 bits) of the codewords within distance 4 of each word; -1 fills rows up."""
        e = self.patterns[self._low[words & 0xFFF] ^ self._high[words >> 12]]
        return np.where(e < 0, -1, (words[:, None] ^ e) >> 11)

    def keys(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(key, fingerprint) for all keys of each fingerprint (unsigned)."""
        seg = [((prints >> np.uint64(s)) & np.uint64((1 << n) - 1)).astype(np.int64) for s, n, _ in SEGMENTS]
        near = [self.codewords(w) for w in seg]
        out, owner, kind = [], [], 0
        rows = np.arange(len(prints))

        def add(exact: np.ndarray, k: int) -> None:
            nonlocal kind
            ok = near[k] >= 0
            out.append((((np.int64(kind) << 40) | (exact << 12))[:, None] | near[k])[ok])
            owner.append(np.broadcast_to(rows[:, None], near[k].shape)[ok])
            kind += 1

        for x in range(3):
            for k in range(3):
                if k != x:
                    add(seg[x], k)
        halves = [(w & ((1 << h) - 1), w >> h) for w, (_, _, h) in zip(seg, SEGMENTS)]
        for k in range(3):
            x, y = [i for i in range(3) if i != k]
            for a in halves[x]:
                for b in halves[y]:
                    add(a | b << 11, k)
        return np.concatenate(out), prints[np.concatenate(owner)]


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns in keep with `fp`, the fingerprint as a signed long, of each row's whole text (null: no words)."""
    kept = Kept(docs, keep, ["fp"])

    def run(batches):
        for batch in batches:
            fp = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("kept"), pa.array(fp)], names=["kept", "fp"])

    return kept.out(docs.select(kept.column, F.col(text).cast("binary").alias("text")).mapInArrow(run, kept.schema("fp long")))


def _spanning(a: np.ndarray, b: np.ndarray | None = None) -> np.ndarray:
    """Pairs that join exactly what links of at most MAX_BITS join: within a, or between a and b. At most one pair for each member."""
    both = a if b is None else np.concatenate([a, b])
    close = popcount(both[:, None] ^ both[None, :]) <= MAX_BITS
    if b is not None:
        close[: len(a), : len(a)] = close[len(a) :, len(a) :] = False
        np.fill_diagonal(close, True)
    label = np.arange(len(both))
    while True:
        least = np.where(close, label[None, :], len(both)).min(axis=1)
        least = least[least]
        if (least == label).all():
            break
        label = least
    at = np.flatnonzero(label != np.arange(len(both)))
    return np.stack([both[label[at]], both[at]], axis=1)


def _emit(links: list[np.ndarray], hot: list[tuple[np.ndarray, np.ndarray]]):
    a = np.concatenate([x[:, 0] for x in links] + [k for k, _ in hot] + [np.zeros(0, np.int64)]).astype(np.int64)
    b = np.concatenate([x[:, 1] for x in links] + [p for _, p in hot] + [np.zeros(0, np.int64)]).astype(np.int64)
    kind = np.repeat(np.array([0, 1], np.int32), [sum(len(x) for x in links), sum(len(k) for k, _ in hot)])
    return pa.RecordBatch.from_arrays([pa.array(kind), pa.array(a), pa.array(b)], names=["kind", "a", "b"])


def _runs(batches):
    """Reads (key, fp) sorted by both; gives links within keys of up to TILE fingerprints, and passes larger keys on as rows of kind 1."""
    key, prints, open_hot = np.zeros(0, np.int64), np.zeros(0, np.int64), None
    for batch in batches:
        key = np.concatenate([key, batch.column("key").to_numpy()])
        prints = np.concatenate([prints, batch.column("fp").to_numpy()])
        if not len(key):
            continue
        last = np.searchsorted(key, key[-1])  # the last key's run may go on
        links, hot = _link_runs(key[:last], prints[:last], open_hot)
        if last:
            open_hot = None
        key, prints = key[last:], prints[last:]
        if open_hot == key[0] or len(key) > TILE:
            hot.append((key, prints))
            open_hot = key[0]
            key, prints = key[:0], prints[:0]
        yield _emit(links, hot)
    links, hot = _link_runs(key, prints, open_hot)
    yield _emit(links, hot)


def _link_runs(key: np.ndarray, prints: np.ndarray, open_hot) -> tuple[list[np.ndarray], list]:
    links, hot = [], []
    if not len(key):
        return links, hot
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(start, len(key)))
    two = start[size == 2]
    p, q = prints[two], prints[two + 1]
    ok = (popcount((p ^ q).view(np.uint64)) <= MAX_BITS) & (p != q)
    links.append(np.stack([p[ok], q[ok]], axis=1))
    for s, n in zip(start.tolist(), size.tolist()):
        if open_hot is not None and s == 0 and key[0] == open_hot:
            hot.append((key[:n], prints[:n]))
        elif n > TILE:
            hot.append((key[s : s + n], prints[s : s + n]))
        elif n > 2:
            links.append(_spanning(np.unique(prints[s : s + n]).view(np.uint64)).view(np.int64))
    return links, hot


def _tile(key, left, right):
    a, b = left["fp"].to_numpy().view(np.uint64), right["fp"].to_numpy().view(np.uint64)
    out = _spanning(a) if key[1].as_py() == key[2].as_py() else _spanning(a, b)
    return pa.table({"a": out[:, 0].astype(np.int64), "b": out[:, 1].astype(np.int64)})


def links(prints: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) that join exactly those which chains of at most MAX_BITS differing bits join."""
    golay = prints.sparkSession.sparkContext.broadcast(Golay())

    def keyed(batches):
        for batch in batches:
            all_prints = batch.column("fp").to_numpy().astype(np.uint64)
            for i in range(0, len(all_prints), 4096):
                k, p = golay.value.keys(all_prints[i : i + 4096])
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(p.astype(np.int64))], names=["key", "fp"])

    keys = prints.select("fp").mapInArrow(keyed, "key long, fp long")
    found = written(keys.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_runs, "kind int, a long, b long"), "links")
    hot = found.where("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("fp"))
    near = found.where("kind = 0").select("a", "b")
    if hot.isEmpty():
        return near.distinct()
    # Tiles of a key are paired, each pair compared in a task of its own; a tile holds about TILE fingerprints.
    tiles = hot.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("n"))
    tiled = written(hot.join(tiles, "key").withColumn("tile", F.pmod(F.xxhash64("fp"), F.col("n")).cast("int")), "tiles")
    each = F.sequence(F.lit(0), F.col("n") - 1)
    left = tiled.select("key", F.col("tile").alias("i"), F.explode(F.filter(each, lambda j: j >= F.col("tile"))).alias("j"), "fp")
    right = tiled.select("key", F.explode(F.filter(each, lambda i: i <= F.col("tile"))).alias("i"), F.col("tile").alias("j"), "fp")
    more = left.groupBy("key", "i", "j").cogroup(right.groupBy("key", "i", "j")).applyInArrow(_tile, "a long, b long")
    return near.union(more).distinct()


def roots(own: DataFrame) -> DataFrame:
    """(fp, root) for each distinct fingerprint of own (column fp): fingerprints of one root are one component."""
    prints = written(own.select("fp").distinct(), "prints")
    edges = written(links(prints), "near")
    reached = components(edges, "a", "b").withColumnRenamed("node", "fp")
    found = written(prints.join(reached, "fp", "left").select("fp", F.coalesce("component", "fp").alias("root")), "roots")
    discard(prints, edges)
    return found


def grouped(docs: DataFrame, keep: list[str], id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The columns in keep, then fp (signed long), root and component_id for each row of docs. Rows of one root are one component, whatever their ids.

    component_id is the smallest id reachable by links, the row's own included; a component of null ids only has a null one. A kept column named like one of the results gives
    way to it.
    """
    kept = Kept(docs, keep, ["fp", "root", "component_id"])
    own = written(fingerprints(docs.select(kept.column, F.col(id_col).alias("id"), F.col(text).alias("text")), ["kept", "id"]), "fingerprints")
    root = roots(own)
    # The least id of each fingerprint first, so a component is no more than its fingerprints.
    least = own.groupBy("fp").agg(F.min("id").alias("least")).join(maybe_broadcast(root), "fp")
    ids = least.groupBy("root").agg(F.min("least").alias("component_id"))
    named = written(root.join(ids, "root"), "named")
    discard(root)
    return kept.out(own.join(maybe_broadcast(named), "fp"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp (signed long) and component_id (the smallest id reachable by links, the row's own included) for each row of docs.

    Null texts, empty ones and ones without words have fingerprint 0 and are linked like others. Rows with a null id take part; a component of
    null ids only has a null component_id. Repeated rows give repeated rows. An empty table gives an empty table.
    """
    return grouped(docs, [id_col], id_col, text).select(id_col, "fp", "component_id")
