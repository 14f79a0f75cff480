"""Edit-aware token counts.

A byte-level BPE text's tokens are the sum over its pre-tokens, so a document keeps a segment tree over them: leaves hold runs
of pre-tokens with their lengths and token counts, inner nodes the sums of characters and tokens. An edit finds its leaves by
descent, re-encodes the touched pre-tokens with the context that could change their borders, until a new border falls
on an old one behind the edit, and updates the sums on the paths to the root. A leaf that has grown to twice its size is split.

Trees are state: build_trees writes them out as columns (text, lengths and counts of pre-tokens, pre-tokens a leaf, sums by node), and apply_edits reads them, opens the leaves that edits
touch, and gives trees again. Texts are encoded whole once, when their trees are built.

Tokenizers are read from vocabulary files whose path is a parameter; the file is read once by the driver and sent to the executors.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Kept, written

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Splits text into pre-tokens for this vocabulary (a fixed value of it).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens in a leaf of a new tree; one of more than twice as many is split.
LEAF = 64
#: A pre-token's end depends on no more than this many characters behind it.
LOOK = 2
#: Counts of this many different pre-tokens are remembered by a worker.
REMEMBERED = 400_000


class Tokenizer:
    def __init__(self, vocabulary: bytes, pattern: str = PATTERN):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        self.encoding = tiktoken.Encoding("counting", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.known: dict[str, int] = {}

    def split(self, text: str) -> list[str]:
        return self.pattern.findall(text)

    def counts(self, pieces: list[str]) -> list[int]:
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        try:
            return [known[p] for p in pieces]
        except KeyError:
            for p in pieces:
                if p not in known:
                    known[p] = len(self.encoding.encode_ordinary(p)) if len(p) < 1000 else -1
            # Long pieces (runs without a break) are counted anew each time rather than kept.
            out = [known[p] for p in pieces]
            return [len(self.encoding.encode_ordinary(p)) if n < 0 else n for p, n in zip(pieces, out)] if -1 in out else out


_MADE: dict[tuple[bytes, str], Tokenizer] = {}


def tokenizer_for(vocabulary: bytes, pattern: str) -> Tokenizer:
    """The tokenizer of a vocabulary file's bytes, kept by the process from one task to the next."""
    if (vocabulary, pattern) not in _MADE:
        _MADE.clear()
        _MADE[vocabulary, pattern] = Tokenizer(vocabulary, pattern)
    return _MADE[vocabulary, pattern]


class TokenTree:
    """A text as a segment tree of pre-tokens. A leaf is a pair of lists (pre-tokens, their counts), or the number of a stored leaf that has not been opened yet."""

    def __init__(self, text: str, tokenizer: Tokenizer):
        self.tokenizer = tokenizer
        pieces = tokenizer.split(text)
        counts = tokenizer.counts(pieces)
        self.leaves: list = [(pieces[i : i + LEAF], counts[i : i + LEAF]) for i in range(0, len(pieces), LEAF)] or [([], [])]
        self._index([(sum(map(len, p)), sum(c)) for p, c in self.leaves])
        self.encoded_chars = len(text)

    @classmethod
    def load(cls, state: dict, tokenizer: Tokenizer) -> "TokenTree":
        """A tree from what save() gave; only its sums are read until an edit opens a leaf."""
        self = cls.__new__(cls)
        self.tokenizer, self.encoded_chars = tokenizer, 0
        self.stored_text, self.sizes = state["text"], state["sizes"]
        self.lengths, self.stored_counts = np.frombuffer(state["lengths"], np.uint32), np.frombuffer(state["counts"], np.uint32)
        self.chars, self.tokens = list(state["chars"]), list(state["tokens"])
        self.width = len(self.chars) // 2
        self.leaves = list(range(len(self.sizes)))
        self.first_piece = np.concatenate([[0], np.cumsum(self.sizes, dtype=np.int64)])
        self.first_char = np.concatenate([[0], np.cumsum(self.chars[self.width : self.width + len(self.sizes)], dtype=np.int64)])
        return self

    def save(self) -> dict:
        opened = [self.leaf(k) for k in range(len(self.leaves))]
        return {
            "text": self.text(), "lengths": np.array([len(p) for own, _ in opened for p in own], np.uint32).tobytes(), "counts": np.array([c for _, own in opened for c in own], np.uint32).tobytes(),
            "sizes": [len(own) for own, _ in opened], "chars": self.chars, "tokens": self.tokens,
        }

    def _index(self, sums: list[tuple[int, int]]) -> None:
        """Builds the nodes over the leaves' sums of characters and tokens."""
        self.width = 1 << (len(sums) - 1).bit_length()
        rest = [0] * (self.width - len(sums))
        self.chars = [0] * self.width + [a for a, _ in sums] + rest
        self.tokens = [0] * self.width + [b for _, b in sums] + rest
        for i in range(self.width - 1, 0, -1):
            self._sum_node(i)

    def leaf(self, k: int) -> tuple[list[str], list[int]]:
        found = self.leaves[k]
        if isinstance(found, int):
            a, b = int(self.first_piece[found]), int(self.first_piece[found + 1])
            ends = (np.cumsum(self.lengths[a:b], dtype=np.int64) + self.first_char[found]).tolist()
            own = [self.stored_text[x:y] for x, y in zip([int(self.first_char[found]), *ends], ends)]
            found = self.leaves[k] = (own, self.stored_counts[a:b].tolist())
        return found

    def _sum_leaf(self, k: int) -> None:
        pieces, counts = self.leaf(k)
        self.chars[self.width + k] = sum(map(len, pieces))
        self.tokens[self.width + k] = sum(counts)

    def _sum_node(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    @property
    def size(self) -> int:
        return self.chars[1]

    def text(self) -> str:
        return "".join(self.stored_text[self.first_char[x] : self.first_char[x + 1]] if isinstance(x, int) else "".join(x[0]) for x in self.leaves)

    def find(self, at: int) -> tuple[int, int, int]:
        """Leaf, piece in it, and the piece's first character, of the piece that holds character at; past the end, the end of the last leaf."""
        if at >= self.size:
            k = len(self.leaves) - 1
            return k, len(self.leaf(k)[0]), self.size
        i, before = 1, 0
        while i < self.width:
            i *= 2
            if at - before >= self.chars[i]:
                before += self.chars[i]
                i += 1
        k = i - self.width
        for j, p in enumerate(self.leaf(k)[0]):
            if at < before + len(p):
                return k, j, before
            before += len(p)
        raise AssertionError("sums and pieces disagree")

    def _forward(self, k: int, j: int):
        while k < len(self.leaves):
            own = self.leaf(k)[0]
            for j in range(j, len(own)):
                yield k, j, own[j]
            k, j = k + 1, 0

    def edit(self, start: int, stop: int, new: str) -> int:
        """Puts new in place of characters start to stop (clipped to the text). Returns how many characters were encoded again."""
        start = max(0, min(start, self.size))
        stop = max(start, min(stop, self.size))
        # The first piece whose end depends on a changed character: it ends behind start - LOOK.
        k, j, begin = self.find(max(0, start - LOOK)) if self.size else (0, 0, 0)
        end_k, end_j, made = self._encode(k, j, begin, start, stop, new)
        self._replace(k, j, end_k, end_j, made, self.tokenizer.counts(made))
        again = sum(map(len, made))
        self.encoded_chars += again
        return again

    def _encode(self, k: int, j: int, begin: int, start: int, stop: int, new: str) -> tuple[int, int, list[str]]:
        """The pieces from piece j of leaf k on, which begins at character begin, up to where a new border falls on an old one behind the edit: that place, and the new pieces."""
        old, taken, held, shift = self._forward(k, j), [], begin, len(new) - (stop - start)
        places: dict[int, tuple[int, int]] = {}  # old borders behind the edit, in new coordinates: leaf and piece after it
        last = len(self.leaves) - 1
        more, ahead = True, 16
        while True:
            wanted = 0
            while more and (held < stop + 1 or wanted < ahead):
                got = next(old, None)
                if got is None:
                    more = False
                    break
                taken.append(got[2])
                held += len(got[2])
                wanted += 1
                if held >= stop:
                    places[held + shift] = (got[0], got[1] + 1)
            window = "".join(taken)
            window = window[: start - begin] + new + window[stop - begin :]
            made, size = [], len(window) + begin
            for m in self.tokenizer.pattern.finditer(window):
                at = m.end() + begin
                # Nearer to the window's end than LOOK, the next characters are needed to be sure of this border.
                if more and at + LOOK > size:
                    break
                made.append(m.group())
                if at >= start + len(new) and at in places:
                    return *places[at], made
            ahead *= 4
            if not more:
                return last, len(self.leaf(last)[0]), made

    def _replace(self, k: int, j: int, end_k: int, end_j: int, made: list[str], counts: list[int]) -> None:
        """Puts pieces in place of those from (k, j) to (end_k, end_j), and updates the sums above."""
        first, last = self.leaf(k), self.leaf(end_k)
        pieces, own = first[0][:j] + made, first[1][:j] + counts
        tail, tail_counts = last[0][end_j:], last[1][end_j:]
        if end_k == k or len(pieces) + len(tail) <= LEAF:
            pieces, own, tail, tail_counts = pieces + tail, own + tail_counts, [], []
        changed = {k: (pieces, own)} | {i: ([], []) for i in range(k + 1, end_k)} | ({end_k: (tail, tail_counts)} if end_k > k else {})
        if max(len(p) for p, _ in changed.values()) <= 2 * LEAF and len(changed) < 3:
            nodes = set()
            for i, x in changed.items():
                self.leaves[i] = x
                self._sum_leaf(i)
                nodes.add((self.width + i) // 2)
            while nodes and nodes != {0}:
                for i in nodes:
                    self._sum_node(i)
                nodes = {i // 2 for i in nodes if i > 1}
            return
        # Leaves are split or go: the nodes are built anew over the sums of all leaves, whose pieces stay as they are.
        sums = list(zip(self.chars[self.width : self.width + len(self.leaves)], self.tokens[self.width : self.width + len(self.leaves)]))
        split = [(p[i : i + LEAF], c[i : i + LEAF]) for p, c in changed.values() for i in range(0, len(p), LEAF)]
        self.leaves[k : end_k + 1] = split
        sums[k : end_k + 1] = [(sum(map(len, p)), sum(c)) for p, c in split]
        if not self.leaves:
            self.leaves, sums = [([], [])], [(0, 0)]
        self._index(sums)


_STATE = pa.struct([("text", pa.string()), ("lengths", pa.binary()), ("counts", pa.binary()), ("sizes", pa.list_(pa.int32())), ("chars", pa.list_(pa.int64())), ("tokens", pa.list_(pa.int64()))])
_STATE_DDL = "struct<text: string, lengths: binary, counts: binary, sizes: array<int>, chars: array<bigint>, tokens: array<bigint>>"
#: Characters of texts whose trees are made before they are handed on.
_BATCH_CHARS = 4 << 20


def _vocabulary(docs: DataFrame, vocabulary: str, pattern: str):
    with open(vocabulary, "rb") as f:
        return docs.sparkSession.sparkContext.broadcast((f.read(), pattern))


def build_trees(docs: DataFrame, keep: list[str], text: str = "text", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """The columns in keep with n_tokens, and tree, the segment tree of each row's whole text as a struct to be written and read again.

    A null text counts as empty. Repeated rows get equal trees; an empty table gives an empty table; other columns are not read. A kept column named like one of the results
    gives way to it.
    """
    shared, kept = _vocabulary(docs, vocabulary, pattern), Kept(docs, keep, ["n_tokens", "tree"])

    def run(batches):
        tokenizer = tokenizer_for(*shared.value)
        for batch in batches:
            rows, first, size = [], 0, 0
            for i, t in enumerate(batch.column("text")):
                tree = TokenTree(t.as_py() or "", tokenizer)
                rows.append((tree.total, tree.save()))
                size += tree.size
                if size > _BATCH_CHARS or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([batch.column("kept").slice(first, len(rows)), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], _STATE)], names=["kept", "n_tokens", "tree"])
                    rows, first, size = [], i + 1, 0

    return kept.out(docs.select(kept.column, F.col(text).alias("text")).mapInArrow(run, kept.schema(f"n_tokens long, tree {_STATE_DDL}")))


def apply_edits(trees: DataFrame, keep: list[str], edits: str, tree: str = "tree", with_tree: bool = True, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """The columns in keep with n_tokens before the edits, n_tokens_edited, n_chars_edited, n_chars_again (characters encoded again) and, if with_tree, tree as edited.

    edits names a column of array<struct<start: bigint, stop: bigint, text: string>>, applied in order, each to the text as the ones before left it; a null array, null edit
    or null bound changes nothing, and a null edit text deletes. Bounds are clipped to the text. A null tree is that of an empty text. Repeated rows get equal results; an empty table
    gives an empty table; other columns are not read. A kept column named like one of the results gives way to it.
    """
    made = ["n_tokens", "n_tokens_edited", "n_chars_edited", "n_chars_again"] + ["tree"] * with_tree
    shared, kept = _vocabulary(trees, vocabulary, pattern), Kept(trees, keep, made)

    def run(batches):
        tokenizer = tokenizer_for(*shared.value)
        for batch in batches:
            rows, first, size = [], 0, 0
            for i, (state, changes) in enumerate(zip(batch.column("tree"), batch.column("edits"))):
                state = state.as_py()
                own = TokenTree.load(state, tokenizer) if state is not None else TokenTree("", tokenizer)
                before, again = own.total, 0
                for e in changes.as_py() or []:
                    if e is not None and e["start"] is not None and e["stop"] is not None:
                        again += own.edit(e["start"], e["stop"], e["text"] or "")
                rows.append((before, own.total, own.size, again, own.save() if with_tree else None))
                size += own.size
                if size > _BATCH_CHARS or i == batch.num_rows - 1:
                    cols = [pa.array([r[c] for r in rows], pa.int64()) for c in range(4)] + [pa.array([r[4] for r in rows], _STATE)] * with_tree
                    yield pa.RecordBatch.from_arrays([batch.column("kept").slice(first, len(rows)), *cols], names=["kept", *made])
                    rows, first, size = [], i + 1, 0

    ddl = "n_tokens long, n_tokens_edited long, n_chars_edited long, n_chars_again long" + f", tree {_STATE_DDL}" * with_tree
    return kept.out(trees.select(kept.column, F.col(tree).alias("tree"), F.col(edits).alias("edits")).mapInArrow(run, kept.schema(ddl)))


def count_with_edits(docs: DataFrame, keep: list[str], edits: str, text: str = "text", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """Trees are built of all texts and written, then read and edited: the columns in keep with n_tokens, n_tokens_edited, n_chars_edited and n_chars_again. Odd cases as in build_trees and apply_edits."""
    kept = Kept(docs, keep, ["n_tokens", "n_tokens_edited", "n_chars_edited", "n_chars_again"])
    packed = docs.select(kept.column, F.col(text).alias("text"), F.col(edits).alias("edits"))
    trees = written(build_trees(packed, ["kept", "edits"], "text", vocabulary, pattern), "token-trees", "zstd")
    return kept.out(apply_edits(trees, ["kept"], "edits", "tree", False, vocabulary, pattern))
