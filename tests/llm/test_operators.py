"""The operators against brute-force versions, on small inputs with nulls, empty and long texts, ties, repeated rows and columns of clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.llm import chat, components, decontaminate, language_id, licenses, line_dedup, media, mixing, quality, queries, simhash, token_counts
from tesserae.llm.common import table

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, row int, h double, _text string, lines string, bucket int, _items int, kept int, k1 long, items string, score double, label int, p int, source_size int"


def docs_of(spark, rows):
    """rows: (doc_id, text, lang, source); the other columns have names that the operators use themselves."""
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t), "x", 1, 2.0, "y", "z", 3, 4, 5, 6, "w", 0.5, 7, 8, 9) for i, t, lang, s in rows], SCHEMA)


LONG = "the quick brown fox jumps over the lazy dog again and again until night falls " * 3000
ODD = [
    (1, None, None, None), (2, "", "en", "a"), (3, "   \n\t ", None, "a"), (4, "the cat sat on the mat with the other cat today", "en", "a"),
    (4, "the cat sat on the mat with the other cat today", "en", "a"), (5, LONG, "en", "b"), (6, "123 456 !!", "en", "b"), (None, "le chat est sur la table avec un autre chat", "fr", "a"),
    (7, "le chat est sur la table avec un autre chat", "fr", None), (8, "Straße \U0001d11e é\x00x\x0b y", "de", "c"), (9, "the cat sat on the mat with the other cat today", "en", "é"),
]


def docs_text(spark):
    return {r["doc_id"]: r["text"] for r in table(spark, SMALL, "documents").collect()}


def test_language_id(spark):
    got = {r["doc_id"]: r for r in queries.op1_language_id(spark, SMALL).collect()}
    lang = {r["doc_id"]: r["lang"] for r in table(spark, SMALL, "documents").collect()}
    held = [i for i in got if got[i]["held_out"]]
    assert len(got) == len(lang) and all((zlib.crc32(str(i).encode()) % 3 == 1) == got[i]["held_out"] for i in got)
    assert sum(got[i]["lang_pred"] == lang[i] for i in held) >= 0.97 * len(held)
    odd = docs_of(spark, ODD)
    model = language_id.train(odd)
    out = language_id.predict(odd, model, ["doc_id"]).collect()
    assert len(out) == len(ODD) and {r["lang_pred"] for r in out if r["doc_id"] in (1, 2, 3, 6)} == {"und"}
    assert {r["lang_pred"] for r in out if r["doc_id"] in (4, 5)} == {"en"} and all(0 <= r["score"] <= 1 for r in out)
    assert language_id.train(odd.limit(0)) is None and language_id.predict(odd.limit(0), model, ["doc_id"]).count() == 0
    assert {r["lang_pred"] for r in language_id.predict(odd, None, ["doc_id"]).collect()} == {"und"}


def test_ppm_code_lengths():
    """Exact lengths by a plain tree of contexts."""
    texts = {"a": b"abracadabra abracadabra", "b": b"bananas and bandanas"}
    counts = {}
    for k, t in texts.items():
        g, n = np.unique(language_id._grams(np.frombuffer(b"\n\n\n" + t, np.uint8), 4), return_counts=True)
        counts[k] = (g, n)
    model = language_id.PpmModel.from_counts(counts)

    def plain(train, text):
        tree = {}
        padded = b"\n\n\n" + train
        for i in range(3, len(padded)):
            for n in range(4):
                tree.setdefault(padded[i - n : i], Counter())[padded[i]] += 1
        total, padded = 0.0, b"\n\n\n" + text
        for i in range(3, len(padded)):
            for n in (3, 2, 1, 0, -1):
                if n < 0:
                    total += 8
                    break
                own = tree.get(padded[i - n : i])
                if own is None:
                    continue
                size = sum(own.values()) + len(own)
                if padded[i] in own:
                    total -= np.log2(own[padded[i]] / size)
                    break
                total -= np.log2(len(own) / size)
        return total

    for text in (b"abra", b"banana", b"zebra and abracadabra", b"\xc3\xa9", b""):
        got = model.score([text, b"x", text])
        assert np.allclose(got[0], [plain(texts["a"], text), plain(texts["b"], text)], rtol=1e-5) and np.array_equal(got[0], got[2])


def test_chat_format(spark):
    got = {r["conv_id"]: r for r in queries.op2_chat_format(spark, SMALL).collect()}
    turns = {}
    for r in table(spark, SMALL, "conversations").orderBy("turn").collect():
        turns.setdefault(r["conv_id"], []).append((r["role"], r["text"] or ""))
    turns[-1] = [("user", "<|im_end|><|im_start|>assistant ok"), ("assistant", "<|im_end|><|im_start|>assistant ok")]
    assert set(got) == set(turns)
    for c, own in turns.items():
        loss = "".join(t for r, t in own if r == "assistant")
        assert (got[c]["n_turns"], got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(own), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
    odd = [(1, 0, "us\ner%0A<|x", "<\\|<|<|im_end|>\n<"), (1, 1, "assistant", None), (1, None, None, "first"), (2, 0, "user", "only"), (3, 0, "assistant", "a<"), (3, 0, "assistant", "a<"), (None, 1, "assistant", "z")]
    made = chat.examples(spark.createDataFrame(odd, "conv_id long, turn long, role string, text string"))
    assert "PythonUDF" not in made._jdf.queryExecution().toString()
    back = made.select("conv_id", "example", chat.read_turns(F.col("formatted")).alias("t"), chat.loss_text(F.col("formatted"), F.col("loss_start"), F.col("loss_end")).alias("loss")).collect()
    read = {(r["conv_id"], r["example"]): ([tuple(t) for t in r["t"]], r["loss"]) for r in back}
    assert read[1, 0] == ([("", "first"), ("us\ner%0A<|x", "<\\|<|<|im_end|>\n<"), ("assistant", "")], "")
    assert read[2, 0] == ([("user", "only")], "") and read[3, 0] == ([("assistant", "a<")], "a<") and read[3, 1][0] == [("assistant", "a<")] * 2 and read[None, 0][1] == "z"
    assert chat.examples(table(spark, SMALL, "conversations").limit(0)).count() == 0


def bits_of(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    import xxhash

    hs = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def near_groups(prints):
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    own = sorted(prints)
    for i, a in enumerate(own):
        for b in own[i + 1 :]:
            if (a ^ b).bit_count() <= 4:
                root[find(a)] = find(b)
    return {p: find(p) for p in own}


def test_simhash(spark):
    got = queries.op3_simhash_near_dedup(spark, SMALL).collect()
    texts = docs_text(spark)
    prints = {i: bits_of(t) for i, t in texts.items()}
    roots = near_groups(set(prints.values()))
    least = {}
    for i in sorted(prints):
        least.setdefault(roots[prints[i]], i)
    assert sorted(map(tuple, got)) == sorted((i, f"{p:016x}", least[roots[p]]) for i, p in prints.items())
    odd = {(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs_of(spark, ODD)).collect()}
    assert {(1, 1), (2, 1), (3, 1), (4, 4), (9, 4), (7, 7), (None, 7)} <= odd
    assert simhash.near_duplicates(docs_of(spark, ODD).limit(0)).count() == 0


def test_golay_keys_and_hot_keys(spark, monkeypatch):
    rng = random.Random(1)
    golay = simhash.Golay()
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for k in rng.sample(range(64), 4):
            b ^= 1 << k
        keys = [set(golay.keys(np.array([x], np.uint64))[0].tolist()) for x in (a, b)]
        assert keys[0] & keys[1]
    monkeypatch.setattr(simhash, "TILE", 5)
    base = rng.getrandbits(64)
    prints = {base} | {base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(120)} | {rng.getrandbits(64) for _ in range(50)}
    frame = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    # Keys of more than TILE fingerprints are compared by tiles; run in this process, where TILE is small.
    batch = [(k, p) for k, p in zip(*(x.tolist() for x in golay.keys(np.array(sorted(prints), np.uint64).view(np.uint64))))]
    batch.sort(key=lambda x: (x[0], x[1] - (1 << 64) if x[1] >> 63 else x[1]))
    import pyarrow as pa

    key, fp = np.array([k for k, _ in batch], np.int64), np.array([p for _, p in batch], np.uint64).view(np.int64)
    cuts = [0, 7, 8, 500, 501, len(key)]
    rows = [r for b in simhash._runs([pa.record_batch([key[a:z], fp[a:z]], names=["key", "fp"]) for a, z in zip(cuts, cuts[1:])]) for r in b.to_pylist()]
    hot, links = {}, [(r["a"], r["b"]) for r in rows if r["kind"] == 0]
    for r in rows:
        if r["kind"] == 1:
            hot.setdefault(r["a"], []).append(r["b"])
    assert hot and all(len(v) == int((key == k).sum()) for k, v in hot.items())
    for k, own in hot.items():
        tiles = [np.array(own[i::3], np.int64).view(np.uint64) for i in range(3)]
        for i in range(3):
            for j in range(i, 3):
                out = simhash._spanning(tiles[i]) if i == j else simhash._spanning(tiles[i], tiles[j])
                links += [tuple(x) for x in out.view(np.int64).tolist()]
    edges = spark.createDataFrame(links, "a long, b long")
    found = {r["node"] % (1 << 64): r["component"] % (1 << 64) for r in components.components(edges, "a", "b").collect()}
    want = near_groups(prints)
    same = lambda m: sorted(sorted(p for p in prints if m.get(p, p) == r) for r in {m.get(p, p) for p in prints})
    assert same(found) == same(want) and frame.count() == len(prints)


def test_quality(spark):
    got = {r["doc_id"]: r for r in queries.op4_quality_classifier(spark, "/root/testdata/sf0.01").collect()}
    labels = {r["doc_id"]: r["quality"] for r in table(spark, "/root/testdata/sf0.01", "labels").collect()}
    held = [i for i in labels if got[i]["held_out"]]
    assert held and sum(got[i]["predicted"] == labels[i] for i in held) >= 0.9 * len(held)
    assert all(r["predicted"] == (r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in got.values())
    rows = [np.array([1, 2]), np.array([3, 4])] * 10
    model = quality.NbSvm.fit(rows, np.array([1, 0] * 10))
    out = quality.score(docs_of(spark, ODD), model, ["doc_id"]).collect()
    assert len(out) == len(ODD) and len({r["quality_score"] for r in out if r["doc_id"] in (1, 2)}) == 1
    assert quality.score(docs_of(spark, ODD).limit(0), model, ["doc_id"]).count() == 0
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.train(docs_of(spark, ODD), none) is None
    assert {r[1] for r in quality.score(docs_of(spark, ODD), None, ["doc_id"]).collect()} == {0.5}


def plain_features(text):
    """N-grams as a set of keys, by a plain reading of the whole text."""
    words = re.findall(rb"[^\x09-\x0D\x20]+", text)
    kind = lambda c: 0 if 97 <= c <= 122 else 1 if 65 <= c <= 90 else 2 if 48 <= c <= 57 else 4 if c >= 128 else 3
    shape = lambda w: (kind(w[0]), kind(w[min(1, len(w) - 1)]), kind(w[-1]))
    out = {("bytes", text[i : i + 3]) for i in range(len(text) - 2)} | {("word", w) for w in words} | {("shape", shape(w), min(len(w), 15)) for w in words}
    return out | {("pair", shape(a), shape(b), a == b) for a, b in zip(words, words[1:])}


def test_quality_features_and_fit():
    """Features against a plain reading, in pieces of any length; the fit against plain log-count ratios and a plain solution of the dual."""
    rng, flags = random.Random(3), np.zeros(1 << quality.BITS, bool)
    texts = ["".join(rng.choices(["a", "B", "1", " ", "\n", "é", "  ", "longword" * 3], k=rng.randrange(60))).encode() for _ in range(60)]
    seen: dict = {}
    for t in texts:
        found = quality.features(t, flags)
        for piece in (1, 5, 64):
            assert np.array_equal(found, quality.features(t, flags, piece))
        for key in plain_features(t):
            alone = seen.setdefault(key, set(found.tolist()))
            alone &= set(found.tolist())
        assert len(found) <= len(plain_features(t)) and np.array_equal(quality.unpack(quality.pack(found)), found)
    assert all(seen.values())  # every n-gram has a bucket that is there whenever it is
    rows = [np.unique(np.random.default_rng(i).integers(0, 12, 5)) + 6 * (i % 2) for i in range(40)]
    y = np.array([i % 2 for i in range(40)])
    model = quality.NbSvm.fit(rows, y, epochs=3000)
    learn = [i for i in range(40) if i % 5 != 4]
    p, q = np.ones(1 << quality.BITS), np.ones(1 << quality.BITS)
    for i in learn:
        for f in rows[i]:
            (p if y[i] else q)[f] += 1
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    x = np.zeros((len(learn), 19))
    for a, i in enumerate(learn):
        x[a, rows[i]] = ratio[rows[i]] / np.sqrt(len(rows[i]))
    x[:, 18] = 1
    s = np.where(y[learn] > 0, 1.0, -1.0)
    kernel = (x * s[:, None]) @ (x * s[:, None]).T
    top = np.where(s > 0, 1.0, min(10.0, (s > 0).sum() / (s < 0).sum()))
    alpha = np.zeros(len(learn))
    for _ in range(20000):  # projected gradient on the dual
        alpha = np.clip(alpha + 0.02 * (1 - kernel @ alpha), 0, top)
    w = (alpha * s) @ x
    got = np.append((model.weights / np.where(ratio == 0, 1, ratio))[:18], model.bias)
    loss = lambda w: (w @ w) / 2 + (top * np.maximum(0, 1 - s * (x @ w))).sum()
    assert loss(got) <= loss(w) * 1.02 + 1e-3


def test_token_trees(spark):
    with open(token_counts.VOCABULARY, "rb") as f:
        tok = token_counts.Tokenizer(f.read())
    rng, parts = random.Random(2), ["a", "'", " ", "  ", "\n", "re", "'ll", "7", "é", "!!", "\t", "猫"]
    for turn in range(300):
        text = "".join(rng.choices(parts, k=rng.choice([0, 3, 20, 600])))
        tree = token_counts.TokenTree(text, tok)
        for _ in range(4):
            if turn % 2:
                tree = token_counts.TokenTree.load(tree.save(), tok)
            a, new = rng.randrange(len(text) + 1), "".join(rng.choices(parts, k=rng.choice([0, 1, 5, 300])))
            b = min(len(text), a + rng.choice([0, 1, 5, 200]))
            text = text[:a] + new + text[b:]
            tree.edit(a, b, new)
            assert tree.text() == text and tree.total == len(tok.encoding.encode_ordinary(text)) and tree.size == len(text)
            assert [p for k in range(len(tree.leaves)) for p in tree.leaf(k)[0]] == tok.split(text)
    tree = token_counts.TokenTree(LONG, tok)
    state = tree.save()
    tree = token_counts.TokenTree.load(state, tok)
    assert tree.edit(100_000, 100_000, "x") < 200 and sum(not isinstance(x, int) for x in tree.leaves) <= 3
    for k in range(700):
        tree.edit(50_000, 50_000, f" {k}")
    assert max(len(tree.leaf(k)[0]) for k in range(len(tree.leaves))) <= 2 * token_counts.LEAF and tree.total == len(tok.encoding.encode_ordinary(tree.text()))
    trees = token_counts.build_trees(docs_of(spark, ODD), ["doc_id", "text", "score"])
    once = token_counts.apply_edits(trees.withColumn("edits", F.expr("array(struct(2L AS start, 5L AS stop, 'zz' AS text))")), ["doc_id", "text"], "edits")
    twice = token_counts.apply_edits(once.withColumn("edits", F.expr("array(struct(0L AS start, 1L AS stop, ' q' AS text))")), ["doc_id", "text"], "edits")
    for r in twice.collect():
        t = (r["text"] or "")[:2] + "zz" + (r["text"] or "")[5:]
        assert r["tree"]["text"] == " q" + t[1:] and (r["n_tokens"], r["n_tokens_edited"]) == tuple(len(tok.encoding.encode_ordinary(x)) for x in (t, " q" + t[1:]))
    edits = F.array(F.struct(F.lit(2).cast("long").alias("start"), F.lit(5).cast("long").alias("stop"), F.lit("zz").alias("text")), F.lit(None))
    for r in token_counts.count_with_edits(docs_of(spark, ODD).withColumn("edits", edits), ["doc_id", "n_chars"], "edits").collect():
        t = next(x[1] for x in ODD if x[0] == r["doc_id"]) or ""
        assert (r["n_tokens"], r["n_tokens_edited"]) == tuple(len(tok.encoding.encode_ordinary(x)) for x in (t, t[:2] + "zz" + t[5:]))


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def brute_lines(rows, edits):
    """Rows of distinct ids, or repeated rows."""
    first = {}
    for d, t in rows:
        for p, line in enumerate(t.split("\n") if t is not None else []):
            if line.strip(" "):
                at = first.setdefault(line, [d, p, d])
                at[0], at[1] = min(at[0], d), min(at[1], p)
    allowed = lambda n: max([k for least, k in edits if n >= least], default=0)

    def close(a, b):
        k = allowed(min(len(a), len(b)))
        return k and abs(len(a) - len(b)) <= k and edit_distance(a, b) <= k

    order = sorted(first, key=lambda x: (first[x][0], first[x][1], x))
    near = {b for i, b in enumerate(order) if any(close(a, b) for a in order[:i])}
    out = []
    for d, t in rows:
        seen, kept = set(), []
        for line in t.split("\n") if t is not None else []:
            if not line.strip(" ") or (line not in near and first[line][0] == d and line not in seen):
                kept.append(line)
            seen.add(line)
        out.append((d, None if t is None else "\n".join(kept)))
    return out


def damaged(rng, line, times):
    for _ in range(times):
        k, how = rng.randrange(len(line)), rng.randrange(3)
        line = line[:k] + ("" if how == 0 else "Z" if how == 1 else "Z" + line[k]) + line[k + 1 :]
    return line


@pytest.mark.parametrize("edits", [((30, 1),), ((24, 2),), ((24, 3),), ()])
def test_line_dedup(spark, edits):
    rng = random.Random(4)
    base = ["".join(rng.choices("abcdé ", k=rng.choice([23, 24, 29, 30, 31, 40, 60, 80]))) for _ in range(14)] + ["short", "é"]
    rows = [(i, "\n".join(damaged(rng, x := rng.choice(base), rng.randrange(5) if len(x) > 9 else 0) for _ in range(rng.randrange(1, 9)))) for i in range(70)]
    rows += [(70, None), (71, ""), (72, "short\n\n \nshort\nown"), (5, rows[5][1])]
    df = docs_of(spark, [(i, t, None, None) for i, t in rows])
    out = line_dedup.dedup_lines(df, ["doc_id", "lines", "fp"], edits=edits)
    assert "PythonUDF" not in out._jdf.queryExecution().toString() and out.columns == ["doc_id", "lines", "fp", "clean_text", "n_lines", "n_dropped"]
    got = out.collect()
    assert sorted(((r[0], r["clean_text"]) for r in got), key=repr) == sorted(brute_lines(rows, edits), key=repr)
    assert {r["doc_id"]: (r["n_lines"], r["n_dropped"]) for r in got if r["doc_id"] >= 70} == {70: (0, 0), 71: (1, 0), 72: (5, 2)}
    assert line_dedup.dedup_lines(df.limit(0), ["doc_id"], edits=edits).count() == 0
    assert line_dedup.dedup_lines(docs_of(spark, ODD), ["doc_id"], edits=edits).count() == len(ODD)


def test_line_dedup_of_shared_and_null_ids(spark):
    """Unlike texts of one id, or of none, are rows of their own: a line of theirs stays in one of them."""
    line = "a line that stands in four rows of no id and three of one"
    rows = [(None, f"{line}\n{i}") for i in range(4)] + [(7, f"{line}\n{i}{i}") for i in range(3)]
    out = [r["clean_text"] for r in line_dedup.dedup_lines(docs_of(spark, [(i, t, None, None) for i, t in rows]), []).collect()]
    assert sum(line in t for t in out) == 1 and sorted(t.removeprefix(line + "\n") for t in out) == sorted(t.split("\n")[1] for _, t in rows)


@pytest.mark.parametrize("crowd, short, edits", [(2, {1: 3}, ((30, 1),)), (6, {2: 6, 3: 4}, ((30, 1), (48, 2), (60, 3)))])
def test_line_dedup_of_crowded_keys(spark, monkeypatch, crowd, short, edits):
    """Running numbers and edits of one line, at which every key is crowded; ties of first places."""
    monkeypatch.setattr(line_dedup, "CROWD", crowd)
    monkeypatch.setattr(line_dedup, "SHORT", short)
    rng, long = random.Random(7), "the very same line of words, ünlike its number "
    numbers = [f"{long}{k}" for k in rng.sample(range(200000), 60)]
    changed = [damaged(rng, long, rng.randrange(4)) for _ in range(40)]
    lines = numbers + changed + [x + x for x in changed[:8]]
    rng.shuffle(lines)
    rows = [(i, "\n".join(lines[i * 9 : i * 9 + 9])) for i in range(len(lines) // 9)] + [(i + 100, x) for i, x in enumerate(numbers[:3])]
    out = line_dedup.dedup_lines(docs_of(spark, [(i, t, None, None) for i, t in rows]), ["doc_id"], edits=edits)
    assert sorted((r["doc_id"], r["clean_text"]) for r in out.collect()) == sorted(brute_lines(rows, edits))


def test_line_dedup_query_takes_two_edits_of_long_lines(spark, tmp_path):
    """By the query's own threshold a line of 100 characters goes for an earlier one two edits away, a shorter one only for one."""
    rng = random.Random(9)
    long, short = ("".join(rng.choices("abcdefgh ", k=n - 1)) + "x" for n in (100, 99))
    rows = [(0, f"{long}\n{short}"), (1, "Z" + long[:50] + "Z" + long[51:]), (2, long[:20] + long[21:] + "ZZ"), (3, "Z" + short[:50] + "Z" + short[51:-1]), (4, short[:-1] + "Z")]
    docs_of(spark, [(i, t, None, None) for i, t in rows]).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["n_dropped"] for r in queries.op6_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {0: 0, 1: 1, 2: 0, 3: 0, 4: 1}


def test_edits_within_and_letters(spark):
    """The automaton against brute force, and no pair within k edits has more than 2 k letters that differ; accents, characters beyond 16 bits and empty texts included."""
    rng = random.Random(12)
    base = ["".join(rng.choices("abé😀𝄞 Z0", k=n)) for n in (0, 1, 2, 5, 9, 30, 64, 65)]
    pairs = [(damaged(rng, x, rng.randrange(5)) if len(x) > 4 else x, damaged(rng, x, rng.randrange(3)) if len(x) > 4 else y) for x in base for y in base[:4] for _ in range(6)]
    df = spark.createDataFrame(pairs, "a string, b string")
    near = [line_dedup.edits_within(F.col("a"), F.col("b"), k).alias(f"k{k}") for k in (0, 1, 2, 3, 6)]
    for r in df.select("a", "b", *near, F.bit_count(line_dedup._letters(F.col("a")).bitwiseXOR(line_dedup._letters(F.col("b")))).alias("letters")).collect():
        d = edit_distance(r["a"], r["b"])
        assert [r[f"k{k}"] for k in (0, 1, 2, 3, 6)] == [d if d <= k else None for k in (0, 1, 2, 3, 6)] and r["letters"] <= 2 * d, r


def test_line_dedup_of_one_line_with_many_words_in_a_place(spark):
    """Of lines that differ by a word alone, few pairs are made, no plan is long enough to weigh on the driver, and those that go are those of brute force."""
    rng = random.Random(13)
    start, end = ("".join(rng.choices("abcdefgh ", k=48)) for _ in range(2))
    words = list(dict.fromkeys("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(5, 11))) for _ in range(180)))
    words += [w for w in dict.fromkeys(damaged(rng, w, 2) for w in words[:40]) if w not in words]
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsList().size()
    rows = [(i, f"{start} {w} {end}", None, None) for i, w in enumerate(words)]
    got = {r["doc_id"] for r in line_dedup.dedup_lines(docs_of(spark, rows), ["doc_id"]).where("n_dropped = 1").collect()}
    # What the lines have in common at both ends changes nothing about their distance.
    assert got == {i for i, w in enumerate(words) if any(edit_distance(x, w) <= 2 for x in words[:i])} and len(got) > 20
    made, runs = 0, store.executionsList()
    for k in range(before, runs.size()):
        run = runs.apply(k)
        assert len(run.physicalPlanDescription()) < 100_000
        values, nodes = store.executionMetrics(run.executionId()), store.planGraph(run.executionId()).allNodes()
        for node in (nodes.apply(i) for i in range(nodes.size())):
            for m in (node.metrics().apply(i) for i in range(node.metrics().size())):
                if "Join" in node.name() and "[ha#" in node.desc() and m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                    made = max(made, int(values.apply(m.accumulatorId()).replace(",", "")))
    assert 0 < made < 2 * len(words), made


def test_mixing(spark):
    rows = queries.op7_source_mixing(spark, SMALL).collect()
    source = {r["doc_id"]: (r["source"], r["text"]) for r in table(spark, SMALL, "documents").collect()}
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, (_, t) in source.items()}
    total = Counter()
    for i, (s, _) in source.items():
        total[s] += size[i]
    names = sorted(total, key=lambda s: (s is None, s or ""))
    weight, target, capped = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}, {}, set()
    while True:
        left = sum(total.values()) - sum(3 * total[s] for s in capped)
        open_ = [s for s in names if s not in capped]
        target = {s: 3 * total[s] if s in capped else left * weight[s] / sum(weight[x] for x in open_) for s in names}
        over = {s for s in open_ if target[s] > 3 * total[s]}
        if not over:
            break
        capped |= over
    taken = Counter()
    for r in rows:
        s = source[r["doc_id"]][0]
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == total[s] and abs(r["target"] - target[s]) < 1e-6 * max(1, target[s]) and 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 0.5 + 1e-6 for s in names)
    odd = mixing.mix_plan(docs_of(spark, ODD)).collect()
    assert len(odd) == len(ODD) and mixing.mix_plan(docs_of(spark, ODD).limit(0)).count() == 0
    again = lambda: sorted(map(repr, mixing.mix_plan(docs_of(spark, ODD).repartition(3)).collect()))
    assert again() == again()
    # The inverse of the integrated schedule, against the integral.
    for tier, knots in enumerate(mixing.SCHEDULES):
        t = np.linspace(0, 1, 10001)
        w = np.interp(t, *zip(*knots))
        area = np.concatenate([[0], np.cumsum((w[1:] + w[:-1]) / 2)])
        shares = [0.0, 0.1, 0.25, 0.5, 0.77, 1.0]
        got = spark.createDataFrame([(x,) for x in shares], "x double").select("x", mixing.training_time(F.col("x"), F.lit(tier)).alias("t")).withColumn("y", mixing.integral(F.col("t"), knots)).collect()
        assert all(abs(r["t"] - np.interp(r["x"], area / area[-1], t)) < 1e-3 and abs(r["y"] - r["x"]) < 1e-12 for r in got)


def test_curriculum_windows(spark):
    """In windows of training positions each source has the words that its schedule demands between the window's ends; repeated rows, shared and null ids are uses each."""
    rng = random.Random(9)
    rows = [(i if i % 9 else None if i % 2 else 4, "w " * rng.randrange(1, 30) + f"t{i}", None, "abcd"[min(3, rng.randrange(8))]) for i in range(3000)]
    rows += [rows[5], rows[5], (7777, None, None, "a"), (7778, "", None, None)]
    out = mixing.curriculum(docs_of(spark, rows), ["doc_id", "source", "text", "score", "k1"]).collect()
    plan = mixing.mix_plan(docs_of(spark, rows)).collect()
    assert len(plan) == len(rows)
    order = [r["position"] for r in out]
    goals, sizes = Counter(), Counter()
    for _, t, _, s in rows:
        sizes[s] += len((t or "").split())
    for r in out:
        goals[r["source"]] += r["words"]
    total = sum(goals.values())
    assert order == sorted(order) and order[0] == 0 and order[-1] < total and abs(sum(r["taken"] for r in plan) - total) == 0
    assert all(len(r["uses"]) <= 3 and r["taken"] <= 3 * r["size"] for r in plan)
    names = sorted(s for s in sizes if s) + [None]
    t = np.linspace(0, 1, 20001)
    met = {}
    for k, s in enumerate(names):
        w = np.interp(t, *zip(*mixing.SCHEDULES[k % 3]))
        area = np.concatenate([[0], np.cumsum((w[1:] + w[:-1]) / 2)])
        met[s] = goals[s] * area / area[-1]
    demand = sum(met.values())
    cuts = np.linspace(0, total, 21)
    for a, b in zip(cuts, cuts[1:]):
        got = Counter()
        for r in out:
            if a <= r["position"] < b:
                got[r["source"]] += r["words"]
        for s in names:
            ends = [np.interp(np.interp(x, demand, t), t, met[s]) for x in (a, b)]
            assert abs(got[s] - (ends[1] - ends[0])) <= 31, (a, s)
    places = Counter((r["doc_id"], r["text"]) for r in out)
    assert places[rows[5][0], rows[5][1]] >= 3 and mixing.curriculum(docs_of(spark, rows).limit(0), ["doc_id"]).count() == 0


def test_licenses_by_brute_force():
    """Small words: the best coefficient of all stretches of a text, and of the whole text, is found; nothing under the limit is."""
    rng = random.Random(8)
    for _ in range(150):
        own = [("A", " ".join(rng.choices("abcdefgh", k=rng.randrange(4, 9)))), ("B", " ".join(rng.choices("abcdefgh", k=rng.randrange(4, 9))))]
        text = rng.choices("abcdefghxyz", k=rng.randrange(0, 25))
        for name, t in own:
            if rng.random() < 0.7:
                w = t.split()
                w[rng.randrange(len(w))] = "x"
                at = rng.randrange(len(text) + 1)
                text[at:at] = w * rng.choice([1, 1, 5])
        grams = lambda w: set(zip(w, w[1:]))
        best = {}
        for name, t in own:
            g = grams(t.split())
            best[name] = max([2 * len(g & grams(text[a:b])) / (len(g) + len(grams(text[a:b]))) for a in range(len(text)) for b in range(a + 2, len(text) + 1)], default=0.0)
        got = licenses.Templates(own, 0.6).matches([w.encode() for w in text])
        assert max([m[1] for m in got], default=0.0) == max([c for c in best.values() if c >= 0.6], default=0.0)
        assert all(b2[2] >= a2[3] for a2, b2 in zip(got, got[1:])) and all(0.6 <= c <= best[n] for n, c, _, _ in got)


def test_licenses(spark):
    mit = licenses.NOTICES[2][1]
    rows = [(1, "x\n" + mit.upper() + "\nlast"), (2, "Licensed under the Apache License, Version 2.0. More words follow here"), (3, "nothing of the kind"), (4, None), (5, ""), (6, mit.replace("merge", "fold")), (7, "licensed under")]
    got = {r["doc_id"]: r["matches"] for r in licenses.scan(docs_of(spark, [(i, t, None, None) for i, t in rows]), ["doc_id"]).collect()}
    assert [m["license"] for m in got[1]] == ["MIT"] and got[1][0]["dice"] == 1 and got[1][0]["first"] == 1
    assert [m["license"] for m in got[2]] == ["Apache-2.0"] and not got[3] and not got[4] and not got[5] and not got[7]
    assert [m["license"] for m in got[6]] == ["MIT"] and 0.8 <= got[6][0]["dice"] < 1
    found = {r["doc_id"]: r["licenses"] for r in queries.op8_license_scan(spark, SMALL).collect()}
    for i, t in docs_text(spark).items():
        assert ("MIT" in found[i].split(",")) == ("under the MIT License" in (t or ""))


def brute_hits(text, items):
    words = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
    own, hit, names = words(text), set(), set()
    for k, t in items:
        w = words(t)
        n = min(10, len(w))
        for p in range(len(w) - n + 1) if n else []:
            for q in range(len(own) - n + 1):
                if own[q : q + n] == w[p : p + n]:
                    hit |= set(range(q, q + n))
                    names.add(k)
    return len(own), len(hit), sorted(names)


@pytest.mark.parametrize("max_bloom, broadcast", [(27, 8 << 20), (12, 0)])
def test_decontamination(spark, monkeypatch, max_bloom, broadcast):
    """A filter too small for its fingerprints, and tables joined by shuffle, change nothing."""
    monkeypatch.setattr(decontaminate, "MAX_BLOOM", max_bloom)
    monkeypatch.setattr(decontaminate, "maybe_broadcast", lambda df: F.broadcast(df) if broadcast else df)
    rng = random.Random(6)
    items = [(str(i), " ".join(rng.choices("ab cd Éf g7 xy".split(), k=rng.choice([1, 3, 9, 10, 11, 14, 40])))) for i in range(12)] + [("e", ""), ("n", None), ("3", "same id")]
    texts = [" ".join(rng.choices("ab cd éf g7 xy qq".split(), k=60)) for _ in range(15)]
    texts += [f"q {t[: rng.randrange(1, 200)]}, {t[20:]} ab" for _, t in items if t] + [None, "", "ÀB cd", "zz " * 5000 + items[5][1] + " zz" * 10]
    docs = docs_of(spark, [(i, t, None, None) for i, t in enumerate(texts)])
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in decontaminate.find_hits(docs, bench, ["doc_id", "_items", "items"]).collect()}
    assert got == {i: brute_hits(t, items) for i, t in enumerate(texts)}
    assert decontaminate.find_hits(docs, bench.limit(0), ["doc_id"]).where("n_hit > 0").count() == 0 and decontaminate.find_hits(docs.limit(0), bench, ["doc_id"]).count() == 0


def test_ogg(spark):
    def plain_crc(data):
        c = 0
        for b in data:
            c ^= b << 24
            for _ in range(8):
                c = (c << 1 ^ 0x04C11DB7 if c & 1 << 31 else c << 1) & 0xFFFFFFFF
        return c

    assert media.checksum(b"OggS and more") == plain_crc(b"OggS and more")
    for n in (0, 1, 191, 192, 193, 3840, 65025, 65026, 200_000):
        text = random.Random(n).randbytes(n)
        stored = media.encode(text)
        read = media.decode(stored)
        assert read.payload == media.pad(text) and read.n_bytes == n and abs(read.seconds - len(read.payload) / media.RATE) < 1e-9 and media.encode(text) == stored
        bad = bytearray(stored)
        bad[len(bad) // 2] ^= 4
        for broken in (bytes(bad), stored[:-1], b"x" + stored, stored[:100]):
            with pytest.raises(media.OggError):
                media.decode(broken)
    got = {r["doc_id"]: r for r in queries.op10_ogg_media(spark, SMALL).collect()}
    for i, t in docs_text(spark).items():
        own = media.pad((t or "").encode())
        assert (got[i]["payload_bytes"], got[i]["payload_sha256"], got[i]["tail_crc32"]) == (len(own), hashlib.sha256(own).hexdigest(), zlib.crc32(own[-16:]))
    stored = media.with_media(docs_of(spark, ODD), ["doc_id", "fp"])
    assert stored.count() == len(ODD)
    odd = stored.union(spark.createDataFrame([(99, "x", None), (98, "x", bytearray(b"bad"))], stored.schema))
    assert {r["doc_id"] for r in media.read_media(odd, ["doc_id"]).where("error IS NOT NULL").collect()} == {98, 99}


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    for docs in (docs_of(spark, ODD), docs_of(spark, ODD).limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SMALL)
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == docs.columns
            docs = spark.createDataFrame(out.collect(), out.schema)
    kept = corpus_pipeline.run(spark, SMALL)
    assert 0 < kept.count() and kept.select("doc_id").distinct().count() <= table(spark, SMALL, "documents").count()
