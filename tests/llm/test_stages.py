"""What the pipeline's stages add to the operators."""

import random

import corpus_pipeline
from tesserae.llm import licenses

from .test_operators import SMALL, bits_of, brute_hits, brute_lines, docs_of, near_groups

RNG = random.Random(11)


def prose(n):
    return " ".join("".join(RNG.choices("abcdefghijklmnop", k=RNG.randrange(3, 9))) for _ in range(n))


def test_near_dedup_keeps_unlike_texts_of_one_id_and_of_null_ids(spark):
    """Unlike texts stay whatever their ids; of copies one stays, whichever row of an id holds it."""
    a, b, c, d, e = (prose(40) for _ in range(5))
    rows = [(None, a), (None, b), (None, b), (None, c), (1, c), (2, d), (2, e), (2, e), (3, e), (2, c)]
    docs = docs_of(spark, [(i, t, "en", "s") for i, t in rows])
    want = sorted([(None, a), (None, b), (1, c), (2, d), (2, e)], key=repr)
    kept = corpus_pipeline.dedup_documents(spark, docs, SMALL)
    assert kept.columns == docs.columns and sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == want
    mixed = corpus_pipeline.mix_sources(spark, spark.createDataFrame(kept.collect(), kept.schema), SMALL).collect()
    assert sorted(((r["doc_id"], r["text"], r["mix_repeat"]) for r in mixed), key=repr) == sorted(((i, t, 0) for i, t in want), key=repr)
    assert sum(r["mix_words"] for r in mixed) == 200


def test_copies_with_short_lines_do_not_get_through_as_stumps(spark, tmp_path):
    """Of exact and near copies with short lines one doc_id reaches run()'s result, whole; short lines that stand nowhere else stay."""
    from tesserae.llm.common import table

    lines = [prose(40) for _ in range(8)]
    text = "\n".join([*lines[:4], "Short one.", *lines[4:]])
    words = text.split(" ")
    near = next(t for t in (" ".join([*words[:k], "replaced", *words[k + 1 :]]) for k in range(1, len(words))) if (bits_of(t) ^ bits_of(text)).bit_count() <= 4)
    extract = "\n".join([lines[0], "A line of its own."])
    rows = [(1, text), (2, text), (3, near), (4, extract), (5, prose(60)), (6, "\n".join(lines[:2]))]
    docs_of(spark, [(i, t, "en", "s") for i, t in rows]).write.parquet(f"{tmp_path}/documents.parquet")
    table(spark, SMALL, "benchmark").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == {1: text, 4: "A line of its own.", 5: rows[4][1]}


def test_license_stretches_longer_and_shorter_than_the_template():
    """Words put into or left out of a grant in a long text: the best stretch by brute force is found."""
    grant = licenses.NOTICES[2][1].split()
    sought = licenses.Templates([licenses.NOTICES[2]], licenses.DICE)
    around = [prose(300).split() for _ in range(2)]

    def grams(w):
        return set(zip(w, w[1:]))

    for block in (0, 5, 15, 20, 25, -8, -15):
        inner = grant[:33] + prose(block).split() + grant[33:] if block >= 0 else grant[:33] + grant[33 - block :]
        text = licenses.words(" ".join(around[0] + inner + around[1]).encode())
        own = grams(licenses.words(" ".join(grant).encode()))
        first, last = 300 - 2, 300 + len(inner) + 12
        best = max(2 * len(own & grams(text[a:b])) / (len(own) + len(grams(text[a:b]))) for a in range(first, first + 6) for b in range(last - 40, last))
        assert best >= licenses.DICE
        got = sought.matches(text)
        assert len(got) == 1 and got[0][0] == "MIT" and abs(got[0][1] - best) < 1e-12 and got[0][2] == 300, block
    # Repeated words: the stretch that ends a text, and one start after another.
    words = licenses.words(b"licensed under licensed under " * 4000)
    assert licenses.Templates([("X", "licensed under the terms of X")], licenses.DICE).matches(words) == []


def test_every_stage_by_brute_force(spark, tmp_path):
    """Each stage on what the one before kept, against a plain version: copies, near copies, shared and short lines, benchmark passages, nulls, blanks, no letters."""
    from tesserae.llm.common import table, written

    rng = random.Random(21)
    shared = [prose(12) for _ in range(3)] + ["Ok.", "All rights."]
    items = [("q1", prose(14)), ("q2", prose(4))]
    texts = ["\n".join([prose(30), rng.choice(shared), prose(25), "", rng.choice(shared)]) for _ in range(24)]
    texts += [texts[1], texts[2] + "x"]
    for t in texts[3:8]:  # near copies: a word replaced, in each of the longer lines of some
        lines = t.split("\n")
        w = lines[0].split()
        w[rng.randrange(len(w))] = prose(1)
        texts.append("\n".join([" ".join(w), *lines[1:]]))
    texts += [f"{prose(9)} {items[0][1]} {prose(5)}", f"{prose(9)}, {items[1][1].upper()}!", "\n".join(shared), None, "", "  \n ", "12 34 !", "short"]
    rows = [(i, t, "en", "ab"[i % 2]) for i, t in enumerate(texts)]
    docs = docs_of(spark, rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = {i: t for i, t, _, _ in rows}
    stages = dict(corpus_pipeline.STAGES)

    def run(name):
        nonlocal docs
        docs = written(stages[name](spark, docs, str(tmp_path)), "stage")
        return {r["doc_id"]: r["text"] for r in docs.collect()}

    want = {i: t for i, t in want.items() if t is not None and any(c.isalpha() for c in t)}
    assert run("language ID") == want
    kept = dict(brute_lines(sorted(want.items()), ((30, 1),)))
    want = {i: t for i, t in kept.items() if t == want[i] or t.strip()}
    assert run("line dedup") == want
    prints = {i: bits_of(texts[i]) for i in want}
    group = near_groups(set(prints.values()))
    first = {}
    for i in sorted(want):
        first.setdefault(group[prints[i]], i)
    assert len(first) < len(want)
    want = {i: t for i, t in want.items() if first[group[prints[i]]] == i}
    assert run("SimHash near-dedup") == want
    want = {i: t for i, t in want.items() if not brute_hits(t, items)[1]}
    assert run("benchmark decontamination") == want
    last = stages["mixing sources"](spark, docs, str(tmp_path)).collect()
    assert {r["doc_id"]: r["text"] for r in last}.items() <= want.items()
    size = {s: sum(len(t.split()) for i, t in want.items() if "ab"[i % 2] == s) for s in "ab"}
    target = {"a": min(3 * size["a"], max(sum(size.values()) * 5 / 7, sum(size.values()) - 3 * size["b"]))}
    target["b"] = sum(size.values()) - target["a"]
    for s in "ab":
        assert abs(sum(r["mix_words"] for r in last if r["source"] == s) - target[s]) <= 0.5
    assert [r["mix_position"] for r in last] == sorted(r["mix_position"] for r in last)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_no_plan_of_line_dedup_is_long_enough_to_weigh_on_the_driver(spark):
    """The driver keeps each plan, as a tree and as text, so one of hundreds of thousands of characters takes it beyond its memory after some runs."""
    from tesserae.llm.common import table

    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsList().size()
    assert corpus_pipeline.dedup_lines(spark, table(spark, SMALL, "documents"), SMALL).count() > 0
    runs = store.executionsList()
    longest = max(len(runs.apply(k).physicalPlanDescription()) for k in range(before, runs.size()))
    assert longest < 60_000, longest
