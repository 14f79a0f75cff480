"""Line dedup by a segment-partition edit join, with DataFrame functions only.

A line goes when a line equal to it, or within a number of character edits of it that depends on the shorter one's length, comes earlier in the corpus. A line that
may have k edits is cut into k + 1 segments, one of which an edit leaves alone whatever k edits do; it is indexed under its length and each segment. A line probes the indexes
of its own length and of up to k characters less with the substrings that can stand where such a segment stood, by its number and the difference in length. Lines that
share a key, and whose letters do not tell that they are further apart, are verified by a bit-parallel automaton over the band of diagonals that k edits can reach.

A key that very many lines share (a common opening, a running number) is never joined to itself. What it leaves of its lines is a problem of the same kind, of
two pieces with k edits in all, i of them before a segment i: the longest piece is cut again, until few lines share a key or little is left. Of that little, every variant with
up to k characters taken out or masked is made; two lines that meet in a variant are within the sum of what was taken from each and masked, so
each is held against the earliest there, and no pairs are made at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import content_key, discard, let, maybe_broadcast, written

#: Lines of so many characters or more are near others within so many edits; shorter ones only if equal. Lengths and edits rise.
EDITS = ((30, 1), (100, 2))
#: A key of more lines than this is not joined to itself: its lines are told apart further.
CROWD = 64
#: By number of edits, how many characters are left when all variants are made of them.
SHORT = {1: 32, 2: 16, 3: 9}


def edits_within(a: Column, b: Column, limit: int) -> Column:
    """Edit distance of two strings if at most limit, else null.

    State after j characters of b: for each number of errors e a word whose bit d + limit says that the first j + d characters of a are within e edits of
    them. All diagonals d of the band move at once by shifts, ands and ors.
    """
    return let(_unlike(a, b), lambda u: let(F.split(u["a"], ""), lambda x: let(F.split(u["b"], ""), lambda y: _within(x, F.char_length(u["a"]), y, F.char_length(u["b"]), limit))))


def _alike(a: Column, b: Column) -> Column:
    """How many characters a and b have in common at the start, or a few less; of equal strings, all or more. Found by halving, not by character."""
    steps = F.transform(F.sequence(F.floor(F.log2(F.greatest(F.char_length(a), F.lit(1)))).cast("int"), F.lit(0)), lambda i: F.call_function("shiftleft", F.lit(1), i))
    return F.aggregate(steps, F.lit(0), lambda p, n: p + F.when(F.substr(a, p + 1, n) == F.substr(b, p + 1, n), n).otherwise(0))


def _unlike(a: Column, b: Column) -> Column:
    """A struct of a and b without their common start and end: as many edits apart as a and b."""
    both = F.struct(a.alias("a"), b.alias("b"))
    for _ in range(2):
        both = let(both, lambda s: let(_alike(s["a"], s["b"]), lambda p: F.struct(*[F.reverse(F.substr(s[c], p + 1)).alias(c) for c in "ab"])))
    return both


def _within(x: Column, m: Column, y: Column, n: Column, limit: int) -> Column:
    """The same for arrays x and y of m and n characters."""
    width = 2 * limit + 1
    mask = (1 << width) - 1

    def levels(state: Column, match: Column, new: list[Column]) -> Column:
        e = len(new)
        if e > limit:
            return F.struct(*[r.alias(f"r{i}") for i, r in enumerate(new)])
        own = state[f"r{e}"].bitwiseAND(match)
        if e:
            old = state[f"r{e - 1}"]
            own = own.bitwiseOR(old).bitwiseOR(F.shiftright(old, 1)).bitwiseOR(F.shiftleft(new[-1], 1)).bitwiseAND(F.lit(mask))
        return let(own, lambda r: levels(state, match, [*new, r]))

    def step(state: Column, j: Column) -> Column:
        match = F.lit(0)
        for d in range(-limit, limit + 1):
            match = match.bitwiseOR(F.when(F.get(x, j + d) == F.get(y, j), F.lit(1 << (d + limit))).otherwise(0))
        return let(match, lambda m: levels(state, m, []))

    def fewest(end: Column) -> Column:
        # Bit m - n + limit, where it is one of the band; a shift by more than the band leaves 0, one by less than 0 is ruled out.
        bit = F.when(F.abs(m - n) <= limit, F.call_function("shiftleft", F.lit(1), m - n + limit)).otherwise(0)
        found = F.lit(None).cast("int")
        for e in reversed(range(limit + 1)):
            found = F.when(end[f"r{e}"].bitwiseAND(bit) != 0, F.lit(e)).otherwise(found)
        return found

    start = F.struct(*[F.lit(sum(1 << (d + limit) for d in range(e + 1))).alias(f"r{e}") for e in range(limit + 1)])
    # Bound by let: an expression written twice is computed twice, and what stands inside a lambda is written out in every plan.
    return let(F.when(n > 0, F.aggregate(F.sequence(F.lit(0), n - 1), start, step)).otherwise(start), fewest)


def _letters(line: Column) -> Column:
    """Which characters, by code modulo 64, stand an odd number of times in a line, as bits. An edit changes two bits at most, so lines within k edits differ in 2 k or fewer."""
    return F.aggregate(F.split(line, ""), F.lit(0).cast("long"), lambda s, c: s.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.ascii(c) % 64)))


def allowed(n: Column, edits=EDITS) -> Column:
    """The edits by which a line may differ from one of n characters, or more."""
    out = F.lit(0)
    for least, k in edits:
        out = F.when(n >= least, F.lit(k)).otherwise(out)
    return out


def _offsets(k: int) -> list[tuple[int, int, int]]:
    """(characters more, segment, shift) of the substrings with which a longer line probes for segments of a line that may have k edits.

    Behind at most i edits a segment i is shifted by at most i, and k - i edits behind it make up the rest of the difference.
    """
    return [(more, i, off) for more in range(k + 1) for i in range(k + 1) for off in range(max(-i, more - k + i), min(i, more + k - i) + 1)]


def _cut(size: Column, i: int, k: int) -> Column:
    """Where segment i of k + 1 begins."""
    return F.call_function("div", size * i, F.lit(k + 1)).cast("int")


def _segments(lines: DataFrame, edits, index: bool = False) -> DataFrame:
    """A row of lines for each segment of its line that has a key, with the key, side (1 stands in the index, 2 probes it, 3 does both), k, i, more and off, and the segment's first
    character and end. With index, segments stand once in the index for each (more, off) with which they may be probed.

    A row for each way and one short expression: all the ways in one expression make a method that the JVM refuses to compile.
    """
    ways = [(k, more, i, off, 3 if more == off == 0 else 2) for k in sorted({k for _, k in edits if k}) for more, i, off in _offsets(k)]
    ways += [(k, more, i, off, 1) for k, more, i, off, side in ways if side == 2 and index]
    way = F.array(*[F.struct(*[F.lit(x).alias(c) for c, x in zip(("k", "more", "i", "off", "side"), w, strict=True)]) for w in ways])
    # The length is a column, so that it is counted once a line.
    rows = lines.withColumn("n", F.char_length("line")).where(F.col("n") >= min(n for n, k in edits if k)).withColumn("way", F.explode(way)).select("*", "way.*").drop("way")
    rows = rows.withColumn("size", F.when(F.col("side") > 1, F.col("n") - F.col("more")).otherwise(F.col("n"))).where(allowed(F.col("size"), edits) == F.col("k"))
    shift = F.when(F.col("side") > 1, F.col("off")).otherwise(0)
    for c, i in (("start", F.col("i")), ("end", F.col("i") + 1)):
        rows = rows.withColumn(c, F.call_function("div", F.col("size") * i, F.col("k") + 1).cast("int") + shift)
    key = F.xxhash64(F.col("k") * 64 + F.col("i"), "size", F.substr("line", F.col("start") + 1, F.col("end") - F.col("start")))
    return rows.withColumn("key", key).drop("n", "size")


def _shared(rows: DataFrame, name: str) -> DataFrame:
    """The keys under which an indexed line and another that probes meet, as a table; crowd: of more than CROWD rows."""
    # Counted with partial sums, so that a key that very many lines share is no burden to one task.
    by = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.bit_or("side").alias("sides"))
    return written(by.where("n > 1 AND sides = 3").select("key", (F.col("n") > CROWD).alias("crowd")), name)


def _pairs(rows: DataFrame) -> DataFrame:
    """Pairs (ha, hb) of the rows (key, side, k, letters, h) of which one is indexed and one probes, as a table; those whose letters alone tell that they are too far apart are not made."""
    a, b = (rows.where(where).selectExpr("key", f"h AS {c}", f"side AS side_{c}", f"k AS k_{c}", f"letters AS letters_{c}") for c, where in (("a", "side % 2 = 1"), ("b", "side >= 2")))
    # Two that both stand in the index and probe it meet twice.
    met = a.join(b, "key").where("a != b AND (a < b OR side_a + side_b < 6) AND bit_count(letters_a ^ letters_b) <= 2 * least(k_a, k_b)")
    return written(met.select(F.least("a", "b").alias("ha"), F.greatest("a", "b").alias("hb")).distinct(), "pairs")


def _finer(rows: DataFrame) -> DataFrame:
    """Each problem's longest piece is cut again: rows for each segment, shift and side."""
    rows = rows.withColumn("j", F.expr("array_position(lens, array_max(lens)) - 1").cast("int"))
    rows = rows.selectExpr("*", "pieces[j] AS piece", "lens[j] AS size", "delta[j] AS more", "budget[j] AS own")
    ways = "flatten(transform(sequence(0, own), i -> transform(filter(sequence(-own, own), o -> o BETWEEN greatest(-i, more - own + i) AND least(i, more + own - i)), o -> struct(i, o))))"
    rows = rows.withColumn("way", F.explode(F.expr(ways))).selectExpr("*", "way.i AS i", "way.o AS off")
    rows = rows.withColumn("role", F.explode(F.expr("CASE WHEN side = 3 AND off != 0 THEN array(1, 2) ELSE array(side) END")))
    rows = rows.selectExpr("*", "cast(size * i div (own + 1) AS int) AS start", "cast(size * (i + 1) div (own + 1) AS int) AS end").selectExpr("*", "start + if(role = 2, off, 0) AS at")
    rows = rows.where("at >= 0 AND at + end - start <= char_length(piece)")
    return rows.selectExpr(
        "xxhash64(key, i, off, substr(piece, at + 1, end - start)) AS key", "role AS side", "k", "concat(slice(delta, 1, j), array(off, more - off), slice(delta, j + 2, size(delta))) AS delta",
        "concat(slice(budget, 1, j), array(i, own - i), slice(budget, j + 2, size(budget))) AS budget",
        "concat(slice(pieces, 1, j), array(substr(piece, 1, at), substr(piece, at + end - start + 1)), slice(pieces, j + 2, size(pieces))) AS pieces", "letters", "h", "o",
    )


def _behind(rows: DataFrame, most: int) -> DataFrame:
    """h of the lines among the rows (key, k, pieces, h, o), o being their order, that have an earlier one within k edits under their key. No pairs are made.

    Characters are array elements; a border of pieces is an element of two characters, which stays, and a masked character an empty one.
    """
    chars = "flatten(transform(pieces, x -> concat(if(x = '', array(), split(x, '')), array('||'))))"
    made = rows.selectExpr("key", "k", "h", "o", f"{chars} AS c", "0 AS next", "0 AS gone", "0 AS masked")
    every = made
    for _ in range(most):
        made = made.where("gone + masked < k").withColumn("i", F.explode(F.expr("filter(sequence(next, size(c)), i -> i < size(c) AND c[i] != '||')")))
        less = ["key", "k", "h", "o", "concat(slice(c, 1, i), slice(c, i + 2, size(c))) AS c", "i AS next", "gone + 1 AS gone", "masked"]
        hidden = ["key", "k", "h", "o", "concat(slice(c, 1, i), array(''), slice(c, i + 2, size(c))) AS c", "i + 1 AS next", "gone", "masked + 1 AS masked"]
        made = made.selectExpr(*less).unionByName(made.selectExpr(*hidden))
        every = every.unionByName(made)
    every = every.selectExpr("key", "xxhash64(c) AS c1", "xxhash64(2, c) AS c2", "k", "h", "o", "gone", "masked").distinct()
    every = written(every, "variants")
    on = ["key", "c1", "c2", "masked"]
    least = every.groupBy(*on).agg(F.count(F.lit(1)).alias("n"), *[F.min(F.when(F.col("gone") == e, F.col("o"))).alias(f"m{e}") for e in range(most + 1)]).where("n > 1").drop("n")
    met = every.join(written(least, "variant-firsts"), on)
    before = F.lit(False)
    for e in range(most + 1):
        before = before | F.coalesce((F.col("gone") + F.col("masked") + e <= F.col("k")) & (F.col(f"m{e}") < F.col("o")), F.lit(False))
    return met.where(before).select("h").distinct()


def _crowds(rows: DataFrame, most: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """For problems under crowded keys: pairs to verify, and h of lines that have an earlier line near."""
    pairs, behind = [], []
    while True:
        rows = rows.withColumn("lens", F.expr("zip_with(pieces, delta, (x, y) -> char_length(x) - if(side = 2, y, 0))"))
        keys = _shared(rows, "crowd-keys")
        rows = written(rows.join(keys, "key"), "crowd-rows")
        pairs.append(_pairs(rows.where("NOT crowd")))
        many = rows.where("crowd").drop("crowd")
        left = F.expr("aggregate(lens, 0, (a, x) -> a + x)")
        most_left = F.lit(0)
        for k in range(1, most + 1):
            most_left = F.when(F.col("k") == k, F.lit(SHORT.get(k, 3 * k))).otherwise(most_left)
        done = (left <= most_left) | (F.array_max("lens") < 2 * (F.col("k") + 1))
        if not many.where(done).isEmpty():
            behind.append(written(_behind(many.where(done), most), "behind"))
        rest = many.where(~done)
        if rest.isEmpty():
            return pairs, behind
        rows = written(_finer(rest).distinct(), "finer")


def similar_lines(lines: DataFrame, edits=EDITS) -> DataFrame:
    """Of distinct lines (line, h, d, p), h of those that have an earlier one near; earlier by d, then p, then the line."""
    most = max([k for _, k in edits], default=0)
    if not most:
        return lines.select("h").limit(0)
    keyed = _segments(lines.select("h", "line"), edits).select("key", "side", "h")
    often = _shared(keyed, "segments")
    found = written(keyed.join(maybe_broadcast(often), "key"), "line-keys")
    # Only lines that share a segment with another go on.
    some = written(found.groupBy("h").agg(F.max("crowd").alias("crowd")), "sharing-lines")
    texts = written(lines.join(maybe_broadcast(some), "h").select("h", "line", "d", "p", "crowd", allowed(F.char_length("line"), edits).alias("k"), _letters(F.col("line")).alias("letters")), "line-texts")
    pairs = [_pairs(found.where("NOT crowd").join(maybe_broadcast(texts.select("h", "k", "letters")), "h"))]
    behind = []
    if not often.where("crowd").isEmpty():
        problems = _segments(texts.where("crowd").select("h", "line", "letters", F.struct("d", "p", "line").alias("o")), edits, index=True).join(often.where("crowd").select("key"), "key", "left_semi")
        # What a key leaves of its lines: for both sides the two pieces, by how much longer the prober's are (delta), and the edits in each: of lines within k edits a segment i is alike
        # before which there are i edits, the first with no more edits up to its end than segments before it.
        budget = F.array(F.col("i"), F.col("k") - F.col("i")).alias("budget")
        delta = F.array(F.col("off"), F.col("more") - F.col("off")).alias("delta")
        pieces = F.array(F.substr("line", F.lit(1), F.col("start")), F.substr("line", F.col("end") + 1)).alias("pieces")
        problems = written(problems.select(F.xxhash64("key", "more", "off").alias("key"), "side", "k", delta, budget, pieces, "letters", "h", "o"), "problems")
        more, behind = _crowds(problems, most)
        pairs += more
    both = pairs[0]
    for x in pairs[1:]:
        both = both.union(x)
    one, two = (texts.select(*[F.col(c).alias(f"{c}{i}") for c in ("h", "line", "d", "p")]) for i in (1, 2))
    both = both.distinct().join(one, F.col("ha") == F.col("h1")).join(two, F.col("hb") == F.col("h2"))
    limit = allowed(F.least(F.char_length("line1"), F.char_length("line2")), edits)
    near = both.where(edits_within(F.col("line1"), F.col("line2"), most) <= limit)
    order = [F.struct(*[F.col(f"{c}{i}").alias(c) for c in ("d", "p", "line", "h")]) for i in (1, 2)]
    out = near.select(F.greatest(*order)["h"].alias("h"))
    for x in behind:
        out = out.union(x)
    return out.distinct()


def dedup_lines(docs: DataFrame, keep: list[str], id_col: str = "doc_id", text: str = "text", edits=EDITS) -> DataFrame:
    """One row for each row of docs: the columns in keep (the text's may be among them), then clean_text, n_lines and n_dropped.

    Lines end at line feeds. A line, however short, goes if it stands earlier in its text or in an earlier row, or if another line whose first place is
    earlier (by smallest id, then smallest place in a text, then as text) is near by edits: pairs (characters, edits) say within how many edits lines of that many characters
    or more are near, the shorter line of the two deciding. All other lines stay in order, and so do lines of white space alone, which hold no text. Rows go by id (null first), then by a hash of
    id and text, so unlike texts of one id, or of none, are ordered too; rows that repeat an id and text are cleaned alike, as one. A null text stays null with no
    lines; an empty one is one empty line. An empty table gives an empty table. A kept column named like one of the results gives way to it.
    """
    made = ["clean_text", "n_lines", "n_dropped"]
    names = [c for c in dict.fromkeys(keep) if c.lower() not in made]
    key = content_key(F.col(id_col), F.col(text))
    own = docs.select(F.col(id_col).alias("d"), key[0].alias("k1"), key[1].alias("k2"), F.split(F.col(text), "\n").alias("lines"))
    found = own.select("d", "k1", "k2", F.posexplode("lines").alias("p", "line")).where(F.trim("line") != "")
    lines = found.groupBy("line").agg(F.min("d").alias("d"), F.max(F.col("d").isNull()).alias("z"), F.min("p").alias("p"), F.count(F.lit(1)).alias("n"))
    lines = lines.select("line", F.xxhash64("line").alias("h"), F.hash("line").alias("g"), F.when(~F.col("z"), F.col("d")).alias("d"), "p", "n")
    lines = written(lines, "lines", "zstd")
    near = written(similar_lines(lines, edits).select("h", F.lit(True).alias("near")), "near")
    marked = lines.select("h", "g", "n").join(maybe_broadcast(near), "h", "left").where("n > 1 OR near")
    # Tables, so that the joins read them plainly and Spark can split a very common line over tasks.
    marked = written(marked.select("h", "g", F.coalesce("near", F.lit(False)).alias("near")), "marked")
    discard(lines, near)
    seen = found.select("d", "k1", "k2", "p", F.xxhash64("line").alias("h"), F.hash("line").alias("g")).join(maybe_broadcast(marked), ["h", "g"])
    seen = written(seen, "seen")
    discard(marked)
    # Of an exact repeat the earliest row stays; with sums by task first, however many rows there are.
    firsts = seen.where("NOT near").groupBy("h", "g", "d", "k1", "k2").agg(F.min("p").alias("p")).groupBy("h", "g").agg(F.min(F.struct("d", "k1", "k2", "p")).alias("first"))
    firsts = written(firsts, "firsts")
    last = seen.join(maybe_broadcast(firsts), ["h", "g"], "left")
    stays = F.coalesce(F.struct("d", "k1", "k2", "p").eqNullSafe(F.col("first")), F.lit(False))
    gone = last.where(~stays).groupBy("k1", "k2").agg(F.collect_set("p").alias("_gone"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(names)] or [F.lit(True)]).alias("kept"), F.col(text).alias("text"), key[0].alias("k1"), key[1].alias("k2")).join(gone, ["k1", "k2"], "left")
    split = F.split("text", "\n")
    kept = let(split, lambda x: F.concat_ws("\n", F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("_gone")), lambda i: F.get(x, i))))
    clean = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(kept)
    return rows.select(*[F.col(f"kept.k{i}").alias(c) for i, c in enumerate(names)], clean.alias("clean_text"), F.when(F.col("text").isNull(), 0).otherwise(F.size(split)).cast("long").alias("n_lines"), F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_dropped"))
