"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight and a schedule: how its share of the training stream changes over training time 0 to 1. Targets are
shared out by weight with a cap on repeats. A source's demand up to a time is its target times its integrated schedule; the sum over all sources is the
cumulative token demand, which turns times into training positions, counted in tokens from 0 to all that the mix takes. Within a source, documents stand in the order of a
hash, again and again until the demand is met; the words before a use of a document, put into the inverse of its source's demand, give the time it is due, and
the cumulative demand at that time is its position. Uses that no time demands have no position and are not taken. Documents are then range-sorted by position, so about
every position the sources' words are in proportion to their demands at its time.

Only sums by (source, hash bucket) are gathered, so no task holds a source and a source with a third of all rows is dealt over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD_BREAK, Kept, content_key, discard, maybe_broadcast, written

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
#: Knots (time, relative weight) of a schedule for each weight: the heaviest sources fade, the lightest come late.
SCHEDULES = (((0.0, 1.25), (1.0, 0.75)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.25), (0.5, 0.75), (1.0, 2.25)))
#: Hash buckets of a source (hexadecimal digits of its documents' hash).
BUCKET_DIGITS = 3


def segments(knots) -> list[tuple[float, float, float, float, float]]:
    """A schedule as segments of time: start, length, weight at start and end, and the integral up to the start, the whole integral being 1."""
    whole = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:]))
    out, done = [], 0.0
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        out.append((float(t0), float(t1 - t0), w0 / whole, w1 / whole, done))
        done += (t1 - t0) * (w0 + w1) / 2 / whole
    return out


def integral(time: Column, knots) -> Column:
    """The integrated schedule up to a time."""
    out = None
    for t, d, a, b, c in reversed(segments(knots)):
        x = time - t
        own = F.lit(c) + x * (F.lit(a) + x * ((b - a) / d) / 2)
        out = own if out is None else F.when(time < t + d, own).otherwise(out)
    return out


def _inverse(share: Column, knots) -> Column:
    out = None
    for t, d, a, b, c in reversed(segments(knots)):
        left = F.greatest(share - c, F.lit(0.0))
        # The root of a x + (b - a) / d x^2 / 2 = left, in a form without loss of digits.
        root = F.lit(t) + F.least(F.lit(d), 2 * left / F.greatest(F.lit(a) + F.sqrt(F.greatest(F.lit(a * a) + 2 * ((b - a) / d) * left, F.lit(0.0))), F.lit(1e-300)))
        end = c + d * (a + b) / 2
        out = root if out is None else F.when(share < end, root).otherwise(out)
    return F.least(F.lit(1.0), out)


def training_time(share: Column, tier: Column, schedules=SCHEDULES) -> Column:
    """The time at which a source of this tier (index of its schedule) has met this share of its demand: the inverse of its integrated schedule."""
    out = _inverse(share, schedules[-1])
    for k in reversed(range(len(schedules) - 1)):
        out = F.when(tier == k, _inverse(share, schedules[k])).otherwise(out)
    return out


def token_position(time: Column, demands: list[Column], schedules=SCHEDULES) -> Column:
    """Cumulative token demand over all sources up to a time; demands: the sum of the targets of each tier."""
    out = None
    for d, knots in zip(demands, schedules):
        own = d * integral(time, knots)
        out = own if out is None else out + own
    return out


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """From (source, size): source, tier, source_size, target, and goal, the target in whole words; sources are rows of a table of their own, a few bytes each.

    Sources by code point, null last, take the weights in turn. Targets share all sizes by weight; one over max_repeats times its source's size stops there, and the excess
    is shared by weight again until none is above. That is one level for all: target = min(cap, level * weight), found by going through the sources by cap / weight.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(W.orderBy(F.col("source").isNull(), "source")) - 1
    tier = F.pmod(rank, F.lit(len(weights))).cast("int")
    by = by.withColumn("tier", tier).withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("tier") + 1))
    by = by.withColumn("cap", (F.col("source_size") * max_repeats).cast("double")).withColumn("ratio", F.col("cap") / F.col("weight"))
    before = W.orderBy("ratio", F.col("source").isNull(), "source").rowsBetween(W.unboundedPreceding, -1)
    every = W.orderBy("ratio", F.col("source").isNull(), "source").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    by = by.withColumn("level", (F.sum(F.col("source_size").cast("double")).over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(every)["level"]
    target = F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))
    return by.withColumn("level", level).select("source", "tier", "source_size", target.alias("target")).withColumn("goal", F.floor(F.col("target") + 0.5))


def _source_key(source: Column) -> Column:
    """The source as a text that is never null, so that joins on it are plain."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit("null"))


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, max_repeats: int = MAX_REPEATS, schedules=SCHEDULES) -> DataFrame:
    """One row for each row of docs: id_col, k1 and k2 (128 bits of hash of id and text), size, source_size, target, uses, taken, position and last_position.

    uses: (repeat, words, position, end) of each time the mix takes the document, position and end being the training positions of its first word and of the one after its
    last; taken is the words of all uses, position that of the first use and last_position the end of the last (null without a use). A document is used whole each time,
    but for one use in a source, which stops short so that the source's words are its target to the word. Null texts have size 0; a document of size 0 takes part with no words and
    no use. A null source is a source of its own. Repeated rows are mixed each by itself. Reruns agree: order depends on ids and texts alone, and rows that share an id, or
    have none, are ordered by their texts. An empty table gives an empty one.
    """
    k1, k2 = content_key(F.col(id_col), F.col(text))
    h = F.md5(F.concat_ws("\n", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(text), F.lit(""))).cast("binary"))
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD_BREAK)), F.lit(0)).cast("long")
    sizes = written(docs.select(F.col(id_col).alias("id"), k1.alias("k1"), k2.alias("k2"), h.alias("h"), F.col(source).cast("string").alias("source"), size.alias("size")), "sizes")
    targets = written(source_targets(sizes, weights, max_repeats), "targets")
    keyed = sizes.withColumn("s", _source_key(F.col("source"))).withColumn("bucket", F.substring("h", 1, BUCKET_DIGITS)).drop("source")
    sums = keyed.groupBy("s", "bucket").agg(F.sum("size").alias("words"))
    starts = sums.withColumn("start", F.sum("words").over(W.partitionBy("s").orderBy("bucket")) - F.col("words")).drop("words")
    own = targets.withColumn("s", _source_key(F.col("source"))).drop("source")
    starts = written(starts.join(maybe_broadcast(own), "s"), "starts")
    tiers = targets.agg(*[F.coalesce(F.sum(F.when(F.col("tier") == k, F.col("goal"))), F.lit(0)).cast("double").alias(f"d{k}") for k in range(len(schedules))]).first()
    discard(targets)
    demands = [F.lit(x) for x in tiers]
    inner = W.partitionBy("s", "bucket").orderBy("h", "id", "size", "k1", "k2").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = keyed.withColumn("upto", F.sum("size").over(inner)).join(maybe_broadcast(starts), ["s", "bucket"])
    rows = rows.withColumn("first", F.col("start") + F.col("upto") - F.col("size"))
    # A source's stream repeats its documents; a use begins where its demand is not yet met, if it has a position at all.
    passes = F.when(F.col("source_size") > 0, F.ceil(F.col("goal") / F.greatest(F.col("source_size"), F.lit(1)))).otherwise(0)
    rows = rows.withColumn("at", F.when((F.col("size") > 0) & (passes > 0), F.transform(F.sequence(F.lit(0).cast("long"), passes.cast("long") - 1), lambda k: k * F.col("source_size") + F.col("first"))).otherwise(F.array().cast("array<bigint>")))
    rows = rows.withColumn("at", F.filter("at", lambda x: x < F.col("goal")))
    where = lambda x: token_position(training_time(x / F.col("goal"), F.col("tier"), schedules), demands, schedules)
    use = lambda x, k: F.struct(k.alias("repeat"), F.least(F.col("size"), F.col("goal") - x).alias("words"), where(x).alias("position"), where(F.least(x + F.col("size"), F.col("goal"))).alias("end"))
    rows = rows.withColumn("uses", F.transform("at", use))
    taken = F.aggregate("uses", F.lit(0).cast("long"), lambda n, u: n + u["words"])
    return rows.select(F.col("id").alias(id_col), "k1", "k2", "size", "source_size", "target", taken.alias("taken"), F.get("uses", F.lit(0))["position"].alias("position"), F.get("uses", F.size("uses") - 1)["end"].alias("last_position"), "uses")


def curriculum(docs: DataFrame, keep: list[str], id_col: str = "doc_id", text: str = "text", **kinds) -> DataFrame:
    """The documents in training order: a row for each use, with the columns in keep, then repeat, words and position, range-sorted by position.

    Ties in position go by a hash of id and text, and repeat. Rows that repeat an id and a text are uses each; what else is kept of them is that of one of the rows. An empty table
    gives no rows. A kept column named like one of the results gives way to it.
    """
    kept = Kept(docs, keep, ["repeat", "words", "position"])
    plan = mix_plan(docs, id_col, text, **kinds).where(F.size("uses") > 0).groupBy("k1", "k2").agg(F.flatten(F.collect_list("uses")).alias("uses"))
    k1, k2 = content_key(F.col(id_col), F.col(text))
    own = docs.select(kept.column, k1.alias("k1"), k2.alias("k2"))
    often = written(own.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("k1", "k2"), "repeated")
    if not often.isEmpty():
        # Only rows that repeat are gathered, to be one.
        one = own.join(often, ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.min_by("kept", F.xxhash64("kept")).alias("kept"))
        own = own.join(often, ["k1", "k2"], "left_anti").unionByName(one)
    rows = own.join(plan, ["k1", "k2"]).select("kept", "k1", "k2", F.explode("uses").alias("use"))
    order = ["position", "k1", "k2", "repeat"]
    rows = rows.select("kept", "k1", "k2", "use.repeat", "use.words", "use.position")
    return kept.out(rows.repartitionByRange(*order).sortWithinPartitions(*order))
