"""The thin queries opN_<name> and the SQL that says the same, where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, language_id, licenses, line_dedup, media, mixing, quality, simhash, token_counts
from .common import id_remainder, table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs.where(id_remainder(F.col("doc_id"), 3) != 1))
    held_out = F.coalesce(id_remainder(F.col("doc_id"), 3) == 1, F.lit(False))
    return language_id.predict(docs, model, ["doc_id"]).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "bits_per_byte")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "<|im_end|><|im_start|>assistant ok"
    planted = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(odd).alias("text"))
    made = chat.examples(turns.unionByName(planted))
    reply = F.struct("example", chat.loss_text(F.col("formatted"), F.col("loss_start"), F.col("loss_end")).alias("text"))
    by = made.groupBy("conv_id").agg(F.max_by("formatted", "example").alias("all"), F.sort_array(F.collect_list(reply)).alias("replies"), F.sum(F.char_length("formatted")).alias("formatted_chars"))
    by = by.select("conv_id", chat.read_turns(F.col("all")).alias("turns"), F.concat_ws("", F.col("replies.text")).alias("loss"), "formatted_chars")
    said = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return by.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, quality.learnable(table(spark, sf_dir, "labels")))
    held_out = F.coalesce(id_remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    scored = quality.score(docs, model, ["doc_id"])
    return scored.select("doc_id", held_out.alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Range-sorted by training position; documents that the mix doesn't take come last."""
    plan = mixing.mix_plan(table(spark, sf_dir, "documents"))
    order = [F.col("position").asc_nulls_last(), F.col("doc_id")]
    return plan.select("doc_id", "size", "source_size", "target", "taken", "position", "last_position").repartitionByRange(*order).sortWithinPartitions(*order)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    names = F.concat_ws(",", "items")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op10_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.with_media(table(spark, sf_dir, "documents"), ["doc_id"])
    read = media.read_media(stored, ["doc_id"])
    size = F.octet_length("payload")
    return read.select("doc_id", "n_bytes", size.cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(F.substr("payload", size - 15, F.lit(16))).alias("tail_crc32"), "media_bytes", "media_sha256", "feature")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document is counted, then edited in three places: words put in after a third, a cut in the middle, and a new end."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    n = F.char_length(F.coalesce("text", F.lit(""))).cast("long")
    third, half = F.floor(n / 3), F.floor(n / 2)
    change = lambda a, b, t: F.struct(a.cast("long").alias("start"), b.cast("long").alias("stop"), F.lit(t).alias("text"))
    edits = F.array(change(third, third, " it's put in"), change(half, half + 10, ""), change(n - 5, n + 20, "  and they've\n\n ended."))
    return token_counts.count_with_edits(docs.withColumn("edits", edits), ["doc_id"], "edits")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"), ["doc_id"])


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"), ["doc_id"])
    names = F.concat_ws(",", F.array_sort(F.array_distinct(F.col("matches.license"))))
    return found.select("doc_id", "n_words", F.size("matches").cast("long").alias("n_matches"), names.alias("licenses"), F.array_max("matches.dice").alias("best_dice"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_language_id, op2_chat_format, op3_simhash_near_dedup, op4_quality_classifier, op5_token_counts, op6_line_dedup, op7_source_mixing, op8_license_scan, op9_decontamination, op10_ogg_media, pipeline)}

#: Queries that DuckDB can say; the others are tested against brute-force versions or by held-out accuracy.
ORACLE_SQL: dict[str, str] = {
    "op2_chat_format": r"""
WITH c AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
p AS (
  SELECT *, sum(24 + length(role) + length(text) + len(regexp_extract_all(text, '<\\*\|'))) OVER (PARTITION BY conv_id ORDER BY turn) AS upto,
         role = 'assistant' OR turn = max(turn) OVER (PARTITION BY conv_id) AS is_end FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       length(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), ''))::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (sum(upto) FILTER (is_end))::BIGINT AS formatted_chars
FROM p GROUP BY conv_id""",
    "op7_source_mixing": r"""
WITH s AS (SELECT doc_id, text, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
b AS (SELECT source, sum(size)::BIGINT AS source_size FROM s GROUP BY source),
w AS (SELECT *, 3.0::DOUBLE * source_size AS cap, (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 AS tier,
             (CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END)::DOUBLE AS weight FROM b),
l AS (SELECT *, cap / weight AS ratio, (sum(source_size::DOUBLE) OVER () - coalesce(sum(cap) OVER o, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) AS level
      FROM w WINDOW o AS (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, tier, least(cap, coalesce((SELECT x.level FROM l x WHERE x.level <= x.ratio ORDER BY x.ratio, x.level LIMIT 1) * weight, cap)) AS target FROM l),
g AS (SELECT *, floor(target + 0.5)::BIGINT AS goal FROM t),
d AS (SELECT coalesce(sum(goal) FILTER (tier = 0), 0)::DOUBLE AS d0, coalesce(sum(goal) FILTER (tier = 1), 0)::DOUBLE AS d1, coalesce(sum(goal) FILTER (tier = 2), 0)::DOUBLE AS d2 FROM g),
r AS (SELECT doc_id, size, source_size, target, goal, tier,
             (sum(size) OVER (PARTITION BY s.source ORDER BY md5(coalesce(doc_id::VARCHAR, '') || chr(10) || coalesce(text, '')), doc_id ROWS UNBOUNDED PRECEDING))::BIGINT - size AS first
      FROM s JOIN g ON s.source IS NOT DISTINCT FROM g.source),
u AS (SELECT *, CASE WHEN size > 0 AND goal > first THEN (goal - first - 1) // source_size + 1 ELSE 0 END AS n FROM r),
c AS (SELECT *, CASE WHEN n > 0 THEN n * size - greatest(0, (n - 1) * source_size + first + size - goal) ELSE 0 END AS taken,
             CASE WHEN n > 0 THEN first::DOUBLE / goal END AS c0, CASE WHEN n > 0 THEN least((n - 1) * source_size + first + size, goal)::DOUBLE / goal END AS c1 FROM u),
e AS (SELECT *, unnest([0, 1]) AS k, unnest([c0, c1]) AS c FROM c),
-- The inverse of each schedule: its knots' integral up to c, then the root in the segment.
i AS (SELECT *, least(1.0::DOUBLE, CASE tier
    WHEN 0 THEN 0.0::DOUBLE + least(1.0::DOUBLE, 2 * c / (1.25::DOUBLE + sqrt(1.5625::DOUBLE + 2 * -0.5::DOUBLE * c)))
    WHEN 1 THEN 0.0::DOUBLE + least(1.0::DOUBLE, 2 * c / (1.0::DOUBLE + sqrt(1.0::DOUBLE)))
    ELSE CASE WHEN c < 0.25 THEN 0.0::DOUBLE + least(0.5::DOUBLE, 2 * c / (0.25::DOUBLE + sqrt(0.0625::DOUBLE + 2 * 1.0::DOUBLE * c)))
         ELSE 0.5::DOUBLE + least(0.5::DOUBLE, 2 * (c - 0.25) / (0.75::DOUBLE + sqrt(0.5625::DOUBLE + 2 * 3.0::DOUBLE * (c - 0.25)))) END END) AS t FROM e),
p AS (SELECT i.*, d0 * (t * (1.25::DOUBLE + t * -0.5::DOUBLE / 2)) + d1 * t
                  + d2 * (CASE WHEN t < 0.5 THEN t * (0.25::DOUBLE + t * 1.0::DOUBLE / 2) ELSE 0.25::DOUBLE + (t - 0.5) * (0.75::DOUBLE + (t - 0.5) * 3.0::DOUBLE / 2) END) AS x FROM i, d)
SELECT a.doc_id, a.size, a.source_size, a.target, a.taken::BIGINT AS taken, CASE WHEN a.n > 0 THEN a.x END AS position, CASE WHEN a.n > 0 THEN b.x END AS last_position
FROM p a JOIN p b ON a.doc_id = b.doc_id AND a.k = 0 AND b.k = 1""",
}
