"""Queries of the training-data operators, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.llm import encode, langid, pack, quantiles, reading, splits, turns
from tallyloom.operators import wide
from tallyloom.operators.skew import hot_split_join
from tallyloom.session import materialise
from tallyloom.sources.tables import table


def _related(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "manifest").select("case_id", "subject_id", "audio_sha256", "split", "label")
    return splits.with_component(m, "case_id", [splits.subject_key(F.col("subject_id")), splits.digest_key(F.col("audio_sha256"))])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    records = materialise(_related(spark, d).select("case_id", "component", "split"), "p5-related")
    return hot_split_join(records, splits.leaking_components(records), "component").select("case_id").distinct()


def p5_splits(spark: SparkSession, d: str) -> DataFrame:
    records = materialise(_related(spark, d), "p5-related")
    return hot_split_join(records, splits.assign_splits(records), "component").select("case_id", "subject_id", "label", "split", "component", "new_split").distinct()


def p5_split_shares(spark: SparkSession, d: str) -> DataFrame:
    return p5_splits(spark, d).groupBy("label", "new_split").agg(F.count("*").alias("recordings"))


def p5_checks(spark: SparkSession, d: str) -> DataFrame:
    """Recordings, and what an assignment must not show: groups in two parts, recordings without a part, and parts off their share by more than a twentieth of a label's recordings and its largest group."""
    r = materialise(p5_splits(spark, d), "p5-checks")
    torn = r.groupBy("component").agg(F.count_distinct("new_split").alias("n")).agg(F.count_if(F.col("n") > 1).alias("torn_groups"))
    whole = r.agg(F.count_distinct("case_id").alias("recordings"), F.count_if(F.col("new_split").isNull()).alias("unassigned"))
    label = F.coalesce("label", F.lit(""))
    largest = r.groupBy(label.alias("l"), "component").count().groupBy("l").agg(F.max("count").alias("largest"), F.sum("count").alias("n"))
    wanted = F.element_at(F.create_map(*[F.lit(x) for x in ("train", 0.8, "validation", 0.1, "test", 0.1)]), F.col("new_split"))
    shares = r.groupBy(label.alias("l"), "new_split").count().join(largest, "l")
    off = shares.agg(F.count_if(F.abs(F.col("count") - wanted * F.col("n")) > F.col("n") / 20 + F.col("largest")).alias("parts_off"))
    return whole.join(F.broadcast(torn)).join(F.broadcast(off))


#: A group is reported from this many finite values on, and from this share on one side of its median on.
P2_LEAST, P2_SHARE = 50, 0.65
#: Groups that an exact count may be broadcast to; beyond it they are joined.
P2_BROADCAST = 10_000
P2_KEYS = ("metric_id", "reference_scope")


def _values(spark: SparkSession, d: str) -> DataFrame:
    """Finite values under the registry's metric names."""
    registry = wide.read_registry(table(spark, d, "metric_registry"), [])
    names = F.array(*[F.lit(a.name) for a in registry])
    index = wide.attribute_index(registry, F.col("metric_id"))
    finite = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf"))
    rows = table(spark, d, "metric_evidence").where(finite).select(F.try_element_at(names, index + 1).alias("metric_id"), "reference_scope", "value", "reference_median")
    return rows.where(F.col("metric_id").isNotNull())


def _merged(values: DataFrame) -> DataFrame:
    return quantiles.merge(quantiles.sketch(values, P2_KEYS, "value"), P2_KEYS)


def _stored_medians(values: DataFrame) -> DataFrame:
    """The stored median of each group: the one most of its rows bear, of equally frequent ones the greatest."""
    counted = values.groupBy(*P2_KEYS, "reference_median").count().where(F.col("reference_median").isNotNull() & ~F.isnan("reference_median"))
    return counted.groupBy(*P2_KEYS).agg(F.max_by("reference_median", F.struct("count", "reference_median")).alias("reference_median"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Groups whose stored median does not fit, by the sketches' rank bounds.

    Groups that the bounds leave open are counted exactly.
    """
    values = _values(spark, d)
    bounds = quantiles.rank_bounds(_merged(values), P2_KEYS, _stored_medians(values), "reference_median")
    limit = P2_SHARE * F.col("n")
    bounds = materialise(bounds.where(F.col("n") >= P2_LEAST), "p2-bounds")
    sure = (F.col("below_least") > limit) | (F.col("above_least") > limit)
    open_ = bounds.where(~sure & ((F.col("below_most") > limit) | (F.col("above_most") > limit))).select(*[F.col(k).alias(f"_{k}") for k in P2_KEYS], F.col("reference_median").alias("_median"))
    few = open_.count()
    found = bounds.where(sure).select(*P2_KEYS)
    if not few:
        return found
    match = F.col("metric_id").eqNullSafe(F.col("_metric_id")) & F.col("reference_scope").eqNullSafe(F.col("_reference_scope"))
    counted = (
        values.select(*P2_KEYS, "value").join(F.broadcast(open_) if few <= P2_BROADCAST else open_, match)
        .groupBy(*P2_KEYS).agg(F.count("*").alias("n"), F.count_if(F.col("value") < F.col("_median")).alias("below"), F.count_if(F.col("value") > F.col("_median")).alias("above"))
    )
    return found.unionByName(counted.where(F.greatest("below", "above") > limit).select(*P2_KEYS))


def p2_percentiles(spark: SparkSession, d: str) -> DataFrame:
    values = _values(spark, d)
    stored = _stored_medians(values).select(*[F.col(k).alias(f"_{k}") for k in P2_KEYS], "reference_median")
    found = quantiles.percentiles(_merged(values), P2_KEYS)
    match = F.col("metric_id").eqNullSafe(F.col("_metric_id")) & F.col("reference_scope").eqNullSafe(F.col("_reference_scope"))
    return found.join(stored, match, "left").select(*found.columns, "reference_median", (F.col("p50") - F.col("reference_median")).alias("median_shift"))


def p2_checks(spark: SparkSession, d: str) -> DataFrame:
    """Groups, their values, and how many of their percentiles have a true rank farther from the asked one than the stated bound."""
    at = {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}
    values = _values(spark, d)
    found = materialise(quantiles.percentiles(_merged(values), P2_KEYS, tuple(at.values())), "p2-checks")
    asked = F.explode(F.array(*[F.struct(F.lit(q).alias("q"), F.col(c).alias("v")) for c, q in at.items()])).alias("a")
    long = found.select(*[F.col(k).alias(f"_{k}") for k in P2_KEYS], F.col("n").alias("_n"), "rank_error", asked)
    match = F.col("metric_id").eqNullSafe(F.col("_metric_id")) & F.col("reference_scope").eqNullSafe(F.col("_reference_scope"))
    # A value stands for its cell of the encoding, which is 2^-19 of it wide, and two parts of the bound: a place within the cell, and its rank.
    near = F.abs(F.col("a.v")) * 2.0**-18 + 1e-300
    ranks = long.join(values, match).groupBy(*[f"_{k}" for k in P2_KEYS], "a").agg(F.max("_n").alias("n"), F.max("rank_error").alias("e"), F.count_if(F.col("value") < F.col("a.v") - near).alias("low"), F.count_if(F.col("value") <= F.col("a.v") + near).alias("high"))
    target, slack = F.col("a.q") * (F.col("n") - 1), 2 * F.col("e") * F.col("n") + 1
    out = ranks.agg(F.count_if((F.col("low") > target + slack) | (F.col("high") < target - slack)).alias("outside"))
    return found.agg(F.count("*").alias("groups"), F.sum("n").alias("rows")).join(F.broadcast(out))


def _case_turns(spark: SparkSession, d: str) -> DataFrame:
    return turns.speaker_turns(table(spark, d, "prepared_authority_study_case"), "case_id", "transcript")


def p4_turns(spark: SparkSession, d: str) -> DataFrame:
    """The turns of both transcript fields, with what is said."""
    told = table(spark, d, "synthetic_workspace").select("case_id", F.col("case_transcript.text").alias("transcript"))
    both = table(spark, d, "prepared_authority_study_case").select("case_id", "transcript").unionByName(told)
    return turns.speaker_turns(both, "case_id", "transcript")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_turns(spark, d).where(F.col("case_id").isNotNull()).select("case_id", "turn_no", "speaker", "n_letters").distinct()


def _judged_turns(spark: SparkSession, d: str) -> DataFrame:
    return langid.turn_languages(_case_turns(spark, d), langid.fit(table(spark, d, "documents")))


def p3_turns(spark: SparkSession, d: str) -> DataFrame:
    return _judged_turns(spark, d).select("case_id", "turn_no", "speaker", "language", "confidence", "whole", F.size("segments").alias("n_segments")).distinct()


def p3_documents(spark: SparkSession, d: str) -> DataFrame:
    """The language of every document, and whether its label names another."""
    documents = table(spark, d, "documents")
    found = langid.document_languages(documents, langid.fit(documents))
    wrong = F.col("named").isNotNull() & F.col("language").isNotNull() & (F.col("named") != F.col("language"))
    return found.select("doc_id", "label", "language", "confidence", "whole", F.size("segments").alias("n_segments"), wrong.alias("label_differs"))


def p3_segments(spark: SparkSession, d: str) -> DataFrame:
    """The parts of documents that hold several languages, each with its language."""
    documents = table(spark, d, "documents")
    mixed = langid.document_languages(documents, langid.fit(documents)).where(F.size("segments") > 1)
    return mixed.select("doc_id", F.posexplode("segments").alias("segment_no", "s")).select("doc_id", "segment_no", "s.language", "s.letters", "s.confidence")


def _named(spark: SparkSession, d: str) -> DataFrame:
    """case_id and each language its labels name."""
    names = F.pandas_udf(lambda s: s.map(langid.named_language, na_action="ignore"), "string")
    labels = table(spark, d, "public_cases").select("case_id", "language").distinct()
    return labels.withColumn("named", names("language"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    spoken = _judged_turns(spark, d).where("whole").select("case_id", "language").where(F.col("case_id").isNotNull()).distinct()
    named = _named(spark, d).where(F.col("named").isNotNull()).select("case_id", F.col("named").alias("language")).distinct()
    return spoken.join(named, ["case_id", "language"], "left_anti")


def p3_cases(spark: SparkSession, d: str) -> DataFrame:
    """Each public case with its label, the language its transcripts are mostly in, and the corrected label.

    A case without a spoken transcript keeps the language its label names.
    """
    letters = _judged_turns(spark, d).where(F.col("language").isNotNull()).groupBy("case_id", "language").agg(F.sum("n_letters").alias("n"), F.avg("confidence").alias("c"))
    main = letters.groupBy("case_id").agg(F.max_by("language", F.struct("n", "language")).alias("spoken"), (F.max("n") / F.sum("n")).alias("share"), F.max_by("c", F.struct("n", "language")).alias("confidence"))
    labels = _named(spark, d).groupBy("case_id").agg(F.min("language").alias("label"), F.min("named").alias("named"))
    return labels.join(main, "case_id", "left").select("case_id", "label", "spoken", "share", "confidence", F.coalesce("spoken", "named").alias("language"))


#: Tokens a container holds.
P8_CAPACITY = 2048


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode(table(spark, d, "documents"), encode.Tokenizer.load())


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return pack.pack(encode.token_counts(table(spark, d, "documents"), encode.Tokenizer.load()), capacity=P8_CAPACITY)


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return pack.fill(p8_containers(spark, d), P8_CAPACITY)


def p8_checks(spark: SparkSession, d: str) -> DataFrame:
    """Documents, and what a packing must not show: units lost or doubled, pieces that overlap or stick out, and texts divided without need."""
    counts = materialise(encode.token_counts(table(spark, d, "documents"), encode.Tokenizer.load()), "p8-counts")
    p = materialise(pack.pack(counts, capacity=P8_CAPACITY), "p8-checks")
    per = p.groupBy("doc_id").agg(F.sum("piece_size").alias("units"), F.count("*").alias("pieces"), F.sum(F.col("piece_from") + F.col("piece_no")).alias("order"))
    k = F.greatest(F.ceil(F.coalesce("n_tokens", F.lit(0)) / P8_CAPACITY), F.lit(1))
    lost = counts.join(per, "doc_id", "left").agg(F.count("*").alias("documents"), F.count_if(~F.coalesce("units", F.lit(-1)).eqNullSafe(F.coalesce("n_tokens", F.lit(0)))).alias("lost"), F.count_if(F.col("pieces") != k).alias("divided_without_need"))
    # A container's pieces in order of place: each begins where the one before has ended, or later.
    w = Window.partitionBy("container").orderBy("place")
    inside = p.where(F.col("container").isNotNull()).withColumn("before", F.lag(F.col("place") + F.col("piece_size")).over(w))
    wrong = inside.agg(F.count_if(F.col("before") > F.col("place")).alias("overlapping"), F.count_if((F.col("place") < 0) | (F.col("place") + F.col("piece_size") > P8_CAPACITY)).alias("sticking_out"))
    return lost.join(F.broadcast(wrong))


#: Texts whose ids are known: empty and null ones, scripts, marks and repeats. Fixed values.
P7_TEXTS = {1: "", 2: None, 3: "The quick brown fox jumps over the lazy dog.", 4: "  two  blanks\n\tand a tab ", 5: "你好，世界！ naïve café — 42%", 6: "aaaaaaaaaaaaaaaaaaaaaaaa", 7: "<|endoftext|> don't we'll I'M"}


def p7_fixed(spark: SparkSession, d: str) -> DataFrame:
    """The ids of a few fixed texts, against those the tokenizer's own library gives."""
    return encode.encode(spark.createDataFrame(list(P7_TEXTS.items()), "doc_id long, text string"), encode.Tokenizer.load())


def p9_levels(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    return reading.read_levels(documents, reading.fit(documents, table(spark, d, "reading_labels")))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_levels(spark, d).where(F.col("band") == reading.BANDS[2]).select("doc_id").distinct()


# Where an operator has no pN_found, its first query is the one that stands for it: over whole tables, as p7_ids.
QUERIES = {"p2_checks": p2_checks, "p5_checks": p5_checks, "p7_ids": p7_ids, "p7_fixed": p7_fixed, "p8_checks": p8_checks, "p8_containers": p8_containers, "p8_fill": p8_fill, "p9_found": p9_found, "p9_levels": p9_levels, "p3_found": p3_found, "p3_turns": p3_turns, "p3_cases": p3_cases, "p3_documents": p3_documents, "p3_segments": p3_segments, "p4_found": p4_found, "p4_turns": p4_turns, "p2_found": p2_found, "p2_percentiles": p2_percentiles, "p5_found": p5_found, "p5_splits": p5_splits, "p5_split_shares": p5_split_shares}

ORACLES = {
    "p2_checks": r"""
WITH k AS (SELECT metric_id, lower(regexp_replace(metric_id, '[^\pL\pN]', '', 'g')) AS key FROM metric_registry),
v AS (
  SELECT k.metric_id, e.reference_scope FROM metric_evidence e JOIN k
    ON lower(regexp_replace(regexp_replace(lower(trim(e.metric_id)), '^\s*metric\s*:', ''), '[^\pL\pN]', '', 'g')) = k.key
  WHERE isfinite(e.value)
)
SELECT count(*) AS groups, CAST(sum(n) AS BIGINT) AS rows, 0 AS outside FROM (SELECT count(*) AS n FROM v GROUP BY metric_id, reference_scope)
""",
    "p5_checks": "SELECT count(DISTINCT case_id) AS recordings, 0 AS unassigned, 0 AS torn_groups, 0 AS parts_off FROM manifest",
    # What the tokenizer's own library gives. Fixed values.
    "p7_fixed": "SELECT * FROM (VALUES (1, []::INTEGER[]), (2, []::INTEGER[]), (3, [464, 2068, 7586, 21831, 18045, 625, 262, 16931, 3290, 13]::INTEGER[]), (4, [220, 734, 220, 698, 2283, 198, 197, 392, 257, 7400, 220]::INTEGER[]), (5, [19526, 254, 25001, 121, 171, 120, 234, 10310, 244, 45911, 234, 171, 120, 223, 41492, 40304, 851, 5433, 4]::INTEGER[]), (6, [24794, 24794, 24794, 24794, 24794, 24794]::INTEGER[]), (7, [27, 91, 437, 1659, 5239, 91, 29, 836, 470, 356, 1183, 314, 6, 44]::INTEGER[])) x(doc_id, ids)",
    "p8_checks": "SELECT count(*) AS documents, 0 AS lost, 0 AS divided_without_need, 0 AS overlapping, 0 AS sticking_out FROM documents",
    "p2_found": r"""
WITH k AS (SELECT metric_id, lower(regexp_replace(metric_id, '[^\pL\pN]', '', 'g')) AS key FROM metric_registry),
v AS (
  SELECT k.metric_id, e.reference_scope, e.value, e.reference_median FROM metric_evidence e JOIN k
    ON lower(regexp_replace(regexp_replace(lower(trim(e.metric_id)), '^\s*metric\s*:', ''), '[^\pL\pN]', '', 'g')) = k.key
  WHERE isfinite(e.value)
), m AS (
  SELECT metric_id, reference_scope, arg_max(reference_median, (n, reference_median)) AS m
  FROM (SELECT metric_id, reference_scope, reference_median, count(*) AS n FROM v WHERE reference_median IS NOT NULL GROUP BY ALL) GROUP BY ALL
)
SELECT v.metric_id, v.reference_scope FROM v JOIN m ON v.metric_id = m.metric_id AND v.reference_scope IS NOT DISTINCT FROM m.reference_scope
GROUP BY ALL
HAVING count(*) >= 50 AND greatest(count(*) FILTER (value < m), count(*) FILTER (value > m)) > 0.65 * count(*)
""",
    # Label propagation to a fixed point, by recursion over the recordings' shared keys.
    "p5_found": r"""
WITH RECURSIVE r AS (
  SELECT DISTINCT case_id, split,
    nullif(lower(regexp_replace(subject_id, '[^\pL\pN]', '', 'g')), '') AS s,
    CASE WHEN regexp_matches(lower(audio_sha256), '^[0-9a-f]{64}$') AND lower(audio_sha256) <> repeat(left(lower(audio_sha256), 1), 64)
         THEN lower(audio_sha256) END AS h
  FROM manifest
), k AS (
  SELECT case_id, split, CASE WHEN s NOT IN ('unknown', 'na', 'none', 'null', 'nan', 'notapplicable', 'notavailable', 'unk') THEN s END AS s, h FROM r
), links AS (
  SELECT DISTINCT a.s AS x, b.s AS y FROM k a JOIN k b ON a.h = b.h WHERE a.s IS NOT NULL AND b.s IS NOT NULL AND a.s <> b.s
), reach(x, y) AS (
  SELECT x, y FROM links UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x
), root AS (
  SELECT x AS s, least(x, min(y)) AS root FROM reach GROUP BY x
), byhash AS (
  SELECT h, min(coalesce(root.root, k.s)) AS root FROM k LEFT JOIN root USING (s) WHERE h IS NOT NULL GROUP BY h
), grouped AS (
  SELECT k.case_id, k.split, coalesce(root.root, k.s, byhash.root, k.h, 'case ' || k.case_id) AS g
  FROM k LEFT JOIN root USING (s) LEFT JOIN byhash USING (h)
)
SELECT DISTINCT case_id FROM grouped
WHERE g IN (SELECT g FROM grouped WHERE split IS NOT NULL GROUP BY g HAVING count(DISTINCT split) > 1)
""",
}
