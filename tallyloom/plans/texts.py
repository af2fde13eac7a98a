"""Text, JSON and identifier functions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import parse
from tallyloom.functions import text as T
from tallyloom.plans.catalog import Catalog, Tables, r

catalog = Catalog()
add = catalog.add
QUERIES, ORACLES = catalog.queries, catalog.oracles

TOKENS_SQL = r"regexp_extract_all(lower(text), '\p{L}+(?:''\p{L}+)?')"


def tokens(t: Tables) -> DataFrame:
    return t.documents.where(F.col("text").isNotNull()).select("doc_id", "text", "lang", T.words(F.col("text")).alias("tokens"))


def _t(select: str) -> str:
    return f"SELECT doc_id, {select} FROM (SELECT doc_id, text, lang, {TOKENS_SQL} AS tokens FROM documents WHERE text IS NOT NULL)"


@add("t01_slug", "SELECT DISTINCT task_name, trim(regexp_replace(lower(task_name), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM public_cases")
def _(t: Tables) -> DataFrame:
    return t.public_cases.select("task_name", T.slug(F.col("task_name")).alias("slug")).distinct()


@add(
    "t02_canonical_language",
    "WITH b AS (SELECT DISTINCT language, split_part(replace(lower(trim(language)), '_', '-'), '-', 1) AS base FROM public_cases) SELECT language, CASE WHEN language IS NULL OR trim(language) = '' THEN 'unknown' ELSE CASE "
    + " ".join(f"WHEN base = '{k}' THEN '{v}'" for k, v in T.LANGUAGE_ALIASES.items())
    + " ELSE base END END AS code FROM b",
)
def _(t: Tables) -> DataFrame:
    return t.public_cases.select("language", T.canonical_language(F.col("language")).alias("code")).distinct()


@add("t04_word_count", _t("len(tokens) AS words"))
def _(t: Tables) -> DataFrame:
    return tokens(t).select("doc_id", F.size("tokens").cast("long").alias("words"))


@add("t06_type_token_ratio", _t("CASE WHEN len(tokens) > 0 THEN round(len(list_distinct(tokens)) / len(tokens), 9) END AS ttr, round(len(tokens) / 2.5, 9) AS wpm"))
def _(t: Tables) -> DataFrame:
    return tokens(t).select("doc_id", r(T.type_token_ratio(F.col("tokens"))).alias("ttr"), r(F.size("tokens") / 2.5).alias("wpm"))


def _in(words: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _lexicon_sql(words: dict[str, tuple[str, ...]], keep: str = "") -> str:
    """Rate per hundred tokens that are (or, with ``keep``, are not) in the words of the document's language; English for languages without a list."""
    own = "CASE lang " + " ".join(f"WHEN '{k}' THEN {_in(v)}" for k, v in words.items() if k != "en") + f" ELSE {_in(words['en'])} END"
    return f"CASE WHEN len(tokens) > 0 THEN round(100.0 * len(list_filter(tokens, lambda w: {keep} list_contains({own}, w))) / len(tokens), 9) END"


_NOT_CONTENT = {k: T.FILLERS[k] + T.PRONOUNS[k] + T.FUNCTION_WORDS[k] for k in T.PRONOUNS}


@add("t07_lexicon_rates", _t(f"{_lexicon_sql(T.FILLERS)} AS fillers, {_lexicon_sql(T.PRONOUNS)} AS pronouns, {_lexicon_sql(_NOT_CONTENT, 'NOT')} AS content_words"))
def _(t: Tables) -> DataFrame:
    """Fillers, pronouns and content words per hundred words, by the lists of the document's language."""

    def rate(words: dict[str, tuple[str, ...]]):
        out = T.lexicon_rate(F.col("tokens"), words["en"])
        for k, v in words.items():
            if k != "en":
                out = F.when(F.col("lang") == k, T.lexicon_rate(F.col("tokens"), v)).otherwise(out)
        return out

    return tokens(t).select("doc_id", r(rate(T.FILLERS)).alias("fillers"), r(rate(T.PRONOUNS)).alias("pronouns"), r(100.0 - rate(_NOT_CONTENT)).alias("content_words"))


@add("t08_repairs", "SELECT case_id, CAST((length(transcript) - length(replace(transcript, '[/]', ''))) / 3 AS INT) AS repeats, CAST((length(transcript) - length(replace(transcript, '[//]', ''))) / 4 AS INT) AS repairs FROM prepared_authority_study_case")
def _(t: Tables) -> DataFrame:
    x = F.col("transcript")
    return t.prepared_authority_study_case.select("case_id", T.occurrences(x, "[/]").alias("repeats"), T.occurrences(x, "[//]").alias("repairs"))


@add("t09_mean_line_words", "SELECT doc_id, round(avg(n), 9) AS mean_words FROM (SELECT doc_id, len(regexp_extract_all(lower(l), '\\p{L}+(?:''\\p{L}+)?')) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents)) WHERE n > 0 GROUP BY 1")
def _(t: Tables) -> DataFrame:
    lines = t.documents.select("doc_id", F.explode(F.split("text", "\n")).alias("l")).select("doc_id", F.size(T.words(F.col("l"))).alias("n"))
    return lines.where("n > 0").groupBy("doc_id").agg(r(F.avg("n")).alias("mean_words"))


@add("t12_clean_chat", "SELECT DISTINCT case_id, trim(regexp_replace(regexp_replace(regexp_replace(transcript, '\\[[^\\]]*\\]', ' ', 'g'), '&[-=+~]?[^ \\t\\n\\r\\f\\v]*', ' ', 'g'), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS clean FROM prepared_authority_study_case WHERE contains(transcript, '@Begin')")
def _(t: Tables) -> DataFrame:
    p = t.prepared_authority_study_case.where(F.col("transcript").contains("@Begin"))
    return p.select("case_id", T.clean_chat(F.col("transcript")).alias("clean")).distinct()


@add("t13_redaction", None)
def _(t: Tables) -> DataFrame:
    """Sentences that speak of a diagnosis or a doctor, redacted."""
    return t.documents.select("doc_id", T.redact(F.col("text"), r"(?iu)\b(diagnos\w*|doctor|médico|médecin|ärztin)\b|医生").alias("text"))


@add("t14_metadata_disclosure", "SELECT case_id, regexp_matches(lower(concat_ws(' ', dataset_id, label, diagnosis_source, audio_path)), '(^|[^a-z])(ad|mci|dementia)([^a-z]|$)') AS discloses FROM manifest")
def _(t: Tables) -> DataFrame:
    return t.manifest.select("case_id", F.lower(F.concat_ws(" ", "dataset_id", "label", "diagnosis_source", "audio_path")).rlike("(^|[^a-z])(ad|mci|dementia)([^a-z]|$)").alias("discloses"))


@add("t15_pseudonym", "SELECT case_id, substr(sha256('salt::' || case_id), 1, 12) AS pseudonym FROM manifest")
def _(t: Tables) -> DataFrame:
    return t.manifest.select("case_id", T.pseudonym(F.col("case_id"), "salt").alias("pseudonym"))


@add("t16_typed_id", "SELECT DISTINCT metric_id, CASE WHEN trim(metric_id) = '' THEN NULL WHEN starts_with(trim(metric_id), 'metric:') THEN trim(metric_id) ELSE 'metric:' || trim(metric_id) END AS typed FROM metric_evidence")
def _(t: Tables) -> DataFrame:
    return t.metric_evidence.select("metric_id", T.typed_id("metric", F.col("metric_id")).alias("typed")).distinct()


@add("t17_composite_identity", "SELECT case_id, 'dataset=' || url_encode(coalesce(dataset_id, '')) || ':task=' || url_encode(coalesce(task_type, '')) AS identity FROM manifest")
def _(t: Tables) -> DataFrame:
    return t.manifest.select("case_id", T.composite_identity(dataset=F.col("dataset_id"), task=F.col("task_type")).alias("identity"))


@add("t18_task_family", "SELECT DISTINCT task_type, CASE " + " ".join(f"WHEN contains(lower(task_type), '{w}') THEN '{f}'" for w, f in T.TASK_FAMILIES) + " ELSE 'other' END AS family FROM public_cases")
def _(t: Tables) -> DataFrame:
    return t.public_cases.select("task_type", T.task_family(F.col("task_type")).alias("family")).distinct()


_RUBRIC = ("because", "although", "evidence", "interview", "however", "pause", "variability")


@add("t19_rubric", "SELECT doc_id, least(5, " + " + ".join(f"CAST(contains(lower(coalesce(text, '')), '{w}') AS INT)" for w in _RUBRIC) + ") AS score FROM documents")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.rubric(F.col("text"), _RUBRIC).alias("score"))


@add(
    "t20_tf_idf",
    f"""WITH k AS (SELECT doc_id, unnest({TOKENS_SQL}) AS w FROM documents WHERE text IS NOT NULL), tf AS (SELECT doc_id, w, count(*) AS n FROM k GROUP BY ALL),
df AS (SELECT w, count(*) AS d FROM tf GROUP BY 1 HAVING count(*) >= 5), c AS (SELECT count(*) AS docs FROM documents)
SELECT w, round(sum((1 + ln(n)) * (ln((1 + docs) / (1 + d)) + 1)), 6) AS weight, any_value(d) AS documents FROM tf JOIN df USING (w) CROSS JOIN c GROUP BY 1""",
)
def _(t: Tables) -> DataFrame:
    """Sublinear term weights times smoothed inverse document frequency, summed by term."""
    tf = tokens(t).select("doc_id", F.explode("tokens").alias("w")).groupBy("doc_id", "w").agg(F.count("*").alias("n"))
    df = tf.groupBy("w").agg(F.count("*").alias("d"), F.sum(1 + F.log("n")).alias("s")).where("d >= 5")
    docs = t.documents.agg(F.count("*").alias("docs"))
    return df.join(F.broadcast(docs)).select("w", F.round(F.col("s") * (F.log((1 + F.col("docs")) / (1 + F.col("d"))) + 1), 6).alias("weight"), F.col("d").alias("documents"))


@add("t21_capture", "SELECT case_id, regexp_extract(audio_path, '([a-z_]+)/rec', 1) AS folder FROM manifest")
def _(t: Tables) -> DataFrame:
    return t.manifest.select("case_id", F.coalesce(F.regexp_extract("audio_path", "([a-z_]+)/rec", 1), F.lit("")).alias("folder"))


@add("w16_mattr", _t("CASE WHEN len(tokens) = 0 THEN NULL WHEN len(tokens) <= 50 THEN round(len(list_distinct(tokens)) / len(tokens), 9) ELSE round(list_avg(list_transform(range(1, len(tokens) - 48), lambda i: len(list_distinct(tokens[i:i+49])))) / 50, 9) END AS mattr"))
def _(t: Tables) -> DataFrame:
    return tokens(t).select("doc_id", r(T.mattr(F.col("tokens"))).alias("mattr"))


@add("w17_mtld", None)
def _(t: Tables) -> DataFrame:
    return tokens(t).select("doc_id", T.mtld("tokens").alias("mtld"))


@add("w18_repetition", _t("CASE WHEN len(tokens) > 1 THEN len(list_filter(range(2, len(tokens) + 1), lambda i: tokens[i] = tokens[i-1])) ELSE 0 END AS tokens_repeated, CASE WHEN len(tokens) > 3 THEN len(list_filter(range(3, len(tokens)), lambda i: tokens[i] = tokens[i-2] AND tokens[i+1] = tokens[i-1])) ELSE 0 END AS pairs_repeated"))
def _(t: Tables) -> DataFrame:
    return tokens(t).select("doc_id", T.repeated_tokens(F.col("tokens")).cast("long").alias("tokens_repeated"), T.repeated_pairs(F.col("tokens")).cast("long").alias("pairs_repeated"))


@add("n01_json_list", "SELECT metric_instance_id, t AS tag, count(*) AS n FROM (SELECT metric_instance_id, unnest(from_json(confound_tags, '[\"VARCHAR\"]')) AS t FROM metric_evidence) GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    return t.metric_evidence.select("metric_instance_id", F.explode(parse.json_strings(F.col("confound_tags"))).alias("tag")).groupBy("metric_instance_id", "tag").agg(F.count("*").alias("n"))


@add("n02_json_length", "SELECT coalesce(json_array_length(confound_tags), 0) AS tags, count(*) AS n FROM metric_evidence GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return t.metric_evidence.groupBy(F.size(parse.json_strings(F.col("confound_tags"))).cast("long").alias("tags")).agg(F.count("*").alias("n"))


@add("n03_records_to_json", "SELECT state_id, '[' || string_agg('{\"metric_id\":\"' || metric_id || '\",\"direction\":' || direction || '}', ',' ORDER BY metric_id) || ']' AS records FROM metric_registry GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return t.metric_registry.groupBy("state_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("metric_id", "direction")))).alias("records"))


@add("n04_distinct_structs", "SELECT record_id, len(list_distinct(evidence_registry)) AS n FROM synthetic_workspace WHERE evidence_registry IS NOT NULL")
def _(t: Tables) -> DataFrame:
    w = t.synthetic_workspace.where(F.col("evidence_registry").isNotNull())
    return w.select("record_id", F.size(F.filter(F.array_distinct("evidence_registry"), lambda x: x.isNotNull())).cast("long").alias("n"))


@add("n05_canonical_hash", None)
def _(t: Tables) -> DataFrame:
    """SHA-256 of each row's JSON with its fields in order of name: equal only within this engine."""
    m = t.manifest
    return m.select("case_id", F.sha2(F.to_json(F.struct(*sorted(m.columns)), {"ignoreNullFields": "false"}), 256).alias("hash"))


@add("n08_all_items", "SELECT record_id, list_bool_and(list_transform(state_observations, lambda s: coalesce(s.task_scope = 'global', false))) AS all_global FROM synthetic_workspace WHERE len(state_observations) > 0")
def _(t: Tables) -> DataFrame:
    w = t.synthetic_workspace.where(F.size("state_observations") > 0)
    return w.select("record_id", F.forall("state_observations", lambda s: F.coalesce(s["task_scope"] == "global", F.lit(False))).alias("all_global"))


@add("n09_id_dictionary", "SELECT task_type, dense_rank() OVER (ORDER BY task_type) AS alias FROM (SELECT DISTINCT task_type FROM manifest WHERE task_type IS NOT NULL)")
def _(t: Tables) -> DataFrame:
    """Aliases of the few task types; for ids of unbounded number use a hash, as one task ranks them."""
    from pyspark.sql import Window as W

    d = t.manifest.where(F.col("task_type").isNotNull()).select("task_type").distinct()
    return d.select("task_type", F.dense_rank().over(W.orderBy("task_type")).alias("alias"))


@add("n10_id_list", "SELECT metric_id, CASE WHEN trim(metric_id) = '' THEN 0 ELSE 1 END AS ids FROM metric_registry")
def _(t: Tables) -> DataFrame:
    return t.metric_registry.select("metric_id", F.size(parse.id_list(F.col("metric_id"))).alias("ids"))


@add("n11_split_list", "SELECT part, count(*) AS n FROM (SELECT trim(unnest(string_split(audio_path, '/'))) AS part FROM manifest) WHERE part <> '' GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return t.manifest.select(F.explode(parse.split_list(F.col("audio_path"), "/")).alias("part")).groupBy("part").agg(F.count("*").alias("n"))


@add("t03_mojibake", None)
def _(t: Tables) -> DataFrame:
    """Texts read with the wrong encoding, put right."""
    return t.documents.select("doc_id", T.repair_mojibake(F.col("text")).alias("text"))
