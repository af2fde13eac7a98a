"""Tables written by each sink and read back by each source, and manifests from paths."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.plans.catalog import Catalog, Tables
from tallyloom.session import scratch_root
from tallyloom.sources import adapters as A
from tallyloom.sources import files as S

catalog = Catalog()
add = catalog.add
QUERIES, ORACLES = catalog.queries, catalog.oracles


def _path(t: Tables, name: str) -> str:
    return f"{scratch_root(t.spark)}/{name}-{uuid.uuid4().hex}"


_MANIFEST = ("case_id", "subject_id", "label", "age", "recording_index")
_TYPES = "case_id string, subject_id string, label string, age double, recording_index int"


def _written(t: Tables, kind: str, **options: str) -> str:
    path = _path(t, kind)
    t.manifest.select(*_MANIFEST).write.options(**S.CSV_SINK, **options).csv(path)
    return path


# The reader takes an empty field for null, and a quoted one for an empty text.
_AS_READ = "SELECT case_id, subject_id, label, age, recording_index FROM manifest"


@add("s01_csv_with_text_ids", _AS_READ)
def _(t: Tables) -> DataFrame:
    return S.read_csv(t.spark, _written(t, "csv"), _TYPES, multi_line=False)


@add("s02_csv_as_text", "SELECT coalesce(case_id, '') AS case_id, coalesce(subject_id, '') AS subject_id, coalesce(label, '') AS label, coalesce(CAST(recording_index AS VARCHAR), '') AS recording_index FROM manifest")
def _(t: Tables) -> DataFrame:
    return S.read_csv_text(t.spark, _written(t, "csv"), _MANIFEST).drop("age")


@add("s03_csv_some_columns", "SELECT age, case_id FROM manifest")
def _(t: Tables) -> DataFrame:
    return S.read_csv(t.spark, _written(t, "csv"), _TYPES, columns=["age", "case_id", "absent"])


@add("s04_csv_columns_by_test", "SELECT case_id, subject_id FROM manifest")
def _(t: Tables) -> DataFrame:
    return S.read_csv(t.spark, _written(t, "csv"), _TYPES, columns=lambda c: c.endswith("_id"))


@add("s05_csv_semicolons", _AS_READ)
def _(t: Tables) -> DataFrame:
    return S.read_csv(t.spark, _written(t, "csv", sep=";"), _TYPES, sep=";")


@add("s07_json_folder", "SELECT r_regionkey, r_name FROM region")
def _(t: Tables) -> DataFrame:
    """A file an object: five regions, each written alone."""
    path = _path(t, "json")
    t.region.select("r_regionkey", "r_name").repartitionByRange(5, "r_regionkey").write.json(path)
    return S.read_json_folder(t.spark, path, "r_regionkey long, r_name string").select(F.col("r_regionkey"), "r_name")


@add("s08_json_lines", "SELECT line_no, exporter, payload, CAST(NULL AS VARCHAR) AS _bad FROM workspace_lines")
def _(t: Tables) -> DataFrame:
    """Payloads of every shape, line breaks and quotes among them, inside JSON."""
    path = _path(t, "jsonl")
    S.write_json(t.workspace_lines.select("line_no", "exporter", "payload"), path)
    return S.read_json_lines(t.spark, path, "line_no long, exporter string, payload string")


@add("s13_segmentation", "SELECT user_id, count(*) AS n, round(sum((e - b) / 1000.0), 6) AS seconds FROM (SELECT user_id, CAST(event_id % 977 AS DOUBLE) AS b, CAST(event_id % 977 + value AS DOUBLE) AS e, event_type FROM events) WHERE event_type = 'click' AND e > b GROUP BY 1")
def _(t: Tables) -> DataFrame:
    """Intervals of one speaker from text in milliseconds."""
    rows = t.events.select("user_id", F.when(F.col("event_type") == "click", "PAR").otherwise("INV").alias("speaker"), (F.col("event_id") % 977).cast("string").alias("b"), ((F.col("event_id") % 977) + F.col("value")).cast("string").alias("e"))
    i = S.segmentation_intervals(rows, "user_id", "speaker", "b", "e").select("user_id", F.explode("intervals").alias("i"))
    return i.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum(F.col("i.end") - F.col("i.start")), 6).alias("seconds"))


_LABELS = {"HC": "control", "MCI": "mild", "AD": "severe"}
#: Datasets of the manifest, and what the folder of one of them says of files without a label of their own.
_ADAPTERS = {
    name: A.Adapter(subject=r"([A-Za-z0-9_]+)\.[a-z0-9]+$", folders={name.lower(): "mild"} if name == "TIDE_MULTI" else {}, labels=_LABELS, language="en" if name == "HARBOR_PIC" else None)
    for name in ("HARBOR_PIC", "LANTERN_INT", "ORCHARD_TASK", "TIDE_MULTI", "MEADOW_PROG", "QUARRY_PUB")
}
_NAMED = r"nullif(regexp_extract(audio_path, '([A-Za-z0-9_]+)\.[a-z0-9]+$', 1), '') AS subject_id"
_MAPPED = "CASE label WHEN 'HC' THEN 'control' WHEN 'MCI' THEN 'mild' WHEN 'AD' THEN 'severe' ELSE CASE WHEN contains(audio_path, '/tide_multi/') THEN 'mild' END END AS label"


@add("s16_manifest_of_datasets", f"SELECT dataset_id, audio_path AS path, {_NAMED}, {_MAPPED}, CASE WHEN dataset_id = 'HARBOR_PIC' THEN 'en' END AS language FROM manifest WHERE dataset_id IS NOT NULL")
def _(t: Tables) -> DataFrame:
    """One manifest of all datasets, each read by its adapter."""
    files = t.manifest.where(F.col("dataset_id").isNotNull()).select("dataset_id", F.col("audio_path").alias("path"), "label")
    return A.build_manifest(files, _ADAPTERS, label="label").drop("split")


@add("s17_names_from_paths", f"SELECT dataset_id, {_NAMED}, {_MAPPED}, count(*) AS n FROM manifest WHERE dataset_id = 'TIDE_MULTI' GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    """Identity from the file's name; the label from a map of the dataset's own names, else from the folder."""
    files = t.manifest.where("dataset_id = 'TIDE_MULTI'").select(F.col("audio_path").alias("path"), F.col("label").alias("said"))
    return A.manifest_of(files, _ADAPTERS["TIDE_MULTI"], "TIDE_MULTI", label="said").groupBy("dataset_id", "subject_id", "label").agg(F.count("*").alias("n"))


@add("k01_sorted_csv", "SELECT case_id, age FROM manifest")
def _(t: Tables) -> DataFrame:
    path = _path(t, "sorted")
    S.write_sorted(t.manifest.select("case_id", "age"), path, ["case_id"], "csv")
    return S.read_csv(t.spark, path, "case_id string, age double")


@add("k02_json_without_nan", "SELECT subject_id, metric_id, CASE WHEN isfinite(value) THEN value END AS value, count(*) AS n FROM metric_evidence GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    """NaN and infinite values come back as null."""
    path = _path(t, "json")
    S.write_json(t.metric_evidence.select("subject_id", "metric_id", "value"), path)
    return t.spark.read.schema("subject_id string, metric_id string, value double").json(path).groupBy("subject_id", "metric_id", "value").agg(F.count("*").alias("n"))


@add("k04_resumed_log", "SELECT vec_id, label FROM embeddings")
def _(t: Tables) -> DataFrame:
    """A log that a run stopped half way is appended to by the next, without repeats."""
    path = _path(t, "log")
    e = t.embeddings.select("vec_id", "label")
    S.append_new(e.where("vec_id % 3 <> 0"), path, "vec_id")
    S.append_new(e, path, "vec_id")
    return t.spark.read.schema(e.schema).json(path)


@add("k06_latest_run", "SELECT doc_id, n_chars + 2 AS n_chars FROM documents")
def _(t: Tables) -> DataFrame:
    """Two snapshots, of which the pointer names the second."""
    root = _path(t, "runs")
    for i in (1, 2):
        S.publish(t.documents.select("doc_id", (F.col("n_chars") + i).alias("n_chars")), root, f"r{i}")
        S.point_to(t.spark, root, f"r{i}")
    return t.spark.read.parquet(f"{root}/run={S.latest(t.spark, root)}")


@add("g22_inventory", "SELECT run, 1 AS tables, n AS rows FROM (SELECT 'r1' AS run, count(*) AS n FROM region UNION ALL SELECT 'r2', count(*) FROM nation)")
def _(t: Tables) -> DataFrame:
    """The runs under a folder, by what lies there: their tables and rows."""
    root = _path(t, "experiments")
    S.publish(t.region.select("r_name"), root, "r1")
    S.publish(t.nation.select(F.col("n_name").alias("r_name")), root, "r2")
    found = S.inventory(t.spark, root, "*.parquet").where("bytes > 0").select(F.regexp_extract("path", r"run=([^/]+)/", 1).alias("run"), F.regexp_replace("path", "/[^/]*$", "").alias("table"))
    whole = found.groupBy("run").agg(F.count_distinct("table").alias("tables"))
    rows = t.spark.read.parquet(root).groupBy("run").agg(F.count("*").alias("rows"))
    return whole.join(rows, "run")
