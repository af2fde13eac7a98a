"""Files at the edge: delimited and JSON text with stated schemas, archives, transcripts, inventories and sinks."""

from __future__ import annotations

import hashlib
import io
import json
import tarfile
import wave
import zipfile
from collections.abc import Callable, Iterator, Sequence
from pathlib import PurePosixPath

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.functions import parse
from tallyloom.session import materialise

#: Largest archive that is unpacked in one task.
MAX_ARCHIVE_BYTES = 512 * 2**20


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType, sep: str = ",", columns: Sequence[str] | Callable[[str], bool] | None = None, multi_line: bool = True) -> DataFrame:
    """Delimited text with a header and a stated schema, so that ids stay text and nothing is inferred.

    columns: those wanted, of which absent ones are left out, or a test of a name;
    the reader parses no others. Rows that do not fit the schema have nulls in the
    fields that don't. A file whose fields hold no line breaks should be read with
    ``multi_line=False``: then its parts are read by several tasks.
    """
    df = spark.read.schema(schema).option("header", True).option("sep", sep).option("multiLine", multi_line).option("escape", '"').csv(path)
    if columns is None:
        return df
    return df.select([c for c in df.columns if columns(c)] if callable(columns) else [c for c in columns if c in df.columns])


def read_csv_text(spark: SparkSession, path: str, columns: Sequence[str], sep: str = ",") -> DataFrame:
    """Delimited text with every column as text; an empty field is an empty text and not null."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    df = spark.read.schema(schema).option("header", True).option("sep", sep).option("emptyValue", "").option("nullValue", "\x00").option("multiLine", True).option("escape", '"').csv(path)
    return df.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in columns])


def read_json_lines(spark: SparkSession, path: str, schema: str | T.StructType, bad: str = "_bad") -> DataFrame:
    """One JSON object a line; lines that are none are kept as text in the column ``bad``."""
    full = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return spark.read.schema(full.add(bad, T.StringType())).option("columnNameOfCorruptRecord", bad).json(path)


def read_json_folder(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """One JSON object a file, with ``source_file``."""
    return spark.read.schema(schema).option("multiLine", True).json(f"{path}/*.json").withColumn("source_file", F.element_at(F.split(F.input_file_name(), "/"), -1))


def inventory(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, bytes and modified of every file under a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def safe_member(name: str) -> bool:
    """Whether an archive member stays inside the folder it is unpacked to."""
    p = PurePosixPath(name.replace("\\", "/"))
    return bool(name) and not p.is_absolute() and ".." not in p.parts and ":" not in p.parts[0]


def archive_members(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """archive, member and text of every file in the tar, tar.gz and zip archives of a folder.

    Members whose name leaves the archive's folder stop the query. Archives are
    unpacked in memory, one at a time in a task, up to ``MAX_ARCHIVE_BYTES`` each.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                if len(content) > MAX_ARCHIVE_BYTES:
                    raise ValueError(f"archive too large: {name}")
                rows = []
                for member, raw in _members(name, bytes(content)):
                    if not safe_member(member):
                        raise ValueError(f"unsafe path in {name}: {member}")
                    if member.endswith(suffix):
                        rows.append((name, member, raw.decode("utf-8", "replace")))
                yield pd.DataFrame(rows, columns=["archive", "member", "text"])

    files = spark.read.format("binaryFile").load(path).where(F.col("path").rlike(r"\.(zip|tar|tar\.gz|tgz)$")).select("path", "content")
    return files.mapInPandas(run, "archive string, member string, text string")


def _members(name: str, content: bytes) -> Iterator[tuple[str, bytes]]:
    if name.endswith(".zip"):
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            yield from ((i.filename, z.read(i)) for i in z.infolist() if not i.is_dir())
    else:
        with tarfile.open(fileobj=io.BytesIO(content)) as t:
            yield from ((m.name, t.extractfile(m).read()) for m in t if m.isfile())


def chat_utterances(files: DataFrame, name: str = "name", text: str = "text") -> DataFrame:
    """name, line, speaker, text, start_sec and end_sec of the speaker tiers of CHAT files.

    Lines that begin with white space go on with the line above. All in the JVM: a
    file's lines are one array, so nothing is shuffled.
    """
    joined = F.regexp_replace(text, r"\r?\n[ \t]+", " ")
    lines = files.select(F.col(name), F.posexplode(F.split(joined, r"\r?\n")).alias("line", "raw")).where(F.col("raw").rlike(r"^\*[^:]{1,12}:"))
    ms = lambda i: F.regexp_extract("raw", "\\x15(\\d+)_(\\d+)\\x15", i).try_cast("double") / 1000
    body = F.trim(F.regexp_replace(F.regexp_replace("raw", r"^\*[^:]{1,12}:\s*", ""), "\\x15[^\\x15]*\\x15", ""))
    return lines.select(name, "line", F.upper(F.regexp_extract("raw", r"^\*([^:]{1,12}):", 1)).alias("speaker"), body.alias("text"), ms(1).alias("start_sec"), ms(2).alias("end_sec"))


def chat_intervals(utterances: DataFrame, name: str = "name", speaker: str = "PAR") -> DataFrame:
    """name and the ordered intervals of one speaker's timed utterances."""
    timed = utterances.where((F.col("speaker") == speaker) & F.col("start_sec").isNotNull() & (F.col("end_sec") > F.col("start_sec")))
    return timed.groupBy(name).agg(F.array_sort(F.collect_list(F.struct(F.col("start_sec").alias("start"), F.col("end_sec").alias("end")))).alias("intervals"))


def segmentation_intervals(rows: DataFrame, case: str, speaker: str, begin_ms: str, end_ms: str, wanted: str = "PAR") -> DataFrame:
    """case and ordered intervals in seconds from a segmentation in milliseconds; other speakers and torn numbers are left out."""
    s, e = parse.number(F.col(begin_ms).cast("string")) / 1000, parse.number(F.col(end_ms).cast("string")) / 1000
    kept = rows.where(F.col(speaker) == wanted).select(F.col(case), F.struct(s.alias("start"), e.alias("end")).alias("i")).where(F.col("i.end") > F.col("i.start"))
    return kept.groupBy(case).agg(F.array_sort(F.collect_list("i")).alias("intervals"))


def read_registry_text(text: str) -> dict:
    """A registry in JSON, or in the part of YAML that registries use: nested keys, lists of values and of keyed entries, scalars."""
    try:
        return json.loads(text)
    except ValueError:
        rows = [(len(line) - len(line.lstrip()), line.strip()) for line in text.splitlines() if line.strip() and not line.lstrip().startswith("#")]
        value, rest = _block(rows, 0)
        if rest != len(rows):
            raise ValueError(f"cannot read: {rows[rest][1]}") from None
        return value


def _scalar(s: str):
    s = s.strip()
    if s[:1] == "[" and s[-1:] == "]":
        return [_scalar(x) for x in s[1:-1].split(",") if x.strip()]
    if s[:1] in "\"'" and s[-1:] == s[:1] and len(s) > 1:
        return s[1:-1]
    if s in ("true", "false"):
        return s == "true"
    if s in ("", "null", "~"):
        return None
    try:
        return int(s)
    except ValueError:
        try:
            return float(s)
        except ValueError:
            return s


def _block(rows: list[tuple[int, str]], at: int):
    """The mapping or list that starts at a row, and the row behind it."""
    indent, first = rows[at]
    is_list = first.startswith("- ") or first == "-"
    out: list | dict = [] if is_list else {}
    while at < len(rows) and rows[at][0] == indent and (rows[at][1].startswith("-") == is_list):
        line = rows[at][1]
        if is_list:
            item = line[1:].strip()
            if ":" in item and item[:1] not in "\"'[{":
                rows[at] = (indent + 2, item)
                value, at = _block(rows, at)
                out.append(value)
            else:
                out.append(_scalar(item))
                at += 1
            continue
        key, _, value = line.partition(":")
        at += 1
        if value.strip():
            out[key.strip()] = _scalar(value)
        elif at < len(rows) and (rows[at][0] > indent or (rows[at][0] == indent and rows[at][1].startswith("- "))):
            out[key.strip()], at = _block(rows, at)
        else:
            out[key.strip()] = None
    return out, at


def overlay(metrics: DataFrame, profile: DataFrame) -> DataFrame:
    """A registry under a channel's profile: states it does not enable fall out, reliability is multiplied, confounds are united.

    metrics: metric_id, state_id, reliability, confounds. profile: state_id,
    enabled, factor, confounds. A state the profile lacks stays as it is.
    """
    p = profile.select("state_id", "enabled", "factor", F.col("confounds").alias("_more"))
    joined = metrics.join(p, "state_id", "left").where(F.coalesce("enabled", F.lit(True)))
    none = F.array().cast("array<string>")
    united = F.array_sort(F.array_union(F.coalesce("confounds", none), F.coalesce("_more", none)))
    return joined.select("metric_id", "state_id", (F.col("reliability") * F.coalesce("factor", F.lit(1.0))).alias("reliability"), united.alias("confounds"))


#: Delimited text as it stands: white space kept, empty text told from null.
CSV_SINK = {"header": "true", "escape": '"', "emptyValue": '""', "nullValue": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def write_sorted(df: DataFrame, path: str, by: Sequence[str], kind: str = "parquet") -> None:
    """Files in one global order, by range partitions; committed as a whole by Spark's protocol."""
    writer = df.orderBy(*by).write.mode("overwrite")
    (writer.options(**CSV_SINK) if kind == "csv" else writer).format(kind).save(path)


def append_new(df: DataFrame, path: str, key: str) -> DataFrame:
    """Append the rows whose key the log at ``path`` does not hold yet, and return them: a stopped run goes on where it ended."""
    spark = df.sparkSession
    try:
        done = spark.read.schema(df.schema).json(path).select(key)
        new = df.join(done, key, "left_anti")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        new = df
    # Written aside first: the result must not change once the log has grown.
    new = materialise(new.select(df.columns), "append")
    new.write.mode("append").json(path)
    return new


def publish(df: DataFrame, root: str, run_id: str) -> str:
    """An immutable snapshot under its run id; writing one that exists is an error."""
    path = f"{root.rstrip('/')}/run={run_id}"
    df.write.mode("errorifexists").parquet(path)
    return path


def latest(spark: SparkSession, root: str) -> str | None:
    """The run id that the pointer names; None before the first."""
    path = f"{root.rstrip('/')}/latest"
    try:
        return spark.read.text(path).first().value
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def point_to(spark: SparkSession, root: str, run_id: str) -> None:
    """Make a published run the latest: the pointer is written aside and renamed, so a reader sees the old run or the new one."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    root = root.rstrip("/")
    conf = spark._jsc.hadoopConfiguration()
    fs = fs_path(root).getFileSystem(conf)
    if not fs.exists(fs_path(f"{root}/run={run_id}/_SUCCESS")):
        raise FileNotFoundError(f"no whole run {run_id}")
    aside = f"{root}/.latest-{fingerprint(run_id)[:12]}"
    spark.createDataFrame([(run_id,)], "value string").coalesce(1).write.mode("overwrite").text(aside)
    fs.delete(fs_path(f"{root}/latest"), True)
    if not fs.rename(fs_path(aside), fs_path(f"{root}/latest")):
        raise RuntimeError("the pointer was not renamed")


def plain_numbers(df: DataFrame) -> DataFrame:
    """The table with NaN and infinite numbers as null, at the top level and in arrays of numbers, as JSON has no sign for them."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = parse.finite(c)
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, (T.DoubleType, T.FloatType)):
            c = F.transform(c, parse.finite)
        out.append(c.alias(f.name))
    return df.select(*out)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object a line, nulls written, numbers that JSON lacks as null."""
    plain_numbers(df).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_arrays(spark: SparkSession, path: str) -> DataFrame:
    """source_file, name and rows of every two- or one-dimensional array in NPZ files: ragged sequences of vectors, each file in one task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for file, content in zip(batch["path"], batch["content"], strict=True):
                with np.load(io.BytesIO(content), allow_pickle=False) as held:
                    rows += [(file.rsplit("/", 1)[-1], k, np.atleast_2d(held[k]).astype(np.float32).tolist()) for k in held.files]
            yield pd.DataFrame(rows, columns=["source_file", "name", "rows"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").option("recursiveFileLookup", True).load(path)
    return files.select("path", "content").mapInPandas(run, "source_file string, name string, rows array<array<float>>")


def read_waves(spark: SparkSession, path: str, rate: int = 16_000) -> DataFrame:
    """source_file, seconds and samples of PCM WAV files as one channel at ``rate``; each file in one task.

    Channels are averaged, rates changed by linear interpolation, values scaled to
    -1..1. Files that are no PCM WAV have null samples.
    """

    def samples(content: bytes) -> list[float] | None:
        try:
            with wave.open(io.BytesIO(content)) as w:
                width, channels, own, n = w.getsampwidth(), w.getnchannels(), w.getframerate(), w.getnframes()
                raw = w.readframes(n)
        except (wave.Error, EOFError):
            return None
        if width == 1:
            x = np.frombuffer(raw, np.uint8).astype(np.float64) / 128 - 1
        elif width == 3:
            b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
            x = ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) ^ 0x800000) / 2.0**23 - 1
        else:
            x = np.frombuffer(raw, f"<i{width}").astype(np.float64) / 2.0 ** (8 * width - 1)
        x = x.reshape(-1, channels).mean(axis=1)
        if own != rate and len(x):
            x = np.interp(np.arange(int(len(x) * rate / own)) * own / rate, np.arange(len(x)), x)
        return x.astype(np.float32).tolist()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [samples(c) for c in batch["content"]]
            yield pd.DataFrame({"source_file": [p.rsplit("/", 1)[-1] for p in batch["path"]], "seconds": [None if x is None else len(x) / rate for x in found], "samples": found})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", True).load(path)
    return files.select("path", "content").mapInPandas(run, "source_file string, seconds double, samples array<float>")


def frozen(spark: SparkSession, root: str, required: Sequence[str]) -> DataFrame:
    """name, bytes and sha256 of the required files of a frozen run; raises if one is missing. Contents are hashed where they lie."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    found = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256")).where(F.col("name").isin(list(required)))
    names = {r.name for r in found.select("name").distinct().collect()}
    if missing := sorted(set(required) - names):
        raise FileNotFoundError(f"frozen files missing: {missing}")
    return found


def fingerprint(*parts: str) -> str:
    """SHA-256 over texts that decide a stage's result, each with its length, so that parts never run together."""
    h = hashlib.sha256()
    for p in parts:
        raw = p.encode()
        h.update(f"{len(raw)}:".encode() + raw)
    return h.hexdigest()


def stage(spark: SparkSession, root: str, name: str, key: str, build) -> DataFrame:
    """The stage's table for a fingerprint: read if it was written before, else built and written."""
    path = f"{root.rstrip('/')}/{name}/{key}"
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def byte_range(header: str | None, size: int) -> tuple[int, int] | None:
    """First and last byte of an HTTP range header; None without one; raises for a range outside the file."""
    if not header:
        return None
    unit, _, spec = header.partition("=")
    first, dash, last = spec.partition("-")
    if unit.strip() != "bytes" or not dash or "," in spec or not (first.strip() or last.strip()):
        raise ValueError("no single byte range")
    if not first.strip():
        start, end = max(0, size - int(last)), size - 1
    else:
        start, end = int(first), min(size - 1, int(last)) if last.strip() else size - 1
    if start > end or start >= size:
        raise ValueError("range outside the file")
    return start, end
