"""Readers and sinks on temporary files."""

import io
import json
import tarfile
import zipfile

import pytest

from tallyloom.sources import files as S


def test_csv_keeps_ids_and_empty_text(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('subject_id,value,extra\n007,1.5,x\n008,bad,"a,b"\n009,,\n')
    df = S.read_csv(spark, str(p), "subject_id string, value double, extra string", columns=["subject_id", "value", "absent"])
    assert df.columns == ["subject_id", "value"] and [tuple(r) for r in df.collect()] == [("007", 1.5), ("008", None), ("009", None)]
    t = S.read_csv_text(spark, str(p), ["subject_id", "value", "extra"]).collect()
    assert [r.value for r in t] == ["1.5", "bad", ""] and t[2].extra == ""
    q = tmp_path / "b.csv"
    q.write_text("a;b\n1;2\n")
    assert tuple(S.read_csv(spark, str(q), "a int, b int", sep=";").first()) == (1, 2)


def test_json(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"a": 1}\n{"a": 2, "b"\n{"a": null}\n')
    got = S.read_json_lines(spark, str(p), "a int").collect()
    assert [r.a for r in got] == [1, None, None] and got[1]._bad.startswith('{"a": 2')
    d = tmp_path / "many"
    d.mkdir()
    (d / "one.json").write_text('{\n "a": 5\n}')
    assert tuple(S.read_json_folder(spark, str(d), "a int").first()) == (5, "one.json")
    assert S.inventory(spark, str(d)).first().bytes == 11


def test_archives_and_unsafe_paths(spark, tmp_path):
    raw = b"a,b\n1,2\n"
    with tarfile.open(tmp_path / "t.tar.gz", "w:gz") as t:
        i = tarfile.TarInfo("in/x.csv")
        i.size = len(raw)
        t.addfile(i, io.BytesIO(raw))
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("y.csv", raw)
        z.writestr("y.txt", "no")
    got = sorted(r.member for r in S.archive_members(spark, str(tmp_path), ".csv").collect())
    assert got == ["in/x.csv", "y.csv"]
    with zipfile.ZipFile(tmp_path / "bad.zip", "w") as z:
        z.writestr("../out.csv", raw)
    with pytest.raises(Exception, match="unsafe path"):
        S.archive_members(spark, str(tmp_path)).collect()
    assert [S.safe_member(n) for n in ("a/b", "/a", "a/../../b", "C:/x", "")] == [True, False, False, False, False]


def test_chat(spark):
    text = "@Begin\n*INV:\tHow\n\tare you? \x150_500\x15\n%com:\tno\n*PAR:\tFine. \x15600_1500\x15\n*PAR:\tYes.\n@End"
    u = S.chat_utterances(spark.createDataFrame([("f", text)], "name string, text string"))
    assert [(r.speaker, r.text, r.start_sec) for r in u.collect()] == [("INV", "How are you?", 0.0), ("PAR", "Fine.", 0.6), ("PAR", "Yes.", None)]
    assert [tuple(i) for i in S.chat_intervals(u).first().intervals] == [(0.6, 1.5)]
    seg = spark.createDataFrame([("c", "PAR", "1000", "2500"), ("c", "INV", "0", "1"), ("c", "PAR", "x", "9")], "c string, s string, b string, e string")
    assert [tuple(i) for i in S.segmentation_intervals(seg, "c", "s", "b", "e").first().intervals] == [(1.0, 2.5)]


def test_registry_text_and_overlay(spark):
    text = "# states\nstates:\n  - id: S01\n    metrics: [a, b]\n    weights: [0.5, 1]\n  - id: S02\n    metrics: []\nname: x\nflag: true\nnested:\n  k: 'v'\n"
    got = S.read_registry_text(text)
    assert got == {"states": [{"id": "S01", "metrics": ["a", "b"], "weights": [0.5, 1]}, {"id": "S02", "metrics": []}], "name": "x", "flag": True, "nested": {"k": "v"}}
    assert S.read_registry_text(json.dumps(got)) == got
    m = spark.createDataFrame([("a", "S1", 0.8, ["q"]), ("b", "S2", 1.0, None), ("c", "S3", 1.0, [])], "metric_id string, state_id string, reliability double, confounds array<string>")
    p = spark.createDataFrame([("S1", True, 0.5, ["p"]), ("S2", False, 1.0, None)], "state_id string, enabled boolean, factor double, confounds array<string>")
    assert {r.metric_id: (r.reliability, r.confounds) for r in S.overlay(m, p).collect()} == {"a": (0.4, ["p", "q"]), "c": (1.0, [])}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b", 2), ("a", 1)], "k string, v int")
    S.write_sorted(df, f"{tmp_path}/s", ["k"], "csv")
    assert [r.k for r in spark.read.option("header", True).csv(f"{tmp_path}/s").collect()] == ["a", "b"]
    assert S.append_new(df, f"{tmp_path}/log", "k").count() == 2
    assert [r.k for r in S.append_new(df.union(spark.createDataFrame([("c", 3)], df.schema)), f"{tmp_path}/log", "k").collect()] == ["c"]
    assert spark.read.json(f"{tmp_path}/log").count() == 3
    path = S.publish(df, f"{tmp_path}/runs", "r1")
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        S.publish(df, f"{tmp_path}/runs", "r1")
    name = next(p.name for p in (tmp_path / "runs/run=r1").glob("*.parquet"))
    assert len(S.frozen(spark, path, [name]).first().sha256) == 64
    with pytest.raises(FileNotFoundError, match="nothing"):
        S.frozen(spark, path, ["nothing"])


def test_stage_runs_once(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    key = S.fingerprint("config", "code")
    assert S.stage(spark, str(tmp_path), "one", key, build).count() == S.stage(spark, str(tmp_path), "one", key, build).count() == 3
    assert len(calls) == 1 and S.fingerprint("ab", "c") != S.fingerprint("a", "bc")


def test_byte_ranges():
    assert [S.byte_range(h, 100) for h in (None, "bytes=0-9", "bytes=90-", "bytes=-5", "bytes=50-500")] == [None, (0, 9), (90, 99), (95, 99), (50, 99)]
    for bad in ("bytes=100-", "items=0-1", "bytes=1-2,3-4", "bytes=-", "bytes=9-3"):
        with pytest.raises(ValueError):
            S.byte_range(bad, 100)


def test_latest_pointer_and_plain_numbers(spark, tmp_path):
    root = f"{tmp_path}/runs"
    df = spark.createDataFrame([("a", float("nan"), [1.0, float("inf")]), ("b", 2.0, None)], "k string, v double, w array<double>")
    assert S.latest(spark, root) is None
    with pytest.raises(FileNotFoundError, match="no whole run"):
        S.point_to(spark, root, "r1")
    for run in ("r1", "r2"):
        S.publish(df, root, run)
        S.point_to(spark, root, run)
        assert S.latest(spark, root) == run
    S.write_json(df, f"{tmp_path}/j")
    lines = sorted(x for p in (tmp_path / "j").glob("*.json") for x in p.read_text().splitlines())
    assert [json.loads(x) for x in lines] == [{"k": "a", "v": None, "w": [1.0, None]}, {"k": "b", "v": 2.0, "w": None}]


def test_arrays_and_waves(spark, tmp_path):
    import wave

    import numpy as np

    np.savez(tmp_path / "e.npz", a=np.arange(6, dtype=np.float32).reshape(3, 2), b=np.array([1.5]))
    got = {r.name: r.rows for r in S.read_arrays(spark, str(tmp_path)).collect()}
    assert got == {"a": [[0.0, 1.0], [2.0, 3.0], [4.0, 5.0]], "b": [[1.5]]}
    for name, width, channels, raw in (("one", 2, 1, np.array([0, 16384, -32768], "<i2").tobytes()), ("two", 1, 2, bytes([128, 192, 0, 128])), ("three", 3, 1, b"\x00\x00\x40")):
        with wave.open(str(tmp_path / f"{name}.wav"), "wb") as w:
            w.setnchannels(channels)
            w.setsampwidth(width)
            w.setframerate(8000)
            w.writeframes(raw)
    (tmp_path / "torn.wav").write_bytes(b"RIFF")
    same = {r.source_file: r.samples for r in S.read_waves(spark, str(tmp_path), 8000).collect()}
    assert same == {"one.wav": [0.0, 0.5, -1.0], "two.wav": [0.25, -0.5], "three.wav": [0.5], "torn.wav": None}
    twice = {r.source_file: (r.seconds, r.samples) for r in S.read_waves(spark, str(tmp_path), 16000).collect()}
    assert twice["one.wav"] == (6 / 16000, [0.0, 0.25, 0.5, -0.25, -1.0, -1.0]) and twice["torn.wav"] == (None, None)


def test_adapters(spark):
    from tallyloom.sources.adapters import Adapter, build_manifest

    adapters = {"one": Adapter(r"/(s\d+)_", folders={"ad": "AD", "cn": "HC"}, split="/(train|test)/"), "two": Adapter(r"^(\w+)\.", labels={"p": "AD"}, language="de")}
    rows = [("one", "x/train/ad/s12_a.wav", None), ("one", "cn/odd.wav", "p"), ("two", "k7.wav", "p"), ("two", "ad/k8.wav", "zz"), ("one", None, None)]
    files = spark.createDataFrame(rows, "dataset_id string, path string, said string")
    got = {(r.path, r.subject_id, r.label, r.split, r.language) for r in build_manifest(files, adapters, label="said").collect()}
    assert got == {("x/train/ad/s12_a.wav", "s12", "AD", "train", None), ("cn/odd.wav", None, "HC", None, None), ("k7.wav", "k7", "AD", None, "de"), ("ad/k8.wav", None, None, None, "de"), (None, None, None, None, None)}
    with pytest.raises(Exception, match="no adapter for three"):
        build_manifest(spark.createDataFrame([("three", "a", "b")], files.schema), adapters).collect()
