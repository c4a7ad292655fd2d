"""Files in and out."""

import hashlib
import json
import threading
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lanespan.functions import exprs
from lanespan.operators import audit, splitting
from lanespan.sources import files, sinks, versions


@pytest.fixture
def folder(tmp_path):
    for group in ("a", "b"):
        for kind, names in (("img", ["1.png", "2.JPG", "note.txt"]), ("msk", ["1_mask.png", "2.bmp", "x.png"])):
            place = tmp_path / group / kind
            place.mkdir(parents=True)
            for name in names:
                (place / name).write_bytes(b"data" + name.encode())
    return tmp_path


def test_groups_to_samples(spark, folder):
    doc = {"groups": [{"group": g, "images_dir": f"./{g}/img", "masks_dir": f"{g}/../{g}/msk"} for g in "ab"]}
    (folder / "groups.json").write_text("﻿" + json.dumps(doc), encoding="utf-8")
    groups = files.scan_groups(spark, str(folder / "groups.json"))
    assert all(r.images_dir.endswith(f"/{r.group}/img") and ".." not in r.masks_dir for r in groups.collect())
    pairs = audit.pair_images_masks(files.discover_files(spark, groups))
    assert sorted((r.group, r.stem, r.fault) for r in pairs.collect()) == [
        (g, s, f) for g in "ab" for s, f in (("1", None), ("2", None), ("x", "orphan mask"))
    ]
    assert files.scan_image_files(spark, str(folder / "a/img")).count() == 2
    (folder / "empty.json").write_text('{"groups": []}')
    with pytest.raises(ValueError):
        files.scan_groups(spark, str(folder / "empty.json"))


def document(**change):
    sample = lambda g, i: {"image": f"{g}/{i}.png", "mask": f"/abs/{g}{i}.png", "group": g}
    doc = {"version": 1, "splits": {"train": [sample("a", 0), sample("a", 1)], "validation": [sample("b", 0)], "test": [sample("c", 0)]}}
    doc.update(change)
    return doc


def test_manifest_scan(spark, tmp_path):
    path = tmp_path / "m.json"
    path.write_text("﻿" + json.dumps(document()), encoding="utf-8")
    rows = files.scan_manifest(spark, str(path)).orderBy("split", "pos").collect()
    assert [(r.split, r.pos, r.group) for r in rows] == [("test", 0, "c"), ("train", 0, "a"), ("train", 1, "a"), ("validation", 0, "b")]
    assert rows[1].image.endswith(f"{tmp_path}/a/0.png") and rows[1].mask == "/abs/a0.png"
    for bad in (document(version=2), document(splits={"train": []}), document(splits={**document()["splits"], "extra": []})):
        path.write_text(json.dumps(bad))
        with pytest.raises(ValueError, match="version 1"):
            files.scan_manifest(spark, str(path))
    for bad in ({"image": "x", "mask": "y", "group": " "}, {"image": " ", "mask": "y", "group": "g"}, {"image": "x", "mask": "", "group": "g"}):
        path.write_text(json.dumps(document(splits={**document()["splits"], "test": [bad]})))
        with pytest.raises(Exception, match="non-empty group"):
            files.scan_manifest(spark, str(path)).collect()


def test_manifest_is_published_only_after_its_audit(spark, tmp_path):
    rows = [(f"g{i % 6}", f"i{i}", f"m{i}", f"h{i}", "k", i % 2 == 0) for i in range(24)]
    df = spark.createDataFrame(rows, "group string, image string, mask string, image_hash string, mask_hash string, negative boolean")
    split = splitting.apply_split(df, splitting.assign_groups(df))
    out = str(tmp_path / "manifest")
    with pytest.raises(ValueError, match="no negative"):
        sinks.write_manifest(split.withColumn("negative", F.lit(False)), out)
    assert not (tmp_path / "manifest").exists()
    # Odd groups have no road-free frame at all, so only the relaxed audit may pass everywhere.
    assert sinks.write_manifest(split, out, require_negatives=False).count() == 24
    with pytest.raises(FileExistsError):
        sinks.write_manifest(split, out, require_negatives=False)
    back = files.scan_manifest(spark, out).collect()
    assert sorted((r.split, r.group, r.image, r.mask) for r in back) == sorted((r.split, r.group, r.image, r.mask) for r in split.collect())
    for name in exprs.SPLITS:
        places = sorted(r.pos for r in back if r.split == name)
        assert places == list(range(len(places)))


def test_manifest_versions(spark, tmp_path, monkeypatch):
    def samples(n):
        rows = [(f"g{i % 6}", f"i{i}", f"m{i}", f"h{i}", "k", i % 2 == 0) for i in range(n)]
        df = spark.createDataFrame(rows, "group string, image string, mask string, image_hash string, mask_hash string, negative boolean")
        return splitting.apply_split(df, splitting.assign_groups(df))

    out = str(tmp_path / "manifest")
    write = lambda n, replaces: sinks.write_manifest(samples(n), out, False, replaces)
    count = lambda: files.scan_manifest(spark, out).count()
    write(24, 0)
    assert write(30, 1).count() == 30 and count() == 30
    with pytest.raises(FileExistsError):
        write(36, 1)

    # Both writers have seen version 2; whichever publishes first wins, and the other's rows are removed.
    both, publish = threading.Barrier(2), versions.publish

    def together(*args):
        both.wait(120)
        publish(*args)

    monkeypatch.setattr(versions, "publish", together)
    won, lost = [], []

    def writer(n):
        try:
            write(n, 2)
            won.append(n)
        except FileExistsError:
            lost.append(n)

    threads = [threading.Thread(target=writer, args=(n,)) for n in (42, 48)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == len(lost) == 1 and count() == won[0]
    assert len(list((tmp_path / "manifest.versions").iterdir())) == 3

    def crash(*args):
        raise OSError("lost")

    monkeypatch.setattr(versions, "publish", crash)
    with pytest.raises(OSError, match="lost"):
        write(54, 3)
    assert count() == won[0]
    monkeypatch.setattr(versions, "publish", publish)
    write(54, 3)
    assert count() == 54 and versions.latest(spark, out).version == 4


def test_one_of_many_writers_puts_a_file(spark, tmp_path):
    path = str(tmp_path / "log" / "1.json")
    with ThreadPoolExecutor(16) as pool:
        got = list(pool.map(lambda k: versions.put_if_absent(spark, path, str(k)), range(64)))
    assert sum(got) == 1 and Path(path).read_text() == str(got.index(True))
    assert [p.name for p in Path(path).parent.iterdir() if not p.name.endswith(".crc")] == ["1.json"]


def test_report_refuses_nan(spark, tmp_path):
    df = spark.createDataFrame([(1.0, None)], "a double, b double")
    sinks.write_report(df, str(tmp_path / "ok"))
    assert spark.read.json(str(tmp_path / "ok")).first().a == 1.0
    with pytest.raises(Exception, match="not finite"):
        sinks.write_report(df.withColumn("b", F.lit(float("nan"))), str(tmp_path / "bad"))
    deep = F.array(F.struct(F.create_map(F.lit("k"), F.lit(float("inf"))).alias("m")))
    with pytest.raises(Exception, match="not finite"):
        sinks.write_report(df.withColumn("b", deep), str(tmp_path / "deep"))
    fine = F.array(F.struct(F.create_map(F.lit("k"), F.lit(2.0)).alias("m")))
    sinks.write_report(df.withColumn("b", fine), str(tmp_path / "fine"))
    assert spark.read.json(str(tmp_path / "fine")).first().b[0].m.k == 2.0
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.write_report(df, str(tmp_path / "ok"))


def test_artifacts_and_their_sidecars(spark, tmp_path):
    meta = {"architecture": "lite_road_net", "input_width": 256, "input_height": 144, "training_groups": ["a"]}
    for name, digest in (("good", None), ("wrong", "0" * 64), ("bare", None), ("plain", None)):
        content = name.encode()
        (tmp_path / f"{name}.onnx").write_bytes(content)
        if name != "bare":
            record = dict(meta)
            if name != "plain":
                record["model_sha256"] = digest or hashlib.sha256(content).hexdigest()
            (tmp_path / f"{name}.onnx.json").write_text(json.dumps(record, indent=2))
    rows = {r.path.rsplit("/", 1)[-1]: r for r in files.scan_artifacts(spark, str(tmp_path)).collect()}
    assert {k: r.fault for k, r in rows.items()} == {
        "good.onnx": None,
        "wrong.onnx": "digest mismatch",
        "bare.onnx": "missing sidecar",
        "plain.onnx": None,
    }
    assert rows["good.onnx"].training_groups == ["a"] and rows["good.onnx"].length == 4


def test_digest_of_a_file_that_no_cell_could_hold(spark, tmp_path):
    size, tail = (1 << 31) + 5, b"end"
    with open(tmp_path / "big.onnx", "wb") as file:
        file.seek(size)
        file.write(tail)
    (tmp_path / "a b.onnx").write_bytes(b"x")
    want, zeros = hashlib.sha256(), bytes(1 << 20)
    for _ in range(size >> 20):
        want.update(zeros)
    want.update(bytes(size & ((1 << 20) - 1)) + tail)
    rows = {r.path.rsplit("/", 1)[-1]: r for r in files.scan_artifacts(spark, str(tmp_path)).collect()}
    assert (rows["big.onnx"].length, rows["big.onnx"].actual_sha256) == (size + 3, want.hexdigest())
    assert rows["a b.onnx"].actual_sha256 == hashlib.sha256(b"x").hexdigest()


def test_frame_extraction(spark):
    df = spark.range(25).select(F.lit("trip_1").alias("group"), (F.col("id") * 100000).alias("frame_idx"))
    out = files.extract_every_n(df, 1000000).orderBy("frame_idx").collect()
    assert [r.name for r in out] == ["trip_1_frame_000000", "trip_1_frame_1000000", "trip_1_frame_2000000"]
    ledger = files.extraction_ledger(df, 1000000).first()
    assert (ledger.frames_decoded, ledger.frames_saved) == (25, 3)
    with pytest.raises(ValueError, match="already"):
        files.extract_every_n(df, 10, files.extraction_ledger(df, 10))
    with pytest.raises(Exception, match="unusable"):
        files.extract_every_n(df.withColumn("group", F.lit("a/b")), 10).collect()
    with pytest.raises(ValueError):
        files.extract_every_n(df, 0)
