"""Media operators, sources, sinks and recipes on small files."""

import io
import json
import struct
import wave
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql, queries
from foldwise.operators.impute import fill_na
from foldwise.operators.media import (
    first_segment, image_metadata, image_sizes, list_images, load_waveforms, mel_decibels, mel_filters,
    mel_spectrogram, resample, segments, size_ratio_warnings,
)
from foldwise.operators.split import kfold
from foldwise.plans.recipe import compose
from foldwise.sources.readers import (
    check_separate, csv_files, csv_headers, latest_run, load_inputs, read_csv, read_csv_directory, read_csv_glob,
    read_index_splits, read_manifest, resolve_latest, rows_of_split, run_history,
)
from foldwise.sources.writers import (
    read_fold, record_run, write_folds, write_predictions, write_statistics, write_table,
)
from tests.oracle import compare


def png(width, height, kind):
    """A minimal PNG: kind 0 grey, 2 RGB, 6 RGBA."""
    def chunk(tag, data):
        return struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data))

    line = b"\x00" + bytes(width * {0: 1, 2: 3, 6: 4}[kind])
    return (
        b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0))
        + chunk(b"IDAT", zlib.compress(line * height)) + chunk(b"IEND", b"")
    )


@pytest.fixture(scope="module")
def images(tmp_path_factory):
    root = tmp_path_factory.mktemp("images")
    for name, data in {
        "b.png": png(30, 20, 2), "a.png": png(5, 9, 0), "c.png": png(8, 8, 6), "bad.png": b"no image",
        "notes.txt": b"text",
    }.items():
        (root / name).write_bytes(data)
    return str(root)


def test_image_listing_and_metadata(spark, images):
    names = [r.path.rsplit("/", 1)[1] for r in list_images(spark, images).collect()]
    assert names == ["a.png", "b.png", "bad.png", "c.png"]
    paths = [(f"{images}/{n}",) for n in ("a.png", "b.png", "c.png", "bad.png", "gone.png")]
    found = image_metadata(spark.createDataFrame(paths, "path string"), "path", images)
    sizes = ("__image_width__", "__image_height__", "__image_channels__")
    shapes = {r["path"].rsplit("/", 1)[1]: tuple(r[s] for s in sizes) for r in found.collect()}
    assert shapes == {
        "a.png": (5, 9, 1), "b.png": (30, 20, 3), "c.png": (8, 8, 4), "bad.png": (0, 0, 0), "gone.png": (0, 0, 0)
    }


def bmp(width, height, bits, palette=b"", header=40, compression=0, masks=b""):
    if header == 12:
        info = struct.pack("<IHHHH", 12, width, height, 1, bits)
    else:
        info = struct.pack("<IiiHHIIiiII", header, width, height, 1, bits, compression, 0, 0, 0, len(palette) // 4, 0)
        info += masks + bytes(header - 40 - len(masks))
    return b"BM" + bytes(12) + info + palette


def tiff(order, width, height, samples, photometric, bits=8, extra=None):
    tags = [(256, width), (257, height), (258, bits), (262, photometric), (277, samples)]
    tags += [(338, extra)] if extra is not None else []
    lead = {"<": b"II*\0", ">": b"MM\0*"}[order] + struct.pack(order + "I", 8) + struct.pack(order + "H", len(tags))
    return lead + b"".join(struct.pack(order + "HHIHH", tag, 3, 1, value, 0) for tag, value in tags) + bytes(4)


def jpeg(width, height, parts, before=b"", frame=0xC2):
    sof = struct.pack(">BBHBHHB", 0xFF, frame, 8 + 3 * parts, 8, height, width, parts) + bytes(3 * parts)
    return b"\xff\xd8" + before + sof + b"\xff\xda"


def segment(marker, size):
    return bytes([0xFF, marker]) + struct.pack(">H", size + 2) + bytes(size)


def test_sizes_from_header_bytes(spark):
    grey = b"".join(bytes([i, i, i, 0]) for i in range(256))
    broken = bytearray(png(30, 20, 2))
    broken[17] ^= 1
    cases = {
        "png": (png(70_000, 1, 2)[:40], (70_000, 1, 3)),
        "broken png": (bytes(broken), (0, 0, 0)),
        "cut png": (png(30, 20, 2)[:32], (0, 0, 0)),
        "bmp": (bmp(640, 480, 24), (640, 480, 3)),
        "bmp from the top": (bmp(640, -480, 24), (640, 480, 3)),
        "old bmp": (bmp(5, 6, 24, header=12), (5, 6, 3)),
        "grey bmp": (bmp(5, 6, 8, grey), (5, 6, 1)),
        "palette bmp": (bmp(5, 6, 8, grey[::-1]), (5, 6, 3)),
        "bmp with alpha": (bmp(5, 6, 32, b"", 124, 3, struct.pack("<IIII", 255 << 16, 255 << 8, 255, 255 << 24)), (5, 6, 4)),
        "cut bmp": (bmp(640, 480, 24)[:24], (0, 0, 0)),
        "tiff": (tiff("<", 300, 200, 3, 2), (300, 200, 3)),
        "grey tiff": (tiff(">", 300, 200, 1, 1), (300, 200, 1)),
        "deep tiff": (tiff(">", 300, 200, 1, 1, 16), (300, 200, 3)),
        "tiff with alpha": (tiff("<", 300, 200, 4, 2, extra=2), (300, 200, 4)),
        "tiff with a pad": (tiff("<", 300, 200, 4, 2, extra=0), (300, 200, 3)),
        "cut tiff": (tiff("<", 300, 200, 3, 2)[:30], (0, 0, 0)),
        "wrong tiff": (b"II*\0" + b"\xff" * 12, (0, 0, 0)),
        "jpeg": (jpeg(800, 600, 3), (800, 600, 3)),
        "grey jpeg": (jpeg(9, 7, 1, segment(0xE0, 14) + segment(0xC4, 30) + b"\xff\xff" + segment(0xFE, 60_000), 0xC0), (9, 7, 1)),
        "long jpeg": (jpeg(9, 7, 4, segment(0xE1, 0) * 1000), (9, 7, 3)),
        "cut jpeg": (jpeg(9, 7, 3, segment(0xE0, 14))[:26], (0, 0, 0)),
        "jpeg that ends": (b"\xff\xd8" + segment(0xE0, 3) + b"\xff\xd9" + jpeg(9, 7, 3), (0, 0, 0)),
        "jpeg gone wrong": (b"\xff\xd8\xff\xe0\x00\x03\x00\x01" + jpeg(9, 7, 3), (0, 0, 0)),
        "huge numbers": (b"BM" + bytes(12) + struct.pack("<I", 40) + b"\xff" * 60, (0, 0, 0)),
        "text": (b"no image", (0, 0, 0)),
        "empty": (b"", (0, 0, 0)),
        "null": (None, (0, 0, 0)),
    }
    df = spark.createDataFrame([(n, None if c is None else bytearray(c)) for n, (c, _) in cases.items()], "name string, content binary")
    got = {r["name"]: tuple(r)[2:] for r in image_sizes(df, "content").collect()}
    assert got == {n: size for n, (_, size) in cases.items()}


def test_media_without_python_workers(spark):
    """Header sizes and resampling stay in the JVM."""
    df = spark.createDataFrame([([1.0, 2.0], 4)], "w array<float>, r int")
    for found in (resample(df, "w", "r", 8), image_sizes(df.select(F.lit(b"").alias("c")), "c")):
        text = found._sc._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "simple")
        assert "Python" not in text and "Arrow" not in text


def test_size_ratio(spark):
    df = spark.createDataFrame([(1, 100, 20), (2, 900, 10), (3, 20, 20)], "id int, w int, h int")
    found = {r.id: r.size_ratio for r in size_ratio_warnings(df, "w", "h", 100).collect()}
    assert found == {2: 9.0, 3: 0.2}


def wav(samples, rate, channels=1, width=2):
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(channels)
        f.setsampwidth(width)
        f.setframerate(rate)
        f.writeframes(samples)
    return out.getvalue()


def test_load_waveforms(spark):
    mono = np.array([0, 16384, -32768, 32767], "<i2")
    stereo = np.array([0, 16384, 16384, 16384], "<i2")
    deep = b"\x00\x00\x40" + b"\x00\x00\xc0"
    rows = [("m", wav(mono.tobytes(), 4)), ("s", wav(stereo.tobytes(), 2, 2)), ("d", wav(deep, 1, 1, 3)),
            ("u", wav(bytes([128, 192]), 1, 1, 1))]
    df = spark.createDataFrame(rows, "path string, content binary")
    found = {r.path: r for r in load_waveforms(df).collect()}
    assert found["m"].waveform == pytest.approx([0, 0.5, -1.0, 32767 / 32768])
    assert (found["m"].sample_rate, found["m"].duration_seconds) == (4, 1.0)
    assert found["s"].waveform == [0.25, 0.5] and found["d"].waveform == [0.5, -0.5]
    assert found["u"].waveform == [0.0, 0.5]
    part = load_waveforms(df.where("path = 'm'"), offset=0.25, duration=0.5).first()
    assert part.waveform == [0.5, -1.0]


def test_resample(spark):
    df = spark.createDataFrame([([0.0, 1.0, 2.0, 3.0], 4)], "w array<float>, rate int")
    assert resample(df, "w", "rate", 4).first().w == [0.0, 1.0, 2.0, 3.0]
    assert resample(df, "w", "rate", 2).first().w == [0.5, 2.5]
    assert resample(df, "w", "rate", 8).first().w == [0.0, 0.25, 0.75, 1.25, 1.75, 2.25, 2.75, 3.0]


def test_segments(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4.0, 5.0]), (2, [])], "id int, w array<float>")
    found = [(r.id, r.segment, r.w) for r in segments(df, "w", 2).orderBy("segment").collect()]
    assert found == [(1, 0, [1.0, 2.0]), (1, 1, [3.0, 4.0]), (1, 2, [5.0, 0.0])]
    assert {r.id: r.w for r in first_segment(df, "w", 3).collect()} == {1: [1.0, 2.0, 3.0], 2: [0.0] * 3}


def test_mel_of_a_sine(spark):
    tone = np.sin(2 * np.pi * 440 * np.arange(3200) / 3200).astype(np.float32)
    df = spark.createDataFrame([(tone.tolist(),)], "w array<float>")
    mel = np.array(mel_spectrogram(df, "w", "mel", 3200, 256, 64, 32).first().mel)
    assert mel.shape == (32, 3200 // 64 + 1) and np.isfinite(mel).all()
    assert mel.max() - mel.min() <= 80.0 + 1e-3
    middle = mel[:, 20]
    centre = mel_filters(3200, 256, 32)[:, round(440 * 256 / 3200)].argmax()
    assert abs(int(middle.argmax()) - int(centre)) <= 1
    silent = mel_decibels(np.zeros(512), 3200, 256, 64, 8)
    assert np.allclose(silent, -100.0)


def test_mel_against_a_plain_transform():
    rate, n_fft, hop, bands = 64, 16, 8, 4
    samples = np.random.default_rng(4).normal(size=40)
    padded = np.concatenate([samples[8:0:-1], samples, samples[-2:-10:-1]])
    bins = [int((n_fft + 1) * 700 * (10 ** (m / 2595) - 1) / rate) for m in np.linspace(0, 2595 * np.log10(1 + 32 / 700), 6)]
    expected = np.zeros((bands, len(samples) // hop + 1))
    for t in range(expected.shape[1]):
        for b in range(bands):
            low, mid, high = bins[b : b + 3]
            for k in range(low, high):
                weight = (k - low) / (mid - low) if k < mid else (high - k) / (high - mid)
                wave_k = sum(
                    padded[t * hop + i] * (0.5 - 0.5 * np.cos(2 * np.pi * i / n_fft)) * np.exp(-2j * np.pi * k * i / n_fft)
                    for i in range(n_fft)
                )
                expected[b, t] += weight * abs(wave_k) ** 2
    expected = 10 * np.log10(np.maximum(expected, 1e-10))
    expected = np.maximum(expected, expected.max() - 80)
    assert np.allclose(mel_decibels(samples, rate, n_fft, hop, bands), expected, atol=1e-3)


def test_csv_sources(spark, tmp_path):
    (tmp_path / "b.csv").write_text("id,x\n1,0.5\n2,\n")
    (tmp_path / "a.csv").write_text("id,x\n3,1.5\n")
    (tmp_path / "c.txt").write_text("no")
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "d.csv").write_text("id,x\n9,9\n")
    root = str(tmp_path)
    files = csv_files(spark, [f"{root}/b.csv", root])
    assert [f.rsplit("/", 1)[1] for f in files] == ["b.csv", "a.csv", "b.csv"]
    assert read_csv(spark, f"{root}/b.csv").dtypes == [("id", "int"), ("x", "double")]
    tagged = read_csv_directory(spark, root, "id int, x double")
    assert {(r.id, r.source_file.split("/")[-1]) for r in tagged.collect()} == {(1, "b.csv"), (2, "b.csv"), (3, "a.csv")}
    assert read_csv_glob(spark, f"{root}/*.csv").count() == 3
    (tmp_path / "z.csv").write_text("name,id\nzed,7\n")
    mixed = read_csv_glob(spark, f"{root}/*.csv")
    assert set(mixed.columns) == {"id", "x", "name"}
    assert {(r.id, r.x, r.name) for r in mixed.collect()} == {
        (1, 0.5, None), (2, None, None), (3, 1.5, None), (7, None, "zed")
    }


def test_inputs_and_latest(spark, tmp_path):
    root = str(tmp_path)
    (tmp_path / "t.csv").write_text("id\n1\n")
    for run, n in (("20260101T000000", 1), ("20260202T000000", 2)):
        spark.range(n).write.parquet(f"{root}/job/{run}/out")
    (tmp_path / "job" / "zzz.txt").write_text("a file is not a run")
    (tmp_path / "texts").mkdir()
    (tmp_path / "texts" / "one.txt").write_text("hello\nthere")
    (tmp_path / "rows.jsonl").write_text('{"a": 1}\n{"a": 2}\n')
    found = load_inputs(
        spark,
        [
            {"id": "csv", "path": f"{root}/t.csv"},
            {"id": "latest", "path": f"{root}/job/latest/out", "format": "parquet"},
            {"id": "job", "from_job": f"{root}/job", "output": "out"},
            {"id": "text", "path": f"{root}/texts", "format": "text_dir"},
            {"id": "json", "path": f"{root}/rows.jsonl", "format": "jsonl"},
            {"id": "glob", "glob": f"{root}/*.csv"},
        ],
    )
    assert {k: v.count() for k, v in found.items()} == {
        "csv": 1, "latest": 2, "job": 2, "text": 1, "json": 2, "glob": 1
    }
    assert tuple(found["text"].first()) == ("one", "hello\nthere")
    assert resolve_latest(spark, f"{root}/t.csv") == f"{root}/t.csv"
    with pytest.raises(ValueError):
        resolve_latest(spark, f"{root}/texts/latest/x")
    for bad in ({"id": "x"}, {"id": "x", "path": "p", "format": "xml"}):
        with pytest.raises(ValueError):
            load_inputs(spark, [bad])


def test_io_separation():
    check_separate(["/data/raw", "/data/rawer"], "/data/out")
    for output in ("/data/raw", "/data/raw/out", "/data", "file:///data/raw/x"):
        with pytest.raises(ValueError):
            check_separate(["/data/raw"], output)
    with pytest.raises(ValueError):
        check_separate(["s3://b/raw"], "s3://b/raw/out")
    check_separate(["s3://b/raw"], "s3://c/raw/out")


def test_manifest_and_index_splits(spark, tmp_path):
    items = [{"file_path": f"f{i}", "label": [float(i % 2), 0.0]} for i in range(4)]
    (tmp_path / "manifest.json").write_text(json.dumps(items, indent=1))
    (tmp_path / "cv.json").write_text(json.dumps([{"train": [0, 1], "val": [2, 3]}, {"train": [2, 3], "val": [0, 1]}]))
    manifest = read_manifest(spark, f"{tmp_path}/manifest.json")
    assert manifest.count() == 4 and manifest.first().label == [0.0, 0.0]
    splits = read_index_splits(spark, f"{tmp_path}/cv.json")
    assert splits.count() == 8
    df = manifest.withColumn("row_index", F.substring("file_path", 2, 9).cast("long"))
    kept = rows_of_split(df, splits, 1, "val")
    assert sorted(r.file_path for r in kept.collect()) == ["f0", "f1"]


def test_sinks(spark, tmp_path):
    df = kfold(spark.range(30).withColumn("x", F.col("id") * 2), "id", 3)
    out = str(tmp_path)
    path = write_table(df, out, "test_out", ["x"])
    assert path.endswith("test_out/test.parquet") and spark.read.parquet(path).columns == ["x"]
    assigned = write_folds(df, out, "train_out", ["id", "x"])
    exploded = write_folds(df, out, "all_out", ["id"], layout="exploded", n_splits=3)
    for i in range(3):
        test = {r.id for r in df.where(F.col("fold") == i).collect()}
        for where in (assigned, exploded):
            assert {r.id for r in read_fold(spark, where, i, "test").collect()} == test
            assert {r.id for r in read_fold(spark, where, i, "train").collect()} == set(range(30)) - test
    with pytest.raises(ValueError):
        write_folds(df, out, "x", ["id"], layout="exploded")
    predictions = spark.createDataFrame([(1, 0.7), (2, 0.2)], "id int, prediction double")
    assert set(write_predictions(predictions, f"{out}/p", "id", "y")) == {"submission"}
    paths = write_predictions(predictions, f"{out}/q", "id", "y", 0.5)
    assert {tuple(r) for r in read_csv(spark, paths["submission"]).collect()} == {(1, 1), (2, 0)}
    assert write_statistics(predictions, f"{out}/s").endswith(".parquet")
    with pytest.raises(ValueError):
        write_statistics(predictions, f"{out}/s", "xlsx")


def test_run_tables_and_latest_run(spark, tmp_path):
    root = str(tmp_path)
    scores = spark.createDataFrame([(0, 0.9, 0.8)], "fold int, train_score double, valid_score double")
    for ts in ("20260101", "20260102"):
        steps = [{"step_id": "a", "method": "join", "status": "ok", "reason": None}]
        record_run(spark, root, {"run_ts": ts, "job_id": "j", "kind": "train", "seed": 1}, steps, scores)
    assert latest_run(spark.read.parquet(f"{root}/runs")).first().run_ts == "20260102"
    assert spark.read.parquet(f"{root}/run_steps").count() == 2
    assert spark.read.parquet(f"{root}/fold_scores").count() == 2


def test_recipe(spark):
    train = spark.createDataFrame([(1, 1.0), (2, None), (3, 3.0)], "id int, x double")
    test = spark.createDataFrame([(4, None)], "id int, x double")
    made = compose(
        {"train": train, "test": test},
        [
            {"id": "filled", "method": "fill_na", "options": {"columns": ["x"]}},
            {"id": "test_filled", "method": "apply_imputer", "from": "test", "model": "filled",
             "options": {"columns": ["x"]}},
            {"id": "named", "method": "format_column",
             "options": {"template": "{id}.png", "source_col": "id", "output_col": "path"}},
            {"id": "short", "method": "drop_source", "options": {"columns": ["x"]}},
            {"id": "mine", "method": lambda df: df.limit(1)},
        ],
    )
    assert made.tables["test_filled"].first().x == 2.0
    assert made.tables["named"].first().path == "4.png"
    assert made.tables["short"].columns == ["id", "path"] and made.tables["mine"].count() == 1
    assert {s["status"] for s in made.steps} == {"ok"}


def test_recipe_records_or_raises(spark):
    df = spark.range(3)
    steps = [
        {"id": "a", "method": "mystery"},
        {"id": "b", "method": "select_columns", "options": {"columns": ["gone"]}},
        {"id": "c", "method": "select_columns", "options": {"columns": ["id"]}},
    ]
    made = compose({"in": df}, steps, on_error="record")
    assert [s["status"] for s in made.steps] == ["skipped", "failed", "ok"]
    assert "gone" in made.steps[1]["reason"] and made.tables["c"].count() == 3
    with pytest.raises(ValueError):
        compose({"in": df}, steps)
    with pytest.raises(ValueError):
        compose({"in": df}, steps[1:2])


def test_train_model_is_one_row(spark):
    _, model = fill_na(spark.createDataFrame([(1.0,), (3.0,)], "x double"), ["x"], "mean")
    assert model.count() == 1 and model.first().x == 2.0


def test_latest_run_skips_working_folders(spark, tmp_path):
    from foldwise.sources.readers import resolve_latest

    for name in ("20260101", "20260102", "_temporary", ".hidden"):
        (tmp_path / name).mkdir()
    assert resolve_latest(spark, f"{tmp_path}/latest/x") == f"{tmp_path}/20260102/x"


def test_csv_glob_matches_columns_by_name(spark, tmp_path):
    from foldwise.sources.readers import read_csv_glob

    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "b.csv").write_text("y,x\n10,20\n")
    (tmp_path / "c.csv").write_text("z,x\n7,30\n")
    rows = read_csv_glob(spark, f"{tmp_path}/*.csv", "x int, y int").collect()
    assert sorted(map(tuple, rows)) == [(1, 2), (20, 10), (30, None)]


def test_recipe_builds_only_what_outputs_need(spark):
    built = []
    note = lambda name: lambda df, *rest: built.append(name) or df
    steps = [
        {"id": "a", "method": note("a")}, {"id": "b", "method": note("b")},
        {"id": "c", "method": note("c"), "from": "a"}, {"id": "d", "method": note("d"), "from": "in"},
    ]
    made = compose({"in": spark.range(2)}, steps, outputs=["c"])
    assert built == ["a", "c"] and set(made.tables) == {"in", "a", "c"}
    assert set(compose({"in": spark.range(2)}, steps).tables) == {"in", "a", "b", "c", "d"}


def read_records(spark, first_stage):
    """Records that stages from ``first_stage`` on read from files, and the next stage's number."""
    store, total = spark.sparkContext._jsc.sc().statusStore(), 0
    while True:
        try:
            total += store.lastStageAttempt(first_stage).inputRecords()
        except Exception:
            return total, first_stage
        first_stage += 1


def test_headers_are_found_without_reading_the_files(spark, tmp_path):
    for name, head in (("a", "x,y"), ("b", "y,x"), ("c", "x,y")):
        (tmp_path / f"{name}.csv").write_text(head + "\n" + "1,2\n" * 400_000)
    (tmp_path / "empty.csv").write_text("")
    _, stage = read_records(spark, 0)
    headers = {r.path.rsplit("/", 1)[1]: r.header for r in csv_headers(spark, f"{tmp_path}/*.csv").collect()}
    assert headers == {"a.csv": "x,y", "b.csv": "y,x", "c.csv": "x,y"}
    assert read_records(spark, stage)[0] < 20
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    rows = read_csv_glob(spark, f"{tmp_path}/*.csv", "x int, y int")
    found = {(r.x, r.y): r["count"] for r in rows.groupBy("x", "y").count().collect()}
    assert found == {(1, 2): 800_000, (2, 1): 400_000}
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before


def test_many_files_of_a_header_are_read_in_parts(spark, tmp_path, monkeypatch):
    from foldwise.sources import readers

    monkeypatch.setattr(readers, "_FILES_A_READ", 2)
    monkeypatch.setattr(readers, "_HEADERS_A_JOB", 3)
    for i in range(5):
        (tmp_path / f"{i}.csv").write_text(f"x\n{i}\n")
    (tmp_path / "z{1}.csv").write_text("y,x\n0,9\n")
    assert sorted(r.x for r in read_csv_glob(spark, f"{tmp_path}/*.csv", "x int").collect()) == [0, 1, 2, 3, 4, 9]


def test_newest_run_is_read_alone(spark, tmp_path):
    for ts in ("20260101", "20260102"):
        scores = spark.createDataFrame([(0, 0.5, 0.75)], "fold int, train_score double, valid_score double")
        record_run(spark, str(tmp_path), {"run_ts": ts, "job_id": ts}, [{"step_id": "a", "status": "ok"}], scores)
    found = run_history(spark, str(tmp_path))
    assert {n: [r.run_ts for r in t.collect()] for n, t in found.items()} == dict.fromkeys(found, ["20260102"])
    text = found["runs"]._sc._jvm.PythonSQLUtils.explainString(found["runs"]._jdf.queryExecution(), "formatted")
    assert "PartitionFilters: [isnotnull(run" in text


def test_writers_refuse_their_inputs(spark, tmp_path):
    df, root = spark.range(3).withColumn("fold", F.lit(0)), str(tmp_path)
    for write in (
        lambda: write_table(df, f"{root}/in/out", "n", ["id"], inputs=[f"{root}/in"]),
        lambda: write_folds(df, root, "n", ["id"], inputs=[f"{root}/in"]),
        lambda: write_statistics(df, f"{root}/in/stats", inputs=[f"{root}/in"]),
        lambda: write_predictions(df.withColumn("prediction", F.lit(0.5)), f"{root}/in", "id", "y", inputs=[f"{root}/in"]),
    ):
        with pytest.raises(ValueError):
            write()
    assert spark.read.parquet(write_table(df, f"{root}/out", "n", ["id"], inputs=[f"{root}/in"])).count() == 3


def test_csv_directory_has_its_own_file_for_every_remainder(spark, tmp_path):
    """Of 6,000 suppliers a sampled range put two remainders into one file."""
    supplier = spark.range(6000).selectExpr("id AS s_suppkey", "concat('s', id) AS s_name", "id % 97 / 4D AS s_acctbal")
    supplier.coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW supplier AS SELECT * FROM '{tmp_path}/supplier.parquet/*.parquet'")
    found = queries()["s3_csv_directory"](spark, str(tmp_path))
    assert compare(db, found, oracle_sql()["s3_csv_directory"]) == []
    assert found.count() == 6000


def test_fold_tasks_are_bounded_in_bytes(spark, tmp_path, monkeypatch):
    """A side larger than a task's share is dealt to several, whatever it compresses to."""
    from foldwise.sources import writers

    monkeypatch.setattr(writers, "TASK_BYTES", 24 * 3 * 100)
    df = spark.range(900).coalesce(1).select("id", F.when(F.col("id") < 850, F.col("id") % 2).cast("int").alias("fold"))
    for layout, sides in (("assigned", ["fold"]), ("exploded", ["fold", "split"])):
        path = write_folds(df, str(tmp_path), layout, ["id"], layout=layout, n_splits=2)
        rows = spark.read.parquet(path)
        files = rows.groupBy(*sides, F.input_file_name().alias("file")).count().collect()
        assert max(r["count"] for r in files) <= 250 and len(files) >= 7
        assert rows.count() == 900 * (2 if layout == "exploded" else 1)
        assert {r.id for r in rows.where("fold = 1").collect()} >= {i for i in range(850) if i % 2}
    assert spark.read.parquet(f"{tmp_path}/assigned").where("fold IS NULL").count() == 50
    empty = write_folds(df.where("id < 0"), str(tmp_path), "none", ["id"], layout="exploded", n_splits=2)
    assert spark.read.schema("id long, fold int, split string").parquet(empty).count() == 0
