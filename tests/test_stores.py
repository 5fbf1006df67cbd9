"""Readers and writers: round trips through files."""

import json

from pyspark.sql import functions as F

from strideloom.schemas import PERSONS, STRIKES
from strideloom.sources import stores

STRIKE = {"frame": 9, "side": "left", "strike_pattern": "heel", "overstriding": "skip", "u_frame": None, "video": "a"}


def test_strikes_and_missing_file(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps([STRIKE], indent=4))
    r = stores.strikes(spark, str(tmp_path / "s.json")).first()
    assert (r.frame, r.side, r.u_frame) == (9, "L", None)
    assert stores.strikes(spark, str(tmp_path / "none.json")).count() == 0


def test_frame_tables_drop_nulls(spark, tmp_path):
    row = {"video": "a", "frame": 1, "side": "right", "ankle_x_vel": 1.0, "tibial_angle": 1.0, "shin_velocity": 1.0, "ankle_y_vel": 1.0}
    (tmp_path / "f.json").write_text(json.dumps({"a": [row, row | {"ankle_y_vel": float("nan")}, row | {"frame": None}], "b": [row | {"video": "b"}]}))
    assert sorted((r.video, r.frame, r.side) for r in stores.frame_tables(spark, str(tmp_path / "f.json")).collect()) == [("a", 1, "R"), ("b", 1, "R")]


def test_legacy_frames(spark, tmp_path):
    (tmp_path / "l.json").write_text(json.dumps({"Video1": {"12": [["m", 1.5], ["n", -2], "L"]}}))
    r = stores.legacy_frames(spark, str(tmp_path / "l.json")).first()
    assert (r.video, r.frame, r.side, r.features) == ("Video1", 12, "L", {"m": 1.5, "n": -2.0})


def test_legacy_store_keeps_what_it_is_given(spark, tmp_path):
    """Nulls, quotes, repeated rows, both sides at one frame."""
    rows = [('q"v', 1, "L", "m", None), ('q"v', 1, "L", 'n"\\', 2.5), ('q"v', 1, "L", "m", None), ("w", 1, "R", "m", 1.0), ("w", 1, "L", "m", 3.0), ("w", 2, "R", "x", -1e-9)]
    stores.write_legacy(spark.createDataFrame(rows, "video string, frame int, side string, name string, value double"), str(tmp_path / "l"))
    docs = {k: v for f in (tmp_path / "l").glob("part-*") for line in f.read_text().splitlines() for k, v in json.loads(line).items()}
    assert docs['q"v'] == {"1": [["m", None], ["m", None], ['n"\\', 2.5], "L"]}
    got = {(r.video, r.frame): (r.side, r.features) for r in stores.legacy_frames(spark, str(tmp_path / "l"), lines=True).collect()}
    assert got == {('q"v', 1): ("L", {"m": None, 'n"\\': 2.5}), ("w", 1): ("L", {"m": 3.0}), ("w", 2): ("R", {"x": -1e-9})}


def test_pose_frames_skip_and_take_the_first_person(spark):
    person = lambda k: [{"x": float(i + k), "y": 0.0} for i in range(17)]
    df = spark.createDataFrame([("a", 0, [person(0)]), ("a", 1, []), ("a", 2, [person(5), person(9)])], PERSONS)
    rows = stores.pose_frames(df).orderBy("frame").collect()
    assert [(r.frame, r.idx, r.left_ankle.x, r.right_shoulder.x) for r in rows] == [(0, 0, 15.0, 6.0), (2, 1, 20.0, 11.0)]


def test_video_paths(spark):
    v = spark.createDataFrame([("a",), ("a",), ("b",), ("c",)], "video string")
    f = spark.createDataFrame([("d/a.mp4",), ("d/a.MOV",), ("d/b.MOV",)], "path string")
    assert sorted((r.video, r.path) for r in stores.video_paths(v, f, "d").collect() if r.path) == [("a", "d/a.mp4"), ("b", "d/b.MOV")]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([STRIKE], STRIKES)
    path = str(tmp_path / "k")
    stores.append(df, path)
    stores.append(df, path)
    assert spark.read.json(path).count() == 2
    stores.replace_videos(df, path + "p")
    stores.replace_videos(df.withColumn("video", F.lit("b")), path + "p")
    stores.replace_videos(df, path + "p")
    assert sorted(r.video for r in spark.read.parquet(path + "p").collect()) == ["a", "b"]
    stores.overwrite(df, path + "o")
    stores.overwrite(df, path + "o")
    stores.append_lines(df, path + "o")
    assert spark.read.json(path + "o").count() == 2
    assert json.loads(stores.report(df, "video").first().json)["frame"] == 9


def test_entry_without_the_text_subpackage(tmp_path):
    """The entry module imports and lists its queries where strideloom.llm and corpus_pipeline are gone."""
    import os
    import shutil
    import subprocess
    import sys

    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{here}/strideloom", tmp_path / "strideloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{here}/__spark_entry__.py", tmp_path)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True, env=env)
    assert out.returncode == 0, out.stderr


def test_entry_where_a_module_lacks_that_the_text_subpackage_needs():
    import os
    import subprocess
    import sys

    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import sys; sys.modules['sentencepiece'] = sys.modules['zstandard'] = None; import __spark_entry__ as e; print(*e.queries())"
    out = subprocess.run([sys.executable, "-c", code], cwd=here, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": here})
    assert out.returncode == 0 and "cycle_tensor" in out.stdout, out.stderr
