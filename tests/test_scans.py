"""The source of scanned files: kinds, sizes at the edge, words or texts, failures."""

import json
import os

import pytest

from quillmill.sources import scans
from quillmill.sources import store as S


def fake():
    """A scanner of files that hold what it is to find as JSON."""

    def read(raw: bytes) -> dict:
        seen = json.loads(raw)
        if seen.get("broken"):
            raise ValueError("can't read it")
        return seen

    return read


@pytest.fixture
def folder(tmp_path):
    found = dict(
        a=dict(text="TOTAL 5", confidence=80, words=[dict(text=" TOTAL ", confidence=91, x0=1, y0=2, x1=3, y1=4), dict(text="5", confidence=None, x0=5, y0=2, x1=None, y1=4)]),
        b=dict(blocks=[["  NEW GOOD  ", "x"], [], [" y"]]), c=dict(broken=True), d=dict(text="", confidence=None, words=[]),
    )
    for (name, seen), kind in zip(found.items(), (".jpg", ".PNG", ".jpeg", ".png")):
        (tmp_path / f"{name}{kind}").write_text(json.dumps(seen))
    (tmp_path / "e.txt").write_text("{}")
    (tmp_path / "sub").mkdir()
    small = json.dumps(dict(text="deep"))
    (tmp_path / "sub" / "f.png").write_text(small + " " * (300 - len(small)))
    (tmp_path / "sub" / "g.png").write_text(small + " " * (301 - len(small)))
    (tmp_path / "_hidden.png").write_text("{}")
    return tmp_path


def read(spark, folder, **options):
    scans.register(spark)
    reader = spark.read.format("scans").option("scanner", "tests.test_scans:fake").options(**options)
    return {os.path.basename(r["path"]) + (f"#{r['word_ix']}" if "word_ix" in r and r["word_ix"] is not None else ""): r for r in reader.load(str(folder)).collect()}


def test_texts_sizes_and_kinds(spark, folder):
    got = read(spark, folder, maxBytes="300")
    assert set(got) == {"a.jpg", "b.PNG", "c.jpeg", "d.png", "e.txt", "f.png", "g.png"}
    assert (got["a.jpg"]["text"], got["a.jpg"]["confidence"], got["a.jpg"]["failed"]) == ("TOTAL 5", 0.8, None)
    assert (got["b.PNG"]["text"], got["b.PNG"]["confidence"]) == ("NEW GOOD\nx\ny", 0.0)
    assert got["c.jpeg"]["failed"] == "ValueError: can't read it" and got["c.jpeg"]["text"] is None
    assert got["d.png"]["text"] == "" and got["e.txt"]["failed"] == "no JPG or PNG file"
    assert got["f.png"]["text"] == "deep" and got["g.png"]["failed"] == "over 300 bytes"


def test_words(spark, folder):
    got = read(spark, folder, words="true")
    assert tuple(got["a.jpg#0"])[1:] == (0, "TOTAL", 91.0, 1.0, 2.0, 3.0, 4.0, None)
    assert tuple(got["a.jpg#1"])[1:] == (1, "5", 0.0, 5.0, 2.0, None, 4.0, None)
    assert got["c.jpeg"]["failed"] and got["e.txt"]["failed"] and "d.png" not in got and "b.PNG" not in got


def test_files_are_dealt_into_tasks_and_options_are_needed(spark, folder, monkeypatch):
    monkeypatch.setattr(scans, "TASK_BYTES", 350)
    parts = scans.ScanReader(str(folder), "tests.test_scans:fake", False, 10**6).partitions()
    assert len(parts) > 2 and sum(len(p.value) for p in parts) == 7
    (folder / "none").mkdir()
    assert read(spark, folder / "none") == {}
    with pytest.raises(Exception, match="needs the option scanner"):
        spark.read.format("scans").load(str(folder)).collect()
    with pytest.raises(Exception, match="nowhere"):
        spark.read.format("scans").option("scanner", "nowhere:f").load(str(folder)).collect()


def test_image_files_by_size(spark, tmp_path):
    for name, n in (("a.jpg", 10), ("b.png", S.MAX_IMAGE_BYTES), ("c.png", S.MAX_IMAGE_BYTES + 1), ("d.gif", 5)):
        with open(tmp_path / name, "wb") as f:
            f.truncate(n)
    assert sorted(os.path.basename(r["path"]) for r in S.images(spark, str(tmp_path)).select("path").collect()) == ["a.jpg", "b.png"]


def test_json_keeps_nulls_and_every_record(spark, tmp_path):
    df = spark.createDataFrame([(1, None, 'a "b"\n'), (2, "x", None)], "id long, billNo string, customer string")
    S.write_json(df, str(tmp_path / "j"))
    lines = [json.loads(x[0]) for x in spark.read.text(str(tmp_path / "j")).collect()]
    assert sorted(lines, key=lambda r: r["id"]) == [dict(id=1, billNo=None, customer='a "b"\n'), dict(id=2, billNo="x", customer=None)]
