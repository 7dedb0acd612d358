"""Fill-in-middle against taking texts apart whole, and its index against scans."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmill.llm import fill_in_middle as fim

ODD = ["\n", "\n\n\n", "a\nb", "a\nb\n", "é\n日本\n🙂", "x <P> y\nz", "<", "<S", "ends with <\n<S", "\r\n\r\n", "ab" * 3000, "line\n" * 2000, "é" * 700 + "\n" + "🙂\n" * 600]


def plain(texts):
    return [t for _, t in texts] + ODD


@pytest.mark.parametrize("unit", ["line", "char"])
@pytest.mark.parametrize("spm", [0, 50, 100])
def test_equals_brute_force(spark, texts, unit, spm):
    rows = [(k, t) for k, t in enumerate(plain(texts))] + [(None, "no id\nat all"), (5, "same\nid"), (5, "same\nid")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    made = fim.fill_in_middle(docs, keep=["doc_id", "text"], unit=unit, spm=spm, rate=80)
    got = made.withColumn("again", fim.restored(F.col("output"), F.col("form"))).collect()
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r[c] for c in fim.RESULTS) == fim.brute_force(r["text"], r["doc_id"], unit, 80, spm)
        assert r["again"] == (r["text"] or "")
    assert {"plain", "psm" if spm == 0 else "spm"} <= {r["form"] for r in got}


@pytest.mark.parametrize("unit", ["line", "char"])
@pytest.mark.parametrize("every, block", [(1, 1), (3, 7), (256, 64), (5, 1 << 20)])
def test_checkpoints_lead_to_every_cut(unit, every, block, monkeypatch):
    monkeypatch.setattr(fim, "BLOCK", max(block, 4))
    rng = random.Random(every)
    for _ in range(30):
        text = "".join(rng.choice(["a", "é", "日", "🙂", "\n", "\n"]) for _ in range(rng.randrange(60)))
        raw = text.encode()
        index = fim.Checkpoints(np.frombuffer(raw, np.uint8), unit, every, block)
        units = [x + "\n" for x in text.split("\n")[:-1]] + [text.split("\n")[-1]] * bool(text.split("\n")[-1]) if unit == "line" else list(text)
        assert (index.units, index.chars) == (len(units), len(text))
        assert len(index.marks) == len(index.bytes) == len(index.points) <= len(units) // every + 1
        for u in range(len(units) + 1):
            head = "".join(units[:u])
            assert index.cut(u) == (len(head.encode()), len(head))


def test_a_text_of_many_megabytes_and_one_endless_line(spark):
    long = "".join(f"line {k} é\n" for k in range(600_000))
    docs = spark.createDataFrame([(1, long), (2, "y" * (5 << 20))], "doc_id long, text string")
    for r in fim.fill_in_middle(docs, keep=["doc_id", "text"]).collect():
        assert tuple(r[c] for c in fim.RESULTS) == fim.brute_force(r["text"], r["doc_id"])
    index = fim.Checkpoints(np.frombuffer(long.encode(), np.uint8))
    assert len(index.marks) < 600_000 // fim.EVERY + 2


def test_empty_table_clashing_columns_and_bad_names(docs, empty):
    assert fim.fill_in_middle(empty).count() == 0
    assert fim.fill_in_middle(docs, keep=["doc_id", "key", "spans"]).columns == ["doc_id", "key", "spans", *fim.RESULTS]
    with pytest.raises(ValueError):
        fim.fill_in_middle(docs, keep=["doc_id", "n"])
    with pytest.raises(ValueError):
        fim.fill_in_middle(docs, unit="word")


def test_query_equals_its_sql(compare):
    compare(fim.op11_fill_in_middle, fim.SQL)
