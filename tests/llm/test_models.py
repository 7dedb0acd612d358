"""BPE against the library, nearest neighbours against all pairs, languages held out."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmill.llm import ann, bpe, langid

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(bpe.tokenizer_path())


ODD = [None, "", "<|endoftext|>", "a <|endoftext|>\n b", "it's  we'll 'S", "\x1c\x1f\x85\u00a0\u3000 x", "naïve ½²Ⅷ 12３", "🙂🙂 é́", "x" * 3000, " " * 50, "\r\n\t" * 9, "日本語テキスト"]


def test_bpe_equals_library(spark, docs, texts, library):
    own = [t for _, t in texts] + ODD
    frame = spark.createDataFrame(list(enumerate(own)), "doc_id long, text string")
    got = bpe.encode_documents(frame, bpe.tokenizer_path(), results=("ids", "decoded", "ids_sha256", "decoded_sha256", "lossless"), words=50).collect()
    assert len(got) == len(own)
    for r in got:
        ids = library.encode(own[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and r["lossless"]
        back = library.decode(ids, skip_special_tokens=False)
        assert r["decoded"] == back and r["decoded_sha256"] == hashlib.sha256(back.encode()).hexdigest()
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_bpe_empty_table_and_clashing_columns(docs, empty):
    assert bpe.encode_documents(empty, bpe.tokenizer_path()).count() == 0
    assert bpe.encode_documents(docs, bpe.tokenizer_path(), keep=["doc_id", "words"], lexicon=["the"]).columns == ["doc_id", "words", "n_tokens", "ids", "decoded"]


def test_words_are_counted_over_all_documents_and_flushes(spark, docs, texts, monkeypatch):
    monkeypatch.setattr(bpe, "COUNT_WORDS", 1)
    split, want = bpe.splitter(), {}
    for _, t in texts:
        for w in split(t or ""):
            if len(w) <= bpe.CACHE_CHARS:  # longer ones, up to megabytes, are merged and never kept
                want[w] = want.get(w, 0) + 1
    assert dict(map(tuple, bpe.word_counts(docs).collect())) == want
    some = bpe.frequent_words(docs, words=40)
    assert 0 < len(some) <= 60 and min(want[w] for w in some) >= sorted(want.values())[-60]


def test_lexicon_is_minimal_and_exact(tmp_path):
    words = sorted({f"{a}{b}ing".encode() for a in "abcdef" for b in "xyz"} | {b"", b"a", b"\xff\x00"})
    bpe.Lexicon.compile([(w, list(w)) for w in words], str(tmp_path / "l"))
    lexicon = bpe.Lexicon(str(tmp_path / "l"))
    assert all(lexicon.get(w) == list(w) for w in words)
    assert lexicon.get(b"axin") is None and lexicon.get(b"zzz") is None
    assert lexicon.states < 12  # suffixes are shared
    assert lexicon.words == len(words)


def test_pretokens_split_as_the_library_does(library):
    rng = random.Random(3)
    split, own = bpe.splitter(), bpe.Vocabulary(bpe.tokenizer_path())
    for _ in range(500):
        text = "".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x250), rng.randrange(0x250, 0x3000), 32])) for _ in range(20))
        assert [i for w in split(text) for i in own.merge(w.encode())] == library.encode(text, add_special_tokens=False).ids


def test_only_new_pieces_are_split_and_words_are_merged_together(library, monkeypatch):
    rng = random.Random(6)
    marks = ["a", "b", " ", " ", " ", "\n", "\t", "'s", "\u00a0", "\x1c", "\u3000", "1", "½", "é", "日", "🙂", ".", "<|endoftext|>", "x" * 70, "é" * 40]
    texts = ["".join(rng.choice(marks) for _ in range(rng.randrange(30))) for _ in range(2000)]
    split, own = bpe.splitter(), bpe.Vocabulary(bpe.tokenizer_path())
    words = sorted({w for t in texts for w in split(t)})
    assert [np.frombuffer(x, "<u4").tolist() for x in own.merge_all([w.encode() for w in words])] == [own.merge(w.encode()) for w in words]
    assert all([w for piece in bpe.pieces(t, split) for w in split(bpe.unpieced(piece))] == split(t) for t in texts)
    monkeypatch.setattr(bpe, "CACHE_PIECES", 100)
    coder = bpe.Encoder(own, None)
    got = [ids for k in range(0, len(texts), 50) for ids in coder.encode_all(texts[k : k + 50])]
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [r.ids for r in library.encode_batch(texts, add_special_tokens=False)]
    assert all(len(piece) <= bpe.CACHE_CHARS for piece in coder)
    seen: list[str] = []
    coder = bpe.Encoder(own, None)
    coder.split = lambda text: seen.append(text) or split(text)
    coder.encode_all(["one, two, three"] * 500 + [None, "two, one,"])
    assert sum(map(len, seen)) < 50  # not 500 texts


@pytest.mark.parametrize("kind", ["float", "double"])
def test_neighbours(spark, kind):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(900, 12)).astype(np.float32)
    x[100:160] = x[5]
    x[300] = 0
    rows = [(i, v.tolist(), None) for i, v in enumerate(x)] + [(2000, None, 1), (2001, [], 1), (2002, [float("nan")] * 12, 1), (2003, [1.0], 1), (2020, [None] * 12, 1), (7, x[7].tolist(), 2)]
    frame = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, entry int")
    got = ann.nearest(frame, frame.filter(F.col("vec_id") % 20 == 0)).collect()
    found: dict = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    ids = np.array([i for i in range(900) if i != 300])
    y, hits = x.astype(np.float64), 0
    assert set(found) == {i for i in range(0, 900, 20) if i != 300}
    for q, mine in found.items():
        s = y[ids] @ y[q]
        order = [j for j in np.lexsort((ids, -np.round(s, 9))) if ids[j] != q][:20]
        assert len(mine) == 20 and [v for v, _ in mine] == [v for v, _ in sorted(mine, key=lambda m: (-round(m[1], 9), m[0]))]
        hits += len({int(ids[j]) for j in order} & {v for v, _ in mine})
    assert hits >= 0.9 * 20 * len(found)


def test_neighbours_in_many_small_lists(spark, monkeypatch):
    monkeypatch.setattr(ann, "LIST_ROWS", 8)  # 1,000 lists: their centroids are close, and a fixed ratio admits few
    monkeypatch.setattr(ann, "TURN_VALUES", 64 * 150)
    x = np.random.default_rng(2).normal(size=(8000, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    found: dict = {}
    for r in ann.nearest(frame, frame.filter(F.col("vec_id") % 20 == 0)).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    y, hits = x.astype(np.float64), 0
    for q in range(0, 8000, 20):
        s = y @ y[q]
        s[q] = -np.inf
        hits += len(found[q] & set(np.argsort(-s)[:20].tolist()))
    assert hits >= 0.98 * 20 * 400


def test_fewer_candidates_than_asked_for(spark):
    frame = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in ann.nearest(frame, frame.filter("vec_id = 0")).collect())
    assert got == [(0, 1, 2, 1.0), (0, 2, 1, 0.0)]
    assert ann.nearest(frame.limit(0), frame.limit(0)).count() == 0


def test_languages_held_out(spark, sf_dir):
    got = langid.op10_langid(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = got.filter("held_out").toPandas()
    assert len(held) > 20 and (held.lang == held.lang_pred).mean() >= 0.95
    assert held.score.between(0, 1).all()


def out_of_place(labelled, texts, top=1000, own=400):
    """(lang_pred, score) by dictionaries: most frequent 1- to 3-grams of letters, ties by code, and the sum of how far ranks are apart."""

    def counts(text):
        runs, now = ["\1"], ""
        for ch in text.lower() + "\1":
            if ch.isalpha():
                now += ch
            elif now:
                runs += [*now, "\1"]
                now = ""
        found: dict = {}
        for n in (1, 2, 3):
            for i in range(len(runs) - n + 1):
                g = tuple(ord(c) for c in runs[i : i + n])
                if n == 1 and g != (1,) or n == 2 or n == 3 and g[1] != 1:
                    found[g] = found.get(g, 0) + 1
        return found if len(runs) > 1 else {}

    def code(g):
        out = 0
        for c in g:
            out = out << 21 | c
        return out

    def ranks(found, k):
        return [g for g, _ in sorted(found.items(), key=lambda x: (-x[1], code(x[0])))[:k]]

    total: dict = {}
    for text, lang in labelled:
        for g, n in counts(text).items():
            total.setdefault(lang, {})
            total[lang][g] = total[lang].get(g, 0) + n
    place = {lang: {g: r for r, g in enumerate(ranks(f, top))} for lang, f in total.items()}
    out = []
    for text in texts:
        mine = ranks(counts(text or ""), own)
        apart = {lang: sum(abs(p[g] - r) if g in p else top for r, g in enumerate(mine)) for lang, p in place.items()}
        best = min(sorted(apart), key=apart.get) if mine and apart else None
        out.append((best, 1 - apart[best] / (top * len(mine))) if best else ("und", 0.0))
    return out


def test_languages_equal_plain_out_of_place_distances(spark, texts):
    labelled = [("the cat sat on the mat, and the dog too", "en"), ("der hund und die katze sind im haus", "de"), ("le chat est sur la table et le chien", "fr"), ("abc abc", "t2"), ("abc abc", "t1"), (texts[0][1], "zz")]
    model = langid.fit(spark.createDataFrame([(i, *r) for i, r in enumerate(labelled)], "doc_id long, text string, lang string"))
    rng = random.Random(6)
    own = [t for _, t in texts] + ["abc", "the hund", "É été ÀB", "x1y2z3", "日本 x"] + ["".join(rng.choice("abcdeé t,.hrn") for _ in range(60)) for _ in range(40)]
    got = langid.predict(spark.createDataFrame(list(enumerate(own)), "doc_id long, text string"), model).orderBy("doc_id").collect()
    for r, (lang, score) in zip(got, out_of_place(labelled, own)):
        assert (r["lang_pred"], r["score"]) == (lang, pytest.approx(score)), own[r["doc_id"]]
    assert got[len(texts)]["lang_pred"] == "t1"  # of equals, the first


def test_only_the_most_frequent_labels_are_learned(spark, monkeypatch):
    monkeypatch.setattr(langid, "LANGUAGES", 2)
    rows = [(i, "the cat", lang) for i, lang in enumerate(["en", "en", "de", "de", "dirty"])]
    assert langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string")).names == ["de", "en"]


def test_texts_without_letters(spark, docs, empty):
    model = langid.fit(spark.createDataFrame([(1, "the cat", "en"), (2, "der hund", "de"), (3, "x", None), (4, None, "en")], "doc_id long, text string, lang string"))
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "123 !?"), (4, "THE"), (5, "der")], "doc_id long, text string")
    assert [r["lang_pred"] for r in langid.predict(rows, model).orderBy("doc_id").collect()] == ["und", "und", "und", "en", "de"]
    assert langid.predict(docs, model, keep=["doc_id", "words"]).count() == docs.count()
    assert langid.predict(empty, model).count() == 0
    nothing = langid.fit(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert langid.predict(rows, nothing).filter("lang_pred <> 'und'").count() == 0
