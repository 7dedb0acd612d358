"""BPE encoding and decoding with a minimal acyclic transducer of frequent words.

Words (pieces of the byte-level split) are counted over all documents; the
``LEXICON_WORDS`` most frequent are compiled, with the ids that exact merging
gives them, into a minimal acyclic automaton: words share suffixes as well as
prefixes, and the numbers on a word's transitions add up to its place in the
table of outputs.  The file goes to the executors by ``addFile`` and is
memory-mapped there.  Words that it lacks are merged exactly.

Texts are cut before single spaces that end a word, which are always a boundary of
the split; the pieces are counted and kept by a task, and only pieces that it does
not know are split.  Their words walk the automaton, and are merged, all at once.

Defined results: a null text is empty and has no ids; the special token's string
in a text is that token; repeated rows each get a row; an empty table gives an
empty result (and an empty lexicon); further columns are ignored unless in
``keep``; words of any length are merged in n log n.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import re
import struct
import unicodedata
import uuid
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmill.llm._native import table
from quillmill.llm._scratch import Scratch
from quillmill.llm._worker import resident, text_batches, tidy

#: The split that byte-level BPE makes before merging; x1C-x1F are no spaces there.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"""
#: The same split for texts without a character from here on, in the faster module.
LATIN_END = 0x250
LEXICON_WORDS = 200_000
#: Pieces kept by a Python worker (twice so many at most), pieces counted before they are summed up,
#: and the longest that are kept or counted: together they bound the bytes held.
CACHE_PIECES = 220_000
COUNT_WORDS = 160_000
CACHE_CHARS = 64
#: Bytes of the longest words that are merged many at once, and how many.
SHORT_BYTES = 256
TOGETHER = 4096
#: Documents whose ids leave a task at once.
ROWS = 256


def splitter() -> Callable[[str], list[str]]:
    import regex

    def chars(major: str) -> str:
        return "".join(re.escape(chr(c)) for c in range(LATIN_END) if unicodedata.category(chr(c))[0] == major)

    space = "".join(re.escape(chr(c)) for c in range(LATIN_END) if regex.match(r"\p{White_Space}", chr(c)))
    latin = PATTERN.replace(r"[^\p{White_Space}\p{L}\p{N}]", f"[^{space}{chars('L')}{chars('N')}]")
    for name, own in ((r"\P{White_Space}", f"[^{space}]"), (r"\p{White_Space}", f"[{space}]"), (r"\p{L}", f"[{chars('L')}]"), (r"\p{N}", f"[{chars('N')}]")):
        latin = latin.replace(name, own)
    beyond, fast, full = re.compile(f"[^\0-{chr(LATIN_END - 1)}]").search, re.compile(latin).findall, regex.compile(PATTERN).findall
    return lambda text: full(text) if beyond(text) else fast(text)


#: Where a cut before a single space would part a run of white space; \s has all of White_Space, and some more.
_RUNS = re.compile(r"\s (?:\s|\Z)").search


def pieces(text: str, split: Callable[[str], list[str]]) -> list[str]:
    """The text in pieces whose words are those of the text: one that begins with a space is what follows it, others have a space before them.

    No match of PATTERN has a space behind another character that is none, so such spaces begin one.
    """
    if _RUNS(text):
        return [" " + w for w in split(text)]
    out = text.split(" ")
    out[0] = " " + out[0]
    return out


def unpieced(piece: str) -> str:
    return piece[1:] if piece[:1] == " " else " " + piece


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """Token bytes, and merges as {(left id, right id): (rank, id)}, of a byte-level tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = {c: b for b, c in enumerate(byte_letters())}
        ids = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*ids.values(), *self.special.values()]) + 1
        self.token: list[bytes] = [b""] * size
        for word, i in ids.items():
            if word not in self.special:
                self.token[i] = bytes(back[c] for c in word)
        for word, i in self.special.items():
            self.token[i] = word.encode()
        self.byte = [ids[c] for c in byte_letters()]
        self.merges = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[ids[a], ids[b]] = (rank, ids[a + b])
        self.made = [new for _, new in self.merges.values()]
        self.none = (len(self.made), -1)
        # The same for many pairs at once: pairs as sorted numbers, with their ranks and ids.
        pairs = np.array([a << 32 | b for a, b in self.merges] or [-1], np.int64)
        order = np.argsort(pairs)
        self.pair = pairs[order]
        self.rank = np.array([r for r, _ in self.merges.values()] or [len(self.made)], np.int64)[order]
        self.new = np.array(self.made or [-1], np.int64)[order]

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word: always the merge of least rank, the leftmost of equals."""
        ids = [self.byte[b] for b in word]
        if len(ids) < 48:
            none = self.none
            get = self.merges.get
            ranks = [get(p, none)[0] for p in zip(ids, ids[1:])]
            while ranks:
                least = min(ranks)
                if least == none[0]:
                    break
                i = ranks.index(least)
                ids[i] = new = self.made[least]
                del ids[i + 1], ranks[i]
                if i:
                    ranks[i - 1] = get((ids[i - 1], new), none)[0]
                if i < len(ranks):
                    ranks[i] = get((new, ids[i + 1]), none)[0]
            return ids
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := self.merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = new, -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (m := self.merges.get((ids[x], ids[y]))):
                    heapq.heappush(heap, (m[0], x, ids[x], ids[y], m[1]))
        return [i for i in ids if i >= 0]

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and id of the merge of each pair; the rank of none is the number of merges."""
        pair = a << 32 | b
        at = np.minimum(np.searchsorted(self.pair, pair), len(self.pair) - 1)
        known = self.pair[at] == pair
        return np.where(known, self.rank[at], len(self.made)), self.new[at]

    def merge_all(self, words: Sequence[bytes]) -> list[bytes]:
        """Ids of each word as ``merge`` gives them, packed: in each round every word that is not done has one merge."""
        out: list[bytes] = [b""] * len(words)
        for k, word in enumerate(words):
            if len(word) > SHORT_BYTES:
                out[k] = np.array(self.merge(word), "<u4").tobytes()
        own = [k for k, word in enumerate(words) if 0 < len(word) <= SHORT_BYTES]
        for first in range(0, len(own), TOGETHER):
            self._merge_some(words, own[first : first + TOGETHER], out)
        return out

    def _merge_some(self, words: Sequence[bytes], own: list[int], out: list[bytes]) -> None:
        none, done = len(self.made), []
        ids = np.array(self.byte, np.int64)[np.frombuffer(b"".join([words[k] for k in own]), np.uint8)]
        word = np.repeat(np.array(own, np.int64), [len(words[k]) for k in own])
        rank, new = np.full(len(ids), none), np.full(len(ids), -1)
        inner = np.flatnonzero(word[1:] == word[:-1])
        rank[inner], new[inner] = self._ranks(ids[inner], ids[inner + 1])
        while len(ids):
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            size = np.diff(np.append(first, len(ids)))
            least = np.minimum.reduceat(rank, first)
            over = np.repeat(least == none, size)
            if over.any():
                done.append((word[over], ids[over]))
                word, ids, rank, new = word[~over], ids[~over], rank[~over], new[~over]
                size, least = size[least < none], least[least < none]
                if not len(ids):
                    break
            at = np.flatnonzero(rank == np.repeat(least, size))
            at = at[np.concatenate([[True], word[at[1:]] != word[at[:-1]]])]  # the leftmost of equals
            ids[at] = new[at]
            stays = np.ones(len(ids), bool)
            stays[at + 1] = False
            at -= np.arange(len(at))
            word, ids, rank, new = word[stays], ids[stays], rank[stays], new[stays]
            rank[at] = none
            changed = np.concatenate([at[at > 0] - 1, at[at < len(ids) - 1]])
            changed = changed[word[changed] == word[changed + 1]]
            rank[changed], new[changed] = self._ranks(ids[changed], ids[changed + 1])
        for word, ids in done:
            cut = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            packed = ids.astype("<u4").tobytes()
            for k, a, b in zip(word[cut].tolist(), (4 * cut).tolist(), [*(4 * cut[1:]).tolist(), len(packed)]):
                out[k] = packed[a:b]


class Lexicon:
    """A minimal acyclic automaton of words with id lists, in one file that is mapped, not read."""

    HEAD = struct.Struct("<5q")

    @staticmethod
    def compile(entries: Iterable[tuple[bytes, Sequence[int]]], path: str) -> None:
        with open(path, "wb") as f:
            f.write(Lexicon.packed(entries))

    @staticmethod
    def packed(entries: Iterable[tuple[bytes, Sequence[int]]]) -> bytes:
        """The file's bytes."""
        words = sorted(dict(entries).items())
        # Incremental construction from sorted words: what can no longer change is replaced by its equal.
        root: list = [False, {}]
        known: dict[tuple, list] = {}
        path_: list[tuple[list, int, list]] = []

        def fold(down_to: int) -> None:
            while len(path_) > down_to:
                parent, label, child = path_.pop()
                shape = (child[0], tuple((b, id(x)) for b, x in child[1].items()))
                parent[1][label] = known.setdefault(shape, child)

        last = b""
        for word, _ in words:
            same = 0
            while same < min(len(word), len(last)) and word[same] == last[same]:
                same += 1
            fold(same)
            node = path_[-1][2] if path_ else root
            for b in word[same:]:
                child: list = [False, {}]
                node[1][b] = child
                path_.append((node, b, child))
                node = child
            node[0] = True
            last = word
        fold(0)
        # Words below each state, children first (a state's suffixes are acyclic).
        below: dict[int, int] = {}
        order, stack, seen = [], [root], {id(root)}
        while stack:
            node = stack.pop()
            order.append(node)
            for x in node[1].values():
                if id(x) not in seen:
                    seen.add(id(x))
                    stack.append(x)
        number = {id(x): i for i, x in enumerate(order)}
        todo = [(root, False)]
        while todo:
            node, ready = todo.pop()
            if id(node) in below:
                continue
            if ready:
                below[id(node)] = node[0] + sum(below[id(x)] for x in node[1].values())
            else:
                todo.append((node, True))
                todo += [(x, False) for x in node[1].values() if id(x) not in below]
        first, labels, target, skip, final = [0], bytearray(), [], [], bytearray()
        for node in order:
            n = int(node[0])
            final.append(n)
            for b, x in sorted(node[1].items()):
                labels.append(b)
                target.append(number[id(x)])
                skip.append(n)
                n += below[id(x)]
            first.append(len(labels))
        at, ids = [0], []
        for _, out in words:
            ids += out
            at.append(len(ids))
        head = Lexicon.HEAD.pack(len(order), len(labels), len(words), len(ids), 0)
        return head + b"".join(np.array(part, "<i4").tobytes() for part in (first, target, skip, at, ids)) + bytes(final) + bytes(labels)

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        states, moves, self.words, n_ids, _ = self.HEAD.unpack_from(self.map)
        off, parts = self.HEAD.size, []
        for n in (states + 1, moves, moves, self.words + 1, n_ids):
            parts.append(np.frombuffer(self.map, "<i4", n, off))
            off += 4 * n
        self.first, self.target, self.skip, self.at, self.ids = parts
        self.states, self.id_bytes = states, off - 4 * n_ids
        self.final, labels = (np.frombuffer(self.map, np.uint8, n, at) for n, at in ((states, off), (moves, off + states)))
        # A move's key: state and byte; moves are sorted by both.
        self.key = np.repeat(np.arange(states), np.diff(self.first)) << 8 | labels

    def find(self, words: Sequence[bytes]) -> np.ndarray:
        """Each word's number, -1 where there is none: all words walk from state to state at once."""
        size = np.array([len(w) for w in words], np.int64)
        begin, raw = np.cumsum(size) - size, np.frombuffer(b"".join(words), np.uint8)
        state, number = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        on, depth = np.flatnonzero(size), 0
        while len(on):
            key = state[on] << 8 | raw[begin[on] + depth]
            move = np.searchsorted(self.key, key)
            goes = move < len(self.key)
            goes[goes] = self.key[move[goes]] == key[goes]
            state[on[~goes]] = -1
            on, move = on[goes], move[goes]
            state[on] = self.target[move]
            number[on] += self.skip[move]
            depth += 1
            on = on[size[on] > depth]
        ends = (state >= 0) & (self.final[state] > 0)
        return np.where(ends, number, -1)

    def packed_ids(self, numbers: np.ndarray) -> list[bytes]:
        """Ids of the words of these numbers, as little-endian 32-bit integers."""
        begin, end = (self.id_bytes + 4 * self.at[numbers + k].astype(np.int64) for k in (0, 1))
        return [self.map[a:b] for a, b in zip(begin.tolist(), end.tolist())]

    def get(self, word: bytes) -> list[int] | None:
        number = int(self.find([word])[0])
        return None if number < 0 else self.ids[self.at[number] : self.at[number + 1]].tolist()


class Encoder(dict):
    """Piece -> its ids as little-endian unsigned 32-bit integers; a bounded cache before the lexicon.

    When the cache is full it becomes the older half, and pieces met again move to the new one.
    """

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon | None):
        super().__init__()
        self.vocabulary, self.lexicon, self.split, self.older = vocabulary, lexicon, splitter(), {}
        self.cut = re.compile("(" + "|".join(map(re.escape, vocabulary.special)) + ")").split

    def words(self, words: Sequence[str]) -> list[bytes]:
        raw = [w.encode() for w in words]
        number = self.lexicon.find(raw) if self.lexicon else np.full(len(raw), -1)
        merged = iter(self.vocabulary.merge_all([raw[k] for k in np.flatnonzero(number < 0).tolist()]))
        found = iter(self.lexicon.packed_ids(number[number >= 0]) if self.lexicon else ())
        return [next(merged) if n < 0 else next(found) for n in number.tolist()]

    def learn(self, used: set[str]) -> list[str]:
        """Put the ids of the pieces into the cache; returns those too long to stay."""
        if len(self) >= CACHE_PIECES:
            self.older = dict(self)
            self.clear()
        new = used.difference(self)
        known = self.older.keys() & new
        for piece in known:
            self[piece] = self.older[piece]
        new -= known
        whole = [piece for piece in new if piece.isascii() and piece.isalpha()]  # a space and letters: one word
        new.difference_update(whole)
        others = list(new)
        words = [self.split(unpieced(piece)) for piece in others]
        each = list(set().union(*words))
        packed = self.words([*[" " + piece for piece in whole], *each])
        self.update(zip(whole, packed))
        known = dict(zip(each, packed[len(whole) :]))
        self.update((piece, b"".join([known[w] for w in own])) for piece, own in zip(others, words))
        return [piece for some in (whole, others) for piece in some if len(piece) > CACHE_CHARS]

    def encode_all(self, texts: Sequence[str | None]) -> list[bytes]:
        """Packed ids of each text; a text that is none has no ids."""
        special = self.vocabulary.special
        parts = []
        for k, text in enumerate(texts):
            if isinstance(text, str):
                cut = self.cut(text) if any(s in text for s in special) else [text]
                parts += [(k, part, None if part in special else pieces(part, self.split)) for part in cut]
        used: set[str] = set().union(*[own for _, _, own in parts if own])
        long = self.learn(used)
        out: list[bytes] = [b""] * len(texts)
        for k, part, own in parts:
            out[k] += struct.pack("<I", special[part]) if own is None else b"".join(map(self.__getitem__, own))
        for piece in long:
            del self[piece]
        return out

    def decode(self, packed: bytes) -> bytes:
        raw = b"".join(map(self.vocabulary.token.__getitem__, memoryview(packed).cast("I")))
        try:
            raw.decode()
        except UnicodeDecodeError:
            raw = raw.decode("utf-8", "replace").encode()
        return raw


def _encoder(tokenizer: str, name: str) -> Encoder:
    """This worker's encoder; the next task of the same query finds its cache warm."""
    return resident(("bpe", tokenizer, name), lambda: Encoder(Vocabulary(tokenizer), Lexicon(SparkFiles.get(name))))


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n) of the words of at most CACHE_CHARS characters over all documents, summed up in each task before the shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        split, seen = splitter(), Counter()

        def out() -> pd.DataFrame:
            n: dict[str, int] = {}
            for piece, times in seen.items():
                for w in [" " + piece] if piece.isascii() and piece.isalpha() else split(unpieced(piece)):
                    n[w] = n.get(w, 0) + times
            words = [w for w in n if len(w) <= CACHE_CHARS]
            return pd.DataFrame(dict(word=pd.Series(words, dtype=object), n=np.array([n[w] for w in words], np.int64)))

        for pdf in batches:
            for text in pdf["text"]:
                if isinstance(text, str):
                    own = pieces(text, split)
                    if max(map(len, own)) > CACHE_CHARS:
                        long = [w for piece in own if len(piece) > CACHE_CHARS for w in split(unpieced(piece))]
                        seen.update(" " + w for w in long if len(w) <= CACHE_CHARS)
                        own = [piece for piece in own if len(piece) <= CACHE_CHARS]
                    seen.update(own)
                if len(seen) >= COUNT_WORDS:
                    yield out()
                    seen.clear()
        if seen:
            yield out()

    found = docs.select(F.col(text_col).alias("text")).mapInPandas(tidy(run), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(docs: DataFrame, text_col: str = "text", words: int = LEXICON_WORDS) -> list[str]:
    """About ``words`` of the most frequent words of at most CACHE_CHARS characters, which bounds what the driver gets.

    The least count of a frequent word is a quantile of the counts, so nothing is sorted in one place.
    """
    counts = word_counts(docs, text_col)
    scratch = Scratch(docs.sparkSession, "bpe")
    counts = scratch.put(counts, "words")
    total = counts.count()
    if total > words:
        least = counts.agg(F.percentile_approx("n", 1.0 - words / total, 100_000)).collect()[0][0]
        counts = counts.filter(F.col("n") > least)
    found = [r["word"] for r in counts.select("word").collect()]
    scratch.drop("words")
    return found


def build_lexicon(spark: SparkSession, vocabulary: Vocabulary, words: Iterable[str]) -> str:
    """Compile into the shared folder, and hand to the executors; returns the name for SparkFiles."""
    name = f"quillmill-{uuid.uuid4().hex}.lexicon"
    raw = [w.encode() for w in words]
    raw = Lexicon.packed((w, np.frombuffer(ids, "<u4").tolist()) for w, ids in zip(raw, vocabulary.merge_all(raw)))
    spark.sparkContext.addFile(Scratch(spark, "bpe").put_file(raw, name))
    return name


def encode_documents(
    docs: DataFrame, tokenizer: str, text_col: str = "text", keep: Sequence[str] = ("doc_id",), words: int = LEXICON_WORDS,
    results: Sequence[str] = ("ids", "decoded"), lexicon: Iterable[str] | None = None,
) -> DataFrame:
    """(*keep, n_tokens, *results) for each row of docs.

    results: of ids (array<int>), decoded (string), lossless (whether it is the
    text), ids_sha256 (of ids as little-endian 32-bit integers), decoded_sha256.
    """
    spark = docs.sparkSession
    text_batches(spark)
    name = build_lexicon(spark, Vocabulary(tokenizer), frequent_words(docs, text_col, words) if lexicon is None else lexicon)
    inner = {c: f"_k{j}" for j, c in enumerate(dict.fromkeys(keep))}
    rows = docs.select(*[F.col(c).alias(x) for c, x in inner.items()], F.col(text_col).alias("text"))
    kinds = dict(
        ids=T.ArrayType(T.IntegerType()), decoded=T.StringType(), lossless=T.BooleanType(), ids_sha256=T.StringType(), decoded_sha256=T.StringType()
    )
    schema = T.StructType(
        [*[rows.schema[x] for x in inner.values()], T.StructField("n_tokens", T.LongType()), *[T.StructField(r, kinds[r]) for r in results]]
    )
    own = list(inner.values())
    make = dict(
        ids=lambda packed, back, text: np.frombuffer(packed, np.int32),
        decoded=lambda packed, back, text: back.decode(),
        lossless=lambda packed, back, text: back == (text or "").encode("utf-8", "surrogatepass"),
        ids_sha256=lambda packed, back, text: hashlib.sha256(packed).hexdigest(),
        decoded_sha256=lambda packed, back, text: hashlib.sha256(back).hexdigest(),
    )

    def coded_rows(coder: Encoder, batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, list[bytes]]]:
        for pdf in batches:
            packed = coder.encode_all(pdf["text"].tolist())
            for at in range(0, len(pdf), ROWS):
                yield pdf.iloc[at : at + ROWS], packed[at : at + ROWS]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = _encoder(tokenizer, name)
        for pdf, coded in coded_rows(coder, batches):
            n, got = [], [[] for _ in results]
            for text, packed in zip(pdf["text"], coded):
                back = coder.decode(packed)
                n.append(len(packed) // 4)
                for values, r in zip(got, results):
                    values.append(make[r](packed, back, text))
            yield pdf[own].assign(n_tokens=n, **{r: pd.Series(v, dtype=object, index=pdf.index) for r, v in zip(results, got)})

    return rows.mapInPandas(tidy(run, keep=True), schema).withColumnsRenamed({x: c for c, x in inner.items()})


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), tokenizer_path(), results=("ids_sha256", "decoded_sha256"))
