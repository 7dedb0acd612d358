"""Text and words of image files by an injected scanner, or ready-made tables of them.

A scanner is made once for each task: ``scanner()`` gives a function of image bytes to
{text, confidence 0-100, words: [{text, confidence, x0, y0, x1, y1}], blocks}; what it
doesn't know may be missing.  Without a text, the lines of its ``blocks``
(a list of lists of lines) are joined.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quillmill.functions.text import joined_lines
from quillmill.sources.store import MAX_IMAGE_BYTES

WORDS = "bill_id long, word_ix int, text string, confidence double, x0 double, y0 double, x1 double, y1 double"
TEXTS = "bill_id long, text string, confidence double"
FILE_WORDS = "path string, " + WORDS.partition(", ")[2] + ", failed string"
FILE_TEXTS = "path string, text string, confidence double, failed string"
KINDS = (".jpg", ".jpeg", ".png")
#: Bytes of images in one task of the file source.
TASK_BYTES = 64 << 20

Scanner = Callable[[], Callable[[bytes], dict]]


def text_of(seen: dict) -> str:
    if seen.get("text") is not None:
        return seen["text"]
    return "\n".join(line.strip() for block in seen.get("blocks") or () for line in block)


def _share(seen: dict) -> float:
    return (seen.get("confidence") or 0) / 100


def _words(seen: dict) -> list[tuple]:
    def number(w: dict, name: str) -> float | None:
        return None if w.get(name) is None else float(w[name])

    return [
        (k, (w.get("text") or "").strip(), float(w.get("confidence") or 0), *(number(w, c) for c in ("x0", "y0", "x1", "y1")))
        for k, w in enumerate(seen.get("words") or ())
    ]


def scan(images: DataFrame, scanner: Scanner, words: bool = False) -> DataFrame:
    """images: (bill_id, content binary).  Returns TEXTS rows (confidence 0-1), or WORDS rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = scanner()
        for pdf in batches:
            seen = [(i, read(bytes(c))) for i, c in zip(pdf["bill_id"], pdf["content"])]
            if words:
                rows = [(i, *w) for i, s in seen for w in _words(s)]
                yield pd.DataFrame(rows, columns=["bill_id", "word_ix", "text", "confidence", "x0", "y0", "x1", "y1"])
            else:
                yield pd.DataFrame([(i, text_of(s), _share(s)) for i, s in seen], columns=["bill_id", "text", "confidence"])

    return images.select("bill_id", "content").mapInPandas(run, WORDS if words else TEXTS)


class ScanSource(DataSource):
    """``spark.read.format("scans").option("scanner", "module:name").load(folder)``: each image file of a folder, scanned.

    Options: ``scanner``, where tasks import it from; ``words`` (true: a row for each word,
    else one for each file); ``maxBytes``.  Files of other kinds or beyond
    the size, and those on which the scanner fails, are rows with
    ``failed``.  The folder may be in any store that Arrow opens; for others read
    ``store.images`` and ``scan`` them.
    """

    @classmethod
    def name(cls) -> str:
        return "scans"

    def _words(self) -> bool:
        return self.options.get("words", "false").lower() == "true"

    def schema(self) -> str:
        return FILE_WORDS if self._words() else FILE_TEXTS

    def reader(self, schema) -> DataSourceReader:
        for needed in ("path", "scanner"):
            if not self.options.get(needed):
                raise ValueError(f"scans needs the option {needed}")
        return ScanReader(self.options["path"], self.options["scanner"], self._words(), int(self.options.get("maxBytes", MAX_IMAGE_BYTES)))


class ScanReader(DataSourceReader):
    def __init__(self, path: str, scanner: str, words: bool, most: int):
        self.path, self.scanner, self.words, self.most = path, scanner, words, most

    def _store(self) -> tuple:
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)

    def partitions(self) -> list[InputPartition]:
        """Files, in the order of their names, in groups of about TASK_BYTES."""
        from pyarrow import fs

        files, folder = self._store()
        groups, size = [[]], 0
        for f in sorted(files.get_file_info(fs.FileSelector(folder, recursive=True)), key=lambda f: f.path):
            if f.type != fs.FileType.File or f.base_name[0] in "._":
                continue
            if groups[-1] and size + min(f.size, self.most) > TASK_BYTES:
                groups.append([])
                size = 0
            groups[-1].append((f.path, f.size))
            size += min(f.size, self.most)
        return [InputPartition(g) for g in groups]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        module, _, name = self.scanner.partition(":")
        files, read = self._store()[0], None
        for path, size in partition.value:
            why = None if path.lower().endswith(KINDS) else "no JPG or PNG file"
            why = why or (f"over {self.most} bytes" if size > self.most else None)
            if not why:
                try:
                    read = read or getattr(importlib.import_module(module), name)()
                    with files.open_input_stream(path) as f:
                        seen = read(f.read())
                    rows = [(path, *w, None) for w in _words(seen)] if self.words else [(path, text_of(seen), _share(seen), None)]
                except (ImportError, AttributeError):
                    raise  # no scanner, no result
                except Exception as e:
                    why = f"{type(e).__name__}: {e}"
            if why:
                rows = [(path, *[None] * (7 if self.words else 2), why)]
            yield from rows


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ScanSource)


def words_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(WORDS).parquet(path)


def text_of_blocks(blocks: Column) -> Column:
    """The text of blocks of lines, array<array<string>>."""
    return joined_lines(F.flatten(F.transform(blocks, lambda b: F.coalesce(b, F.array().cast("array<string>")))))


def text_of_words(words: DataFrame) -> DataFrame:
    """(bill_id, text): words of one height joined by spaces, lines by line breaks."""
    lines = words.groupBy("bill_id", "y0").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x0", "word_ix", "text"))), lambda x: x["text"]), " ").alias("l"))
    return lines.groupBy("bill_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("y0", "l"))), lambda x: x["l"]), "\n").alias("text"))
