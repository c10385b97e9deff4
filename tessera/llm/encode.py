"""Encoding of the corpus with a public byte-level tokenizer.

One pass counts the words of all documents; the most frequent (a documented bound) are
compiled with their ids into the transducer of ``lexicon``, written once to the shared
folder and memory-mapped by every task. Words it lacks are merged exactly.

Defined results: null and empty texts give an empty list; a special token's string in a
text is ordinary text; rows that repeat give a result each.
"""

from __future__ import annotations

from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.lexicon import Lexicon, compile_words, merge, ranks, split, tokenizer_file
from tessera.runtime import Scratch, local_path

#: Words that the transducer holds at most, and distinct words that a task keeps at once.
FREQUENT, HELD = 50_000, 200_000


def _count(batches):
    seen: Counter = Counter()

    def out():
        short = [(w, n) for w, n in seen.items() if len(w) <= 64]
        return pa.RecordBatch.from_arrays([pa.array([w for w, _ in short], pa.string()), pa.array([n for _, n in short], pa.int64())], names=["word", "n"])

    for b in batches:
        for t in b.column(0).to_pylist():
            if t:
                seen.update(split(t))
        if len(seen) > HELD:
            yield out()
            seen = Counter()
    if seen:
        yield out()


def frequent_words(df: DataFrame, text_col: str = "text", k: int = FREQUENT) -> DataFrame:
    """(word, n) of the k most frequent words of at most 64 characters, ties by word."""
    n = df.select(text_col).mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return n.orderBy(F.desc("n"), "word").limit(k)


class Encoder(dict):
    """Encodes in a task: the ids of the words met, first from the mapped transducer, for words that it lacks by merges."""

    def __init__(self, vocabulary: str, lexicon: Lexicon | None):
        super().__init__()
        self.rank, self.lexicon = ranks(vocabulary), lexicon

    def __missing__(self, w: str) -> list[int]:
        b = w.encode("utf-8", "surrogatepass")
        got = self.lexicon.get(b) if self.lexicon is not None else None
        if got is None:
            got = merge(b, self.rank)
        if len(self) >= HELD:
            self.clear()
        if len(w) <= 64:
            self[w] = got
        return got

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(map(self.__getitem__, split(text)))) if text else []

    def count(self, text: str | None) -> int:
        return sum(map(len, map(self.__getitem__, split(text)))) if text else 0


def _encoder(df: DataFrame, text_col: str, vocabulary: str, k: int):
    """A function that gives a task its encoder."""
    spark = df.sparkSession
    rank = ranks(vocabulary)
    words = {w: merge(w, rank) for w in (r.word.encode("utf-8", "surrogatepass") for r in frequent_words(df, text_col, k).collect())}
    lexicon = compile_words(words)
    keep = Scratch(spark)
    folder = keep.path("lexicon")
    if folder.startswith(("file:", "/")):
        folder = local_path(folder)
        lexicon.save(folder)
        return lambda: Encoder(vocabulary, Lexicon.mapped(folder))
    held = spark.sparkContext.broadcast({n: getattr(lexicon, n) for n in Lexicon.NAMES})  # at most FREQUENT words
    return lambda: Encoder(vocabulary, Lexicon(held.value))


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, k: int = FREQUENT) -> DataFrame:
    """(id_col, ids array<int>) of every row."""
    make = _encoder(df, text_col, vocabulary or tokenizer_file(), k)
    kind = dict(df.dtypes)[id_col]

    def run(batches):
        e = make()
        for b in batches:
            got = [e.encode(t) for t in b.column(1).to_pylist()]
            at = np.cumsum([0, *map(len, got)]).astype(np.int32)
            flat = np.fromiter(chain.from_iterable(got), np.int32, int(at[-1]))
            ids = pa.ListArray.from_arrays(pa.array(at), pa.array(flat))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], names=[id_col, "ids"])

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, k: int = FREQUENT) -> DataFrame:
    """(id_col, n_tokens int) of every row."""
    make = _encoder(df, text_col, vocabulary or tokenizer_file(), k)
    kind = dict(df.dtypes)[id_col]

    def run(batches):
        e = make()
        for b in batches:
            n = pa.array([e.count(t) for t in b.column(1).to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), n], names=[id_col, "n_tokens"])

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens int")
