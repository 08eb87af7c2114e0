"""Language identification of mixed-language text: scripts, trigram scores per word, Viterbi.

A model holds, per language, log shares of the hashed character trigrams (with word edges) that it
was seen with, and the scripts that it writes.  A word's script narrows the candidates: it is scored
for the languages that write the script, and the others are set far behind the last of those.
Viterbi over the words, with a penalty for each change of language, labels spans.  A text's language is the one that labels most of its letters,
and its score is that share.

Scores, windows and the Viterbi recursion run as numpy operations over many documents at once.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from almanac.llm.common import give_back, staged

#: Hash buckets of trigrams: a language has at most as many log shares.
BUCKETS = 1 << 15
#: Sums that the driver gathers for a model at most (16 bytes each); with more it fails, as it drops no language.
SUMS = 1 << 24
#: Cost of changing the language between two words, in nats, and of a language not written in the word's script.
SWITCH, FOREIGN = 12.0, 60.0
#: Share of a language's letters from which on it writes a script.
WRITES = 0.01
#: Characters that are scored at a time, fewer if there are many languages.
CHUNK = 1 << 20
GAP = re.compile(r"\s")

#: First code points of script ranges and the script's number there (Unicode blocks).
RANGES = [
    (0x0000, 0), (0x0370, 1), (0x0400, 2), (0x0530, 3), (0x0590, 4), (0x0600, 5), (0x0780, 6), (0x0900, 7),
    (0x0980, 8), (0x0A00, 9), (0x0A80, 10), (0x0B00, 11), (0x0B80, 12), (0x0C00, 13), (0x0C80, 14), (0x0D00, 15),
    (0x0D80, 16), (0x0E00, 17), (0x0E80, 18), (0x0F00, 19), (0x1000, 20), (0x10A0, 21), (0x1100, 22), (0x1200, 23),
    (0x1380, 24), (0x1780, 25), (0x1800, 26), (0x1E00, 0), (0x1F00, 1), (0x2000, 0), (0x2DE0, 2), (0x2E00, 27),
    (0x3040, 28), (0x3100, 27), (0x3130, 22), (0x3190, 27), (0xA640, 2), (0xA6A0, 24), (0xA720, 0), (0xA800, 24),
    (0xAC00, 22), (0xD7B0, 24), (0xF900, 27), (0xFB00, 0), (0xFB1D, 4), (0xFB50, 5), (0xFE00, 24), (0xFE70, 5),
    (0xFF00, 0), (0xFF66, 28), (0xFFA0, 22), (0x10000, 24), (0x20000, 27), (0x30000, 27), (0x40000, 24),
]
SCRIPTS = 29


@cache
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per code point: its lower case (0 where it is no part of a word), whether it is a letter, its script."""
    size = 0x110000
    lower, letter = np.zeros(size, dtype=np.uint32), np.zeros(size, dtype=bool)
    for i in range(0x32000):  # no letters are assigned beyond
        c = chr(i)
        if c.isalpha():
            small = c.lower()
            lower[i], letter[i] = ord(small) if len(small) == 1 else i, True
        elif unicodedata.category(c)[0] == "M":
            lower[i] = i
    script = np.zeros(size, dtype=np.uint8)
    for (start, number), (end, _) in zip(RANGES, [*RANGES[1:], (size, 0)], strict=True):
        script[start:end] = number
    return lower, letter, script


@dataclass
class Words:
    """Words of several texts put one after another: per window its bucket and word, per word its facts."""

    buckets: np.ndarray  #: bucket of each trigram window
    first: np.ndarray  #: first window of each word
    start: np.ndarray  #: first code point of each word, in the joined texts
    end: np.ndarray
    letters: np.ndarray
    script: np.ndarray


def cut(codes: np.ndarray) -> Words:
    """Words of code points in which anything but letters and marks separates words."""
    lower, letter, script = tables()
    padded = np.zeros(len(codes) + 2, dtype=np.uint32)
    padded[1:-1] = lower[codes]
    inside = padded != 0
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]  # positions in codes
    middle = np.flatnonzero(inside[1:-1])
    mixed = padded[middle] * np.uint32(0x9E3779B1) ^ padded[middle + 1] * np.uint32(0x85EBCA6B) ^ padded[middle + 2] * np.uint32(0xC2B2AE35)
    buckets = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(17)
    size = end - start
    first = np.cumsum(size) - size
    count = np.concatenate(([0], np.cumsum(letter[codes])))
    return Words(buckets, first, start, end, count[end] - count[start], script[codes[start]] if len(start) else np.zeros(0, np.uint8))


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def pieces(text: str, size: int = CHUNK) -> Iterator[tuple[int, str]]:
    """Parts of a long text with their offsets, cut at the first white space behind ``size`` characters.

    No word is cut: what has no white space stays in one part.
    """
    at = 0
    while at < len(text):
        gap = GAP.search(text, at + size)
        to = gap.start() if gap else len(text)
        yield at, text[at:to]
        at = to


def viterbi(scores: np.ndarray, sizes: np.ndarray, switch: float) -> np.ndarray:
    """Best label of each word.  ``scores``: words x languages, texts one after another; ``sizes``: their words."""
    labels = np.zeros(len(scores), dtype=np.int32)
    if not len(scores):
        return labels
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] > 0]
    starts, size = (np.cumsum(sizes) - sizes)[order], sizes[order]
    best = scores[starts].copy()
    moved, source = np.zeros(scores.shape, dtype=bool), np.zeros(len(scores), dtype=np.int32)
    live = np.searchsorted(-size, -np.arange(size[0]), side="left")  # texts with more than t words
    for t in range(1, size[0]):
        k = live[t]
        at, old = starts[:k] + t, best[:k]
        top = old.argmax(axis=1)
        jump = (old[np.arange(k), top] - switch)[:, None]
        moves = old < jump
        moved[at], source[at] = moves, top
        best[:k] = np.where(moves, jump, old) + scores[at]
    now = best.argmax(axis=1)
    for t in range(size[0] - 1, -1, -1):
        k = live[t]
        at = starts[:k] + t
        labels[at] = now[:k]
        now[:k] = np.where(moved[at, now[:k]], source[at], now[:k])
    return labels


@dataclass
class Model:
    langs: list[str]
    at: list[np.ndarray]  #: per language the buckets it was seen with
    logs: list[np.ndarray]  #: and their log shares
    unseen: np.ndarray  #: log share of a bucket it was not seen with
    writes: np.ndarray  #: scripts x languages

    def row(self, i: int) -> np.ndarray:
        """A language's log shares of all buckets."""
        out = np.full(BUCKETS, self.unseen[i], dtype=np.float32)
        out[self.at[i]] = self.logs[i]
        return out

    def scores(self, words: Words) -> np.ndarray:
        """Words x languages.  A word in a script that no learned language writes is neutral."""
        n, windows = len(words.start), len(words.buckets)
        out = np.zeros((n, len(self.langs)), dtype=np.float32)
        size = np.diff(np.append(words.first, windows))
        for script in np.flatnonzero(np.bincount(words.script)) if n else ():
            candidates = np.flatnonzero(self.writes[script])
            own = np.flatnonzero(words.script == script)
            if not len(candidates):
                continue
            first = np.cumsum(size[own]) - size[own]
            at = slice(None) if len(own) == n else np.repeat(words.first[own] - first, size[own]) + np.arange(size[own].sum())
            found = np.stack([np.add.reduceat(self.row(i)[words.buckets[at]], first) for i in candidates], axis=1)
            out[own] = found.min(axis=1, keepdims=True) - FOREIGN
            out[np.ix_(own, candidates)] = found
        return out

    def labelled(self, texts: list[str], switch: float = SWITCH) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Per text: its number and, per word, label, letters, start and end."""
        most = CHUNK * 8 // max(8, len(self.langs)) + 1
        batch, size = [], 0
        for i, text in enumerate(texts):
            batch.append(i)
            size += len(text)
            if size >= most or i + 1 == len(texts):
                yield from self._labelled(texts, batch, switch, most)
                batch, size = [], 0

    def _labelled(self, texts, batch, switch, most):
        scores, letters, starts, ends, sizes = [], [], [], [], []
        short = sum(len(texts[i]) + 1 for i in batch) <= 2 * most
        if short:  # all at once
            words = cut(codes_of("\n".join(texts[i] for i in batch)))
            at = np.cumsum([0, *(len(texts[i]) + 1 for i in batch)])
            where = np.searchsorted(words.start, at)
            sizes = np.diff(where)
            base = np.repeat(at[:-1], sizes)
            scores, letters, starts, ends = self.scores(words), words.letters, words.start - base, words.end - base
        else:
            for i in batch:
                n = 0
                for offset, part in pieces(texts[i], most):
                    words = cut(codes_of(part))
                    scores.append(self.scores(words))
                    letters.append(words.letters)
                    starts.append(words.start + offset)
                    ends.append(words.end + offset)
                    n += len(words.start)
                sizes.append(n)
            sizes, scores, letters, starts, ends = np.array(sizes), np.concatenate(scores), np.concatenate(letters), np.concatenate(starts), np.concatenate(ends)
        labels = viterbi(scores, sizes, switch)
        at = np.cumsum([0, *sizes])
        for k, i in enumerate(batch):
            own = slice(at[k], at[k + 1])
            yield i, labels[own], letters[own], starts[own], ends[own]


def fit(docs: DataFrame, *, text: str = "text", lang: str = "lang") -> Model | None:
    """Learns from all rows with a text and a language; None if there are none.

    Every language is learned, however few its texts; one whose texts have no letter has no candidate
    word.  Trigrams are counted in the tasks and summed by Spark; the sums that are not zero reach
    the driver, SUMS of them at most.
    """
    width = BUCKETS + SCRIPTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def rows():
            for name, found in sums.items():
                at = np.flatnonzero(found)
                yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * len(at), pa.string()), "at": pa.array(at), "n": pa.array(found[at])})
            sums.clear()

        for batch in batches:
            names, texts = batch.column("lang").to_pylist(), batch.column("text")
            for i, name in enumerate(names):
                found = sums.setdefault(name, np.zeros(width, dtype=np.int64))
                for _, part in pieces(texts[i].as_py()):
                    words = cut(codes_of(part))
                    found[:BUCKETS] += np.bincount(words.buckets, minlength=BUCKETS)
                    found[BUCKETS:] += np.bincount(words.script, weights=words.letters, minlength=SCRIPTS).astype(np.int64)
                if len(sums) > 100:
                    yield from rows()
        yield from rows()
        give_back()

    known = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null")
    sums = known.mapInArrow(count, "lang string, at long, n long").groupBy("lang", "at").agg(F.sum("n").alias("n"))
    sums = staged(sums, "trigrams")
    if sums.count() > SUMS:
        raise ValueError("the languages have more trigrams than one model holds")
    found = sums.toArrow()
    names = found["lang"].combine_chunks().dictionary_encode()
    if not len(names):
        return None
    number, at, n = names.indices.to_numpy(), found["at"].to_numpy(), found["n"].to_numpy().astype(np.float64)
    order = sorted(range(len(names.dictionary)), key=lambda i: names.dictionary[i].as_py())
    bounds = np.argsort(number, kind="stable")
    ends = np.concatenate(([0], np.cumsum(np.bincount(number))))
    seen, logs, unseen, scripts = [], [], [], np.zeros((len(order), SCRIPTS))
    for k, i in enumerate(order):
        own = bounds[ends[i] : ends[i + 1]]
        grams = own[at[own] < BUCKETS]
        total = n[grams].sum() + 0.5 * BUCKETS
        seen.append(at[grams])
        logs.append(np.log((n[grams] + 0.5) / total).astype(np.float32))
        unseen.append(np.log(0.5 / total))
        other = own[at[own] >= BUCKETS]
        scripts[k, at[other] - BUCKETS] = n[other]
    writes = (scripts >= WRITES * scripts.sum(axis=1, keepdims=True)) & (scripts > 0)
    return Model([names.dictionary[i].as_py() for i in order], seen, logs, np.array(unseen), writes.T)


def identified(docs: DataFrame, model: Model | None, *, text: str = "text", switch: float = SWITCH, spans: bool = True) -> DataFrame:
    """Adds lang_pred, lang_score (0 to 1) and, if asked for, lang_spans to all columns of ``docs``.

    Spans are (start, end, lang) in code points, from the first word of one language to its last.
    A null text, a text without letters, or any text where nothing was learned: und, 0.0, no spans.
    Between languages with as many letters the first by name is taken.
    """
    extra = [StructField("lang_pred", StringType()), StructField("lang_score", DoubleType())]
    if spans:
        span = StructType([StructField("start", LongType()), StructField("end", LongType()), StructField("lang", StringType())])
        extra.append(StructField("lang_spans", ArrayType(span)))
    names = [x.name for x in extra]
    kept = [c for c in docs.columns if c not in names]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = [x or "" for x in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            n = len(texts)
            pred, score, found = ["und"] * n, [0.0] * n, [[] for _ in range(n)]
            for i, labels, letters, starts, ends in model.labelled(texts, switch) if model else ():
                share = np.bincount(labels, weights=letters, minlength=len(model.langs))
                if share.sum():
                    top = int(share.argmax())
                    pred[i], score[i] = model.langs[top], float(share[top] / share.sum())
                if spans and len(labels):
                    new = np.flatnonzero(np.diff(labels, prepend=-1))
                    last = np.append(new[1:], len(labels)) - 1
                    found[i] = [{"start": int(a), "end": int(b), "lang": model.langs[x]} for a, b, x in zip(starts[new], ends[last], labels[new], strict=True)]
            made = [pa.array(pred, pa.string()), pa.array(score, pa.float64())]
            if spans:
                made.append(pa.array(found, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))))
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, *names])
            give_back()

    rows = docs.select(*kept)
    return rows.mapInArrow(label, StructType([*rows.schema.fields, *extra]))


def remainder(key: str, by: int) -> Column:
    """crc32 of a key as text, modulo ``by``; a null key counts as empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % by


def op4_langid(spark, sf_dir: str) -> DataFrame:
    """Every document's language by a model of the documents that are not held out.

    A null or empty text, one without letters, and every text where nothing was learned: und, 0.0.
    Rows that repeat keep a row each; a null doc_id counts as empty text; an empty table gives no rows.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = fit(docs.where(remainder("doc_id", 3) != 1))
    found = identified(docs.select("doc_id", "text"), model, spans=False)
    return found.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
