"""Language-model scoring by a probabilistic suffix tree over words.

A text is its lower-cased words and one end.  A node of the tree is a context, the last one, two or
more words (a text's start counts as one).  It is kept if it occurs LEAST times in training texts
and its next-word distribution diverges enough from that of its longest kept suffix: its gain in log
likelihood must pay for its distinct next words.  Next-word distributions are smoothed into the
suffix's, the shortest one being all words, and a word is scored in the longest kept context that
the text before it ends in.  Counts are absolute, so the tree grows with the corpus.

Nothing of the tree reaches the driver or any one task.  The texts are cut into blocks; each is
written once, as word numbers, into the shared folder.  Then blocks and parts take turns: a block
sends the words, n-grams or contexts that it has, each once and dealt by hash into parts, with its
own sums; a part adds up what all blocks sent and answers each block, entry by entry in the order
sent.  Keys are dealt by the hash of the whole n-gram, so a word that a third of all n-grams start
with is spread over all parts, and what repeats inside a block is sent once.  A block works with
its own numbers and the answers only, so any task can be done again.
"""

from __future__ import annotations

import pickle
import struct
import zlib
from collections.abc import Callable, Generator, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from almanac.llm.common import discard, give_back, scratch_path, settled, staged, text_blocks
from almanac.llm.langid import remainder
from almanac.llm.tokenids import put, take

#: Words of the longest context; occurrences that a context needs; gain in log likelihood (nats) that
#: it needs for each distinct next word.
DEPTH, LEAST, GAIN = 2, 2, 0.5
#: Bytes of text of a block.
BLOCK = 10 << 20
#: What stands for a text's end among its words, as no word holds white space, and the hash of its start.
END, START = b"\n", np.uint64(0x5851F42D4C957F2D)
#: Bits of an n-gram's hash that are dropped: 52 stay, so that of 10**13 n-grams one in 450 meets another.
DROPPED = np.uint64(12)

MESSAGE = "block long, part int, keys binary, sums binary"
ANSWER = "block long, part int, answer binary, tokens long, distinct long"


# --- what is sent


def packed(values: np.ndarray) -> bytes:
    """Whole numbers from 0 on, in as few bytes each as the largest needs, compressed."""
    size = next(s for s in (1, 2, 4, 8) if int(values.max(initial=0)) < 1 << (8 * s))
    return bytes([size]) + zlib.compress(values.astype(f"<u{size}").tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data[1:]), dtype=f"<u{data[0]}").astype(np.int64)


def joined(*parts: bytes) -> bytes:
    return struct.pack(f"<{len(parts)}Q", *map(len, parts)) + b"".join(parts)


def split(data: bytes, n: int) -> list[bytes]:
    at, out = 8 * n, []
    for size in struct.unpack_from(f"<{n}Q", data):
        out.append(data[at : at + size])
        at += size
    return out


def packed_keys(keys: np.ndarray) -> bytes:
    """Ascending keys by their differences."""
    steps = np.diff(keys, prepend=np.uint64(0))
    return joined((steps & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes(), packed(steps >> np.uint64(32)))


def unpacked_keys(data: bytes) -> np.ndarray:
    low, high = split(data, 2)
    return np.cumsum(np.frombuffer(low, "<u4").astype(np.uint64) + (unpacked(high).astype(np.uint64) << np.uint64(32)), dtype=np.uint64)


def rounded(values: np.ndarray) -> np.ndarray:
    """Numbers from 0 on with seven binary places of their own, as whole numbers of two bytes."""
    return (np.maximum(values, 0).astype(np.float32).view(np.uint32) + np.uint32(1 << 15)) >> np.uint32(16)


def restored(values: np.ndarray) -> np.ndarray:
    return (values.astype(np.uint32) << np.uint32(16)).view(np.float32).astype(np.float64)


def mixed(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    x = (context ^ (context >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + word
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(27))


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, one place of each, and for every place its key's number."""
    order = np.argsort(keys)
    ranked = keys[order]
    new = np.ones(len(keys), dtype=bool)
    np.not_equal(ranked[1:], ranked[:-1], out=new[1:])
    which = np.empty(len(keys), dtype=np.int32)
    which[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    return ranked[new], order[new], which


def dealt(keys: np.ndarray, sums: list[np.ndarray], parts: int) -> list[tuple[int, bytes, bytes]]:
    """(part, keys, sums) of ascending keys; a part is a range of keys."""
    part = ((keys >> np.uint64(20)) * np.uint64(parts)) >> np.uint64(32)
    cuts = np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))
    return [(p, packed_keys(keys[a:b]), joined(*(packed(x[a:b]) for x in sums))) for p, (a, b) in enumerate(zip(cuts.tolist(), cuts[1:].tolist(), strict=False)) if b > a]


# --- what parts answer


def rows_of(block: list[int], part: int, answers: list[bytes], tokens: int = 0, distinct: int = 0) -> pa.Table:
    n = len(block)
    return pa.table({"block": pa.array(block, pa.int64()), "part": pa.array([part] * n, pa.int32()), "answer": pa.array(answers, pa.binary()), "tokens": pa.array([tokens] + [0] * (n - 1), pa.int64()), "distinct": pa.array([distinct] + [0] * (n - 1), pa.int64())})


def word_sums(rows: pa.Table) -> pa.Table:
    """Answers how often training texts have each word, and adds up tokens and distinct words."""
    rows = rows.sort_by("block")
    lists = [x.split(b" ") for x in rows.column("keys").to_pylist()]
    counts = [unpacked(x) for x in rows.column("sums").to_pylist()]
    at = pa.array([w for x in lists for w in x], pa.binary()).dictionary_encode().indices.to_numpy()
    sums = np.bincount(at, weights=np.concatenate(counts)).astype(np.int64)
    ends = np.cumsum([0, *map(len, lists)])
    answers = [packed(sums[at[a:b]]) for a, b in zip(ends, ends[1:], strict=False)]
    return rows_of(rows.column("block").to_pylist(), rows.column("part")[0].as_py(), answers, int(sums.sum()), int((sums > 0).sum()))


def key_sums(rows: pa.Table, answer: Callable) -> pa.Table:
    rows = rows.sort_by("block")
    keys = [unpacked_keys(x) for x in rows.column("keys").to_pylist()]
    every, _, which = grouped(np.concatenate(keys))
    ends = np.cumsum([0, *map(len, keys)])
    found = answer([split(x, 2) for x in rows.column("sums").to_pylist()], len(every), which)
    answers = [joined(*(packed(x[a:b]) for x in found)) for a, b in zip(ends, ends[1:], strict=False)]
    return rows_of(rows.column("block").to_pylist(), rows.column("part")[0].as_py(), answers)


def gram_sums(rows: pa.Table) -> pa.Table:
    """Answers an n-gram's training count, whether it occurs just once in all texts, and to one block with
    a training occurrence that the n-gram is its to account for."""

    def answer(sums: list[list[bytes]], n: int, which: np.ndarray) -> list[np.ndarray]:
        train, other = (np.concatenate([unpacked(x[k]) for x in sums]) for k in (0, 1))
        total = np.bincount(which, weights=train, minlength=n).astype(np.int64)
        seen = total + np.bincount(which, weights=other, minlength=n).astype(np.int64)
        has = np.flatnonzero(train)
        first = np.full(n, -1)
        first[which[has[::-1]]] = has[::-1]  # of several the last one written, which is the first
        owner = np.zeros(len(which), dtype=np.int64)
        owner[first[first >= 0]] = 2
        return [total[which], owner + (seen == 1)[which]]

    return key_sums(rows, answer)


def context_sums(rows: pa.Table) -> pa.Table:
    """Answers a context's distinct next words and its sum of n (log n - log of the suffix's probability)."""

    def answer(sums: list[list[bytes]], n: int, which: np.ndarray) -> list[np.ndarray]:
        kinds = np.bincount(which, weights=np.concatenate([unpacked(x[0]) for x in sums]), minlength=n)
        gains = np.bincount(which, weights=np.concatenate([restored(unpacked(x[1])) for x in sums]), minlength=n)
        return [kinds.astype(np.int64)[which], rounded(gains).astype(np.int64)[which]]

    return key_sums(rows, answer)


# --- blocks


def block_of(texts: pa.Array, train: np.ndarray) -> dict:
    """A block's words (the end is the last one), their hashes, and the number of each token's word."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    flat = lists.flatten()
    there = pc.binary_length(flat).to_numpy() > 0
    bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    before = np.concatenate(([0], np.cumsum(there)))
    size = np.diff(before[bounds]) + 1
    coded = flat.filter(pa.array(there)).dictionary_encode()
    words = [*coded.dictionary.cast(pa.binary()).to_pylist(), END]
    ends = np.cumsum(size) - 1
    at = np.full(int(size.sum()), len(words) - 1, dtype=np.int32)
    inside = np.ones(len(at), dtype=bool)
    inside[ends] = False
    at[inside] = coded.indices.to_numpy()
    return {"words": words, "hashes": np.array([xxhash.xxh64_intdigest(w) for w in words], dtype=np.uint64), "at": at, "size": size, "train": train}


def word_message(block: dict, parts: int) -> list[tuple[int, bytes, bytes]]:
    part = (block["hashes"] % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    counts = np.bincount(block["at"], weights=np.repeat(block["train"], block["size"]), minlength=len(part)).astype(np.int64)
    cuts = np.searchsorted(part[order], np.arange(parts + 1)).tolist()
    return [(p, b" ".join([block["words"][i] for i in order[a:b]]), packed(counts[order[a:b]])) for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a]


def scoring(block: dict, parts: int, spread: float, depth: int, least: int, gain: float) -> Generator[list, list[bytes], tuple[np.ndarray, ...]]:
    """Yields a block's messages after that of its words, is sent the answers, returns per text: tokens,
    known ones, base score, score."""
    at, size, hashes = block["at"], block["size"], block["hashes"]
    n = len(at)
    train, text = np.repeat(block["train"], size), np.repeat(np.arange(len(size), dtype=np.int32), size)
    first = np.zeros(n, dtype=bool)
    first[np.cumsum(size) - size] = True
    order = np.argsort((hashes % np.uint64(parts)).astype(np.int64), kind="stable")
    count = np.zeros(len(hashes), dtype=np.int64)
    count[order] = np.concatenate([unpacked(x) for x in (yield [])])
    chance = (count + 0.1) / spread
    known = np.bincount(text, weights=(count > 0)[at], minlength=len(size)).astype(np.int64)
    base = np.bincount(text, weights=np.log10(chance)[at], minlength=len(size))
    p = chance[at]
    # of the last k words: hash, training count, whether there is just this one
    gram, seen, alone = hashes[at], count[at], np.zeros(n, dtype=bool)
    for k in range(1, depth + 1):
        context, times = np.roll(gram, 1), np.roll(seen, 1)
        context[first], times[first] = START, count[-1] if k == 1 else 0
        gram = mixed(context, hashes[at])
        valid = times >= least
        sent = np.flatnonzero(valid & ~alone)
        keys, one, which = grouped(gram[sent] >> DROPPED)
        own, other = (np.bincount(which, weights=x, minlength=len(keys)).astype(np.int64) for x in (train[sent], ~train[sent]))
        answer = yield dealt(keys, [own, other], parts)
        del keys, own, other
        found = [split(x, 2) for x in answer]
        total, marks = (np.concatenate([unpacked(x[i]) for x in found]) if found else np.zeros(0, dtype=np.int64) for i in (0, 1))
        # what was alone with one word less is alone
        old = valid & alone
        lone = np.flatnonzero(old & train)
        seen = np.where(old, train, 0)
        seen[sent] = total[which]
        alone[sent] = (marks & 1)[which] > 0
        held = np.flatnonzero(marks >= 2)
        inside = np.flatnonzero(valid)
        contexts, _, of = grouped(context[inside] >> DROPPED)
        number = np.zeros(n, dtype=np.int32)
        number[inside] = of
        # the n-grams that this block accounts for, and those that nobody else has
        where, n_of = np.concatenate((sent[one[held]], lone)), np.concatenate((total[held], np.ones(len(lone), dtype=np.int64)))
        kinds = np.bincount(number[where], minlength=len(contexts))
        gains = np.bincount(number[where], weights=n_of * (np.log(n_of) - np.log(p[where])), minlength=len(contexts))
        del which, one, total, marks, held, where, n_of, number, context
        answer = yield dealt(contexts, [kinds, rounded(gains).astype(np.int64)], parts)
        found = [split(x, 2) for x in answer]
        kinds, gains = (np.concatenate([unpacked(x[i]) for x in found]) if found else np.zeros(0, dtype=np.int64) for i in (0, 1))
        total, kinds, gains = times[inside], kinds[of], restored(gains)[of]
        kept = np.flatnonzero(gains - total * np.log(total) >= gain * kinds)
        to, kinds = inside[kept], kinds[kept]
        p[to] = (seen[to] + kinds * p[to]) / (total[kept] + kinds)
    return size, known, base, np.bincount(text, weights=np.log10(p), minlength=len(size))


def scored(docs: DataFrame, train: str, *, key: str = "doc_id", text: str = "text", depth: int = DEPTH, least: int = LEAST, gain: float = GAIN) -> DataFrame:
    """Per row: ``key``, ``train``, n_tokens, n_known, train_tokens, base_score, score.

    ``train`` names a boolean column: the rows to learn from (null: not).  Tokens are the words and
    one end.  A null text is an empty one: its only token is the end.  Repeated rows stay repeated.
    With no training rows every token has probability 1 in the base model, and in the tree's.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(train), F.lit(False)).alias("train"), F.col(text).cast("string").alias("text"))
    parts, folder, most = text_blocks(rows, text="text", target=BLOCK), scratch_path(spark, "blocks"), BLOCK
    kind = StructType([StructField(key, docs.schema[key].dataType), StructField(train, rows.schema["train"].dataType), *(StructField(x, LongType()) for x in ("n_tokens", "n_known", "train_tokens")), *(StructField(x, DoubleType()) for x in ("base_score", "score"))])

    def messages(block: int, found: list[tuple[int, bytes, bytes]]) -> pa.Table:
        part, keys, sums = zip(*found, strict=True) if found else ((), (), ())
        return pa.table({"block": pa.array([block] * len(part), pa.int64()), "part": pa.array(part, pa.int32()), "keys": pa.array(keys, pa.binary()), "sums": pa.array(sums, pa.binary())})

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        held: list[pa.RecordBatch] = []
        size = number = 0

        def flushed() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).combine_chunks()
            block = block_of(table.column("text").combine_chunks(), table.column("train").to_numpy().astype(bool))
            name = (TaskContext.get().partitionId() << 24) + number
            kept = {**block, "words": None, "key": table.column("key").combine_chunks()}
            put(fs, f"{root}/{name}", [zstandard.compress(pickle.dumps(kept, protocol=5), 1)])
            yield from messages(name, word_message(block, parts)).to_batches()

        for batch in batches:
            share = (size + np.cumsum(pc.binary_length(batch.column("text")).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))) // most
            cuts = [0, *(np.flatnonzero(np.diff(share, prepend=0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                part = batch.slice(a, b - a)
                if part.num_rows:
                    held.append(part)
                    size += pc.sum(pc.binary_length(part.column("text"))).as_py() or 0
                if size >= most:
                    yield from flushed()
                    held, size, number = [], 0, number + 1
        if held:
            yield from flushed()

    def turn(step: int, spread: float) -> Callable[[pa.Table], tuple]:
        """A block's state after the answers of ``step``: its id, keys, and its next message or its results."""

        def run(rows: pa.Table) -> tuple:
            rows = rows.sort_by("part")
            fs, root = pafs.FileSystem.from_uri(folder)
            name = rows.column("block")[0].as_py()
            block = pickle.loads(zstandard.decompress(take(fs, f"{root}/{name}")))
            own = rows.column("answer").to_pylist()
            if step < 2 * depth:  # a later turn needs them
                put(fs, f"{root}/{name}-{step}", [pickle.dumps(own, protocol=5)])
            state = scoring(block, parts, spread, depth, least, gain)
            next(state)
            try:
                for past in range(step):
                    state.send(pickle.loads(take(fs, f"{root}/{name}-{past}")))
                return name, block, state.send(own)
            except StopIteration as done:
                return name, block, done.value
            finally:
                state.close()
                give_back()

        return run

    answers = staged(rows.mapInArrow(cut, MESSAGE).groupBy("part").applyInArrow(word_sums, ANSWER), "answers")
    tokens, distinct = answers.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    spread = tokens + 0.1 * (distinct + 1)

    def sending(step: int) -> Callable[[pa.Table], pa.Table]:
        run = turn(step, spread)

        def send(rows: pa.Table) -> pa.Table:
            name, _, found = run(rows)
            # a block that has nothing to send still waits for an answer
            return messages(name, found or [(name % parts, packed_keys(np.zeros(0, np.uint64)), joined(*[packed(np.zeros(0, np.int64))] * 2))])

        return send

    for step in range(2 * depth):
        sums = gram_sums if step % 2 == 0 else context_sums
        sent = answers.select("block", "part", "answer").groupBy("block").applyInArrow(sending(step), MESSAGE)
        found = staged(sent.groupBy("part").applyInArrow(sums, ANSWER), "answers")
        discard(answers)
        answers = found
        settled(spark)
    last = turn(2 * depth, spread)

    def finish(rows: pa.Table) -> pa.Table:
        _, block, (size, known, base, score) = last(rows)
        n = len(size)
        made = [block["key"], pa.array(block["train"]), pa.array(size, pa.int64()), pa.array(known), pa.array([tokens] * n, pa.int64()), pa.array(base), pa.array(score)]
        return pa.Table.from_arrays(made, names=kind.names)

    return answers.select("block", "part", "answer").groupBy("block").applyInArrow(finish, kind)


def op5_lm(spark, sf_dir: str) -> DataFrame:
    """Every document's base score and score, by a model of the documents that are not held out.

    A null or empty text has the end alone; rows that repeat keep a row each; a null doc_id counts as
    empty text in the choice of what is held out; an empty table gives no rows.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scored(docs.withColumn("train", remainder("doc_id", 10) != 0), "train")
    return found.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
