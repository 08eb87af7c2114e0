"""Token ids as files: canonical length-limited Huffman codes in blocks that decode on their own.

1.  Documents are dealt by ranges of their key (rows of one key by a hash of their text and their
    number, so that no key is too many for a task) and sorted; each range is tokenized into one raw
    part file, and the ids are counted.  Spark sums the counts; one count per vocabulary id reaches
    the driver, where package-merge gives code lengths.
2.  Each part becomes one coded file: code lengths, keys, document lengths, the bit offset of every
    block, then the bits.
3.  Reading decodes all blocks of a file side by side with one table look-up a symbol.

File names depend on the range only and a file appears when it is whole, so repeated tasks replace
what they wrote.  The raw files go when all coded files are there, not before: a task of either step
may run again at any time.
"""

from __future__ import annotations

import os
import posixpath
import struct
import unicodedata
import uuid
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from almanac.llm.common import give_back, removed, scratch_path, staged, text_blocks

#: Bits of the longest code (where the vocabulary allows it), symbols in a block.
LONGEST, BLOCK = 16, 512
MAGIC = b"ALMTOK1\n"
END_ID = 1
#: Bytes of text that one file holds on average.
FILE = 32 << 20
#: Words that a worker remembers the ids of, a young and an old generation of this many; bytes of text
#: whose chunks are looked up together; ids that are packed together.
REMEMBERED, TOGETHER, PACKED = 200_000, 8 << 20, 1 << 19
#: ASCII punctuation that is cut from the end of a word; the tokenizer treats an apostrophe in its own way.
TAIL = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def word_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def stays_letters(word: str) -> bool:
    """Whether a word is letters and nothing else after the tokenizer composed and lower-cased it.

    A dotted capital I, for one, becomes an i and a combining dot, and the tokenizer puts that dot
    together with the punctuation behind it.  Letters are those of an old version of Unicode, which
    are letters in every later one, whatever version the tokenizer was built with.
    """
    return word.isascii() or all(unicodedata.ucd_3_2_0.category(c)[0] == "L" for c in unicodedata.normalize("NFC", word).lower())


class Encoder:
    """Ids of texts by the tokenizers library, one chunk between ASCII white space at a time.

    The tokenizer drops white space and lower-cases, so a text's ids are those of its chunks, and
    the ids of what stays letters with punctuation behind it those of either part; the tests hold
    this against whole texts.  Ids of lower-case words are remembered within a bound.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.size = max(vocab.values()) + 1
        self.kind = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.ends = np.zeros(self.size, dtype=bool)
        for token, i in vocab.items():
            self.ends[i] = token.endswith("</w>")
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def raw(self, ids: list[int]) -> bytes:
        return np.array(ids, dtype=self.kind).tobytes()

    def each(self, chunks: list[str]) -> Iterator[tuple[str, bytes]]:
        for chunk, found in zip(chunks, self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False), strict=True):
            yield chunk, self.raw(found.ids)

    def letters(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """Words of letters only: a run of them is encoded at once and cut at word ends."""
        for at in range(0, len(words), 1000):
            part = words[at : at + 1000]
            found = self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)
            ids = np.array(found[0].ids, dtype=self.kind)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(part) or cuts[-1] != len(ids):
                yield from self.each(part)
                continue
            raw, size = ids.tobytes(), self.kind.itemsize
            ends = (cuts * size).tolist()
            yield from zip(part, map(raw.__getitem__, map(slice, [0, *ends[:-1]], ends)), strict=True)

    def looked_up(self, stems: pa.Array) -> list[bytes]:
        """Ids of each stem: a lower-case word, remembered, or a chunk of anything else."""
        if len(self.young) > REMEMBERED:
            self.old, self.young = self.young, {}
        names, plain = stems.to_pylist(), pc.utf8_is_alpha(stems).to_pylist()
        found = list(map(self.young.get, names))
        missing, other, old = [], [], self.old.get
        for i in [i for i, x in enumerate(found) if x is None]:
            word = names[i]
            if not plain[i]:
                other.append(i)
            elif (x := old(word)) is None:
                missing.append(i)
            else:
                found[i] = self.young[word] = x
        for at, encode in ((missing, self.letters), (other, self.each)):
            for i, (word, ids) in zip(at, encode([names[i] for i in at]), strict=True):
                found[i] = ids
                if plain[i]:
                    self.young[word] = ids
        return found

    def __call__(self, texts: pa.Array) -> Iterator[bytes]:
        """Ids of each text (null: none) as little-endian numbers; a few texts at a time share a look-up."""
        texts = texts.fill_null("")
        share = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)) // TOGETHER
        cuts = [0, *(np.flatnonzero(np.diff(share)) + 1).tolist(), len(texts)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield from self.together(texts.slice(a, b - a))

    def together(self, texts: pa.Array) -> Iterator[bytes]:
        lists = pc.ascii_split_whitespace(texts)
        coded = lists.flatten().dictionary_encode()
        chunks, at = coded.dictionary, coded.indices.to_numpy()
        low = pc.ascii_lower(chunks)
        core = pc.ascii_rtrim(low, characters=TAIL)
        letters = pc.utf8_is_alpha(core).to_numpy(zero_copy_only=False).copy()
        wide = np.flatnonzero(letters & ~pc.string_is_ascii(core).to_numpy(zero_copy_only=False))
        letters[wide] = [stays_letters(x) for x in core.take(pa.array(wide)).to_pylist()]
        plain = pa.array(letters)
        stems = pc.if_else(plain, core, chunks).dictionary_encode()
        behind = (pc.binary_length(low).to_numpy() - pc.binary_length(core).to_numpy()) * letters
        has = np.flatnonzero(behind)
        tails = pa.array([x[-k:] for x, k in zip(low.take(pa.array(has)).to_pylist(), behind[has].tolist(), strict=True)], pa.string()).dictionary_encode()
        # every chunk is a stem and what stands behind it, number 0 being nothing
        parts = [b"", *self.looked_up(stems.dictionary), *(x for _, x in self.each(tails.dictionary.to_pylist()))]
        size = np.array([len(x) for x in parts]) // self.kind.itemsize
        table = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))).astype(np.int32)), pa.array(np.frombuffer(b"".join(parts), dtype=self.kind)))
        pair = np.zeros((len(chunks), 2), dtype=np.int64)
        pair[:, 0] = stems.indices.to_numpy() + 1
        pair[has, 1] = tails.indices.to_numpy() + 1 + len(stems.dictionary)
        used = pair[at].ravel()
        ids = table.take(pa.array(used)).flatten().to_numpy().tobytes()
        ends = np.concatenate(([0], np.cumsum(size[used]))) * self.kind.itemsize
        where = ends[2 * np.asarray(lists.offsets)].tolist()
        for a, b in zip(where, where[1:], strict=False):
            yield ids[a:b]


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Lengths of an optimal prefix code with no code longer than ``longest`` bits (package-merge)."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), dtype=np.uint8)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    longest = max(longest, int(len(used) - 1).bit_length())
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(np.int64)
    n = len(order)
    # each level: merged list of leaves and packages of the level below, with flags of the leaves
    levels, packages = [], np.zeros(0, dtype=np.int64)
    for _ in range(longest):
        both = np.concatenate((weight, packages))
        at = np.argsort(both, kind="stable")
        levels.append(at < n)
        merged = both[at]
        even = len(merged) // 2 * 2
        packages = merged[0:even:2] + merged[1:even:2]
    depth, take = np.zeros(n, dtype=np.int64), 2 * n - 2
    for leaf in reversed(levels):
        chosen = leaf[:take]
        leaves = int(chosen.sum())
        depth[:leaves] += 1
        take = 2 * (len(chosen) - leaves)
    lengths[order] = depth
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of length and id, from the lengths alone."""
    codes = np.zeros(len(lengths), dtype=np.uint32)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    code, last = 0, 0
    for i in order.tolist():
        size = int(lengths[i])
        code <<= size - last
        codes[i], last = code, size
        code += 1
    return codes


def packed(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bits of ``ids`` in big-endian 16-bit words, and the bit at which each block starts.

    Every PACKED ids start a new word, so that long parts are packed piece by piece.
    """
    words, starts, done = [], [], 0
    for first in range(0, len(ids), PACKED):
        part = ids[first : first + PACKED]
        size = lengths[part].astype(np.int64)
        at = np.cumsum(size) - size
        total = -(-int(at[-1] + size[-1]) // 16)
        wide = codes[part].astype(np.int64) << (48 - size - (at & 15))  # three words, for codes of up to 33 bits
        at >>= 4
        out = np.zeros(total + 3)
        for k in range(3):
            out += np.bincount(at + k, weights=(wide >> (32 - 16 * k)) & 0xFFFF, minlength=len(out))
        words.append(out[:total].astype(">u2").tobytes())
        starts.append((np.cumsum(size) - size)[::BLOCK] + 16 * done)
        done += total
    return b"".join([*words, bytes(8)]), np.concatenate(starts) if starts else np.zeros(0, dtype=np.int64)


def unpacked(bits: bytes, starts: np.ndarray, n: int, lengths: np.ndarray) -> np.ndarray:
    """The ids back: all blocks take one symbol a step from a table of every window of bits."""
    if not n:
        return np.zeros(0, dtype=np.uint32)
    longest = int(lengths.max())
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    spans = 1 << (longest - lengths[order].astype(np.int64))
    symbol, step = np.repeat(order, spans).astype(np.uint32), np.repeat(lengths[order], spans).astype(np.int64)
    fill = (1 << longest) - len(symbol)  # codes that no symbol has, as with one symbol only
    symbol, step = np.pad(symbol, (0, fill)), np.pad(step, (0, fill), constant_values=1)
    words = np.frombuffer(bits, dtype=">u2").astype(np.uint64)
    windows = words[:-2] << np.uint64(32) | words[1:-1] << np.uint64(16) | words[2:]
    out = np.zeros((BLOCK, len(starts)), dtype=np.uint32)
    at = starts.astype(np.int64)
    whole, rest = divmod(n, BLOCK)
    down, mask = 48 - longest, (1 << longest) - 1
    for k in range(BLOCK):
        if k == rest:
            at = at[:whole]
        if not len(at):
            break
        window = (windows[at >> 4] >> (down - (at & 15)).astype(np.uint64)).astype(np.int64) & mask
        out[k, : len(at)] = symbol[window]
        at = at + step[window]
    return out.T.reshape(-1)[:n]


def put(fs, path: str, data: list[bytes]) -> None:
    draft = posixpath.join(posixpath.dirname(path), f"_draft-{uuid.uuid4().hex}")
    with fs.open_output_stream(draft) as out:
        for part in data:
            out.write(part)
    fs.move(draft, path)


def take(fs, path: str) -> memoryview:
    with fs.open_input_file(path) as source:
        return memoryview(source.read())


def file_of(keys: np.ndarray, nulls: np.ndarray, sizes: np.ndarray, ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> list[bytes]:
    bits, starts = packed(ids, lengths, codes)
    table = zlib.compress(lengths.tobytes())
    head = struct.pack("<8sQQQQQ", MAGIC, len(keys), len(ids), len(lengths), len(table), len(starts))
    return [head, table, keys.astype("<i8").tobytes(), nulls.astype(np.uint8).tobytes(), sizes.astype("<u8").tobytes(), starts.astype("<u8").tobytes(), bits]


def read_file(data: memoryview) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys, which of them are null, ids per document, all ids."""
    magic, docs, n, symbols, table, blocks = struct.unpack_from("<8sQQQQQ", data)
    if magic != MAGIC:
        raise ValueError("not a token file")
    at = 48
    lengths = np.frombuffer(zlib.decompress(data[at : at + table]), dtype=np.uint8)
    if len(lengths) != symbols:
        raise ValueError("a token file's code table is broken")
    at += table
    parts = []
    for kind, size in (("<i8", docs), ("u1", docs), ("<u8", docs), ("<u8", blocks)):
        parts.append(np.frombuffer(data, dtype=kind, count=size, offset=at))
        at += np.dtype(kind).itemsize * size
    keys, nulls, sizes, starts = parts
    return keys, nulls.astype(bool), sizes, unpacked(data[at:], starts, n, lengths)


def coded_part(fs, raw: str, root: str, part: int, lengths: np.ndarray, codes: np.ndarray) -> None:
    """One raw file as a coded one; it may be done again whenever a task is."""
    data = take(fs, posixpath.join(raw, f"raw-{part:06d}"))
    n, size = struct.unpack_from("<QQ", data)
    keys = np.frombuffer(data, "<i8", n, 16)
    nulls = np.frombuffer(data, "u1", n, 16 + 8 * n)
    sizes, packs = (np.frombuffer(data, "<u8", n, 16 + k * n) for k in (9, 17))
    ends = 16 + 25 * n + np.cumsum(packs)
    ids = b"".join(zlib.decompress(data[a:b]) for a, b in zip((ends - packs).tolist(), ends.tolist(), strict=True))
    put(fs, posixpath.join(root, f"tokens-{part:06d}.huf"), file_of(keys, nulls, sizes, np.frombuffer(ids, f"<u{size}"), lengths, codes))


def written(docs: DataFrame, folder: str, *, path: str, key: str = "doc_id", text: str = "text", end: int = END_ID) -> DataFrame:
    """Writes all texts' ids as coded files in ascending order of ``key``; (part, docs, tokens) of each file.

    A null text has no ids but the end id; null keys come first; rows with equal keys are in order
    of the front of their texts, then of a hash of them; equal rows are interchangeable.  Every document ends with ``end``.
    """
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    parts = text_blocks(rows, target=FILE)
    order = ["key", "front", "hash", "row"]
    rows = rows.withColumns({"front": F.substring("text", 1, 64), "hash": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("key", "text")
    drafts = scratch_path(docs.sparkSession, "raw-ids")

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        ending = encode.raw([end])
        fs, root = pafs.FileSystem.from_uri(drafts)
        fs.create_dir(root, recursive=True)
        part = TaskContext.get().partitionId()
        keys, nulls, sizes, found = [], [], [], []
        counts = np.zeros(max(encode.size, end + 1), dtype=np.int64)
        for batch in batches:
            keys.append(batch.column(0).fill_null(0).to_numpy(zero_copy_only=False))
            nulls.append(batch.column(0).is_null().to_numpy(zero_copy_only=False))
            for ids in encode(batch.column(1)):
                ids += ending
                sizes.append(len(ids) // encode.kind.itemsize)
                counts += np.bincount(np.frombuffer(ids, dtype=encode.kind), minlength=len(counts))
                found.append(zlib.compress(ids, 1))
        give_back()
        if not sizes:
            return
        head = struct.pack("<QQ", len(sizes), encode.kind.itemsize)
        put(fs, posixpath.join(root, f"raw-{part:06d}"), [head, np.concatenate(keys).astype("<i8").tobytes(), np.concatenate(nulls).astype(np.uint8).tobytes(), np.array(sizes, "<u8").tobytes(), np.array([*map(len, found)], "<u8").tobytes(), *found])
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"part": pa.array([part] * (len(at) + 1), pa.int32()), "id": pa.array([-1, *at.tolist()], pa.int64()), "n": pa.array([len(sizes), *counts[at].tolist()], pa.int64())})

    counted = staged(ranged.mapInArrow(tokenize, "part int, id long, n long"), "id-counts")
    sums = counted.where("id >= 0").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(max(sums["id"].to_pylist(), default=0) + 1, dtype=np.int64)
    counts[sums["id"].to_numpy()] = sums["n"].to_numpy()
    lengths = code_lengths(counts)
    shared = docs.sparkSession.sparkContext.broadcast((lengths, canonical(lengths)))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        _, raw = pafs.FileSystem.from_uri(drafts)
        lengths, codes = shared.value
        for batch in batches:
            for part in batch.column("part").to_pylist():
                coded_part(fs, raw, root, part, lengths, codes)
            yield batch

    per_part = counted.groupBy("part").agg(F.sum(F.when(F.col("id") < 0, F.col("n"))).alias("docs"), F.sum(F.when(F.col("id") >= 0, F.col("n"))).alias("tokens"))
    per_part = staged(per_part, "parts")
    coded = per_part.repartition(parts, "part").mapInArrow(code, per_part.schema)
    files = staged(coded, "files")
    removed(docs.sparkSession, drafts)
    return files


def decoded(files: DataFrame, folder: str, *, tokens: bool = False) -> DataFrame:
    """Per document of the files: key, start, n_tokens, ids_crc32 and, if asked for, its tokens."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    based = files.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    count = max(1, files.count())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for part, base in zip(batch.column("part").to_pylist(), batch.column("base").to_pylist(), strict=True):
                keys, nulls, sizes, ids = read_file(take(fs, posixpath.join(root, f"tokens-{part:06d}.huf")))
                starts = np.cumsum(sizes, dtype=np.int64) - sizes.astype(np.int64)
                raw = memoryview(ids.astype("<u4").tobytes())
                sums = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)]
                columns = {"key": pa.array(keys, mask=nulls), "start": pa.array(starts + base), "n_tokens": pa.array(sizes.astype(np.int64)), "ids_crc32": pa.array(sums, pa.int64())}
                if tokens:
                    columns["tokens"] = pa.ListArray.from_arrays(pa.array(np.append(starts, len(ids)).astype(np.int32)), pa.array(ids.astype(np.int64)))
                yield pa.RecordBatch.from_pydict(columns)

    schema = "key long, start long, n_tokens long, ids_crc32 long" + (", tokens array<long>" if tokens else "")
    return based.repartition(count, "part").select("part", "base").mapInArrow(read, schema)


def op9_tokens(spark, sf_dir: str) -> DataFrame:
    """Every document's place, number and checksum of ids, as read back from the coded files.

    A null or empty text has the end id alone.  Documents with equal ids and rows that repeat keep
    a row each; documents with a null doc_id come first; an empty table gives no rows.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    folder = scratch_path(spark, "tokens")
    files = written(docs, folder, path=word_vocabulary())
    return decoded(files, folder).withColumnRenamed("key", "doc_id")
