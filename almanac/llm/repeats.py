"""Substring dedup by repeated-phrase automata: every window of words that also starts earlier is removed.

A window is WINDOW words in a row.  No pairs of documents are made, and no passage that many
documents share meets in one task more than once a block:

1.  Documents are put in order and dealt by range into blocks, which are staged once.  Each window
    is known by its anchor, the shorter run of words inside it whose hash is smallest; windows next
    to each other mostly share one, and equal windows have equal anchors.
2.  A block sends the hashes of its anchors, each once, dealt by hash into parts; a part tells the
    blocks which of theirs occur a second time anywhere.  Nearly all unrepeated text ends here.
3.  A block cuts the stretches of windows that have such an anchor.  Stretches of equal words are sent
    once, with all places where the block has them, to the part of their anchor, so equal windows of
    all blocks meet in one part.
4.  A part confirms which windows recur, compiles them into an Aho-Corasick automaton over phrases of
    a few words, and streams all stretches through it: every occurrence is located by its words, and
    is a repeat unless it is the first one in the order of documents.
5.  The places go back to their blocks, which drop the covered words.

Work between blocks and parts is an exchange of one row a pair, packed in binary columns; a block
works with what it was sent and its own texts, so any task can be done again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import compress

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from almanac.llm.common import give_back, hidden, shown, text_blocks
from almanac.operators.staging import bucketed

#: Words of a window.
WINDOW = 20
#: Bytes of text of a block, and of text for which there is one part; anchors that a task gathers before it
#: sends them; bytes of a text whose words are found at once; phrases that the automaton is given at once.
BLOCK, PART, GATHERED, PIECE, STREAMED = 16 << 20, 8 << 20, 1 << 19, 1 << 20, 1 << 17
#: Letters that stand for one digit of a phrase's code.
DIGITS = 64
#: Odd factors of the hashes.
BASE, MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93

BLANK = re.compile(rb"[\x20\x09-\x0D]")
#: What an operator adds to the columns of its input.
ADDED = ("n_words", "n_removed", "kept")


# --- words, anchors, hashes


class Powers:
    """Powers of an odd number and of its inverse modulo 2**64, as many as were asked for."""

    def __init__(self, base: int):
        self.base, self.inverse = np.uint64(base), np.uint64(pow(base, -1, 1 << 64))
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            self.up, self.down = (np.cumprod(np.concatenate(([np.uint64(1)], np.full(size - 1, x)))) for x in (self.base, self.inverse))
        return self.up[:n], self.down[:n]


BYTES, WORDS = Powers(BASE), Powers(0xBF58476D1CE4E5B9)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(MIX)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(BASE)
    return x ^ (x >> np.uint64(32))


def spans(values: np.ndarray, start: np.ndarray, end: np.ndarray, powers: Powers) -> np.ndarray:
    """Hashes of the stretches start..end of values, wherever these stand."""
    up, down = powers.upto(len(values) + 1)
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(MIX))


def words_of(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the words of a text start and end, in bytes, and their hashes; long texts are taken in pieces."""
    found, at = [], 0
    while at < len(data):
        cut = BLANK.search(data, at + PIECE)
        to = cut.start() if cut else len(data)
        raw = np.frombuffer(data, dtype=np.uint8, count=to - at, offset=at)
        word = np.zeros(len(raw) + 2, dtype=bool)
        word[1:-1] = (raw != 32) & ((raw < 9) | (raw > 13))
        edges = np.flatnonzero(word[1:] != word[:-1])
        start, end = edges[::2], edges[1::2]
        found.append((start + at, end + at, spans(raw.astype(np.uint64) + np.uint64(1), start, end, BYTES)))
        at = to
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return found[0] if len(found) == 1 else tuple(np.concatenate(x) for x in zip(*found, strict=True))


def anchor_words(window: int) -> int:
    """Words of an anchor: two fifths of the window's, and so many that a window has 64 at most."""
    return max(1, 2 * window // 5, window - 63)


def anchors(hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, anchor): stretches of windows by their anchor's place, and its hash."""
    none = np.zeros(0, np.int64)
    if len(hashes) < window:
        return none, none, np.zeros(0, np.uint64)
    k = anchor_words(window)
    n = len(hashes) - k + 1
    grams = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        grams = grams * np.uint64(BASE) + hashes[j : n + j]
    grams = mixed(grams)
    places = np.lib.stride_tricks.sliding_window_view(grams, window - k + 1).argmin(axis=1)
    places += np.arange(len(places))
    first = np.flatnonzero(np.diff(places, prepend=-1))
    return first, np.append(first[1:], len(places)) - 1, grams[places[first]]


def groups_of(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by the first column, then the others, and where a new value of the first begins in it (and the end)."""
    order = np.lexsort(columns[::-1])
    value = columns[0][order]
    return order, np.append(np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1]))) if len(value) else [0], len(value))


def numbers(value: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(value, dtype=kind)


def present(side: pa.Table, column: str) -> bool:
    """Whether this side of a group has rows; one without may lack its columns, too."""
    return side.num_rows > 0 and column in side.column_names


# --- rounds between blocks and parts


def sent_anchors(column: str, parts: int, window: int):
    """Of staged documents: (part, block, keys, often), the anchors of a block's texts, and whether one stands twice in them."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(block: int, found: list[np.ndarray]) -> pa.RecordBatch:
            keys, times = np.unique(np.concatenate(found), return_counts=True)
            order, cuts = groups_of(keys % np.uint64(parts))
            made = [(int(keys[order[a]] % np.uint64(parts)), block, keys[order[a:b]].tobytes(), (times[order[a:b]] > 1).tobytes()) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a]
            kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made, strict=True), kinds, strict=True)], names="part block keys often".split())

        now, held, found = None, 0, []
        for batch in batches:
            blocks = batch.column(batch.schema.get_field_index("_block")).to_pylist()
            for block, text in zip(blocks, batch.column(batch.schema.get_field_index(column)), strict=True):
                if found and (block != now or held >= GATHERED):
                    yield rows(now, found)
                    held, found = 0, []
                now = block
                own = anchors(words_of(text_bytes(text))[2], window)[2]
                if len(own):
                    found.append(own)
                    held += len(own)
        if found:
            yield rows(now, found)
        give_back()

    return send


def text_bytes(text: pa.StringScalar) -> bytes:
    buffer = text.as_buffer()
    return buffer.to_pybytes() if buffer is not None else b""


def repeated_anchors(rows: pa.Table) -> pa.Table:
    """(of, keys): for each block those of its anchors that occur a second time in any."""
    blocks = rows.column("block").to_numpy()
    lists = [numbers(x, "u8") for x in rows.column("keys").to_pylist()]
    keys, block = np.concatenate(lists), np.repeat(blocks, [len(x) for x in lists])
    often = numbers(b"".join(rows.column("often").to_pylist()), "?")
    order, cuts = groups_of(keys)
    times = np.diff(cuts)
    again = np.repeat((times > 1) | np.logical_or.reduceat(often[order], cuts[:-1]), times)
    keys, block = keys[order][again], block[order][again]
    order, cuts = groups_of(block, keys)
    made = [(int(block[order[a]]), np.unique(keys[order[a:b]]).tobytes()) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a]
    return pa.table({"of": pa.array([x[0] for x in made], pa.int32()), "keys": pa.array([x[1] for x in made], pa.binary())})


STRETCHES = "part int, block int, texts binary, times binary, rows binary, starts binary"


def sent_stretches(docs: pa.Table, replies: pa.Table, column: str, parts: int, window: int) -> pa.Table:
    """The stretches of a block's windows whose anchors recur, by part: words once, then all places."""
    made: list[tuple] = []
    if present(replies, "keys") and present(docs, "_row"):
        keys = np.unique(np.concatenate([numbers(x, "u8") for x in replies.column("keys").to_pylist()]))
        found, datas = [], [text_bytes(x) for x in docs.column(column)]
        for i, (row, data) in enumerate(zip(docs.column("_row").to_pylist(), datas, strict=True)):
            start, end, hashes = words_of(data)
            first, last, anchor = anchors(hashes, window)
            at = np.searchsorted(keys, anchor)
            hit = np.flatnonzero(keys[np.minimum(at, len(keys) - 1)] == anchor) if len(anchor) else []
            if len(hit):
                a, b = first[hit], last[hit] + window
                found.append((anchor[hit], spans(hashes, a, b, WORDS), np.full(len(hit), row), a, start[a], end[b - 1], np.full(len(hit), i)))
        if found:
            anchor, digest, row, first, start, end, doc = (np.concatenate(x) for x in zip(*found, strict=True))
            part = (anchor % np.uint64(parts)).astype(np.int64)
            order, cuts = groups_of(part, digest, row, first)
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                own = order[a:b]
                new = np.flatnonzero(np.concatenate(([True], digest[own][1:] != digest[own][:-1])))
                words = [b" ".join(datas[d][x:y].split()) for d, x, y in zip(doc[own[new]].tolist(), start[own[new]].tolist(), end[own[new]].tolist(), strict=True)]
                times = np.diff(np.append(new, len(own))).astype(np.int32)
                made.append((int(part[own[0]]), b"\n".join(words), times.tobytes(), row[own].astype(np.int64).tobytes(), first[own].astype(np.int32).tobytes()))
    block = docs.column("_block")[0].as_py() if made else None
    kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
    part, *rest = (pa.array([x[i] for x in made], k) for i, k in enumerate(kinds))
    give_back()
    return pa.table([part, pa.array([block] * len(made), pa.int32()), *rest], names=[x.split()[0] for x in STRETCHES.split(", ")])


def symbols_of(words: np.ndarray, window: int) -> tuple[np.ndarray, int]:
    """(codes, length): a code for the phrase of so many words from each place on, 0 where it would cross a gap (0).

    Phrases are coded exactly, by pairs of codes of half their length.  The length is a power of two
    that divides the window and goes into it four times at least.
    """
    length = 1
    while window % (2 * length) == 0 and 8 * length <= window:
        left, right = words[:-length], words[length:]
        pairs, whole = (left << 32) | right, (left > 0) & (right > 0)
        words = np.zeros(len(words), dtype=np.int64)
        words[:-length][whole] = np.unique(pairs[whole], return_inverse=True)[1] + 1
        length *= 2
    return words, length


def letters(symbols: np.ndarray, most: int) -> tuple[str, int]:
    """(text, letters): each phrase's code as so many letters of DIGITS each, other ones in each place; a gap is none of them.

    A node of the automaton finds its children one by one, so there must be few.
    """
    digits = 1
    while DIGITS**digits <= most:
        digits += 1
    places = np.arange(digits)
    out = symbols[:, None] // DIGITS**places % DIGITS + 1 + DIGITS * places
    out[symbols == 0] = 0
    return out.astype("<u4").tobytes().decode("utf-32-le"), digits


def located(rows: pa.Table, window: int) -> pa.Table:
    """(of, rows, starts, masks): places of a block, and which of the windows from there on start earlier, too.

    The automaton reads phrases, so a window is a few of them, and the stream goes by once for each
    phase.  Equal stretches of several blocks are read once: all but the first repeat it whole.
    """
    code: dict[bytes, int] = {}
    known: dict[bytes, int] = {}
    own, stretches_of = [], []  # the stretch of each entry, the entries of each row
    for texts in rows.column("texts").to_pylist():
        entries = texts.split(b"\n")
        own.extend([known.setdefault(x, len(known)) for x in entries])
        stretches_of.append(len(entries))
    flat: list[int] = []  # words of all stretches as numbers from 1 on, and 0 between stretches
    sizes: list[int] = []
    for words in map(bytes.split, known):
        flat.extend([code.setdefault(w, len(code) + 1) for w in words])
        flat.append(0)
        sizes.append(len(words))
    size, own = np.array(sizes), np.array(own)
    times = np.concatenate([numbers(x, "i4") for x in rows.column("times").to_pylist()])
    every_row = np.concatenate([numbers(x, "i8") for x in rows.column("rows").to_pylist()])
    every_start = np.concatenate([numbers(x, "i4") for x in rows.column("starts").to_pylist()])
    place = np.cumsum(times) - times  # where each entry's first place stands in these
    order, cuts = groups_of(own, every_row[place], every_start[place])
    first = place[order[cuts[:-1]]]  # of each stretch
    row, start = every_row[first], every_start[first]
    often = np.add.reduceat(times[order], cuts[:-1]) > 1

    # windows of all stretches, equal ones together, the first in the order of documents ahead
    windows = size - window + 1
    of = np.repeat(np.arange(len(size)), windows)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows)
    base = np.cumsum(size + 1) - size - 1
    begin = base[of] + nth
    numbered = np.array(flat, dtype=np.int64)
    digest = spans(mixed(numbered.astype(np.uint64)), begin, begin + window, WORDS)
    order, cuts = groups_of(digest, row[of], start[of] + nth)
    recurs = (np.diff(cuts) > 1) | np.maximum.reduceat(often[of][order], cuts[:-1])
    home = order[cuts[:-1]][recurs]
    home_row, home_start = row[of[home]], start[of[home]] + nth[home]

    symbols, length = symbols_of(numbered, window)
    count = window // length
    most = int(symbols.max(initial=0))
    machine = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    phrases, digits = letters(symbols[begin[home][:, None] + length * np.arange(count)].ravel(), most)
    for number in range(len(home)):
        machine.add_word(phrases[number * count * digits : (number + 1) * count * digits], number)
    machine.make_automaton()
    masks = np.zeros(len(size), dtype=np.uint64)
    stretch_at = np.repeat(np.arange(len(size)), size + 1)
    for phase in range(length if len(home) else 0):
        stream = symbols[phase::length]
        for at in range(0, len(stream), STREAMED):
            # windows that begin in this part of the stream
            text, _ = letters(stream[at : at + STREAMED + count - 1], most)
            hits = np.array(list(machine.iter(text)), dtype=np.int64).reshape(-1, 2)
            begun, number = ((hits[:, 0] + 1) // digits - count + at) * length + phase, hits[:, 1]
            s = stretch_at[begun]
            k = begun - base[s]
            here = start[s] + k
            later = (row[s] > home_row[number]) | ((row[s] == home_row[number]) & (here > home_start[number]))
            np.bitwise_or.at(masks, s[later], np.uint64(1) << k[later].astype(np.uint64))

    # all windows of a stretch that has been there before start earlier
    mask = np.repeat((~np.uint64(0) >> (np.uint64(64) - windows.astype(np.uint64)))[own], times)
    mask[first] = masks
    block = np.repeat(np.repeat(rows.column("block").to_numpy(), stretches_of), times)
    keep = np.flatnonzero(mask)
    order, cuts = groups_of(block[keep], every_row[keep], every_start[keep])
    keep = keep[order]
    made = [(int(block[keep[a]]), *(x[keep[a:b]].tobytes() for x in (every_row, every_start, mask))) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a]
    del machine, flat, code, known
    give_back()
    kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.table([pa.array([x[i] for x in made], k) for i, k in enumerate(kinds)], names="of rows starts masks".split())


def thinned(docs: pa.Table, places: pa.Table, column: str, window: int, columns: list[str]) -> pa.Table:
    """The documents of a block with their words counted and the covered ones dropped."""
    row = start = mask = np.zeros(0, np.int64)
    if present(places, "masks"):
        row, start, mask = (np.concatenate([numbers(x, kind) for x in places.column(c).to_pylist()]) for c, kind in (("rows", "i8"), ("starts", "i4"), ("masks", "u8")))
        order = np.argsort(row, kind="stable")
        row, start, mask = row[order], start[order], mask[order]
    texts, counts, removed, kept = docs.column(column), [], [], []
    own = docs.column("_row").to_numpy()
    for i, (a, b) in enumerate(zip(np.searchsorted(row, own), np.searchsorted(row, own, side="right"), strict=True)):
        words = text_bytes(texts[i]).split()
        counts.append(len(words))
        if a == b:
            removed.append(0)
            kept.append(b" ".join(words))
            continue
        edges = np.zeros(len(words) + 1, dtype=np.int64)
        for k in range(window - anchor_words(window) + 1):
            at = start[a:b][(mask[a:b] >> np.uint64(k)) & np.uint64(1) == 1] + k
            np.add.at(edges, at, 1)
            np.add.at(edges, at + window, -1)
        keep = np.cumsum(edges[:-1]) == 0
        removed.append(len(words) - int(keep.sum()))
        kept.append(b" ".join(compress(words, keep.tolist())))
    out = [*(docs.column(c) for c in columns), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).view(pa.string())]
    give_back()
    return pa.table(out, names=[*columns, *(f"_{c}" for c in ADDED)])


def without_repeats(docs: DataFrame, *, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Adds n_words, n_removed and kept, the words that are left joined by one space; columns of those names are replaced.

    A window counts as repeated if its words also start earlier: in a document of a smaller key, or
    before in the same one.  Null keys come last; documents of one key stand in the order of their
    texts' hashes, and of equal rows all but one repeat it.  Null, empty and short texts have no
    window and lose nothing; a null text has no words and an empty ``kept``.
    """
    if window < 1:
        raise ValueError("a window has one word at least")
    rows, names = hidden(docs)
    own = [names[c] for c in docs.columns if c not in ADDED or c in (key, text)]
    column = names[text]
    rows = rows.select(*own)
    blocks, parts = text_blocks(rows, text=column, target=BLOCK), text_blocks(rows, text=column, target=PART)
    order = [F.col(names[key]).asc_nulls_last(), F.xxhash64(column).asc()]
    placed = rows.repartitionByRange(blocks, *order).sortWithinPartitions(*order)
    placed = placed.select("*", F.spark_partition_id().alias("_block"), F.monotonically_increasing_id().alias("_row"))
    held = bucketed(placed, "_block", blocks, "passages")

    texts = held.select(column, "_block", "_row")
    keys = texts.mapInArrow(sent_anchors(column, parts, window), "part int, block int, keys binary, often binary")
    replies = keys.groupBy("part").applyInArrow(repeated_anchors, "of int, keys binary")
    cut = texts.groupBy("_block").cogroup(replies.groupBy("of")).applyInArrow(lambda left, right: sent_stretches(left, right, column, parts, window), STRETCHES)
    places = cut.groupBy("part").applyInArrow(lambda part: located(part, window), "of int, rows binary, starts binary, masks binary")
    kinds = {"n_words": LongType(), "n_removed": LongType(), "kept": StringType()}
    schema = StructType([*rows.schema.fields, *(StructField(f"_{c}", kinds[c]) for c in ADDED)])
    out = held.groupBy("_block").cogroup(places.groupBy("of")).applyInArrow(lambda left, right: thinned(left, right, column, window, own), schema)
    return out.select(*shown({c: x for c, x in names.items() if x in own and c not in ADDED}), *(F.col(f"_{c}").alias(c) for c in ADDED))


def op11_repeats(spark, sf_dir: str) -> DataFrame:
    """Every document with its words counted, those that repeated windows cover, and a digest of what is left.

    See without_repeats for nulls, ties and repeated rows; an empty table gives no rows.
    """
    found = without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
w AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(words[i:i + 19], ' ') ORDER BY doc_id, i) > 1 AS again
      FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS i FROM d)),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS at FROM w WHERE again),
k AS (SELECT x.doc_id, count(c.at) AS n_removed, coalesce(string_agg(x.word, ' ' ORDER BY x.at) FILTER (WHERE c.at IS NULL), '') AS kept
      FROM (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS at FROM d) x LEFT JOIN c ON x.doc_id = c.doc_id AND x.at = c.at
      GROUP BY x.doc_id)
SELECT d.doc_id, len(d.words)::BIGINT AS n_words, coalesce(k.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
