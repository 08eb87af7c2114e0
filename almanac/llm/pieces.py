"""Pieces of text and back: N-best segmentation by a forward Viterbi and a backward A* search.

The vocabulary comes from a sentencepiece model file.  All ways to write a stretch of text with
pieces form a lattice.  A forward pass finds the best score of every prefix; a search from the end
then extends suffixes by the piece before them, always the one whose score plus the best score of
the rest is highest.  As that estimate is exact, complete paths come out best first.

The lattice of a text falls into parts at every place that no piece crosses: at the start of each
word, as a piece has its space mark only at its front, and often inside words.  Two facts about the
search make it cheap for many texts at once.  The first path it completes never leaves the chain of
best estimates, so for all parts of a batch it is followed side by side, as numpy operations.  And a
text's N best differ from its best only in the N - 1 parts whose second best way costs least (a pass
from the other end gives that cost), so the agenda of the search is kept for those parts alone.

The file's scores are merge ranks, not probabilities, so a piece's score here is its log share
under a rank-frequency law.  Scores are whole micro-nats: sums are exact and ties are ties.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, StringType, StructField, StructType

from almanac.llm.common import give_back

SPACE = "▁"
#: Words of a text that has several spaces in a row or the mark itself, which is a word's first character then.
WORD = re.compile(f" +[^ {SPACE}]*|{SPACE}[^ {SPACE}]*")
#: Added to ranks in the rank-frequency law; micro-nats of a nat; extra cost of a byte, in nats.
FLAT, UNIT, BYTE_COST = 10, 1_000_000, 2.0
#: Bytes of text whose words are looked up together; characters of distinct words in one lattice.
TOGETHER, LATTICE = 2 << 20, 1 << 18
#: A cost that no choice has.
NONE = 1 << 60
BEST = 3


def piece_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Trie:
    """All pieces as a trie in arrays; the child of many nodes at once is one look-up in a hash table."""

    BITS, MULTIPLIER = 19, np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, pieces: list[str]):
        chars = sorted({c for piece in pieces for c in piece})
        self.number = np.zeros(0x110000, dtype=np.int32)  # of characters; 0: in no piece
        self.number[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.width = len(chars) + 1
        edges: dict[tuple[int, str], int] = {}
        ends: dict[int, int] = {}
        for i, piece in enumerate(pieces):
            node = 0
            for c in piece:
                node = edges.setdefault((node, c), len(edges) + 1)
            ends[node] = i
        self.piece = np.full(len(edges) + 1, -1, dtype=np.int32)  # that ends in a node, if any
        self.piece[list(ends)] = list(ends.values())
        self.first = np.zeros(self.width, dtype=np.int32)
        above = np.array([node for node, _ in edges], dtype=np.int64)
        number = self.number[[ord(c) for _, c in edges]]
        below = np.arange(1, len(edges) + 1, dtype=np.int32)
        self.first[number[above == 0]] = below[above == 0]
        if len(edges) > 1 << (self.BITS - 1):
            self.BITS = len(edges).bit_length() + 1
        self.keys, self.nodes = np.full(1 << self.BITS, -1, dtype=np.int64), np.zeros(1 << self.BITS, dtype=np.int32)
        key = above * self.width + number
        slot = self.slot(key)
        while len(key):
            free = np.flatnonzero(self.keys[slot] < 0)
            took = free[np.unique(slot[free], return_index=True)[1]]
            self.keys[slot[took]], self.nodes[slot[took]] = key[took], below[took]
            left = np.ones(len(key), dtype=bool)
            left[took] = False
            key, below, slot = key[left], below[left], (slot[left] + 1) & ((1 << self.BITS) - 1)

    def slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * self.MULTIPLIER) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def child(self, node: np.ndarray, number: np.ndarray) -> np.ndarray:
        """The node below each node by a character; 0 if there is none."""
        key = node.astype(np.int64) * self.width + number
        slot = self.slot(key)
        found = self.keys[slot]
        out = np.where(found == key, self.nodes[slot], 0)
        open_ = np.flatnonzero((found != key) & (found >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.BITS) - 1)
            found = self.keys[slot[open_]]
            hit = found == key[open_]
            out[open_[hit]] = self.nodes[slot[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out


@dataclass
class Solved:
    """The best way to write each of some words, and where the second best costs least."""

    score: np.ndarray  #: of each word
    ids: np.ndarray  #: of all words
    size: np.ndarray  #: ids of each word
    cost: np.ndarray  #: words x choices: what the second best way of its cheapest parts costs, least first; NONE if there is none
    part: np.ndarray  #: words x choices: number of that part
    text: list  #: per part the word's number, and start and end in the spelled word
    at: np.ndarray  #: per part its first id in the word
    count: np.ndarray  #: per part its ids
    spelled: list[str]


class Pieces:
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain, self.bytes, self.table = [], {}, []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            self.table.append(piece.replace(SPACE, " ").encode())
            if model.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.table[i] = bytes([int(piece[3:5], 16)])
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.table[i] = b""
            else:
                plain.append((-model.get_score(i), i, piece))
                if SPACE in piece.lstrip(SPACE):
                    raise ValueError("a piece with a space mark inside is not supported")
        if len(self.bytes) < 256:
            raise ValueError("a vocabulary with pieces for all bytes is needed")
        total = sum(1 / (rank + FLAT) for rank in range(len(plain)))
        self.scores: dict[str, tuple[int, int]] = {}
        for rank, (_, i, piece) in enumerate(sorted(plain)):
            self.scores[piece] = (i, round(-UNIT * math.log((rank + FLAT) * total)))
        self.byte = round(-UNIT * (math.log((len(plain) + FLAT) * total) + BYTE_COST))
        self.longest = max(map(len, self.scores))
        self.trie = Trie(list(self.scores))
        self.ids = np.array([i for i, _ in self.scores.values()], dtype=np.int32)
        self.logs = np.array([x for _, x in self.scores.values()], dtype=np.int64)
        self.spelled = pa.array(self.table, pa.binary())

    def spell(self, c: str) -> list[int]:
        return [self.bytes[x] for x in c.encode("utf-8", "surrogatepass")]

    # --- one part

    def edges(self, part: str) -> list[list[tuple[int, tuple[int, ...], int]]]:
        """Pieces by the place where they end: (start, ids, score).

        A character without a piece of its own is written in bytes.
        """
        found: list[list] = [[] for _ in range(len(part) + 1)]
        for e in range(1, len(part) + 1):
            for b in range(max(0, e - self.longest), e):
                own = self.scores.get(part[b:e])
                if own:
                    found[e].append((b, (own[0],), own[1]))
            if part[e - 1] not in self.scores:
                ids = tuple(self.spell(part[e - 1]))
                found[e].append((e - 1, ids, self.byte * len(ids)))
        return found

    def search(self, part: str, n: int) -> list[tuple[int, tuple[int, ...]]]:
        """The ``n`` best ways to write a part: (score, ids), best first; equal scores in a fixed order.

        Every suffix on the agenda stands for at least one whole path of just its estimate, so those
        behind the n best ones are let go.
        """
        edges, size = self.edges(part), len(part)
        ahead = [0]
        for e in range(1, size + 1):
            ahead.append(max([ahead[b] + score for b, _, score in edges[e]]))
        found: list[tuple[int, tuple[int, ...]]] = []
        agenda = [(-ahead[size], (), size, 0)]
        while agenda:
            _, ids, at, after = agenda.pop(0)
            if not at:
                found.append((after, ids))
                if len(found) == n:
                    break
                continue
            agenda += [(-(after + score + ahead[b]), i + ids, b, after + score) for b, i, score in edges[at]]
            agenda.sort()
            del agenda[n - len(found) :]
        return found

    # --- many words

    def lattice(self, codes: np.ndarray, literal: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, ...]:
        """Start, end, number and score of all pieces in words put one after another; numbers from
        len(self.ids) on are characters that are written in bytes, and these characters come last.

        ``stop``: for each character the end of its word; ``literal``: space marks that are text.
        """
        trie = self.trie
        number = trie.number[codes]
        number[literal] = 0
        node = trie.first[number]
        alone = np.flatnonzero(trie.piece[node] < 0)
        chars, which = np.unique(codes[alone], return_inverse=True)
        wide = np.array([len(self.spell(chr(c))) for c in chars.tolist()], dtype=np.int64)
        starts, sizes, numbers = [alone.astype(np.int32)], [np.ones(len(alone), dtype=np.int8)], [(which + len(self.ids)).astype(np.int32)]
        live = np.flatnonzero(node).astype(np.int32)
        node, size = node[live], 1
        while len(live):
            piece = trie.piece[node]
            has = piece >= 0
            starts.append(live[has])
            sizes.append(np.full(len(starts[-1]), size, dtype=np.int8))
            numbers.append(piece[has])
            more = live + size < stop[live]
            live, node = live[more], node[more]
            node = trie.child(node, number[live + size])
            more = node > 0
            live, node = live[more], node[more]
            size += 1
        start, size, piece = np.concatenate(starts), np.concatenate(sizes), np.concatenate(numbers)
        return start, start + size, piece, np.concatenate((self.logs, self.byte * wide))[piece], chars

    def solve(self, words: pa.Array, choices: int) -> Solved:
        """Best ways of distinct words.  A word is known by its text without the one space before it."""
        marked = pc.starts_with(words, SPACE)
        spelled = pc.if_else(marked, words, pc.binary_join_element_wise(SPACE, pc.replace_substring(words, " ", SPACE), ""))
        chars = pc.utf8_length(spelled).to_numpy().astype(np.int64)
        codes = np.frombuffer("".join(spelled.to_pylist()).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        first = np.cumsum(chars) - chars
        word = np.repeat(np.arange(len(chars), dtype=np.int32), chars)
        n, stop = len(codes), np.repeat((first + chars).astype(np.int32), chars)
        start, end, piece, score, alone = self.lattice(codes, first[marked.to_numpy(zero_copy_only=False)], stop)
        # parts: a piece of several characters covers the places inside it
        wide = end - start > 1
        cover = np.cumsum(np.bincount(start[wide] + 1, minlength=n + 1) - np.bincount(end[wide], minlength=n + 1))
        opens = np.flatnonzero(cover[:n] == 0)
        part = np.zeros(n, dtype=np.int32)
        part[opens[1:]] = 1
        part = np.cumsum(part, dtype=np.int32)
        parts, closes = len(opens), np.append(opens[1:], n)
        # a part of k characters has k + 1 places; pieces in order of where they end, of equal ones the longest first
        own = part[start]
        rank = end - opens[own]
        order = np.argsort(((rank * (n + parts) + end + own) << 6) | (63 - np.minimum(end - start, 63)))
        source, target, piece, score, rank = (start + own)[order], (end + own)[order], piece[order], score[order], rank[order]
        group = np.flatnonzero(np.diff(target, prepend=-1))
        place = target[group]
        top_rank = int(rank[-1])
        at_edge, at_group = np.searchsorted(rank, np.arange(1, top_rank + 2)).tolist(), np.searchsorted(rank[group], np.arange(1, top_rank + 2)).tolist()
        ahead = np.zeros(n + parts, dtype=np.int64)
        for r in range(top_rank):
            a, b, c, d = at_edge[r], at_edge[r + 1], at_group[r], at_group[r + 1]
            ahead[place[c:d]] = np.maximum.reduceat(ahead[source[a:b]] + score[a:b], group[c:d] - a)
        way = ahead[source] + score
        best = np.flatnonzero(way == ahead[target])
        best = best[np.flatnonzero(np.diff(target[best], prepend=-1))]
        # back from the ends: the chain of best estimates, and the best score of every suffix
        last = closes + np.arange(parts)
        on = np.zeros(n + parts, dtype=bool)
        behind = np.full(n + parts, -NONE)
        on[last], behind[last] = True, 0
        for r in range(top_rank - 1, -1, -1):
            a, b, c, d = at_edge[r], at_edge[r + 1], at_group[r], at_group[r + 1]
            chosen = best[c:d][on[place[c:d]]]
            on[source[chosen]] = True
            behind[source[a:b]] = np.maximum(behind[source[a:b]], score[a:b] + behind[target[a:b]])
        chosen = best[on[place]]
        other = np.ones(len(source), dtype=bool)
        other[chosen] = False
        second = np.full(parts, -NONE)
        np.maximum.at(second, own[order[other]], (way + behind[target])[other])
        top = ahead[last]
        cost = np.where(second > -NONE, top - second, NONE)
        # ids of the chains, in order of the text
        chosen = chosen[np.argsort(target[chosen])]
        spells = [self.spell(chr(c)) for c in alone.tolist()]
        sizes = np.concatenate((np.ones(len(self.ids), dtype=np.int64), np.array([len(x) for x in spells], dtype=np.int64)))
        flat = np.concatenate((self.ids, np.array([i for x in spells for i in x], dtype=np.int32)))
        used = piece[chosen]
        table = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(flat))
        ids = table.take(pa.array(used)).flatten().to_numpy() if len(spells) else self.ids[used]
        count = np.bincount(own[order[chosen]], weights=sizes[used], minlength=parts).astype(np.int64)
        words_of = word[opens]
        size = np.bincount(words_of, weights=count, minlength=len(chars)).astype(np.int64)
        before = np.cumsum(count) - count
        whole = np.add.reduceat(top, np.searchsorted(words_of, np.arange(len(chars))))
        # the cheapest parts of each word
        order = np.lexsort((cost, words_of))
        nth = np.arange(parts) - np.searchsorted(words_of, words_of)
        costs, which = np.full((len(chars), choices), NONE), np.zeros((len(chars), choices), dtype=np.int64)
        keep = nth < choices
        costs[words_of[keep], nth[keep]], which[words_of[keep], nth[keep]] = cost[order[keep]], order[keep]
        return Solved(whole, ids, size, costs, which, [words_of, opens - first[words_of], closes - first[words_of]], before - (np.cumsum(size) - size)[words_of], count, spelled)

    def encoded(self, texts: list[str], n: int = BEST) -> Iterator[tuple[bytes, list[int], list[bytes]]]:
        """Per text: ids of the best way as bytes, scores of the N best, ids of the others as bytes."""
        first, size = 0, 0
        for k, text in enumerate(texts):
            size += len(text)
            if size >= TOGETHER or k + 1 == len(texts):
                yield from self.together(texts[first : k + 1], n)
                first, size = k + 1, 0

    def together(self, texts: list[str], n: int) -> list[tuple[bytes, list[int], list[bytes]]]:
        plain = [SPACE not in x and "  " not in x and x[:1] != " " for x in texts]
        out: list = [None] * len(texts)
        for kind in (True, False):
            own = [i for i, x in enumerate(plain) if x is kind]
            if not own:
                continue
            if kind:  # every word has one space before it
                lists = pc.split_pattern(pa.array([texts[i] for i in own], pa.string()), " ")
            else:
                lists = pa.array([[w[1:] if w[0] == " " else w for w in WORD.findall(" " + texts[i])] for i in own], pa.list_(pa.string()))
            coded = lists.flatten().dictionary_encode()
            bounds = lists.offsets.to_numpy().astype(np.int64)
            for i, found in zip(own, self.written(coded.dictionary, coded.indices.to_numpy(), bounds - bounds[0], n), strict=True):
                out[i] = found
        return out

    def written(self, words: pa.Array, at: np.ndarray, bounds: np.ndarray, n: int) -> Iterator[tuple[bytes, list[int], list[bytes]]]:
        """Texts from their words: ``at`` numbers the words of all texts, ``bounds`` are those of each."""
        choices = max(1, n - 1)
        share = np.cumsum(pc.binary_length(words).to_numpy().astype(np.int64)) // LATTICE
        cuts = [0, *(np.flatnonzero(np.diff(share)) + 1).tolist(), len(words)]
        solved = [self.solve(words.slice(a, b - a), choices) for a, b in zip(cuts, cuts[1:], strict=False)]
        size = np.concatenate([x.size for x in solved])
        table = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))).astype(np.int32)), pa.array(np.concatenate([x.ids for x in solved])))
        ids = table.take(pa.array(at)).flatten().to_numpy().tobytes()
        where = np.concatenate(([0], np.cumsum(size[at])))
        ends = (4 * where[bounds]).tolist()
        top = np.add.reduceat(np.concatenate([x.score for x in solved])[at], bounds[:-1]).tolist()
        changes: list[list] = [[] for _ in top]
        if n > 1:
            costs, parts = np.concatenate([x.cost for x in solved]), np.concatenate([x.part for x in solved])
            level, now, per = np.zeros(len(at), dtype=np.int64), costs[:, 0][at], np.diff(bounds)
            for _ in range(choices):
                least = np.minimum.reduceat(now, bounds[:-1])
                hit = np.flatnonzero(now == np.repeat(least, per))
                text = np.searchsorted(bounds, hit, side="right") - 1
                new = np.flatnonzero(np.diff(text, prepend=-1))
                hit, text = hit[new], text[new]
                some = least[text] < NONE
                hit, text = hit[some], text[some]
                for i, word, where_, part in zip(text.tolist(), at[hit].tolist(), where[hit].tolist(), parts[at[hit], level[hit]].tolist(), strict=True):
                    changes[i].append((word, where_, part))
                level[hit] += 1
                now[hit] = np.where(level[hit] < choices, costs[at[hit], np.minimum(level[hit], choices - 1)], NONE)
        known: dict[tuple[int, int], list] = {}
        for i, score in enumerate(top):
            best = ids[ends[i] : ends[i + 1]]
            sums: list[tuple[int, tuple]] = [(0, ())]
            for word, first, part in changes[i]:
                block = int(np.searchsorted(cuts, word, side="right")) - 1
                options = known.get((block, part))
                if options is None:
                    options = known[block, part] = self.choices(solved[block], part, n)
                a = 4 * (first + int(solved[block].at[part]))
                b = a + 4 * int(solved[block].count[part])
                own = ids[a:b]
                sums = heapq.nsmallest(n, sums + [(cost + extra, (*chosen, (a - ends[i], b - ends[i], way))) for cost, chosen in sums for extra, way in options if way != own])
            others = []
            for _, chosen in sums[1:]:
                made, done = [], 0
                for a, b, way in sorted(chosen):
                    made += [best[done:a], way]
                    done = b
                others.append(b"".join([*made, best[done:]]))
            yield best, [score - cost for cost, _ in sums], others

    def choices(self, solved: Solved, part: int, n: int) -> list[tuple[int, bytes]]:
        """The ``n`` best ways to write a part: (cost above the best, ids as bytes)."""
        word, a, b = (int(x[part]) for x in solved.text)
        found = self.search(solved.spelled[word].as_py()[a:b], n)
        return [(found[0][0] - score, np.array(ids, dtype="<i4").tobytes()) for score, ids in found]

    def decoded(self, ids: list[int]) -> str:
        """The text of pieces; the space before the first word is none of the text's."""
        raw = b"".join(map(self.table.__getitem__, ids))
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")

    def comes_back(self, text: str, ways: list[bytes]) -> bool:
        """Whether each of these ways, ids as bytes, decodes to the text."""
        want = b" " + text.encode("utf-8", "surrogatepass")
        for ids in ways:
            made = self.spelled.take(pa.array(np.frombuffer(ids, "<i4")))
            if (made.buffers()[2] or pa.py_buffer(b""))[: pc.sum(pc.binary_length(made)).as_py() or 0].to_pybytes() != want:
                return False
        return True


@cache
def pieces(path: str) -> Pieces:
    return Pieces(path)


def with_pieces(docs: DataFrame, *, path: str | None = None, text: str = "text", n_best: int = BEST, alternatives: bool = False, verify: bool = False) -> DataFrame:
    """Adds ``pieces`` (ids of the best segmentation), ``piece_scores`` (nats of the N best, best first)
    and, if asked for, ``piece_alternatives`` (ids of the others) and ``round_trip`` (whether each
    of the N decodes to the text) to all columns of ``docs``.

    A text with fewer segmentations has fewer scores.  A null text has null pieces, scores and
    alternatives, and makes the round trip; an empty one is the mark of its front alone.  Columns of
    these names are replaced.
    """
    path = path or piece_vocabulary()
    kinds = {"pieces": ArrayType(IntegerType()), "piece_scores": ArrayType(DoubleType())}
    if alternatives:
        kinds["piece_alternatives"] = ArrayType(ArrayType(IntegerType()))
    if verify:
        kinds["round_trip"] = BooleanType()

    def listed(raw: list[bytes | None]) -> pa.Array:
        sizes = np.cumsum([0, *(len(x or b"") // 4 for x in raw)])
        values = pa.array(np.frombuffer(b"".join(x or b"" for x in raw), dtype="<i4"))
        return pa.ListArray.from_arrays(pa.array(sizes.astype(np.int32)), values, mask=pa.array([x is None for x in raw]))

    def encoded(own: Pieces, texts: list[str | None]) -> list[pa.Array]:
        best, scores, others, same = [], [], [], []
        for value, (ids, found, more) in zip(texts, own.encoded([x or "" for x in texts], n_best), strict=True):
            ok = value is not None
            best.append(ids if ok else None)
            scores.append([x / UNIT for x in found] if ok else None)
            if alternatives:
                others.append(more if ok else None)
            if verify:
                same.append(not ok or own.comes_back(value, [ids, *more]))
        made = [listed(best), pa.array(scores, pa.list_(pa.float64()))]
        if alternatives:
            ends = pa.array(np.cumsum([0, *(len(x or ()) for x in others)]).astype(np.int32))
            made.append(pa.ListArray.from_arrays(ends, listed([y for x in others for y in x or ()]), mask=pa.array([x is None for x in others])))
        return made + [pa.array(same, pa.bool_())] * verify

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(path)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            share = np.cumsum(pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)) // TOGETHER
            cuts = [0, *(np.flatnonzero(np.diff(share)) + 1).tolist(), len(column)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, *encoded(own, column.slice(a, b - a).to_pylist())], names=[*batch.schema.names, *kinds])
            give_back()

    rows = docs.select(*(c for c in docs.columns if c not in kinds))
    return rows.mapInArrow(encode, StructType([*rows.schema.fields, *(StructField(c, t) for c, t in kinds.items())]))


def with_text(rows: DataFrame, *, path: str | None = None, column: str = "pieces", into: str = "text") -> DataFrame:
    """Adds ``into``, the text of the ids in ``column`` (null for null)."""
    path = path or piece_vocabulary()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(path)
        for batch in batches:
            made = pa.array([None if x is None else own.decoded(x) for x in (y.as_py() for y in batch.column(batch.schema.get_field_index(column)))], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, into])

    kept = rows.drop(into)
    return kept.mapInArrow(decode, StructType([*kept.schema.fields, StructField(into, StringType())]))


def op10_pieces(spark, sf_dir: str) -> DataFrame:
    """Every document's three best segmentations, their scores, and whether each decodes to the text.

    A null text has null pieces, an empty one the mark of its front; of segmentations with equal
    scores any may be first, the same one in every run; rows that repeat keep a row each; an empty
    table gives no rows.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = with_pieces(docs, alternatives=True, verify=True)
    return found.select("doc_id", F.size("pieces").cast("long").alias("n_pieces"), "pieces", "piece_scores", "piece_alternatives", "round_trip")
