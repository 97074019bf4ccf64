"""Language-model scoring by logistic context mixing over the token stream.

A token is coded as bits: the most frequent words (and the end mark) have a Huffman code, any other word is an escape
followed by its spelling, a Huffman code of bytes.  Three predictors foretell every bit of a word: the word code's own
node, the kind of text with the node, and the word before with the node; three more foretell the bits of a spelling
(last two bytes, last four bytes, the word so far).  Hashed contexts keep counts of both values over the whole training
corpus as a state of one byte.  Logistic mixers whose weights are gated by the evidence and by how strange the text was
so far combine them, and a probability map refines their output.  The kinds of text are groups of frequent words that
keep company, found in the corpus; the group that leads in the text so far is its kind.

While a text is read, two more predictors learn from it alone: after two words that stood together before, one bit
tells whether the word that followed then follows again, foretold by the run of such hits; and an escaped word may
repeat one of the text's earlier escaped words.

A training text is scored with its own occurrence taken out of every count that is small enough to matter, so mixers
learn what unseen text is like and a text that occurs twice stands apart.  All sums are of whole numbers: scores do not
depend on partitions or cores.

Beside it a unigram baseline over exact token counts: the most frequent tokens are broadcast, a fixed number of
them, and all others are joined.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, saved, small_batches

HEAD = 1 << 17  # tokens with a code of their own; one that occurs once has none, so the escape is as likely as new words are
BITS = (21, 22)  # log2 slots of the word contexts
KINDS, MARKERS = 8, 256  # kinds of text, frequent words that tell them
SPELL_BITS = (18, 21, 21)  # of the spelling contexts
PART = 1 << 16  # slots that are merged together
BLOCK_TOKENS = 300_000  # tokens of a block of texts, about
CHUNK = 1 << 14  # tokens worked on at once
TABLE_TOKENS = 16_000_000  # tokens that one task counts, about
TAIL = np.uint32(1 << 31)
SMALL = 12  # counts up to this sum are kept exactly
LEVELS, NODE_LEVELS = 40, 10
STRANGE = (0.05, 0.15, 0.4)
RUNS = (1, 2, 4, 8, 16)
TRUST = 32.0


# States: both counts of a slot in one byte.


def state_of(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Pairs with a sum up to SMALL have a state each, others one by the size of the sum and the odds."""
    total = n0 + n1
    odds = np.clip(np.log((n1 + 0.4) / (n0 + 0.4)) / 7, -1, 1)
    large = 91 + np.digitize(total, [32, 128, 1024]) * 35 + np.rint(odds * 17).astype(np.int64) + 17
    return np.where(total <= SMALL, total * (total + 1) // 2 + n1, large).astype(np.uint8)


def _levels() -> np.ndarray:
    """(out of training, state, bit) to the level of what the slot told: a training text's own bit is taken out."""
    table = np.zeros((2, 256, 2), np.uint8)
    level = np.zeros(256, np.uint8)
    for total in range(SMALL + 1):
        for n1 in range(total + 1):
            s = total * (total + 1) // 2 + n1
            level[s] = s if total <= 2 else 6 + round(max(-1, min(1, math.log((n1 + 0.4) / (total - n1 + 0.4)) / 3.2)) * 5.5 + 5.5)
    for s in range(91, 231):
        level[s] = 18 + round((s - 91) % 35 * 21 / 34)
    table[1] = level[:, None]
    table[0] = level[:, None]
    for total in range(1, SMALL + 1):
        for n1 in range(total + 1):
            s, less = total * (total + 1) // 2 + n1, (total - 1) * total // 2
            table[0, s] = level[less + min(n1, total - 1)], level[less + max(n1 - 1, 0)]
    return table.reshape(-1)


LEVEL = _levels()
SURE = np.digitize(np.arange(LEVELS), [1, 6, 18])  # evidence of a level: none, one or two bits, some, much


# Codes.


def _mix32(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint32(16))
    x = x * np.uint32(0x7FEB352D)
    return x ^ (x >> np.uint32(15))


class Code:
    """A Huffman code: of each symbol its path as (inner node, bit) pairs, all paths laid flat."""

    def __init__(self, weight: np.ndarray) -> None:
        n = len(weight)
        heap = [(int(w), i, i) for i, w in enumerate(weight)]
        heapq.heapify(heap)
        up, side = np.zeros(2 * n - 1, np.int64), np.zeros(2 * n - 1, np.uint8)
        mass = np.ones((n - 1, 2))
        for node in range(n, 2 * n - 1):
            (w0, _, x), (w1, _, y) = heapq.heappop(heap), heapq.heappop(heap)
            up[x] = up[y] = node
            side[y] = 1
            mass[node - n] = w0, w1
            heapq.heappush(heap, (w0 + w1, node, node))
        at, steps = np.arange(n), []
        while (at < 2 * n - 2).any():
            live = np.flatnonzero(at < 2 * n - 2)
            steps.append((live, up[at[live]] - n, side[at[live]]))
            at[live] = up[at[live]]
        self.size = np.zeros(n, np.int64)
        for live, _, _ in steps:
            self.size[live] += 1
        self.start = np.cumsum(self.size) - self.size
        self.node, self.bit = np.zeros(int(self.size.sum()), np.uint32), np.zeros(int(self.size.sum()), np.uint8)
        for k, (live, node, bit) in enumerate(steps):
            self.node[self.start[live] + self.size[live] - 1 - k] = node
            self.bit[self.start[live] + self.size[live] - 1 - k] = bit
        # Three levels of the tree, seven nodes, share a group of eight slots: what follows each other lies together.
        depth = np.arange(len(self.node)) - np.repeat(self.start, self.size)
        top = np.arange(len(self.node)) - depth % 3
        one, two = self.bit[np.minimum(top, len(self.bit) - 1)], self.bit[np.minimum(top + 1, len(self.bit) - 1)]
        place = np.where(depth % 3 == 0, 0, np.where(depth % 3 == 1, 1 + one, 3 + 2 * one + two)).astype(np.uint8)
        level = np.rint(np.clip(np.log((mass[:, 1] + 0.4) / (mass[:, 0] + 0.4)) / 3, -1, 1) * 4.5 + 4.5).astype(np.uint8)
        self.key = _mix32(self.node[top] * np.uint32(0x9E3779B1) + np.uint32(5))
        self.told = place * 32 + level[self.node] * 2 + self.bit
        # At the first node of a group, the bits that a symbol has in the group, after a leading one.
        self.leaf = np.ones(len(self.node), np.uint8)
        for k in range(3):
            live = depth - depth % 3 + k < np.repeat(self.size, self.size)
            self.leaf[live] = self.leaf[live] * 2 + self.bit[np.minimum(top + k, len(self.bit) - 1)][live]

        self._derive()

    def _derive(self) -> None:
        bit = self.told & np.uint8(1)
        self.place = (self.told >> np.uint8(5)) * np.uint8(2) + bit
        self.cell = (self.told >> np.uint8(1) & np.uint8(15)) * np.int32(2 * LEVELS**2) + bit  # what they add to a word's cell and bit

    def __getstate__(self) -> dict:
        """What tasks need and cannot derive: every broadcast lies on disk at the driver and at each executor."""
        return {k: v for k, v in vars(self).items() if k not in ("node", "bit", "place", "cell")}

    def __setstate__(self, state: dict) -> None:
        vars(self).update(state)
        self._derive()

    def sorted(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(symbols' order by falling number of bits, their paths' starts in that order, how many have a bit at each
        depth): those with a bit at a depth lead, so bits are worked on depth by depth on slices."""
        size = self.size.take(symbols)
        order = np.argsort((255 - size).astype(np.uint8), kind="stable")
        live = len(size) - np.cumsum(np.bincount(size))[:-1] if len(size) else size
        return order, self.start.take(symbols.take(order)), live


def _group(key: np.ndarray, group: np.ndarray, bits: int) -> np.ndarray:
    """Where the counts of a group begin, two a slot: a group has eight slots."""
    return (((key ^ group) * np.uint32(0x846CA68B) >> np.uint32(31 - bits)) & np.uint32(~15 & 0xFFFFFFFF)).astype(np.int64)


def levels_of(tables: list[np.ndarray], out: bool) -> list[np.ndarray]:
    """Of every slot and bit the level that it tells, for texts out of training or in it."""
    return [LEVEL.view(np.uint16)[256 * out :].take(t).view(np.uint8) for t in tables]


def levels_by_depth(code: Code, start: np.ndarray, live: np.ndarray, keys: list[np.ndarray], levels: list[np.ndarray]):
    """For every depth (how many symbols have a bit there, places of those bits in the code, level that each context
    told), from symbols as ``Code.sorted`` has them.  A group's slots are sought once for its three depths."""
    for depth, n in enumerate(live.tolist()):
        at = start[:n] + depth
        if depth % 3 == 0:
            group = code.key.take(at)
            first = [_group(k[:n], group, len(t).bit_length() - 2) for k, t in zip(keys, levels, strict=True)]
        place = code.place.take(at).astype(np.int64)
        yield n, at, [t.take(f[:n] + place) for t, f in zip(levels, first, strict=True)]


def count_leaves(table: np.ndarray, code: Code, symbols: np.ndarray, key: np.ndarray, times: np.ndarray) -> None:
    """Count a whole group's bits of each symbol at once; ``by_bit`` gives the counts of single bits."""
    order, start, live = code.sorted(symbols)
    key, times = key.take(order), times.take(order).astype(table.dtype)
    bits = len(table).bit_length() - 2
    for depth in range(0, len(live), 3):
        n = live[depth]
        at = start[:n] + depth
        np.add.at(table, _group(key[:n], code.key.take(at), bits) + code.leaf.take(at), times[:n])


def by_bit(leaves: np.ndarray) -> np.ndarray:
    """Counts of both bits of every slot, from counts by leaf."""
    leaves = leaves.reshape(-1, 16)
    out = np.zeros_like(leaves)
    out[:, 6:14] = leaves[:, 8:]
    out[:, 2:6] = leaves[:, 8::2] + leaves[:, 9::2] + leaves[:, 4:8]
    out[:, :2] = out[:, 2:6:2] + out[:, 3:6:2] + leaves[:, 2:4]
    return out.reshape(-1)


def _packed(counts: np.ndarray) -> bytes:
    """Whole numbers in the narrowest type that holds them."""
    kind = next(k for k in "BHIQ" if counts.max(initial=0) <= np.iinfo(k).max)
    return kind.encode() + counts.astype(kind).tobytes()


def _unpacked(x: bytes) -> np.ndarray:
    return np.frombuffer(x[1:], x[:1].decode()).astype(np.int64)


class Texts:
    """A block of texts, those of training first, as ids: of coded words, or TAIL and the place among the others."""

    def __init__(self, row, escape: int, kind_of: np.ndarray, training_only: bool = False) -> None:
        self.size = np.frombuffer(row.size, np.int32)
        self.held = np.frombuffer(row.held, bool)
        self.trained = int(self.size[~self.held].sum())
        self.ids = np.frombuffer(row.ids, np.uint32)
        if training_only:
            self.ids, self.size, self.held = self.ids[: self.trained], self.size[~self.held], self.held[~self.held]
        self.tail = bytes(row.tail).split(b" ") if row.tail else []
        n, start = len(self.ids), escape + 1
        self.start = (np.cumsum(self.size) - self.size).astype(np.int64)
        self.first = np.repeat(self.start, self.size)
        self.is_tail = self.ids >= TAIL
        self.symbol = np.where(self.is_tail, np.uint32(escape), self.ids)
        place = np.arange(n)
        before = np.full(n, start, np.uint64)
        self.near = np.full((2, n), start, np.uint32)  # the two words before
        for k in (1, 2):
            inside = np.flatnonzero(place - self.first >= k)
            self.near[k - 1][inside] = self.ids[inside - k]
            if k == 1:
                before[inside] = self.symbol[inside - 1]
        count = np.cumsum(self.is_tail) - self.is_tail
        share = (count - count[self.first] + 0.4) / (place - self.first + 4) if n else np.empty(0)
        strange = np.digitize(share, STRANGE).astype(np.uint64)
        kind = self._leading(kind_of)
        # What the code's bits depend on; equal ones are worked on once.
        out = (place >= self.trained).astype(np.uint64)
        key = (((out << np.uint64(18) | self.symbol) << np.uint64(18) | before) << np.uint64(4) | kind) << np.uint64(2) | strange
        if n < 1 << 20:
            key = np.sort(key << np.uint64(20) | place.astype(np.uint64))
            order = (key & np.uint64((1 << 20) - 1)).astype(np.int64)
            key >>= np.uint64(20)
        else:
            order = np.argsort(key)
            key = key[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])[:n]
        self.which = np.empty(n, np.int64)
        self.which[order] = np.cumsum(new) - 1
        at = np.flatnonzero(new)
        key = key[at]
        self.times = np.diff(np.append(at, n))
        self.unique = len(key)
        self.seen_in_training = int(np.searchsorted(key, 1 << 42))
        self.word = (key >> np.uint64(24) & np.uint64((1 << 18) - 1)).astype(np.int64)
        self.strange = (key & np.uint64(3)).astype(np.int32) * np.int32(2 * NODE_LEVELS * LEVELS**2)
        self.told_by = (key >> np.uint64(2) & np.uint64(15)).astype(np.uint32), (key >> np.uint64(6) & np.uint64((1 << 18) - 1)).astype(np.uint32)
        self.key = [self.told_by[0] * np.uint32(0xC2B2AE35) + np.uint32(77), self.told_by[1] * np.uint32(0x85EBCA6B) + np.uint32(1)]
        self.key = [_mix32(k) for k in self.key]

    def _leading(self, kind_of: np.ndarray) -> np.ndarray:
        """Of every token, the kind that leads in the text before it, the first of equal ones; KINDS if none."""
        marks = np.flatnonzero(self.symbol < MARKERS)
        of = kind_of.take(self.symbol[marks], mode="clip")
        before = np.zeros(len(self.ids) + 1, np.int32)
        before[marks + 1] = 1
        before = np.cumsum(before, dtype=np.int32)
        base = before[self.first]  # marks before each token's text
        since = base[marks]
        lead, most = np.full(len(marks) + 1, KINDS, np.uint64), np.zeros(len(marks), np.int32)
        for k in range(KINDS):
            told = np.concatenate([[0], np.cumsum(of == k, dtype=np.int32)])
            told = told[1:] - told[since]
            lead[:-1][told > most] = k
            most = np.maximum(most, told)
        before = before[:-1]
        return np.where(before > base, lead[before - 1], np.uint64(KINDS))

    def again(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(foretold, hit, run class): the text's two last words stood together before; the word after them then is the
        word now; how many such foretellings came true in a row up to here."""
        n = len(self.ids)
        pair = _pairs(self.near[1], self.near[0], self.first.astype(np.uint32))
        key = np.sort((pair >> np.uint64(24) << np.uint64(24)) + np.arange(n, dtype=np.uint64)) if n else np.empty(0, np.uint64)
        at = (key & np.uint64((1 << 24) - 1)).astype(np.int64)
        same = np.flatnonzero((key[1:] ^ key[:-1]) >> np.uint64(24) == 0)
        told, hit = np.zeros(n, bool), np.zeros(n, bool)
        now, then = at[same + 1], at[same]
        ok = (self.first[now] == self.first[then]) & (now - self.first[now] >= 2) & (then - self.first[then] >= 2)
        now, then = now[ok], then[ok]
        told[now] = True
        hit[now] = self.ids[now] == self.ids[then]
        miss = np.maximum.accumulate(np.where(hit, -1, np.arange(n))) if n else np.empty(0, np.int64)
        run = np.zeros(n, np.int64)
        run[1:] = np.arange(n - 1) - np.maximum(miss[:-1], self.first[1:] - 1)
        run[self.start] = 0
        return told, hit, np.digitize(run, RUNS)

    def cached(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the other words' tokens: (places, is one of the text's earlier other words, how many of those differ)."""
        at = np.flatnonzero(self.is_tail)
        key = np.sort((_pairs(self.ids[at], self.first[at].astype(np.uint32), np.zeros(len(at), np.uint32)) >> np.uint64(24) << np.uint64(24)) + np.arange(len(at), dtype=np.uint64))
        order = (key & np.uint64((1 << 24) - 1)).astype(np.int64)
        seen = np.zeros(len(at), bool)
        same = np.flatnonzero((key[1:] ^ key[:-1]) >> np.uint64(24) == 0)
        seen[order[same + 1]] = True
        fresh = np.cumsum(~seen) - ~seen
        first = np.searchsorted(at, self.first[at]) if len(at) else at
        return at, seen, fresh - (fresh[first] if len(at) else 0)

    def contexts(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(words, keys, times) of either context, each pair of a word and a key once."""
        for told_by, key, sort in zip(self.told_by, self.key, (True, False), strict=True):
            pair = self.word << 18 | told_by
            order = np.argsort(pair) if sort else np.arange(len(pair))
            at = np.flatnonzero(np.concatenate([[True], np.diff(pair.take(order)) != 0])[: len(order)])
            yield self.word[order[at]], key[order[at]], np.add.reduceat(self.times[order], at) if len(at) else self.times

    def chunks(self) -> Iterator[tuple[int, int]]:
        """What is worked on at once (from, to), all of training or all not."""
        for i in range(0, self.seen_in_training, CHUNK):
            yield i, min(i + CHUNK, self.seen_in_training)
        for i in range(self.seen_in_training, self.unique, CHUNK):
            yield i, min(i + CHUNK, self.unique)


def _pairs(x: np.ndarray, y: np.ndarray, z: np.ndarray) -> np.ndarray:
    h = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + y.astype(np.uint64)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + z.astype(np.uint64)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def spelled(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(bytes of the words, each ended by a blank; first byte of each word; every byte's keys in the three contexts)."""
    text = np.frombuffer(b" ".join(words) + b" ", np.uint8)
    size = np.array([len(w) + 1 for w in words], np.int64)
    starts = np.cumsum(size) - size
    begin = np.repeat(starts, size)
    depth = np.arange(len(text)) - begin
    wide, past, keys = text.astype(np.uint32) + np.uint32(1), np.zeros(len(text), np.uint32), []
    for back in range(1, 5):
        shifted = np.zeros(len(text), np.uint32)
        shifted[back:] = wide[:-back]
        past = past * np.uint32(263) + shifted * (depth >= back)
        if back in (2, 4):
            keys.append(_mix32(past + np.uint32(back)))
    power = np.cumprod(np.full(int(size.max()), 0x01000193, np.uint32), dtype=np.uint32)
    each = wide * power[depth]
    total = np.cumsum(each, dtype=np.uint32) - each
    keys.append(_mix32(total - total[begin] + depth.astype(np.uint32) * np.uint32(0x27D4EB2F)))
    return text, starts, keys


def _some(words: list[bytes], *more: np.ndarray, most: int = 50_000):
    """Cut word lists so that a block has about ``most`` bytes."""
    i = 0
    while i < len(words):
        j, n = i, 0
        while j < len(words) and (n < most or j == i):
            n += len(words[j]) + 1
            j += 1
        yield (words[i:j], *[m[i:j] for m in more])
        i = j


# Mixing.


def mixture(seen: np.ndarray, gates: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """log10 probability of both bits in every cell, from the cells' counts of both bits.

    A predictor's input is the log odds that its level had; every gate has weights of its own, learned by online
    gradient steps over the cells in a fixed order; the cell's own counts refine the mixture.
    """
    total = seen.sum(1)
    inputs = []
    for level in levels:
        n = np.stack([np.bincount(level, seen[:, b], int(level.max()) + 1) for b in (0, 1)])
        inputs.append(np.log((n[1] + 0.4) / (n[0] + 0.4))[level])
    x = np.stack([*inputs, np.full(len(seen), 0.3)])
    weights = np.full((len(x), int(gates.max()) + 1), 0.5)
    weights[-1] = 0.0
    live = np.flatnonzero(total)
    live = live[np.argsort(_mix32(live.astype(np.uint32)), kind="stable")]
    speed = np.full(weights.shape, 1e-3)
    for step in range(40):
        for some in np.array_split(live, 16):
            g = gates[some]
            p = 1 / (1 + np.exp(-np.clip((weights[:, g] * x[:, some]).sum(0), -14, 14)))
            error = seen[some, 1] - total[some] * p
            mass = np.bincount(g, total[some], weights.shape[1]) + 1e-9
            move = np.stack([np.bincount(g, error * row, weights.shape[1]) for row in x[:, some]]) / mass
            speed += move * move
            weights += 0.3 / (1 + 0.1 * step) * move / np.sqrt(speed)
    p = 1 / (1 + np.exp(-np.clip((weights[:, gates] * x).sum(0), -11, 11)))
    p = np.clip((seen[:, 1] + TRUST * p) / (total + TRUST), 1e-5, 1 - 1e-5)
    return np.log10(np.stack([1 - p, p], 1)).astype(np.float32).reshape(-1)


def word_mixture(seen: np.ndarray) -> np.ndarray:
    cell = np.arange(len(seen))
    one, two = cell // LEVELS % LEVELS, cell % LEVELS
    node, strange = cell // LEVELS**2 % NODE_LEVELS, cell // (LEVELS**2 * NODE_LEVELS)
    return mixture(seen, (strange * 4 + SURE[one]) * 4 + SURE[two], [node, one, two])


def spell_mixture(seen: np.ndarray) -> np.ndarray:
    cell = np.arange(len(seen))
    a, b, c = cell // LEVELS**2, cell // LEVELS % LEVELS, cell % LEVELS
    return mixture(seen, (SURE[a] * 4 + SURE[b]) * 4 + SURE[c], [a, b, c])


WORD_CELLS, SPELL_CELLS = 4 * NODE_LEVELS * LEVELS**2, LEVELS**3


def _joined(levels: list[np.ndarray]) -> np.ndarray:
    """Levels as digits of one number, doubled."""
    kind = np.uint16 if len(levels) < 3 else np.int32
    total = levels[0].astype(kind)
    for level in levels[1:]:
        total = total * kind(LEVELS) + level
    return total * kind(2)


def word_cells_by_depth(texts: Texts, code: Code, levels: list[np.ndarray], i: int, j: int):
    """(order, for every depth the cells and bits of the words that have a bit there, in this order)."""
    order, start, live = code.sorted(texts.word[i:j])
    strange, keys = texts.strange[i:j].take(order), [k[i:j].take(order) for k in texts.key]
    return order, (strange[:n] + code.cell.take(at) + _joined(told) for n, at, told in levels_by_depth(code, start, live, keys, levels))


def word_cells(texts: Texts, code: Code, tables: list[np.ndarray], i: int, j: int):
    """(cell and bit, number of bits, first bits), word by word."""
    n = code.size.take(texts.word[i:j])
    first = np.cumsum(n) - n
    out = np.empty(int(n.sum()), np.int64)
    order, cells = word_cells_by_depth(texts, code, levels_of(tables, i >= texts.seen_in_training), i, j)
    for depth, cell in enumerate(cells):
        out[first[order[: len(cell)]] + depth] = cell
    return out, n, first


def spell_cells(text: np.ndarray, keys: list[np.ndarray], code: Code, levels: list[np.ndarray]):
    """(order, for every depth the cells and bits of the bytes that have a bit there, in this order)."""
    order, start, live = code.sorted(text)
    keys = [k.take(order) for k in keys]
    return order, (_joined(told) + (code.place.take(at) & np.uint8(1)) for n, at, told in levels_by_depth(code, start, live, keys, levels))


def _log10(mix: np.ndarray, order: np.ndarray, cells: Iterator[np.ndarray]) -> np.ndarray:
    """Sums of the bits' log10 probabilities."""
    total = np.zeros(len(order))
    for cell in cells:
        total[: len(cell)] += mix.take(cell)
    out = np.empty(len(order))
    out[order] = total
    return out


def _count(seen: np.ndarray, times: np.ndarray, order: np.ndarray, cells: Iterator[np.ndarray]) -> None:
    times = times.take(order)
    for cell in cells:
        np.add.at(seen, cell.astype(np.int64), times[: len(cell)])


# Distributed passes.


BLOCK = "doc binary, null binary, held binary, size binary, length binary, ids binary, words binary"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts in blocks, those of training first: every token as its word's place in the block's list of words."""
    rows, n = [], 0

    def block() -> pa.RecordBatch:
        doc, null, held, size, length = (np.concatenate(x) for x in list(zip(*rows, strict=True))[:-1])
        coded = pa.concat_arrays([r[-1] for r in rows]).dictionary_encode()
        ids = np.zeros(int(size.sum()), np.uint32)
        word = np.ones(len(ids), bool)
        word[np.cumsum(size) - 1] = False
        ids[word] = coded.indices.to_numpy() + 1
        out, order = np.repeat(held, size), np.argsort(held, kind="stable")
        words = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary), b" ")[0].as_py()
        arrays = [x[order].tobytes() for x in (doc, null, held, size.astype(np.int32), length)]
        values = [*arrays, _packed(np.concatenate([ids[~out], ids[out]])), b" " + words if words else b""]
        return pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in values], [c.split()[0] for c in BLOCK.split(", ")])

    for batch in batches:
        doc = batch.column("doc_id")
        lists = pc.ascii_split_whitespace(pc.ascii_lower(batch.column("text")))
        values, ends = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
        bytes_ = pc.binary_length(values).to_numpy()
        words = np.concatenate([[0], np.cumsum(bytes_ > 0)])[ends]  # an end of blanks gives an empty word
        total = np.concatenate([[0], np.cumsum(bytes_, dtype=np.int64)])[ends]
        values = values.filter(pa.array(bytes_ > 0)).cast(pa.binary())
        size = np.diff(words) + 1
        each = (
            pc.fill_null(doc, 0).to_numpy(),
            doc.is_null().to_numpy(zero_copy_only=False),
            batch.column("held_out").to_numpy(zero_copy_only=False).astype(bool),
            size,
            np.diff(total) + size,
        )
        i, past = 0, np.cumsum(size)
        while i < len(size):
            j = min(len(size), 1 + int(np.searchsorted(past, BLOCK_TOKENS - n + (past[i - 1] if i else 0))))
            rows.append((*(x[i:j] for x in each), values[words[i] : words[j]]))
            n += int(size[i:j].sum())
            if n >= BLOCK_TOKENS:
                yield block()
                rows, n = [], 0
            i = j
    if rows:
        yield block()


def _words(joined: bytes) -> pa.Array:
    """Words joined by blanks as an Arrow array."""
    text = np.frombuffer(joined, np.uint8)
    blank = text == 32
    ends = np.append(np.flatnonzero(blank), len(text))
    offsets = np.concatenate([[0], ends - np.arange(len(ends))]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(text[~blank])])


def token_counts(blocks: DataFrame) -> DataFrame:
    """(token, c) over the blocks' texts of training; the end mark is the empty token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                trained = int(np.frombuffer(row["size"], np.int32)[~np.frombuffer(row["held"], bool)].sum())
                n = np.bincount(_unpacked(row["ids"])[:trained])
                some = pa.RecordBatch.from_arrays([_words(row["words"])[: len(n)], pa.array(n, pa.int64())], ["token", "n"])
                yield some if n.all() else some.filter(pa.array(n > 0))

    parts = blocks.select("held", "size", "ids", "words").mapInArrow(run, "token binary, n long")
    return parts.groupBy("token").agg(F.sum("n").alias("c"))


def _parts(tables: list[np.ndarray]) -> Iterator[pd.DataFrame]:
    for c, table in enumerate(tables):
        for at in range(0, len(table), 2 * PART):
            part = table[at : at + 2 * PART]
            if part.any():
                yield pd.DataFrame({"context": [c], "part": [at // (2 * PART)], "counts": [_packed(part)]})


def _collected(parts: DataFrame, bits: tuple[int, ...]) -> list[np.ndarray]:
    """The states of all slots: partial counts are summed part by part; a slot is one byte, their number fixed."""

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        n = _total(rows["counts"]).reshape(-1, 2)
        return pd.DataFrame({"context": rows["context"].iloc[:1], "part": rows["part"].iloc[:1], "states": [state_of(n[:, 0], n[:, 1]).tobytes()]})

    tables = [np.zeros(1 << b, np.uint8) for b in bits]
    for r in parts.groupBy("context", "part").applyInPandas(merge, "context int, part int, states binary").collect():
        states = np.frombuffer(r["states"], np.uint8)
        tables[r["context"]][r["part"] * PART : r["part"] * PART + len(states)] = states
    return tables


def _total(counts) -> np.ndarray:
    out = 0
    for x in counts:
        out = out + _unpacked(x)
    return out


def _summed(parts: DataFrame, *sizes: int) -> list[np.ndarray]:
    """Tables of whole numbers, of fixed sizes, summed part by part."""

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"context": rows["context"].iloc[:1], "part": rows["part"].iloc[:1], "counts": [_packed(_total(rows["counts"]))]})

    tables = [np.zeros(n, np.int64) for n in sizes]
    for r in parts.groupBy("context", "part").applyInPandas(merge, COUNTS).collect():
        n = _unpacked(r["counts"])
        tables[r["context"]][r["part"] * 2 * PART :][: len(n)] = n
    return [t.reshape(-1, 2) for t in tables]


COUNTS = "context int, part int, counts binary"


CODED = "doc binary, null binary, held binary, size binary, length binary, ids binary, tail binary, company binary"


def coded_blocks(blocks: DataFrame, known) -> DataFrame:
    """The blocks with ids of coded words, or TAIL and the place among the block's other words; one more row of a task
    has, in ``company``, in how many of its training texts each two of the MARKERS most frequent words both stand."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros((MARKERS, MARKERS), np.int64)
        for batch in batches:
            for row in batch.itertuples():
                words = bytes(row.words).split(b" ")
                found = np.fromiter(map(known.value.get, words, repeat(-1)), np.int64, len(words))
                other = np.flatnonzero(found < 0)
                found[other] = np.arange(len(other)) + int(TAIL)
                ids = found.astype(np.uint32)[_unpacked(row.ids)]
                tail = b" ".join([words[k] for k in other.tolist()])
                yield pd.DataFrame([(row.doc, row.null, row.held, row.size, row.length, ids.tobytes(), tail, None)], columns=columns)
                size = np.frombuffer(row.size, np.int32)[~np.frombuffer(row.held, bool)]
                text = np.repeat(np.arange(len(size)), size)
                some = np.flatnonzero(ids[: len(text)] < MARKERS)
                for i in range(0, len(size), 4096):
                    mine = some[(text[some] >= i) & (text[some] < i + 4096)]
                    has = np.zeros((min(4096, len(size) - i), MARKERS), np.float32)
                    has[text[mine] - i, ids[mine]] = 1
                    n += (has.T @ has).astype(np.int64)
        if n.any():
            yield pd.DataFrame([(None,) * 7 + (_packed(n.reshape(-1)),)], columns=columns)

    columns = [c.split()[0] for c in CODED.split(", ")]
    return blocks.mapInPandas(run, CODED)


def company(coded: DataFrame) -> np.ndarray:
    """In how many training texts each two of the MARKERS most frequent words both stand."""
    parts = coded.filter("company is not null").select(F.lit(0).alias("context"), F.lit(0).alias("part"), F.col("company").alias("counts"))
    return _summed(parts, MARKERS**2)[0].reshape(MARKERS, MARKERS)


def kinds_of(company: np.ndarray) -> np.ndarray:
    """KINDS groups of words by the texts that they share: spectral embedding, then k-means from far-off starts."""
    often = np.sqrt(np.maximum(np.diag(company), 1))
    _, vectors = np.linalg.eigh(company / np.outer(often, often))
    x = vectors[:, -KINDS:]
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    centres = [x[0]]
    for _ in range(KINDS - 1):
        centres.append(x[np.min([((x - c) ** 2).sum(1) for c in centres], axis=0).argmax()])
    for _ in range(30):
        near = ((x[:, None] - np.array(centres)[None]) ** 2).sum(2).argmin(1)
        centres = [x[near == k].mean(0) if (near == k).any() else c for k, c in enumerate(centres)]
    return near


def word_tables(blocks: DataFrame, shared, tasks: int) -> list[np.ndarray]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        escape, kinds, code = shared.value
        tables = [np.zeros(2 << b, np.uint32) for b in BITS]
        for batch in batches:
            for row in batch.itertuples():
                texts = Texts(row, escape, kinds, training_only=True)
                for t, (word, key, times) in zip(tables, texts.contexts(), strict=True):
                    for i in range(0, len(word), CHUNK):
                        count_leaves(t, code, word[i : i + CHUNK], key[i : i + CHUNK], times[i : i + CHUNK])
        yield from _parts([by_bit(t) for t in tables])

    return _collected(blocks.select("held", "size", "ids", F.lit(None).cast("binary").alias("tail")).coalesce(tasks).mapInPandas(run, COUNTS), BITS)


def spell_tables(rare: DataFrame, shared, tasks: int) -> list[np.ndarray]:
    """``rare(token, c)``: the words without a code."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables = [np.zeros(2 << b, np.uint64) for b in SPELL_BITS]
        for batch in batches:
            for words, c in _some(batch["token"].tolist(), batch["c"].to_numpy(np.uint64)):
                text, starts, keys = spelled(words)
                times = np.repeat(c, np.diff(np.append(starts, len(text))))
                for t, key in zip(tables, keys, strict=True):
                    count_leaves(t, shared.value, text, key, times)
        yield from _parts([by_bit(t) for t in tables])

    return _collected(rare.coalesce(tasks).mapInPandas(run, COUNTS), SPELL_BITS)


def spell_seen(rare: DataFrame, shared, tasks: int) -> np.ndarray:
    """Counts of both bits by cell over the words without a code, each as if one of its tokens were new."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code, tables = shared.value
        levels, seen = levels_of(tables, False), np.zeros(SPELL_CELLS * 2, np.int64)
        for batch in batches:
            for words, c in _some(batch["token"].tolist(), batch["c"].to_numpy(np.int64)):
                text, starts, keys = spelled(words)
                times = np.repeat(c, np.diff(np.append(starts, len(text))))
                _count(seen, times, *spell_cells(text, keys, code, levels))
        yield from _parts([seen])

    return _summed(rare.coalesce(tasks).mapInPandas(run, COUNTS), SPELL_CELLS * 2)[0]


def word_seen(blocks: DataFrame, shared, tasks: int) -> list[np.ndarray]:
    """Counts of both bits by cell over the training texts; misses and hits of words foretold, by run."""
    sizes = WORD_CELLS * 2, (len(RUNS) + 1) * 2

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        escape, kinds, code, tables = shared.value
        levels = levels_of(tables, False)
        seen, runs = (np.zeros(n, np.int64) for n in sizes)
        for batch in batches:
            for row in batch.itertuples():
                texts = Texts(row, escape, kinds, training_only=True)
                told, hit, run = texts.again()
                runs += np.bincount(run[told] * 2 + hit[told], minlength=sizes[1])
                for i, j in texts.chunks():
                    _count(seen, texts.times[i:j], *word_cells_by_depth(texts, code, levels, i, j))
        yield from _parts([seen, runs])

    return _summed(blocks.select("held", "size", "ids", F.lit(None).cast("binary").alias("tail")).coalesce(tasks).mapInPandas(run, COUNTS), *sizes)


class Model:
    """Everything that tells a probability: codes, states, mixtures, hits by run."""

    def __init__(self, known, kinds, code, tables, mix, spell_code, spells, spell_mix, runs) -> None:
        self.known, self.kinds, self.code, self.tables, self.mix = known, kinds, code, tables, mix
        self.spell_code, self.spells, self.spell_mix = spell_code, spells, spell_mix
        p = (runs[:, 1] + 0.5) / (runs.sum(1) + 1)
        self.run = np.log10(np.stack([1 - p, p]))
        self._levels = {}

    def levels(self, out: bool) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Levels of words and of spellings, worked out when first asked for."""
        if out not in self._levels:
            self._levels[out] = levels_of(self.tables, out), levels_of(self.spells, out)
        return self._levels[out]

    def spelling(self, words: list[bytes], out: bool) -> np.ndarray:
        """log10 probability of words' spellings, for texts out of training or in it."""
        each = []
        for (some,) in _some(words):
            text, starts, keys = spelled(some)
            score = _log10(self.spell_mix, *spell_cells(text, keys, self.spell_code, self.levels(out)[1]))
            each.append(np.add.reduceat(score, starts))
        return np.concatenate(each) if each else np.empty(0)

    def tokens(self, texts: Texts) -> np.ndarray:
        """log10 probability of every token."""
        each = np.empty(texts.unique)
        for i, j in texts.chunks():
            levels = self.levels(i >= texts.seen_in_training)[0]
            each[i:j] = _log10(self.mix, *word_cells_by_depth(texts, self.code, levels, i, j))
        score = each[texts.which]
        at, seen, fresh = texts.cached()
        if len(at):
            first = np.searchsorted(at, texts.first[at])
            tries = np.arange(len(at)) - first
            hits = np.cumsum(seen) - seen
            p = (0.5 + hits - hits[first]) / (1 + tries)
            p[tries == 0] = 0.0
            place = (texts.ids[at] ^ TAIL).astype(np.int64)
            plain = np.zeros(len(at))
            for out in (False, True):
                new = np.flatnonzero(~seen & ((at >= texts.trained) == out))
                need, which = np.unique(place[new], return_inverse=True)
                plain[new] = self.spelling([texts.tail[k] for k in need.tolist()], out)[which]
            score[at] += np.where(seen, np.log10(np.where(seen, p, 1) / np.maximum(fresh, 1)), np.log10(np.where(seen, 1, 1 - p)) + plain)
        told, hit, run = texts.again()
        score[told] = np.where(hit[told], 0, score[told]) + self.run[hit[told].astype(int), run[told]]
        return score


def coded(counts: DataFrame) -> tuple[dict[bytes, int], DataFrame]:
    """(the most frequent tokens, HEAD at most, that occur more than once; counts of all others but the end mark): a
    histogram of the counts tells where to cut."""
    scale = F.floor(F.log2("c") * 64)
    found, least = 0, None
    for r in counts.filter("c > 1").groupBy(scale.alias("size")).count().orderBy(F.desc("size")).collect():
        found += r["count"]
        if found > HEAD:
            break
        least = r["size"]
    often = (F.col("c") > 1) & (scale >= least) if least is not None else F.lit(False)
    return {bytes(r[0]): r[1] for r in counts.filter(often).collect()}, counts.filter(~often & (F.length("token") > 0))


def learned(docs: DataFrame):
    """(blocks of texts, counts of words without a code, counts of those with one, tokens, token types, model) from
    ``docs(doc_id, text, held_out)``."""
    share = docs.sparkSession.sparkContext.broadcast
    blocks = saved(docs.mapInArrow(_blocks, BLOCK), "blocks", "zstd")
    counts = saved(token_counts(blocks), "counts")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    head, rare = coded(counts)
    words = sorted({b"", *head}, key=lambda w: (-head.get(w, 0), w))
    known = {w: i for i, w in enumerate(words)}
    code = Code(np.array([*(max(1, head.get(w, 0)) for w in words), max(1, n - sum(head.values()))]))
    letters = np.ones(256, np.int64)
    for w, c in head.items():
        np.add.at(letters, np.frombuffer(w + b" ", np.uint8), c)
    spell_code = Code(letters)

    tasks = 1 + n // TABLE_TOKENS
    shared = share(known)
    plain, blocks = blocks, saved(coded_blocks(blocks, shared), "coded", "zstd")
    discard(plain)
    kinds = kinds_of(company(blocks))
    blocks = blocks.filter("company is null")
    tables = word_tables(blocks, share((len(words), kinds, code)), tasks)
    spells = spell_tables(rare, share(spell_code), tasks)
    spell_mix = spell_mixture(spell_seen(rare, share((spell_code, spells)), tasks))
    cells, runs = word_seen(blocks, share((len(words), kinds, code, tables)), tasks)
    return blocks, rare, head, n, v, Model(known, kinds, code, tables, word_mixture(cells), spell_code, spells, spell_mix, runs)


def lm_score(docs: DataFrame, held_out: Column) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score,
    score, bits_per_byte.

    Learns from the rows where ``held_out`` is not true.  Tokens are the lower-cased words and one end mark; a null
    text counts as empty and has the end mark only.  base_score is the additively smoothed unigram log10
    probability, score the mixing model's; bits_per_byte counts a byte more than a word has for the blank that ends
    it.  No training rows give untrained tables.  Other columns are ignored; rows with equal doc_id, or none, are
    scored one by one.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.coalesce(held_out, F.lit(False)).alias("held_out"),
    )
    blocks, rare, head, n, v, model = learned(docs)
    logs = np.array([math.log10(head.get(w, 0) + 0.1) for w in model.known] + [0.0])
    in_head = np.array([w in head for w in model.known] + [False])
    shared = spark.sparkContext.broadcast((model, logs, in_head))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, logs, in_head = shared.value
        for batch in batches:
            for row in batch.itertuples():
                texts = Texts(row, len(model.known), model.kinds)
                sums = lambda x: np.add.reduceat(x, texts.start)
                score = sums(model.tokens(texts))
                hashed = np.array([xxhash.xxh64_intdigest(w, 42) for w in texts.tail], np.uint64).view(np.int64)
                ends = np.concatenate([[0], np.cumsum(sums(texts.is_tail.astype(np.int64)))])
                tail = hashed[(texts.ids[texts.is_tail] ^ TAIL).astype(np.int64)]
                doc = pd.array(np.frombuffer(row.doc, np.int64), "Int64")
                doc[np.frombuffer(row.null, bool)] = pd.NA
                yield pd.DataFrame(
                    {
                        "doc_id": doc,
                        "held_out": texts.held,
                        "n_tokens": texts.size.astype(np.int64),
                        "head_known": sums(in_head[texts.symbol].astype(np.int64)),
                        "head_base": sums(logs[texts.symbol]),
                        "score": score,
                        "bits_per_byte": -score / math.log10(2) / np.frombuffer(row.length, np.int64),
                        "tail": [tail[i:j] for i, j in zip(ends[:-1], ends[1:], strict=True)],
                    }
                )

    schema = "doc_id long, held_out boolean, n_tokens long, head_known long, head_base double, score double, bits_per_byte double, tail array<long>"
    part = saved(blocks.mapInPandas(run, schema).withColumn("row", F.monotonically_increasing_id()), "scores")
    tail = part.select("row", F.explode("tail").alias("key"))
    other = rare.select(F.xxhash64("token").alias("key"), "c")
    found = (
        tail.join(other, "key", "left")
        .groupBy("row")
        .agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.1))).alias("rare_base"), F.count("c").alias("rare_known"))
    )
    norm = math.log10(n + 0.1 * (v + 1))
    return part.drop("tail").join(found, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("head_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("head_base") + F.coalesce("rare_base", F.lit(0.0)) - F.col("n_tokens") * F.lit(norm)).alias("base_score"),
        "score",
        "bits_per_byte",
    )
