"""Documents packed into sequences of a fixed size: best fit first, then exchanges between sequences that have room.

Texts are tokenised in Arrow batches; the pieces, as numbers only, are dealt at random into groups of bounded size, each
packed by one task, and the sequences that stay loose are opened, dealt again and packed together in further rounds.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, small_batches

SIZE = 2048
#: Pieces that a task packs at once, and exchanges that it makes at most.
GROUP, EXCHANGES = 16_384, 3000
#: Sequences with less than this share in use are opened for the next round.
LOOSE, ROUNDS = 0.985, 3


#: What a text of ASCII and composed Latin letters never holds, an apostrophe included (it may belong to a token), and how
#: it falls into letters, single digits and marks.
_ODD = re.compile(r"[^\t-\r -&(-~À-ÖØ-öø-ÿ]|<\|")
_CUT = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]|[^\sA-Za-zÀ-ÖØ-öø-ÿ0-9]+")
_PROBES = ("Water", "über 12", "ÀÖß,(a)", "a...\tb-c", "zzqx!? _x_", "é")


def _byte_letters() -> list[str]:
    """The letter that byte-level vocabularies use for each byte: itself where it prints, else the next from 256 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in prints]
    return [chr(b) if b in prints else chr(256 + other.index(b)) for b in range(256)]


class _Memo(dict):
    """Answers of a function, a bounded number of short ones remembered."""

    def __init__(self, answer, most: int, longest: int = 48):
        super().__init__()
        self.answer, self.most, self.longest = answer, most, longest

    def __missing__(self, word: str) -> bytes:
        ids = self.answer(word)
        if len(self) < self.most and len(word) <= self.longest:
            self[word] = ids
        return ids


class _Words:
    """Token ids (little-endian 32-bit) of texts, for a tokenizer whose tokens never cross or hold white space.

    Words go one by one.  Plain Latin texts are cut as the tokenizer cuts them and their letters go to its model at once;
    probes tell whether this holds for the tokenizer.
    """

    def __init__(self, path: str, most: int = 500_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.byte = _byte_letters()
        self.pieces, self.words = _Memo(self._piece, most), _Memo(self._encoded, most // 5)
        self.plain = all(self._plain(p) == self._encoded(p) for p in _PROBES)

    def _encoded(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        if not piece.isalpha():
            return self._encoded(piece)
        low = piece.lower()
        shown = low if low.isascii() else "".join([self.byte[b] for b in low.encode()])
        found = [t.id for t in self.tokenizer.model.tokenize(shown)]
        return struct.pack(f"<{len(found)}I", *found)

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, _CUT.findall(text)))

    def ids(self, text: str) -> bytes:
        if self.plain and not _ODD.search(text):
            return self._plain(text)
        return b"".join([self.words[w] for w in text.replace("\n", " ").split(" ") if w])


@lru_cache(1)
def _words(path: str) -> _Words:
    """What a Python worker remembers stays for its next tasks."""
    return _Words(path)


END = b"\0\0\0\0"


def _pieces(path: str, size: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(path)
        for b in batches:
            out = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = words.ids(text.as_py() or "") + END
                out += [(doc, k, k * size, min(size, len(ids) // 4 - k * size), zlib.crc32(ids[4 * k * size : 4 * (k + 1) * size])) for k in range(-(-len(ids) // (4 * size)))]
            columns = zip(*out, strict=True) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return cut


def best_fit(lengths: list[int], size: int) -> list[list[int]]:
    """Bins of item numbers: longest first, each into the fullest bin with room."""
    bins: list[list[int]] = []
    with_gap: list[list[int]] = [[] for _ in range(size + 1)]
    there = 0  # bit g: some bin has a gap of g
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fit = there >> lengths[i]
        if fit:
            g = lengths[i] + (fit & -fit).bit_length() - 1
            b = with_gap[g].pop()
            if not with_gap[g]:
                there &= ~(1 << g)
            bins[b].append(i)
        else:
            b, g = len(bins), size
            bins.append([i])
        g -= lengths[i]
        with_gap[g].append(b)
        there |= 1 << g
    return bins


class Exchange:
    """Local search on bins: moves, one for one, two for one and one for two, each from a bin into one at least as full.

    Every exchange makes the fuller bin fuller, so the sum of squared fills grows and the search ends; emptied bins go.
    """

    def __init__(self, lengths: list[int], bins: list[list[int]], size: int):
        self.lengths, self.bins, self.size = lengths, bins, size
        self.fill = np.array([sum(lengths[i] for i in b) for b in bins] + [0], np.int64)
        self.gap = size - self.fill
        self.gap[-1] = -1  # of no bin
        # What can be taken from each bin: nothing, one length or two.  Rows of a bin that changed point to no bin.
        self.take = np.empty((0, 4), np.int64)  # sum, how many, first, second
        self.of = np.empty(0, np.int64)
        self.rows: dict[int, np.ndarray] = {}
        self._add([b for b in range(len(bins)) if 0 < self.gap[b] < size])

    def _offers(self, b: int) -> list[tuple[int, int, int, int]]:
        each = [self.lengths[i] for i in self.bins[b]]
        own = sorted(set(each))
        twice = [x for x in own if each.count(x) > 1]
        pairs = [(x, y) for k, x in enumerate(own) for y in own[k + 1 :]] + [(x, x) for x in twice]
        return [(0, 0, 0, 0), *[(x, 1, x, 0) for x in own], *[(x + y, 2, x, y) for x, y in pairs]]

    def _add(self, numbers: list[int]) -> None:
        offers = [self._offers(b) for b in numbers]
        at = len(self.of)
        for b, o in zip(numbers, offers, strict=True):
            self.rows[b] = np.arange(at, at + len(o))
            at += len(o)
        if offers:
            self.take = np.concatenate((self.take, np.array([r for o in offers for r in o], np.int64)))
            self.of = np.concatenate((self.of, np.repeat(np.array(numbers, np.int64), [len(o) for o in offers])))

    def _changed(self, b: int) -> None:
        self.of[self.rows.pop(b)] = len(self.bins)
        if 0 < self.gap[b] < self.size:
            self._add([b])
        if len(self.of) > 4096 and (self.of == len(self.bins)).mean() > 0.5:
            live = np.flatnonzero(self.of != len(self.bins))
            place = np.cumsum(self.of != len(self.bins)) - 1
            self.take, self.of = self.take[live], self.of[live]
            self.rows = {k: place[r] for k, r in self.rows.items()}

    def _best(self, a: int) -> tuple[int, tuple[int, ...], tuple[int, ...]] | None:
        """The exchange of bin ``a`` that gains most: (bin, lengths given, lengths taken)."""
        found, most = None, 0
        room, lead = self.gap[self.of], self.fill[self.of] - self.fill[a]
        other = (self.of != a) & (lead >= 0)
        sums, many = self.take[:, 0], self.take[:, 1]
        for total, n, x, y in self._offers(a)[1:]:
            more = total - sums
            ok = other & (more > 0) & (more <= room) & (many <= 2 if n == 1 else many == 1)
            gain = np.where(ok, more * (more + lead), 0)
            k = int(gain.argmax()) if len(gain) else 0
            if len(gain) and gain[k] > most:
                most = int(gain[k])
                _, m, u, v = self.take[k].tolist()
                found = int(self.of[k]), (x, y)[:n], (u, v)[:m]
        return found

    def _move(self, a: int, b: int, lengths: tuple[int, ...]) -> None:
        for x in lengths:
            i = next(i for i in self.bins[a] if self.lengths[i] == x)
            self.bins[a].remove(i)
            self.bins[b].append(i)
            self.fill[a] -= x
            self.fill[b] += x

    def run(self, most: int) -> list[list[int]]:
        """The bins after at most ``most`` exchanges; no more are sought where the tokens need all bins."""
        used, least = len(self.bins), -(-int(self.fill.sum()) // self.size)
        moved = True
        while moved and used > least and most > 0:
            moved = False
            for a in np.argsort(self.fill[:-1], kind="stable").tolist():
                while most > 0 and used > least and a in self.rows and (best := self._best(a)):
                    b, given, taken = best
                    self._move(a, b, given)
                    self._move(b, a, taken)
                    self.gap[[a, b]] = self.size - self.fill[[a, b]]
                    self._changed(a)
                    self._changed(b)
                    used -= self.fill[a] == 0
                    moved, most = True, most - 1
                most -= 1  # a look is work too
                if most <= 0 or used <= least:
                    break
        return [b for b in self.bins if b]


def packed(lengths: list[int], size: int, most: int = EXCHANGES) -> list[list[int]]:
    return Exchange(lengths, best_fit(lengths, size), size).run(most)


_OUT = "doc_id long, piece int, start long, length long, ids_crc32 long, row long, sequence_id long, offset long, fill long"


def _pack(turn: int, size: int, most: int):
    def group(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("row").reset_index(drop=True)
        lengths = x["length"].tolist()
        sequence, offset, fill = np.zeros((3, len(x)), np.int64)
        for k, items in enumerate(packed(lengths, size, most)):
            own = np.array([lengths[i] for i in items], np.int64)
            sequence[items] = (((turn << 38) + key[0]) << 20) + k
            offset[items], fill[items] = np.cumsum(own) - own, own.sum()
        return x.drop(columns="part").assign(sequence_id=sequence, offset=offset, fill=fill)

    return group


def pack_documents(docs: DataFrame, path: str, size: int = SIZE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: every row's token ids and an id 0, in pieces of ``size``
    with the rest in a last one, each placed in a sequence.

    ``path`` names a tokenizer file that all machines have, one that drops white space.  Null text is empty, one token;
    each row is a document, also where a doc_id is missing or repeated.  An empty table gives no rows; columns other than
    doc_id and text are ignored.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").try_cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = rows.mapInArrow(_pieces(path, size), "doc_id long, piece int, start long, length long, ids_crc32 long")
    rest = saved(found.withColumn("row", F.monotonically_increasing_id()), "pieces")
    done, loose = [], F.col("fill") < LOOSE * size
    for turn in range(ROUNDS):
        groups = 1 + rest.count() // GROUP
        dealt = rest.withColumn("part", F.pmod(F.xxhash64("row", F.lit(turn)), F.lit(groups)))
        out = saved(dealt.groupBy("part").applyInPandas(_pack(turn, size, EXCHANGES), _OUT), "packed")
        if groups == 1 or turn == ROUNDS - 1:
            done.append(out)
            break
        done.append(out.filter(~loose))
        rest = out.filter(loose).drop("sequence_id", "offset", "fill")
    whole = done[0]
    for d in done[1:]:
        whole = whole.unionByName(d)
    return whole.drop("row", "fill")
