"""Fuzzy passages that repeat across documents, by collinear chaining of shared k-mer seeds.

All word k-mers are seeds.  Every seed of a document matches its least occurrence and its last one in an earlier
document, so a passage in n documents makes 2 n matches a seed at most and never all pairs.  The matches of two
documents are chained with linear gap costs, and chains are aligned on the word sequences: gapped extension at both
ends, longest common subsequences in the gaps.  Whole equal texts collapse first.

A pair is found by linked seeds that cover COVER words: by substitutions, edits every six words leave a seed in each
run; identity by runs of four words and fewer leaves none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, saved, small_batches, space_words

K = 5
COVER = 8  # words that the seeds of a chain cover at least
GAP_COST = 0.05
BUCKET = 1_000_000  # seeds that are matched together, about
MIN_WORDS, MIN_IDENTITY = 50, 0.8
MAX_GAP = 120  # words: a wider gap ends a chain
DROP = 20  # fifths of a word: an extension ends so far below its best score
CHAIN = "a long, b long, sites binary"
PASSAGE = (
    "doc_id long, start long, end long, source_doc_id long, source_start long, source_end long, identity double"
)


def word_hashes(text: str | None) -> np.ndarray:
    words = space_words(text)
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def seeds(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of all k-mers."""
    if len(h) < K:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    acc = np.zeros(len(h) - K + 1, np.uint64)
    for j in range(K):
        acc = acc * np.uint64(0x9E3779B97F4A7C15) + h[j : j + len(acc)]
    acc = mix64(acc)
    at = np.flatnonzero(np.concatenate([[True], acc[1:] != acc[:-1]]))  # a run of one word repeats its seed once
    return at, acc[at]


def chains(matches: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """Collinear chains of (position, source position) matches, each match in one chain at most.

    score(i) = K + max over j before i in both, at most MAX_GAP away, of score(j) - GAP_COST * distance, or K alone.
    """
    matches = sorted(set(matches))
    b, a = np.array(matches, np.int64).reshape(-1, 2).T
    value = np.empty(len(matches))  # score + GAP_COST * (a + b)
    score, prev = [0.0] * len(matches), [-1] * len(matches)
    first, past = np.searchsorted(b, b - MAX_GAP).tolist(), np.searchsorted(b, b).tolist()
    place = {m: i for i, m in enumerate(matches)}
    by_source: dict[int, list[int]] = {}
    for i, (i0, i1) in enumerate(zip(first, past, strict=True)):
        score[i] = float(K)
        y, x = matches[i]
        here = GAP_COST * (x + y)
        p = place.get((y - 1, x - 1), -1)
        if p >= 0:
            # Whatever comes before the diagonal neighbour too serves that one better; the rest share its row or column.
            # Any other match before both has the diagonal one after it; only its row and column may hold better ones.
            for q in [*by_source[x - 1], *range(past[p], p)]:
                if value[q] > value[p] and i0 <= q < i1 and x - matches[q][1] <= MAX_GAP:
                    p = q
            score[i], prev[i] = K + float(value[p]) - here, p
        elif i0 < i1:
            back = x - a[i0:i1]
            found = np.where((back > 0) & (back <= MAX_GAP), value[i0:i1], -np.inf)
            p = int(found.argmax())
            if found[p] > here:
                score[i], prev[i] = K + float(found[p]) - here, i0 + p
        value[i] = score[i] + here
        by_source.setdefault(x, []).append(i)
    out, used = [], [False] * len(matches)
    for k in sorted(range(len(matches)), key=lambda k: -score[k]):
        chain = []
        while k >= 0 and not used[k]:
            used[k] = True
            chain.append(matches[k])
            k = prev[k]
        if chain:
            out.append(chain[::-1])
    return out


def covered(chain: list[tuple[int, int]]) -> int:
    """Words of the document under the chain's seeds."""
    return K + sum(min(K, y[0] - x[0]) for x, y in zip(chain, chain[1:], strict=False))


def common_length(x: np.ndarray, y: np.ndarray) -> int:
    """Longest common subsequence of two short arrays."""
    if not len(x) or not len(y):
        return 0
    row = np.zeros(len(y) + 1, np.int64)
    for v in x:
        new = row.copy()
        new[1:] = np.maximum(row[1:], row[:-1] + (y == v))
        row = np.maximum.accumulate(new)
    return int(row[-1])


def _reach(x: np.ndarray, y: np.ndarray) -> int:
    """How far two arrays agree from their starts."""
    n = min(len(x), len(y))
    differ = np.flatnonzero(x[:n] != y[:n])
    return int(differ[0]) if len(differ) else n


def extend(x: np.ndarray, y: np.ndarray) -> tuple[list[tuple[int, int, int]], tuple[int, int, int]]:
    """(words of x, words of y, common words) that an alignment from both starts can end with, and the best of them.

    Score: a common word 1, a word left out on one side -2 (both by fifths: 0.8 identity scores 0); rows are followed
    down to DROP below the best score (x-drop).
    """
    r = _reach(x, y)
    best, top = r, (r, r, r)
    ends = [top]
    most, got, xs, ys = len(y) - r, 0, [], []
    row = [best - 2 * k for k in range(min(DROP // 2, most) + 1)]
    lo = 0
    for i in range(len(x) - r):
        n, wide = len(row), min(len(row) + 1 + DROP // 2, most - lo + 1)
        if max(i + 1, lo + wide) > got:  # plain lists are faster than short arrays; few words are needed as a rule
            got = 2 * max(i + 32, lo + wide)
            xs, ys = x[r : r + got].tolist(), y[r : r + got].tolist()
        word, last, most_here, at = xs[i], row[0] - 2, -1, -1
        new = [last]
        for k in range(1, wide):
            last -= 2
            if k < n and row[k] - 2 > last:
                last = row[k] - 2
            if k <= n and ys[lo + k - 1] == word:
                common = row[k - 1] + 1
                if common > last:
                    last = common
                if at < 0 or common > most_here:
                    most_here, at = common, k
            new.append(last)
        if at >= 0:
            a, b = r + i + 1, r + lo + at
            end = (a, b, (most_here + 2 * (a + b)) // 5)
            ends.append(end)
            if most_here >= best:
                best, top = most_here, end
        alive = [k for k, v in enumerate(new) if v >= best - DROP]
        if not alive:
            break
        row = new[alive[0] : alive[-1] + 1]
        lo += alive[0]
    return ends, top


def _linked(b: np.ndarray, a: np.ndarray, one: tuple[int, int], two: tuple[int, int]) -> int:
    """Common words from a match of a chain up to the next."""
    (pb, pa), (nb, na) = one, two
    if nb - pb == na - pa and (nb - pb <= K or np.array_equal(b[pb:nb], a[pa:na])):  # seeds that touch are equal words
        return nb - pb
    return min(K, nb - pb, na - pa) + common_length(b[min(pb + K, nb) : nb], a[min(pa + K, na) : na])


def align(b: np.ndarray, a: np.ndarray, chain: list[tuple[int, int]], least: int, identity: float) -> list[tuple[int, int, int, int, float]]:
    """(start, end, source start, source end, identity) of a chain's passages of at least ``least`` words.

    A chain is extended at both ends to the best score, or where that is too short as far as identity holds; one with
    too many other words inside is cut at its worst gap.
    """
    inner = [_linked(b, a, one, two) for one, two in zip(chain, chain[1:], strict=False)]
    gap = [5 * n - 2 * (t[0] - o[0] + t[1] - o[1]) for n, o, t in zip(inner, chain, chain[1:], strict=False)]
    out, parts = [], [(0, len(chain) - 1)]
    while parts:
        i, j = parts.pop()
        (b0, a0), (b1, a1) = chain[i], chain[j]
        core = sum(inner[i:j]) + K
        lefts, left = extend(b[:b0][::-1], a[:a0][::-1])
        rights, right = extend(b[b1 + K :], a[a1 + K :])

        def row(x: tuple[int, int, int], y: tuple[int, int, int]) -> tuple[float, tuple[int, int, int, int, float]]:
            start, end, s0, s1 = b0 - x[0], b1 + K + y[0], a0 - x[1], a1 + K + y[1]
            share = (core + x[2] + y[2]) / max(end - start, s1 - s0)
            return (share if min(end - start, s1 - s0) >= least else -1.0), (start, end, s0, s1, share)

        share, found = row(left, right)
        if share < 0:
            share, found = max(row(x, y) for x in lefts for y in rights)
        if share >= identity:
            out.append(found)
        elif i < j:
            worst = min(range(i, j), key=gap.__getitem__)
            if gap[worst] < 0:
                parts += [(i, worst), (worst + 1, j)]
    return out


def _narrow(x: np.ndarray) -> bytes:
    """Whole numbers from 0 on in the narrowest type that holds them."""
    kind = next(k for k in "BHI" if x.max(initial=0) <= np.iinfo(k).max)
    return kind.encode() + x.astype(kind).tobytes()


def _wide(x: bytes) -> np.ndarray:
    return np.frombuffer(x[1:], x[:1].decode()).astype(np.int64)


PACKED = "bucket long, low binary, high binary, docs binary, runs binary, steps binary"


def _seeds(buckets: int):
    """Seeds of a batch, packed by bucket: 40 bits of a seed (false matches do not survive the alignment), runs of
    documents, steps of positions."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at, found = [], []
            for text in batch["text"]:
                p, s = seeds(word_hashes(text))
                at.append(p), found.append(s)
            if not found:
                continue
            ids = batch["doc_id"].to_numpy(np.int64)
            seed, pos = np.concatenate(found), np.concatenate(at)
            place = np.repeat(np.arange(len(found)), [len(x) for x in found])
            bucket = (seed % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            seed, place, pos, bucket = seed[order] >> np.uint64(24), place[order], pos[order], bucket[order]
            low, high = seed.astype(np.uint32), (seed >> np.uint64(32)).astype(np.uint8)
            rows = []
            ends = np.append(np.flatnonzero(np.diff(bucket)) + 1, len(bucket))
            for i, j in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                if i < j:
                    first = np.flatnonzero(np.concatenate([[True], place[i + 1 : j] != place[i : j - 1]]))
                    step = np.diff(pos[i:j], prepend=0)
                    step[first] = pos[i:j][first]
                    runs = np.diff(np.append(first, j - i))
                    rows.append((int(bucket[i]), low[i:j].tobytes(), high[i:j].tobytes(), ids[place[i:j][first]].tobytes(), _narrow(runs), _narrow(step)))
            yield pd.DataFrame(rows, columns=["bucket", "low", "high", "docs", "runs", "steps"])

    return run


def links(seed: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, pos, apos): every occurrence of a seed with its least one and the last one in a document before."""
    order = np.argsort(seed, kind="stable")
    new = np.diff(seed[order]) != 0
    again = np.concatenate([[False], ~new]) | np.concatenate([~new, [False]])
    order = order[again[: len(order)]]
    order = order[np.lexsort((pos[order], doc[order], seed[order]))]
    seed, doc, pos = seed[order], doc[order], pos[order]
    n = np.arange(len(seed))
    first_seed = np.concatenate([[True], np.diff(seed) != 0])[: len(n)]
    first_doc = first_seed | np.concatenate([[True], np.diff(doc) != 0])[: len(n)]
    least = np.maximum.accumulate(np.where(first_seed, n, 0))
    last = np.maximum.accumulate(np.where(first_doc, n, 0)) - 1
    at = np.flatnonzero(doc != doc[least])
    also = at[last[at] != least[at]]
    b, a = np.concatenate([at, also]), np.concatenate([least[at], last[also]])
    return doc[a], doc[b], pos[b], pos[a]


def _links(rows: pd.DataFrame) -> pd.DataFrame:
    low, high = np.frombuffer(b"".join(rows["low"]), np.uint32), np.frombuffer(b"".join(rows["high"]), np.uint8)
    seed = high.astype(np.uint64) << np.uint64(32) | low
    runs, step = (np.concatenate([_wide(x) for x in rows[c]]) for c in ("runs", "steps"))
    doc = np.repeat(np.frombuffer(b"".join(rows["docs"]), np.int64), runs)
    total, first = np.cumsum(step), np.cumsum(runs) - runs
    pos = (total - np.repeat(total[first] - step[first], runs)).astype(np.int32)
    return pd.DataFrame(dict(zip(("a", "b", "pos", "apos"), links(seed, doc, pos), strict=True)))


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        words = [space_words(t) for t in batch["text"]]
        yield pd.DataFrame(
            {"doc_id": batch["doc_id"], "n_words": [len(w) for w in words], "digest": [xxhash.xxh3_128_digest(b" ".join(w)) for w in words]}
        )


def _words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"doc_id": batch["doc_id"], "words": [word_hashes(t).astype(np.uint32).tobytes() for t in batch["text"]]})


def _chained(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for a, b, sites in zip(batch["a"].tolist(), batch["b"].tolist(), batch["sites"], strict=True):
            flat = []
            for k, chain in enumerate(chains([(s["pos"], s["apos"]) for s in sites])):
                if covered(chain) >= COVER:
                    flat += [(k, *m) for m in chain]
            if flat:
                rows.append((a, b, np.array(flat, np.int32).tobytes()))
        yield pd.DataFrame(rows, columns=["a", "b", "sites"])


def _aligned(least: int, identity: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for a, b, sites, wa, wb in batch[["a", "b", "sites", "wa", "wb"]].itertuples(index=False):
                flat = np.frombuffer(sites, np.int32).reshape(-1, 3)
                hb, ha = np.frombuffer(wb, np.uint32), np.frombuffer(wa, np.uint32)
                told: list[tuple[int, int, int, int, float]] = []
                for one in np.split(flat, np.flatnonzero(np.diff(flat[:, 0])) + 1):
                    chain = [tuple(x) for x in one[:, 1:].tolist()]
                    (b0, a0), (b1, a1) = chain[0], chain[-1]
                    if any(t[0] <= b0 and b1 + K <= t[1] and t[2] <= a0 and a1 + K <= t[3] for t in told):
                        continue
                    told += align(hb, ha, chain, least, identity)
                whole = [t for t in set(told) if not any(o != t and all(o[k] <= t[k] and t[k + 1] <= o[k + 1] for k in (0, 2)) for o in told)]
                rows += [(b, start, end, a, s0, s1, share) for start, end, s0, s1, share in sorted(whole)]
            yield pd.DataFrame(rows, columns=["doc_id", "start", "end", "source_doc_id", "source_start", "source_end", "identity"])

    return run


def repeated_passages(docs: DataFrame, least: int = MIN_WORDS, identity: float = MIN_IDENTITY) -> DataFrame:
    """One row per passage of at least ``least`` words that ``docs(doc_id, text)`` shares with an earlier document:
    doc_id, start, end (words), source_doc_id, source_start, source_end, identity.

    source_doc_id is the least document with the matching seeds or the last one before; a passage may have both.  A text equal to an earlier one (word by word) is one
    passage over its whole length, and the equal texts' further passages are told for the first of them only.  Null,
    empty and short texts have no rows, nor have repeats inside one document.  doc_id is unique and not null; other
    rows are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null")
    whole = saved(docs.mapInPandas(_digests, "doc_id long, n_words long, digest binary"), "texts").filter(f"n_words >= {least}")
    first = saved(whole.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "equal")
    copies = whole.join(first.select("digest", "rep"), "digest").filter("doc_id <> rep")
    copies = saved(copies.select("doc_id", "rep", "n_words"), "copies")
    same = copies.select(
        "doc_id",
        F.lit(0).cast("long").alias("start"),
        F.col("n_words").alias("end"),
        F.col("rep").alias("source_doc_id"),
        F.lit(0).cast("long").alias("source_start"),
        F.col("n_words").alias("source_end"),
        F.lit(1.0).alias("identity"),
    )
    total = whole.agg(F.sum("n_words")).first()[0] or 0
    packed = docs.join(copies.select("doc_id"), "doc_id", "left_anti").mapInPandas(_seeds(1 + total // BUCKET), PACKED)
    match = packed.groupBy("bucket").applyInPandas(_links, "a long, b long, pos int, apos int")
    pair = match.groupBy("a", "b").agg(F.collect_list(F.struct("pos", "apos")).alias("sites"))
    pair = pair.filter(F.size("sites") > 1)  # one seed covers less than COVER words
    chain = saved(pair.mapInPandas(_chained, CHAIN), "chains")
    ids = chain.select(F.col("a").alias("doc_id")).union(chain.select("b")).distinct()
    words = saved(docs.join(ids, "doc_id", "left_semi").mapInPandas(_words, "doc_id long, words binary"), "words")
    both = chain.join(words.toDF("a", "wa"), "a").join(words.toDF("b", "wb"), "b")
    return both.mapInPandas(_aligned(least, identity), PASSAGE).union(same)
