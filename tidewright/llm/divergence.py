"""How far the vocabularies of a language's sources lie apart, in exact whole numbers.

Texts are cut on their UTF-8 bytes: a table tells letters from the rest and lower-cases A-Z, differences of that mask are
the terms' ends, xxhash groups equal slices, and the bytes of every group are compared before it counts.  Divergences are
taken on sparse rows of (source, term) in blocks of terms, so no task holds a vocabulary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import saved, small_batches

_BYTES = np.arange(256)
_UPPER = (_BYTES >= 0x41) & (_BYTES <= 0x5A)
LETTER = _UPPER | ((_BYTES >= 0x61) & (_BYTES <= 0x7A)) | (_BYTES >= 0x80)
LOWER = np.where(_UPPER, _BYTES + 32, _BYTES).astype(np.uint8)
#: Parts of one: probabilities are whole numbers of these.
SCALE = 1_000_000_000
LEAST_DOCS, TOP = 3, 200
#: Sparse entries of a block, and cells of the dense pieces that a block works on.
ENTRIES, CELLS = 400_000, 1 << 20


def _buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts behind one another, and where each begins and the last one ends."""
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, at - at[0]


def slices(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every term; a term never crosses the end of a text."""
    letter = LETTER[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[at] = True
    before, after = np.concatenate(([False], letter[:-1])), np.concatenate((letter[1:], [False]))
    start = np.flatnonzero(letter & (~before | edge[:-1]))
    end = np.flatnonzero(letter & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(at, start, side="right") - 1


def _alike(low: np.ndarray, start: np.ndarray, end: np.ndarray, code: np.ndarray, first: np.ndarray, step: int = 1 << 17) -> bool:
    """Whether every slice has the bytes of the first of its group."""
    size, ref = end - start, first[code]
    if np.any(size != size[ref]):
        return False
    for i in range(0, len(start), step):
        n = size[i : i + step]
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        if np.any(low[inside + np.repeat(start[i : i + step], n)] != low[inside + np.repeat(start[ref[i : i + step]], n)]):
            return False
    return True


def grouped(low: np.ndarray, start: np.ndarray, end: np.ndarray, hashed=xxhash.xxh3_64_intdigest) -> tuple[np.ndarray, list[bytes]]:
    """A code for each slice and the bytes of each code, equal exactly where the bytes are."""
    buf = low.tobytes()
    keys = np.fromiter((hashed(buf[s:e]) for s, e in zip(start.tolist(), end.tolist(), strict=True)), np.uint64, len(start))
    _, first, code = np.unique(keys, return_index=True, return_inverse=True)
    if not _alike(low, start, end, code, first):  # two terms of one hash
        known: dict[bytes, int] = {}
        code = np.fromiter((known.setdefault(buf[s:e], len(known)) for s, e in zip(start.tolist(), end.tolist(), strict=True)), np.int64, len(start))
        return code, list(known)
    return code, [buf[start[i] : end[i]] for i in first.tolist()]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs): occurrences and documents of each term in a batch; the empty term names the group."""
    for batch in batches:
        names = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        known: dict[tuple[str, str], int] = {}
        group = np.array([known.setdefault(g, len(known)) for g in names], np.int64)
        raw, at = _buffer(batch.column(2))
        low = LOWER[raw]
        start, end, doc = slices(raw, at)
        code, terms = grouped(low, start, end)
        # Sparse rows: terms by text, then summed by group.
        wide = max(1, len(terms))
        cell, count = np.unique(doc * wide + code, return_counts=True)
        key = group[cell // wide] * wide + cell % wide if len(cell) else cell
        order = np.argsort(key, kind="stable")
        key, count = key[order], count[order]
        begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
        n = np.add.reduceat(count, begin) if len(begin) else np.empty(0, np.int64)
        docs = np.diff(np.append(begin, len(key)))
        g, t = key[begin] // wide, key[begin] % wide
        groups = list(known)
        each = np.concatenate((np.arange(len(groups)), g))
        words = pa.array([b""] + terms, pa.binary()).cast(pa.string()).take(pa.array(np.concatenate((np.zeros(len(groups), np.int64), t + 1))))
        pick = lambda k: pa.array([x[k] for x in groups], pa.string()).take(pa.array(each))
        zero = np.zeros(len(groups), np.int64)
        yield pa.RecordBatch.from_arrays([pick(0), pick(1), words, pa.array(np.concatenate((zero, n)).astype(np.int64)), pa.array(np.concatenate((zero, docs)).astype(np.int64))], ["lang", "source", "term", "n", "docs"])


def _part(n: Column, all_: Column) -> Column:
    """1 + floor(SCALE * n / all_); decimals, as the product may pass 64 bits."""
    whole = F.lit(SCALE).cast("decimal(12,0)") * n.cast("decimal(19,0)")
    return F.call_function("div", whole, F.greatest(all_, F.lit(1)).cast("decimal(19,0)")) + 1


def _gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _pairs(entries: pd.DataFrame, groups: pd.DataFrame) -> pd.DataFrame:
    """(lang, source, item, value): over a block's terms, the sum of gaps between each two sources of a language.

    Sparse rows hold the terms a source has; all others of its terms have the probability ``p0``.  A pair's sum is that of
    the first one's own terms, of the second one's alone, and of the terms that neither has.
    """
    groups = groups.sort_values("source").reset_index(drop=True)
    lang, names, p0 = groups["lang"][0], groups["source"].to_numpy(), groups["p0"].to_numpy(np.int64)
    place = {s: i for i, s in enumerate(names)}
    row = np.fromiter((place[s] for s in entries["source"]), np.int64, len(entries))
    code, _ = pd.factorize(entries["term"])
    wide = code.max() + 1 if len(code) else 0
    order = np.argsort(row, kind="stable")
    row, col, p = row[order], code[order], entries["p"].to_numpy(np.int64)[order]
    ptr = np.searchsorted(row, np.arange(len(names) + 1))
    held = np.flatnonzero(np.diff(ptr))  # reduceat takes no empty rows
    out = np.zeros((len(names), len(names)), np.int64)
    for s in range(len(names)):
        q = np.full(wide, p0[s], np.int64)
        mine = slice(ptr[s], ptr[s + 1])
        q[col[mine]] = p[mine]
        own = np.zeros(len(names), np.int64)
        if len(held):
            at = q[col]
            own[held] = np.add.reduceat(_gap(p, at) - _gap(p0[row], at), ptr[held])
        step = max(1, CELLS // max(1, len(names)))
        has = p[mine]
        for i in range(0, len(has), step):
            own += _gap(p0[:, None], has[None, i : i + step]).sum(axis=1)
        out[:, s] = own + (wide - len(has)) * _gap(p0, p0[s])
    g, s = np.nonzero(~np.eye(len(names), dtype=bool))
    return pd.DataFrame({"lang": lang, "source": names[g], "item": names[s], "value": out[g, s]})


def source_divergence(docs: DataFrame, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: every other source of the language by its divergence (``pair``), and the
    terms that a source has more often than its language, the ``top`` first ones (``term``).

    Null text, lang and source are ''.  A language keeps the terms found in at least ``LEAST_DOCS`` of its rows; without
    any its pairs are 0.  Rows repeat freely, each counts.  Groups without terms have pairs and no terms; no rows, no
    result.  Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    found = docs.select(*text).mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    found = found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    w = Window.partitionBy("lang", "term")  # a row for each source
    found = found.withColumns({"n_lang": F.sum("n").over(w), "in_docs": F.sum("docs").over(w), "one": (F.row_number().over(w.orderBy("source")) == 1).cast("long")})
    found = saved(found.filter((F.col("term") == "") | (F.col("in_docs") >= LEAST_DOCS)).drop("docs", "in_docs"), "terms")
    entries = found.filter("term <> ''")
    langs = found.groupBy("lang").agg(F.sum(F.when(F.col("term") != "", F.col("one")).otherwise(0)).alias("v"), F.sum("n").alias("all_lang"), F.count(F.lit(1)).alias("entries"))
    groups = found.groupBy("lang", "source").agg(F.sum("n").alias("all_source")).join(langs, "lang")
    base = F.col("all_source") + F.col("v")
    blocks = 1 + F.floor(F.col("entries") / ENTRIES)
    groups = saved(groups.select("lang", "source", base.alias("base"), (F.col("all_lang") + F.col("v")).alias("base_lang"), blocks.alias("blocks")), "groups")
    p, q = _part(F.col("n") + 1, F.col("base")), _part(F.col("n_lang") + 1, F.col("base_lang"))
    block = F.pmod(F.xxhash64("term"), F.col("blocks")).alias("block")
    entries = saved(entries.join(groups, ["lang", "source"]).select("lang", "source", "term", p.alias("p"), q.alias("q"), block), "entries")

    each = groups.select("lang", "source", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), _part(F.lit(1), F.col("base")).alias("p0"))
    pairs = entries.select("lang", "block", "source", "term", "p").groupBy("lang", "block").cogroup(each.groupBy("lang", "block")).applyInPandas(_pairs, "lang string, source string, item string, value long")
    pairs = pairs.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(best).alias("rank"))

    gap = F.call_function("div", (F.col("p") - F.col("q")) * (F.col("p") - F.col("q")), F.col("q"))
    terms = entries.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), gap.alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    return pairs.unionByName(terms)
