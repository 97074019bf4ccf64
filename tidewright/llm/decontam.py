"""Benchmark decontamination: a broadcast hash set of normalised 13-word windows against every training window."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import alnum_words, mix64, saved, small_batches

WIDTH = 13
#: Benchmark text in bytes up to which its windows are broadcast themselves.
BLOCK_BYTES = 16_000_000
OUT = "doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>"


class WindowSet:
    """Windows of benchmark items by length: vocabulary, sorted hashes, and exact tuples with their items."""

    def __init__(self, items: list[tuple[int, str | None]], width: int = WIDTH) -> None:
        self.vocab: dict[bytes, int] = {}
        exact: dict[int, dict[tuple[int, ...], set[str]]] = {}
        for item, text in items:
            ids = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in alnum_words(text)]
            take = min(width, len(ids))
            for i in range(len(ids) - take + 1 if take else 0):
                exact.setdefault(take, {}).setdefault(tuple(ids[i : i + take]), set()).update([] if item is None else [str(item)])
        self.exact = exact
        self.hashes = {
            n: np.unique(self.rolled(np.array(list(found), np.int64).ravel(), n)[::n]) for n, found in exact.items()
        }

    @staticmethod
    def rolled(ids: np.ndarray, n: int) -> np.ndarray:
        u = mix64(ids.astype(np.uint64))
        acc = np.zeros(max(0, len(ids) - n + 1), np.uint64)
        for k in range(n):
            acc = acc * np.uint64(0x9E3779B97F4A7C15) + u[k : k + len(acc)]
        return acc

    def scan(self, ids: np.ndarray) -> list[tuple[int, int, set[str]]]:
        """(start, end, items) of every window occurrence in ``ids``; 0 is a word of no item and between texts."""
        out = []
        foreign = np.concatenate([[0], np.cumsum(ids == 0)])
        for n, hashes in self.hashes.items():
            if len(ids) < n:
                continue
            at = np.flatnonzero(foreign[n:] == foreign[:-n])  # no foreign word inside
            if not len(at):
                continue
            u = mix64(ids.astype(np.uint64))
            acc = np.zeros(len(at), np.uint64)
            for k in range(n):
                acc = acc * np.uint64(0x9E3779B97F4A7C15) + u[at + k]
            place = np.minimum(np.searchsorted(hashes, acc), len(hashes) - 1)
            for i in at[hashes[place] == acc].tolist():
                items = self.exact[n].get(tuple(ids[i : i + n].tolist()))
                if items is not None:
                    out.append((i, i + n, items))
        return out


def _scanner(shared):
    """The hits of all items in every text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        windows: WindowSet = shared.value
        get = windows.vocab.get
        for batch in batches:
            words = [alnum_words(t) for t in batch["text"]]
            size = np.array([len(w) for w in words], np.int64)
            begin = np.concatenate([[0], np.cumsum(size + 1)])
            flat = np.zeros(int(begin[-1]), np.int64)
            for w, b in zip(words, begin, strict=False):
                flat[b : b + len(w)] = [get(x, 0) for x in w]
            hits: dict[int, list[tuple[int, int, set[str]]]] = {}
            for i, j, items in windows.scan(flat):
                k = int(np.searchsorted(begin, i, "right")) - 1
                hits.setdefault(k, []).append((i - int(begin[k]), j - int(begin[k]), items))
            rows = []
            for k, doc in enumerate(batch["doc_id"].tolist()):
                spans: list[dict] = []
                items: set[str] = set()
                for i, j, named in sorted(hits.get(k, []), key=lambda h: h[:2]):
                    items |= named
                    if spans and i <= spans[-1]["end"]:
                        spans[-1]["end"] = max(j, spans[-1]["end"])
                    else:
                        spans.append({"start": i, "end": j})
                rows.append((doc, int(size[k]), sum(s["end"] - s["start"] for s in spans), sorted(items), spans))
            yield pd.DataFrame(rows, columns=["doc_id", "n_words", "n_hit", "items", "spans"])

    return run


#: Bits of the filter for each window of a larger benchmark, places that a window sets, and the filter's greatest size (128 MB).
FILTER_BITS, FILTER_PLACES, FILTER_MOST = 16, 4, 30
#: Rows that a task of the join gets of one window.
HOT = 100_000
CANDIDATES = "array<struct<start:long,n:int,hash:long,words:string>>"


def _codes(words: list[bytes]) -> np.ndarray:
    known: dict[bytes, int] = {}
    get = xxhash.xxh64_intdigest
    return np.array([known[w] if w in known else known.setdefault(w, get(w)) for w in words], np.uint64)


def _rolled(codes: np.ndarray, n: int) -> np.ndarray:
    """A hash of every ``n`` consecutive words."""
    acc = np.zeros(max(0, len(codes) - n + 1), np.uint64)
    for k in range(n):
        acc = acc * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + len(acc)]
    return mix64(acc)


def _places(hashes: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    for j in range(FILTER_PLACES):
        yield mix64(hashes + np.uint64(0xD1B54A32D192ED03 * (j + 1) % (1 << 64))) >> np.uint64(64 - bits)


def _item_windows(width: int):
    """(hash, n, words, item) of the windows of items, each once a slice of an item."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for item, text in zip(batch["item"], batch["text"], strict=True):
                words = alnum_words(text)
                n = min(width, len(words))
                hashes = _rolled(_codes(words), n).astype(np.int64) if n else []
                for low in range(0, len(hashes), 50_000):
                    found = {b" ".join(words[i : i + n]): hashes[i] for i in range(low, min(low + 50_000, len(hashes)))}
                    out = pd.DataFrame({"hash": list(found.values()), "n": n, "words": [w.decode() for w in found]})
                    yield out.assign(item=item)

    return run


def _set_bits(bits: int):
    """(word, bit) of every place that a window sets in the filter."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at = np.unique(np.concatenate(list(_places(batch["hash"].to_numpy(np.int64).astype(np.uint64), bits))))
            yield pd.DataFrame({"word": (at >> np.uint64(6)).astype(np.int64), "bit": (at & np.uint64(63)).astype(np.int32)})

    return run


def _filter(windows: DataFrame, bits: int) -> np.ndarray:
    """The filter's 64-bit words, put together by Spark in pieces of at most 1 MB."""
    size = 1 << max(0, bits - 6)
    words = windows.select("hash").mapInPandas(_set_bits(bits), "word long, bit int")
    words = words.groupBy("word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("v"))

    def piece(rows: pd.DataFrame) -> pd.DataFrame:
        at = int(rows["word"].iloc[0]) >> 17
        out = np.zeros(min(size, 1 << 17), np.int64)
        out[rows["word"].to_numpy() - (at << 17)] = rows["v"].to_numpy()
        return pd.DataFrame({"at": [at], "v": [out.tobytes()]})

    found = np.zeros(size, np.uint64)
    for r in words.groupBy(F.shiftright("word", 17)).applyInPandas(piece, "at long, v binary").toLocalIterator():
        part = np.frombuffer(bytes(r["v"]), np.uint64)
        found[r["at"] << 17 : (r["at"] << 17) + len(part)] = part
    return found


def _candidates(shared, bits: int, lengths: list[int]):
    """A row a text with its number of words, then rows of at most 10,000 windows that pass the filter."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words_of: np.ndarray = shared.value
        for batch in batches:
            for row, doc, text in batch[["row", "doc_id", "text"]].itertuples(index=False, name=None):
                words = alnum_words(text)
                codes = _codes(words)
                yield pd.DataFrame({"row": [row], "doc_id": pd.array([doc], "Int64"), "n_words": pd.array([len(words)], "Int64"), "found": [[]]})
                for n in lengths:
                    hashes = _rolled(codes, n)
                    at = np.arange(len(hashes))
                    for place in _places(hashes, bits):
                        place = place[at]
                        at = at[(words_of[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1]
                    signed = hashes.astype(np.int64)
                    for low in range(0, len(at), 10_000):
                        part = [
                            {"start": i, "n": n, "hash": int(signed[i]), "words": b" ".join(words[i : i + n]).decode()}
                            for i in at[low : low + 10_000].tolist()
                        ]
                        yield pd.DataFrame({"row": [row], "doc_id": pd.array([None], "Int64"), "n_words": pd.array([None], "Int64"), "found": [part]})

    return run


def _joined(docs: DataFrame, bench: DataFrame, width: int) -> DataFrame:
    """OUT by a join: windows that pass a broadcast filter of bounded size meet the items' windows, hash and words.

    One pass over the texts whatever the benchmark's size.  Rows of a window that many texts hold are spread over
    replicas of its items, one for each HOT rows; at most a HOT-th of the candidates has such a list entry, which is broadcast.
    """
    spark = docs.sparkSession
    windows = bench.select(F.col("item_id").cast("string").alias("item"), "text").mapInPandas(_item_windows(width), "hash long, n int, words string, item string")
    sizes = {r["n"]: r["c"] for r in windows.groupBy("n").agg(F.count(F.lit(1)).alias("c")).collect()}  # at most ``width`` rows
    bits = min(FILTER_MOST, max(10, (FILTER_BITS * sum(sizes.values())).bit_length()))
    shared = spark.sparkContext.broadcast(_filter(windows, bits))
    rows = docs.withColumn("row", F.monotonically_increasing_id())
    scanned = saved(rows.mapInPandas(_candidates(shared, bits, sorted(sizes)), f"row long, doc_id long, n_words long, found {CANDIDATES}"), "scanned")
    shared.destroy()
    texts = scanned.filter("n_words is not null").drop("found")
    found = scanned.select("row", F.explode("found").alias("f")).select("row", "f.*")
    hot = found.groupBy("hash").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > HOT)
    hot = F.broadcast(hot.select("hash", F.ceil(F.col("c") / HOT).cast("int").alias("copies")))
    copies = F.coalesce("copies", F.lit(1))
    found = found.join(hot, "hash", "left").withColumn("copy", F.pmod(F.xxhash64("row", "start"), copies).cast("int")).drop("copies")
    spread = windows.join(hot, "hash", "left").withColumn("copy", F.explode(F.sequence(F.lit(0), copies - 1))).drop("copies")
    hits = saved(found.join(spread, ["hash", "n", "words", "copy"]).select("row", "start", (F.col("start") + F.col("n")).alias("end"), "item").distinct(), "hits")
    items = hits.groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    before = Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    places = hits.select("row", "start", "end").distinct().withColumn("first", F.coalesce(F.col("start") > F.max("end").over(before), F.lit(True)).cast("int"))
    places = places.withColumn("span", F.sum("first").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    spans = places.groupBy("row", "span").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    spans = spans.groupBy("row").agg(F.sum(F.col("end") - F.col("start")).alias("n_hit"), F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    out = texts.join(items, "row", "left").join(spans, "row", "left")
    columns = {"n_hit": F.coalesce("n_hit", F.lit(0).cast("long")), "items": F.coalesce("items", F.array().cast("array<string>")), "spans": F.coalesce("spans", F.array().cast("array<struct<start:long,end:long>>"))}
    return out.withColumns(columns).select("doc_id", "n_words", "n_hit", "items", "spans")


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, n_words, n_hit, items, spans, contaminated.

    ``items`` are the ids (as strings, sorted) of ``benchmark(item_id, text)`` items with a window in the text,
    ``spans`` the merged hit word ranges; contaminated when n_hit > 0 and 20 * n_hit >= n_words.  Null, empty and
    word-less texts have no words and no hits; word-less items have no windows; an empty benchmark hits nothing;
    windows of an item without an id hit and add no id.
    Rows with equal doc_id are judged one by one.  The windows of a benchmark of at most BLOCK_BYTES are broadcast; of a
    larger one a filter is, and what passes it is joined with the windows, so no text is read twice or written.
    """
    spark = docs.sparkSession
    small_batches(spark)
    bench = benchmark.select(F.col("item_id"), F.col("text").cast("string").alias("text")).filter("octet_length(text) > 0")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if (bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0) > BLOCK_BYTES:
        found = _joined(docs, bench, width)
    else:
        shared = spark.sparkContext.broadcast(WindowSet([tuple(r) for r in bench.collect()], width))
        found = docs.mapInPandas(_scanner(shared), OUT)
    return found.withColumn("contaminated", F.expr("n_hit > 0 and 20 * n_hit >= n_words"))


def item_digest(items) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()
