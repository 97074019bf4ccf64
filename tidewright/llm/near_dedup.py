"""Near-duplicate documents by SetSketch registers.

A document is the set of its distinct five-word shingles.  Every shingle starts a Poisson process whose arrivals
fall on uniformly chosen registers; a register keeps the exponentially spaced level of its first arrival, cut off
where no register can still matter.  Such registers merge by maximum and agree with a probability close to the
Jaccard similarity, so bands of them find candidates.  The joint likelihood of two register arrays, given the known
set sizes, discards distant candidates; the rest are confirmed on the full sets.

Equal sets collapse first.  In each bucket of a band only links to a leader are tested (two rounds, the most shared
leader first), which joins dense groups without listing their pairs.  Buckets that still hold several components are
finished exactly: rarest-first prefixes with size and position filters list every pair that could be similar enough.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, saved, small_batches, space_words
from .graph import components

WIDTH = 5
ROWS = 5
MISS = 5e-7  # of a pair at the limit, by all bands
BASE = 1.02
_LN_BASE = math.log(BASE)
DEVIATIONS = 6.3  # by which an estimate may fall short of the limit
_CHUNK = 1_000_000
SKETCH = "doc_id long, n_shingles long, digest binary, bands array<long>, registers binary"


def shingle_hashes(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes; fewer words than ``width`` make one shingle, none make none."""
    words = space_words(text)
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    take = min(width, len(words))
    acc = np.full(len(h) - take + 1, take, np.uint64)
    for j in range(take):
        acc = (acc ^ h[j : j + len(acc)]) * np.uint64(0x9E3779B97F4A7C15)
        acc ^= acc >> np.uint64(29)
    acc = np.sort(mix64(acc))
    return acc[np.concatenate([[True], acc[1:] != acc[:-1]])]


def bands_for(percent: int) -> int:
    """Bands with which a pair at the limit is missed with probability MISS at most: 25 at 85, 37 at 80."""
    if not 60 <= percent <= 100:
        raise ValueError("percent must be from 60 to 100")
    return math.ceil(math.log(MISS) / math.log1p(-((min(percent, 99) / 100) ** ROWS)))


def sketch_sets(sets: list[np.ndarray], m: int = ROWS * bands_for(85)) -> np.ndarray:
    """Registers (len(sets) x m, uint16) of non-empty hash sets."""
    first = np.full(len(sets) * m, np.inf)
    sizes = np.array([len(s) for s in sets])
    start = 0
    while start < len(sets):
        end, total = start + 1, sizes[start]
        while end < len(sets) and total + sizes[end] <= _CHUNK:
            total += sizes[end]
            end += 1
        elem = np.concatenate(sets[start:end])
        doc = np.repeat(np.arange(start, end), sizes[start:end])
        limit = (math.log(m) + 6) / np.repeat(sizes[start:end], sizes[start:end])
        x = np.zeros(len(elem))
        step, gamma = np.zeros(1, np.uint64), np.uint64(0x9E3779B97F4A7C15)
        while len(elem):
            step = step + np.uint64(1)
            r = mix64(elem + step * gamma)
            x = x - np.log(((r >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / m
            keep = x <= limit
            elem, doc, x, limit, r = elem[keep], doc[keep], x[keep], limit[keep], r[keep]
            at = (mix64(r ^ np.uint64(0xD6E8FEB86659FD93)) % np.uint64(m)).astype(np.int64)
            np.minimum.at(first, doc * m + at, x)
        start = end
    with np.errstate(divide="ignore"):
        level = np.where(np.isinf(first), 0, 200 - np.floor(np.log(first) / _LN_BASE))
    return np.clip(level, 0, 65535).astype(np.uint16).reshape(len(sets), m)


def band_keys(reg: np.ndarray) -> np.ndarray:
    bands = reg.shape[1] // ROWS
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(reg), bands)).copy()
    for r in range(ROWS):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + reg[:, r :: ROWS].astype(np.uint64))
    return key.view(np.int64)


def likely_jaccard(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of register rows ``a`` and ``b`` with known set sizes."""
    up, down = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - up - down
    u, v = na / (na + nb), nb / (na + nb)
    grid = np.linspace(0, 1, 101)[None, :]
    top = np.minimum(u / v, v / u)[:, None]
    j = grid * top
    tail = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / _LN_BASE
    p, q = tail(u[:, None] - v[:, None] * j), tail(v[:, None] - u[:, None] * j)
    tiny = 1e-12
    like = up[:, None] * np.log(p + tiny) + down[:, None] * np.log(q + tiny) + same[:, None] * np.log(1 - p - q + tiny)
    return j[np.arange(len(j)), like.argmax(1)]


def _sketches(registers: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingle_hashes(t) for t in batch["text"]]
            full = [i for i, s in enumerate(sets) if len(s)]
            bands: list = [None] * len(sets)
            regs: list = [None] * len(sets)
            digest: list = [None] * len(sets)
            if full:
                reg = sketch_sets([sets[i] for i in full], registers)
                key = band_keys(reg)
                for k, i in enumerate(full):
                    bands[i], regs[i] = key[k], reg[k].tobytes()
                    digest[i] = xxhash.xxh3_128_digest(sets[i].tobytes())
            yield pd.DataFrame(
                {"doc_id": batch["doc_id"], "n_shingles": [len(s) for s in sets], "digest": digest, "bands": bands, "registers": regs}
            )

    return run


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        sets = [shingle_hashes(t) for t in batch["text"]]
        digest = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
        yield pd.DataFrame({"digest": digest, "shingles": [s.tobytes() for s in sets]})


def _estimate(least: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                a, b = (np.frombuffer(b"".join(batch[c]), np.uint16).reshape(len(batch), -1) for c in ("ra", "rb"))
                near = likely_jaccard(a, b, batch["na"].to_numpy(float), batch["nb"].to_numpy(float)) >= least
                yield batch.loc[near, ["a", "b"]]

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ok = []
            for x, y in zip(batch["sa"], batch["sb"], strict=True):
                a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                ok.append(100 * both >= percent * (len(a) + len(b) - both))
            yield batch.loc[np.array(ok, bool), ["a", "b"]]

    return run


def _unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for start in range(0, len(batch), 100):
            part = batch.iloc[start : start + 100]
            sets = [np.frombuffer(s, np.int64) for s in part["shingles"]]
            size = np.array([len(s) for s in sets], np.int64)
            if size.sum():
                yield pd.DataFrame(
                    {"shingle": np.concatenate(sets), "doc_id": np.repeat(part["doc_id"].to_numpy(), size), "n": np.repeat(size, size)}
                )


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, n_shingles, component_id, kept.

    Two documents are linked when 100 * |intersection| >= percent * |union| of their shingle sets.  Null, empty and
    blank texts have no set, link with nothing and are kept.  Other columns are ignored.  Every row is judged by its own
    text, also where a doc_id repeats; component_id is the least doc_id of the rows reachable.  A row without a doc_id is
    kept only where no row of its component has one; component_id is then null.
    """
    spark = docs.sparkSession
    small_batches(spark)
    registers, limit = ROWS * bands_for(percent), percent / 100
    likely = limit - DEVIATIONS * math.sqrt(limit * (1 - limit) / registers)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketch = saved(docs.mapInPandas(_sketches(registers), SKETCH), "sketch")
    group = sketch.filter("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"))
    group = saved(group.withColumn("id", F.monotonically_increasing_id()), "classes")
    # From here on a distinct set is a vertex; doc_id is its number.
    its = group.select(F.col("digest").alias("_digest"), "rep", "id")
    one = sketch.join(its, F.col("digest").eqNullSafe(F.col("_digest")) & F.col("doc_id").eqNullSafe(F.col("rep")))
    one = one.dropDuplicates(["id"]).select(F.col("id").alias("doc_id"), "rep", "n_shingles", "bands", "registers")
    keyed = one.select("doc_id", "rep", F.explode("bands").alias("key"))
    # The least doc_id leads a bucket: of a text and its later edited copies, that is the one that all are like.
    keyed = keyed.withColumn("_by", F.coalesce("rep", F.lit((1 << 63) - 1)))
    lead = keyed.groupBy("key").agg(F.min(F.struct("_by", "doc_id")).alias("l"), F.min("doc_id").alias("a"), F.max("doc_id").alias("b"))
    lead = lead.filter("a < b").select("key", F.col("l.doc_id").alias("lead"), F.col("l._by").alias("lead_by"))
    bucket = saved(keyed.drop("_by").join(lead, "key"), "buckets")
    ids = bucket.select("doc_id", "rep").distinct()
    bucket = bucket.drop("rep")
    regs = one.join(ids.select("doc_id"), "doc_id", "left_semi").select("doc_id", F.col("n_shingles").alias("n"), "registers")
    regs = saved(regs, "registers")
    wanted = ids.select(F.col("rep").alias("_id")).distinct()
    texts = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    sets = texts.mapInPandas(_sets, "digest binary, shingles binary").join(group.select("digest", "id"), "digest")
    sets = saved(sets.dropDuplicates(["id"]).select(F.col("id").alias("doc_id"), "shingles"), "sets")

    def confirmed(pairs: DataFrame) -> DataFrame:
        left = regs.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("registers").alias("ra"))
        right = regs.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("registers").alias("rb"))
        sized = pairs.join(left, "a").join(right, "b")
        sized = sized.filter(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
        near = sized.mapInPandas(_estimate(likely), "a long, b long")
        near = near.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
        return saved(near.mapInPandas(_confirm(percent), "a long, b long"), "links")

    def labelled(comp: DataFrame | None) -> DataFrame:
        if comp is None:
            return bucket.withColumn("comp", F.col("doc_id")).withColumn("lead_comp", F.col("lead"))
        mine = comp.toDF("doc_id", "c1")
        its = comp.toDF("lead", "c2")
        out = bucket.join(mine, "doc_id", "left").join(its, "lead", "left")
        return out.select("key", "doc_id", "lead", "lead_by", F.coalesce("c1", "doc_id").alias("comp"), F.coalesce("c2", "lead").alias("lead_comp"))

    links, comp = None, None
    for _ in range(2):
        open_ = labelled(comp).filter("comp <> lead_comp")
        votes = open_.groupBy("doc_id", "lead", "lead_by").count()
        best = votes.groupBy("doc_id").agg(F.max_by("lead", F.struct(F.col("count"), -F.col("lead_by"), -F.col("lead"))).alias("lead"))
        found = confirmed(best.select(F.col("lead").alias("a"), F.col("doc_id").alias("b")))
        links = found if links is None else links.union(found)
        comp = components(links)

    state = labelled(comp)
    mixed = state.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("key")
    rest = saved(state.join(mixed, "key", "left_semi").select("doc_id", "comp").distinct(), "rest")
    word = sets.join(rest, "doc_id", "left_semi").mapInPandas(_unpack, "shingle long, doc_id long, n long")
    word = saved(word, "postings")
    common = word.groupBy("shingle").agg(F.count(F.lit(1)).alias("df"))
    ranked = (
        word.join(common, "shingle")
        .groupBy("doc_id", "n")
        .agg(F.sort_array(F.collect_list(F.struct("df", "shingle"))).alias("order"))
        .withColumn("order", F.expr(f"slice(order, 1, cast(n - ceil({percent} * n / 100.0) + 1 as int))"))
        .select("doc_id", "n", F.posexplode("order").alias("pos", "item"))
        .filter("item.df > 1")
        .join(rest, "doc_id")
        .select("doc_id", "n", "pos", "comp", F.col("item.shingle").alias("shingle"))
    )
    ranked = saved(ranked, "prefixes")
    p, q = ranked.alias("p"), ranked.alias("q")
    need = f"{percent} * (p.n + q.n) <= {100 + percent} * least(p.n - p.pos, q.n - q.pos)"
    pairs = p.join(
        q,
        F.expr(f"p.shingle = q.shingle and p.doc_id < q.doc_id and p.comp <> q.comp and {need} and 100 * least(p.n, q.n) >= {percent} * greatest(p.n, q.n)"),
    )
    pairs = pairs.select(F.col("p.doc_id").alias("a"), F.col("q.doc_id").alias("b")).distinct()
    comp = components(links.union(confirmed(pairs)))
    part = group.join(comp.toDF("id", "comp"), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    least = part.groupBy("comp").agg(F.min("rep").alias("component_id"))
    found = part.join(least, "comp").select("digest", "component_id")
    rows = sketch.select("doc_id", "n_shingles", "digest").join(found, "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
    )
