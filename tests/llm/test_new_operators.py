"""Packing, divergences and the prefix trie against brute force and odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidewright.llm import divergence, packing, prefix_trie

SF = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string"


def brute_trie(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            key = (role or "", text or "")
            x = hashlib.sha256(f"{len(key[0].encode())}:{key[0]}{key[1]}".encode()).digest()
            own.setdefault(c, []).append((turn is not None, turn or 0, key[0], x, key))
    own = {c: [r[-1] for r in sorted(v, key=lambda r: r[:4])] for c, v in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % 6 for c in own}
    conv = {c: own.get(c - c % 100, [])[: h[c]] + own[c][h[c] :] for c in own}
    member, ends = {}, {}
    for c, v in conv.items():
        for d in range(len(v) + 1):
            member.setdefault(tuple(v[:d]), []).append(c)
        ends.setdefault(tuple(v), []).append(c)
    out = set()
    for node, m in member.items():
        inside = [n for n in member if n[: len(node)] == node]
        kids = [n for n in inside if len(n) == len(node) + 1]
        leaves = [n for n in inside if not any(len(k) == len(n) + 1 and k[:-1] == n for k in inside)]
        spare = sum((len(member[n]) - 1) * len(n[-1][1]) for n in inside if n)
        sha = hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest()
        out.add((min(m), len(node), min(member[node[:-1]]) if node else None, len(m), len(kids), len(leaves), spare, sha))
    return out


def trie(spark, rows):
    got = prefix_trie.prefix_trie(spark.createDataFrame(rows, TURNS)).collect()
    assert len(got) == len({tuple(r)[:2] for r in got})
    return {tuple(r) for r in got}


def test_trie_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "IDS", 4)
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "bot"]), rng.choice(["a", "bb", "é", ""])) for c in [*range(0, 40), 100, *range(105, 120), 251, 252, 10**12] for t in range(rng.randint(1, 9))]
    rows += [(7, None, None, None), (7, None, "user", None), (8, 2, "user", "same"), (8, 2, "user", "same"), (8, 2, "bot", "x"), (None, 1, "user", "lost"), (300, 1, "user", None)]
    rows += [(400 + k, t, "user", "copy") for k in range(30) for t in range(8)]  # copies end together, many in a node
    rows += [(900, t, "user", str(t % 3)) for t in range(300)]  # one long conversation: several blocks and levels
    rng.shuffle(rows)
    assert trie(spark, rows) == brute_trie(rows)


def test_trie_of_few_rows(spark):
    assert trie(spark, []) == set()
    for rows in ([(5, 1, None, None)], [(c, t, "r", "t") for c in (11, 12, 13) for t in (1, 1, None)]):
        assert trie(spark, rows) == brute_trie(rows)


def test_trie_ignores_other_columns(spark):
    rows = [(c, t, "r", f"{c % 2}{t}") for c in range(4) for t in range(7)]
    df = spark.createDataFrame(rows, TURNS).withColumns({c: F.lit("z") for c in ("key", "i", "x", "last", "owner", "depth", "n", "row", "_b")})
    assert {tuple(r) for r in prefix_trie.prefix_trie(df).collect()} == brute_trie(rows)


def test_chain_levels_tell_prefixes_apart(spark):
    rows = [(k, i, bytes([i % 5])) for k in ("a", "b") for i in range(1, 200)] + [("c", i, bytes([9 if i == 71 else i % 5])) for i in range(1, 200)]
    got = {(r["key"], r["i"]): bytes(r["prefix"]) for r in prefix_trie.chained(spark.createDataFrame(rows, "key string, i long, x binary"), 4).collect()}
    assert len(got) == len(rows) and all(got["a", i] == got["b", i] for i in range(1, 200))
    assert [i for i in range(1, 200) if got["a", i] != got["c", i]] == list(range(71, 200))
    assert len({got["a", i] for i in range(1, 200)}) == 199


DOCS = "doc_id long, text string, lang string, source string"


def brute_divergence(rows, top=200):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = [((lang or ""), (source or ""), re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(low))) for _, text, lang, source in rows]
    out = set()
    for lang in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == lang]
        df = Counter(t for r in mine for t in set(r[2]))
        kept = sorted(t for t in df if df[t] >= 3)
        counts = {s: Counter(t for r in mine if r[1] == s for t in r[2] if df[t] >= 3) for s in {r[1] for r in mine}}
        whole = sum(counts.values(), Counter())
        p = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}
        f = lambda a, b: (a - b) ** 2 // b
        every, q = {s: p(c) for s, c in counts.items()}, p(whole)
        for s, ps in every.items():
            pair = [(sum(f(ps[t], po[t]) for t in kept), o) for o, po in every.items() if o != s]
            term = [(f(ps[t], q[t]), t) for t in kept if counts[s][t] and ps[t] > q[t]]
            for part, found in (("pair", pair), ("term", term)):
                found = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, x, v, i + 1) for i, (v, x) in enumerate(found) if part == "pair" or i < top}
    return out


def odd_docs(seed=5, n=120):
    rng = random.Random(seed)
    words = ["Alpha", "beta", "x", "É", "éa", "日本", "a1b", "--", "Z_z", "\x00q", "über", "ſ", "K"]
    rows = [(i, rng.choice([" ", "", "\n", "9"]).join(rng.choices(words, k=rng.randint(0, 30))), rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", None, "Ω"])) for i in range(n)]
    return rows + [(1, None, "en", "none"), (None, "alpha " * 20_000, "en", "a"), (2, "", "xx", "a"), (2, "once", "xx", "b"), (2, "once", "xx", "b"), (None, None, None, None)]


def test_divergence_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(divergence, "ENTRIES", 20)  # several blocks
    monkeypatch.setattr(divergence, "CELLS", 4)
    rows = odd_docs()
    df = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(1) for c in ("term", "n", "docs", "p", "value", "rank", "item", "part")})
    got = [tuple(r) for r in divergence.source_divergence(df, 3).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_divergence(rows, 3)


def test_divergence_of_few_rows(spark):
    assert divergence.source_divergence(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(1, "a b", "en", "s"), (2, "c", "en", "t"), (3, "", "fr", "only")]
    assert {tuple(r) for r in divergence.source_divergence(spark.createDataFrame(rows, DOCS)).collect()} == brute_divergence(rows)


def test_slices_of_one_hash_stay_apart():
    raw = np.frombuffer("Aa b,ab AB é".encode(), np.uint8)
    start, end, doc = divergence.slices(raw, np.array([0, 1, len(raw), len(raw)]))
    for hashed in (divergence.xxhash.xxh3_64_intdigest, lambda b: 7, lambda b: len(b)):
        code, terms = divergence.grouped(divergence.LOWER[raw], start, end, hashed)
        assert [terms[c].decode() for c in code] == ["a", "a", "b", "ab", "ab", "é"]
    assert doc.tolist() == [0, 1, 1, 1, 1, 1]


PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["", "Water's  edge\tit's", "<|endoftext|> a<|startoftext|>b", "ÀÖß über, naïve", "e\u0301te\u0301 \u0301x", "日本語 text", "a\u00a0b\x1cc", "12 3.14 x2y", "ſtop K ǅ", "don't 'S 'll!", "--'s--", "x" * 500, "\u2028a \x85 b", "ΑΣ ΟΔΟΣ"]


def test_ids_are_those_of_whole_texts(spark):
    words = packing._Words(PATH, 50)
    assert words.plain
    rng = random.Random(2)
    letters = "aB ß,.'\n1é|<>~-_\tÿ×ªµ"
    texts = TEXTS + ["".join(rng.choices(letters, k=rng.randint(1, 40))) for _ in range(400)] + [r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    for t in texts:
        assert words.ids(t) == np.array(words.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t


def placed(rows, size):
    """The sequences of a result, checked to be gapless and within the size."""
    seqs = {}
    for r in rows:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= size
    return seqs


def test_pieces_and_places(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 40)  # several groups and rounds
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choices(["sea", "Wall", "x1", "é."], k=rng.choice([0, 1, 5, 9, 30, 64, 63])))) for i in range(250)]
    rows += [(3, "again"), (3, "again"), (None, "no id"), (900, None), (901, ""), (902, "the " * 5_000), *[(1000 + i, t) for i, t in enumerate(TEXTS)]]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("row", "length", "piece", "part", "fill", "sequence_id", "start")})
    got = packing.pack_documents(df, PATH, 64).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset").collect()
    seqs = placed(got, 64)
    want, tokens, tok = [], 0, packing._Words(PATH).tokenizer
    for d, t in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        tokens += len(ids)
        want += [(d, k, k * 64, len(ids[k * 64 : k * 64 + 64]), zlib.crc32(np.array(ids[k * 64 : k * 64 + 64], "<u4").tobytes())) for k in range((len(ids) + 63) // 64)]
    key = lambda r: tuple((x is None, x or 0) for x in r[:5])
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(want, key=key)
    lengths = [w[3] for w in want]
    assert -(-tokens // 64) <= len(seqs) <= 1.03 * len(packing.best_fit(lengths, 64)) + 1


def test_no_documents(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_exchanges_empty_bins():
    lengths = [5, 4, 4, 3, 2, 2]  # best fit takes three bins of 10, two are enough
    bins = packing.best_fit(lengths, 10)
    assert len(bins) == 3
    after = packing.packed(lengths, 10)
    assert len(after) == 2 and sorted(i for b in after for i in b) == list(range(6))


@pytest.mark.parametrize("seed", range(6))
def test_exchanges_raise_squared_fill(seed):
    rng = random.Random(seed)
    lengths = [rng.randint(20, 60) for _ in range(300)]
    bins = packing.best_fit(lengths, 100)
    before = [sum(lengths[i] for i in b) for b in bins]
    squares = lambda fill: sum(f * f for f in fill)
    search, seen = packing.Exchange(lengths, bins, 100), squares(before)
    for _ in range(30):  # few exchanges a call, each from the state before
        search.run(3)
        now = squares(search.fill[:-1].tolist())
        assert now >= seen and max(search.fill) <= 100
        seen = now
    after = packing.packed(lengths, 100)
    assert sorted(i for b in after for i in b) == list(range(300))
    assert len(after) <= len(before) and squares(sum(lengths[i] for i in b) for b in after) >= squares(before)


def test_best_fit_takes_the_fullest_bin():
    rng = random.Random(1)
    lengths = [rng.randint(1, 50) for _ in range(400)]
    want = []
    for i in sorted(range(400), key=lambda i: -lengths[i]):
        gaps = [(50 - sum(lengths[j] for j in b), k) for k, b in enumerate(want)]
        fit = min((g for g, _ in gaps if g >= lengths[i]), default=None)
        if fit is None:
            want.append([i])
        else:
            want[next(k for g, k in gaps if g == fit)].append(i)
    fill = lambda bins: sorted(sum(lengths[i] for i in b) for b in bins)
    assert fill(packing.best_fit(lengths, 50)) == fill(want)
