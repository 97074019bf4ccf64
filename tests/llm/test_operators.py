"""Operators against brute force, planted cases and odd rows."""

import json
import math
import pickle
import random
import types
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewright.llm import chat_format, lm_score, near_dedup, substring_dedup, toxicity
from tidewright.llm.common import alnum_words, crc_mod, space_words
from tidewright.llm.decontam import decontaminate
from tidewright.llm.graph import components
from tidewright.llm.mixing import mixing_rates
from tidewright.llm.quality_model import fit_ordinal, ordinal_quality
from tidewright.llm.quality_rules import quality_rules
from tidewright.llm.sharding import assign_shards, lookup_table

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(900, None), (901, ""), (902, " \n\t "), (903, "one"), (904, "the " * 30_000), (905, "é" * 5_000), (906, "one")]


def made(seed=1, n=60, words=120):
    """Texts with copies, near copies on both sides of the limit, and a shared passage."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 6))) for _ in range(3000)]
    base = [[rng.choice(vocab) for _ in range(words)] for _ in range(n)]
    texts = [" ".join(b) for b in base]
    for k in range(40):
        b = list(base[k % 4])
        for _ in range(k % 5):
            b[rng.randrange(words)] = rng.choice(vocab)
        texts.append(" ".join(b) + (" ." if k % 7 == 0 else ""))
    passage = [rng.choice(vocab) for _ in range(70)]
    texts += [" ".join(base[20][:30] + passage + base[21][:40]), " ".join(base[22][:50] + passage + base[23][:10])]
    return list(enumerate(texts)) + ODD


def table(spark, rows):
    return spark.createDataFrame([(i, x, "en", "s", len(x or "")) for i, x in rows], SCHEMA)


def brute_components(rows, percent=85):
    sets = {}
    for i, x in rows:
        w = space_words(x)
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    up = {i: i for i, _ in rows}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = [i for i, _ in rows]
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_near_duplicates_match_brute_force(spark):
    rows = made()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(table(spark, rows)).collect()}
    assert got == brute_components(rows)


def test_near_duplicates_at_the_general_limit(spark):
    rows = made(seed=8)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(table(spark, rows), 80).collect()}
    assert got == brute_components(rows, 80) and got != brute_components(rows)


def test_bands_miss_few_pairs_at_the_limit():
    for percent in (60, 80, 85, 95):
        assert (1 - (percent / 100) ** near_dedup.ROWS) ** near_dedup.bands_for(percent) <= near_dedup.MISS
    assert near_dedup.bands_for(100) >= 1
    with pytest.raises(ValueError, match="percent"):
        near_dedup.bands_for(20)


def test_near_duplicates_of_a_group_below_the_limit(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(500)}" for _ in range(150)]
    rows = []
    for i in range(120):
        b = list(base)
        for _ in range(rng.randrange(8)):
            b[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(b)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(table(spark, rows)).collect()}
    assert got == brute_components(rows)


def test_likelihood_estimates_similarity():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**63, 1000, dtype=np.uint64)
    b = np.concatenate([a[:850], rng.integers(0, 2**63, 150, dtype=np.uint64)])
    reg = near_dedup.sketch_sets([np.unique(a), np.unique(b)])
    est = near_dedup.likely_jaccard(reg[:1], reg[1:], np.array([1000.0]), np.array([1000.0]))[0]
    assert abs(est - 850 / 1150) < 0.15


def test_empty_tables(spark):
    none = table(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert near_dedup.near_duplicates(none).count() == 0
    assert quality_rules(none).count() == 0
    assert substring_dedup.repeated_passages(none).count() == 0
    assert toxicity.toxicity(none, labels).count() == 0
    assert ordinal_quality(none, labels).count() == 0
    assert lm_score.lm_score(none, F.lit(False)).count() == 0
    assert mixing_rates(none, none.select("doc_id", F.col("lang").alias("domain")), {"en": 1.0}).count() == 0
    assert decontaminate(none, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert assign_shards(none, ["a", "b"]).count() == 0
    assert chat_format.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_near_duplicates_with_repeated_and_missing_ids(spark):
    rng = random.Random(3)
    b, c = ([f"{k}{rng.randrange(10**6)}" for _ in range(200)] for k in "bc")
    rows = [(5, b), (5, c), (6, b), (7, [*c, "more"]), (8, [*b, "more"]), (None, b), (None, ["alone"] * 3), (None, ["alone"] * 3), (9, [])]
    docs = table(spark, [(i, " ".join(w)) for i, w in rows])
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(docs).collect()), key=str)
    want = [(5, 196, 5, True), (5, 196, 5, True), (6, 196, 5, False), (7, 197, 5, False), (8, 197, 5, False), (9, 0, 9, True), (None, 1, None, True), (None, 1, None, True), (None, 196, 5, False)]
    assert got == sorted(want, key=str)


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 40)], "a long, b long")
    got = dict(components(edges).collect())
    assert got == {i: 0 for i in range(21)} | {40: 40, 50: 40}


def test_rules_on_odd_rows(spark):
    got = {r["doc_id"]: r for r in quality_rules(table(spark, made())).collect()}
    assert [got[i]["n_words"] for i in (900, 901, 902, 903)] == [0, 0, 0, 1]
    assert not any(got[i]["kept"] for i in (900, 901, 902, 903, 904, 905))
    assert got[904]["n_repeat_words"] == 30_000 and got[905]["word_chars"] == 5_000
    w = [f"u{i}" for i in range(30)]
    text = " ".join(w[:10] + w[15:20] + w[:10])
    r = quality_rules(table(spark, [(1, text + "\n#$|\nx\nx")])).first()
    assert (r["n_repeat_words"], r["n_symbols"], r["n_dup_lines"]) == (20, 3, 1)


def test_decontamination(spark):
    item = " ".join(f"B{i}" for i in range(20))
    bench = spark.createDataFrame([(7, item), (10, "tiny item"), (8, None), (9, "...")], "item_id long, text string")
    rows = [(1, "x " * 5 + " ".join(f"b{i}" for i in range(3, 18)) + " y"), (2, " ".join(f"b{i}" for i in range(12))), (3, "A TINY, item!" + " pad" * 100), *ODD]
    got = {r["doc_id"]: r for r in decontaminate(table(spark, rows), bench).collect()}
    assert (got[1]["n_hit"], got[1]["items"], got[1]["contaminated"]) == (15, ["7"], True)
    assert got[2]["n_hit"] == 0
    assert (got[3]["n_hit"], got[3]["items"], got[3]["contaminated"]) == (2, ["10"], False)
    assert got[900]["n_words"] == 0 and not got[900]["contaminated"]


def test_items_without_an_id_hit_unnamed(spark):
    bench = spark.createDataFrame([(None, "lost words here"), (5, "named words there"), (None, "named words there")], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate(table(spark, [(1, "the lost words here"), (2, "all named words there"), (2, "all named words there")]), bench).collect()}
    assert (got[1]["n_hit"], got[1]["items"], got[1]["contaminated"]) == (3, [], True)
    assert (got[2]["n_hit"], got[2]["items"]) == (3, ["5"])


def test_shards_are_even_and_stable(spark):
    old, new = lookup_table([f"s{i}" for i in range(8)]), lookup_table([f"s{i}" for i in range(7)], 800)
    assert max(np.bincount(old)) - min(np.bincount(old)) <= 1 and len(old) == len(new)
    assert sum(a != b for a, b in zip(old, new, strict=True)) < 0.35 * len(old)
    got = assign_shards(table(spark, made()), ["a", "b"]).groupBy("doc_id").agg(F.count_distinct("shard").alias("n"))
    assert got.filter("n <> 1").isEmpty()


def test_mixing_reaches_targets(spark):
    rows = [(i, "the quick brown fox jumps why " * (1 + i % 7)) for i in range(80)] + [(100 + i, "für größe öl über ähnlich süß " * 3) for i in range(20)] + ODD
    docs = table(spark, rows)
    known = docs.filter("doc_id < 105").select("doc_id", F.when(F.col("doc_id") < 100, "en").otherwise("de").alias("domain"))
    got = mixing_rates(docs, known, {"en": 0.5, "de": 0.5}).toPandas()
    p = np.stack(got["posterior"].to_numpy())
    total = ((got["rate"] * got["n_tokens"]).to_numpy()[:, None] * p).sum(0)
    assert total / total.sum() == pytest.approx([0.5, 0.5], abs=1e-3) and (got["rate"] >= 0).all() and len(got) == len(rows)


def test_mixing_rates_are_those_of_projected_gradient(spark):
    rng = random.Random(4)
    vocab = {"en": ["the", "with", "show", "why"], "de": ["über", "schön", "größe", "wäre"], "fr": ["été", "ça", "où", "être"]}
    rows = [(i, " ".join(rng.choice(vocab[lang]) for _ in range(rng.randrange(5, 60))), lang, "s", 0) for i in range(90) for lang in [rng.choice(["en", "en", "de", "fr"])]]
    docs = spark.createDataFrame(rows, SCHEMA)
    targets = {"de": 0.5, "en": 0.2, "fr": 0.3}
    got = mixing_rates(docs, docs.select("doc_id", F.col("lang").alias("domain")), targets).orderBy("doc_id").collect()
    p, n = np.array([r["posterior"] for r in got]), np.array([r["n_tokens"] for r in got], float)
    a = p * n[:, None] / n.sum()
    goal, metric = np.array([targets[d] for d in sorted(targets)]), None
    m = (p * n[:, None]).T @ p / n.sum()
    metric = np.linalg.pinv(m + 1e-9 * np.trace(m) * np.eye(3))
    r = np.ones(len(got))
    for _ in range(1000):
        miss = r @ a - goal
        if np.abs(miss).max() < 1e-6:
            break
        r = np.maximum(0, r - p @ (metric @ miss))
    assert [x["rate"] for x in got] == pytest.approx(r.tolist(), abs=1e-5) and min(r) >= 0
    assert (np.array([x["rate"] for x in got]) @ a).tolist() == pytest.approx(goal.tolist(), abs=1e-3)
    assert all(x["copies"] in (math.floor(x["rate"]), math.floor(x["rate"]) + 1) for x in got)


def test_mixing_with_domains_without_texts(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["the", "with", "show", "why"]) for _ in range(rng.randrange(1, 200)))) for i in range(60)]
    docs = table(spark, [*rows, (60, None), (61, " ")])
    for known in (docs.filter("doc_id < 20"), docs.limit(0)):
        labelled = known.select("doc_id", F.col("lang").alias("domain"))
        for keep in (False, True):
            got = mixing_rates(docs, labelled, {"en": 0.4, "de": 0.3, "fr": 0.3}, keep_all=keep).collect()
            assert len(got) == 62 and all(0 <= r["rate"] < 20 for r in got)
            assert [r["rate"] for r in got if r["n_tokens"] == 0] == [1, 1]


def test_toxicity_learns_words_and_stems(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(400):
        w = [f"w{rng.randrange(300)}" for _ in range(40)]
        toxic = i % 4 == 0
        if toxic:
            w[rng.randrange(40)] = rng.choice(["creep", f"blarg{rng.randrange(99)}"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    got = toxicity.toxicity(table(spark, rows + ODD), spark.createDataFrame(labels[:300] + [(None, 1), (3, None)], "doc_id long, toxic int")).toPandas().set_index("doc_id")
    want = dict(labels)
    assert np.mean([got.loc[i, "predicted"] == want[i] for i in range(300, 400)]) > 0.9
    assert got["score"].between(0, 1).all() and len(got) == 400 + len(ODD)


def test_grammar_scopes():
    weigh = lambda *s: toxicity.GRAMMAR.weigh([(x, 2.0 if x == "insult" else 0.0) for x in s])
    plain = weigh("insult")
    assert weigh("target", "insult") > plain > weigh("report", "insult") > weigh("negation", "insult") > 0


def test_ordinal_thresholds_order():
    rng = np.random.default_rng(0)
    rows = [(np.array([g, 10 + rng.integers(5)]), np.array([1.0, 0.2])) for g in (0, 1, 2) for _ in range(50)]
    w, cuts = fit_ordinal(rows, np.repeat([0, 1, 2], 50), 3)
    assert cuts[0] <= cuts[1] and w[0] < w[1] < w[2]


def test_ordinal_probabilities_of_three_grades(spark):
    rng = random.Random(8)
    words = {0: "bad awful poor", 1: "fair middling plain", 2: "good fine splendid"}
    rows = [(i, " ".join(rng.choice(words[i % 3].split()) for _ in range(30))) for i in range(120)]
    docs = table(spark, rows)
    labels = spark.createDataFrame([(i, i % 3) for i, _ in rows[:90]], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in ordinal_quality(docs, labels, n_grades=3).collect()}
    mean = [np.mean([got[i]["expected_grade"] for i in range(90, 120) if i % 3 == g]) for g in range(3)]
    assert mean[0] + 0.3 < mean[1] < mean[2] - 0.3
    assert all(0 <= r["expected_grade"] <= 2 and 0 <= r["tail_probability"] <= 1 for r in got.values())


def test_quality_model_separates(spark):
    rows = [(i, " ".join(f"w{(i * 7 + k) % 90}" for k in range(50)) if i % 2 else "BUY!! " * 50) for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, quality int")
    got = ordinal_quality(table(spark, rows + ODD), labels).toPandas().set_index("doc_id")
    assert all(bool(got.loc[i, "kept"]) == bool(i % 2) for i in range(120, 200))


def test_passages(spark):
    got = {(r["doc_id"], r["source_doc_id"]): r for r in substring_dedup.repeated_passages(table(spark, made())).collect()}
    r = got[(101, 100)]
    assert (r["start"], r["end"], r["source_start"], r["source_end"]) == (50, 120, 30, 100) and r["identity"] == 1.0
    assert not any(r["doc_id"] in range(4, 60) for r in got.values())


def test_chain_is_best_against_brute_force():
    rng = random.Random(4)
    for _ in range(30):
        m = sorted({(rng.randrange(60), rng.randrange(60)) for _ in range(9)})
        best = 0.0
        score = {}
        for b, a in m:
            score[b, a] = substring_dedup.K + max([0.0, *(s - substring_dedup.GAP_COST * (b - y + a - x) for (y, x), s in score.items() if y < b and x < a)])
            best = max(best, score[b, a])
        chain = substring_dedup.chains(m)[0]
        (b0, a0), (b1, a1) = chain[0], chain[-1]
        assert len(chain) * substring_dedup.K - substring_dedup.GAP_COST * (b1 - b0 + a1 - a0) == pytest.approx(best)


def brute_hits(rows, items, width=13):
    """(doc_id, n_words, n_hit, items, spans) of every row by looking at each window of each item."""
    out = []
    for doc, x in rows:
        words, hit, named = alnum_words(x), set(), set()
        for item, y in items:
            w = alnum_words(y)
            n = min(width, len(w))
            wanted = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
            at = [i for i in range(len(words) - n + 1) if tuple(words[i : i + n]) in wanted] if n else []
            hit |= {(i, i + n) for i in at}
            named |= {str(item)} if at and item is not None else set()
        spans = []
        for i, j in sorted(hit):
            if spans and i <= spans[-1][1]:
                spans[-1][1] = max(j, spans[-1][1])
            else:
                spans.append([i, j])
        out.append((doc, len(words), sum(j - i for i, j in spans), sorted(named), spans))
    return sorted(out, key=str)


@pytest.mark.parametrize("most", [16_000_000, 300])
def test_decontamination_equals_brute_force_by_broadcast_and_by_join(spark, monkeypatch, most):
    monkeypatch.setattr("tidewright.llm.decontam.BLOCK_BYTES", most)
    monkeypatch.setattr("tidewright.llm.decontam.HOT", 2)  # nearly every window is spread
    rng = random.Random(8)
    texts = [" ".join(invented(rng, 20)) for _ in range(6)]
    items = [*enumerate([*texts, None, "one", "", "...", f"{texts[1]} {texts[4]}", texts[0]]), (None, texts[5]), (3, "free again"), (3, "free again")]
    rows = [(1, f"{texts[0]} {texts[5]}"), (1, texts[3] + " x " * 30), (2, f"{texts[2]} {texts[2]}"), (3, "free"), (3, "free"), (None, texts[4]), *ODD]
    rows += [(20 + k, " ".join(invented(rng, 5)) + " " + texts[k % 3] + " É " + " ".join(invented(rng, 5))) for k in range(30)]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("row", F.lit("clash"))
    found = decontaminate(table(spark, rows).withColumn("row", F.lit(1)).repartition(3), bench)
    got = [(r["doc_id"], r["n_words"], r["n_hit"], r["items"], [[x["start"], x["end"]] for x in r["spans"]]) for r in found.collect()]
    assert sorted(got, key=str) == brute_hits(rows, items)
    assert decontaminate(table(spark, []), bench).count() == 0


def test_wordless_large_benchmark_hits_nothing(spark, monkeypatch):
    monkeypatch.setattr("tidewright.llm.decontam.BLOCK_BYTES", 3)
    bench = spark.createDataFrame([(1, "... ... ..."), (2, None)], "item_id long, text string")
    assert {r["n_hit"] for r in decontaminate(table(spark, made()[:5]), bench).collect()} == {0}


def test_chain_takes_best_near_match():
    m = [(i, i) for i in range(0, 61, 5)] + [(300, 300), (310, 310)]
    assert [(300, 300), (310, 310)] in substring_dedup.chains(m)


def invented(rng, n):
    return ["".join(rng.choices("abcdefgh", k=6)) for _ in range(n)]


def in_texts(rng, *parts):
    return [(i, " ".join([*invented(rng, 40), *p, *invented(rng, 40)])) for i, p in enumerate(parts, 1)]


def test_passage_whose_parts_occur_in_smaller_documents(spark):
    rng = random.Random(5)
    p = invented(rng, 80)
    rows = in_texts(rng, p[:40], p, [*p[:37], "edited", *p[38:]])
    a, b = invented(rng, 30), invented(rng, 30)
    rows += [(i + 10, x) for i, x in in_texts(rng, b, a, a + b, a + b)]
    got = {(r["doc_id"], r["source_doc_id"]): r for r in substring_dedup.repeated_passages(table(spark, rows)).collect()}
    assert (got[3, 2]["start"], got[3, 2]["end"], got[3, 2]["identity"]) == (40, 120, 79 / 80)
    assert (got[14, 13]["start"], got[14, 13]["end"]) == (40, 100)


def test_edited_passages(spark):
    """Edits each eight words, three edits in 55 words, random ones down to 0.82; two edited passages in one pair."""
    rng = random.Random(6)

    def edited(p, at):
        return [w if i not in at else "".join(rng.choices("stuvw", k=6)) for i, w in enumerate(p)]

    rows, want, i = [], [], 0
    for n, at in [(64, range(7, 64, 8)), (55, (13, 27, 41)), *[(100, rng.sample(range(1, 99), k)) for k in (5, 10, 15, 18)]]:
        p = invented(rng, n)
        for part in (p, edited(p, at)):
            rows.append((i, " ".join([*invented(rng, 50), *part, *invented(rng, 50)])))
            i += 1
        want.append((i - 1, i - 2, n))
    p, q = invented(rng, 100), invented(rng, 100)
    for r, s, gap in ((p, q, 150), (edited(p, range(10, 100, 20)), edited(q, range(10, 100, 20)), 150)):
        rows.append((i, " ".join([*r, *invented(rng, gap), *s])))
        i += 1
    got = substring_dedup.repeated_passages(table(spark, rows)).collect()
    for b, a, n in want:
        (r,) = [r for r in got if (r["doc_id"], r["source_doc_id"]) == (b, a)]
        assert r["identity"] >= 0.8 and r["end"] - r["start"] >= max(50, 0.8 * n) and r["start"] >= 50 and r["end"] <= 50 + n
    two = sorted((r["start"], r["end"]) for r in got if r["doc_id"] == i - 1)
    assert two == [(0, 100), (250, 350)] and len(got) == len(want) + 2


def test_extension_against_brute_force():
    rng = random.Random(7)
    for _ in range(20):
        x = [rng.randrange(50) for _ in range(30)]
        y = [w for w in x if rng.random() > 0.1]
        ends, top = substring_dedup.extend(np.array(x), np.array(y))
        score = {(i, j): 5 * substring_dedup.common_length(np.array(x[:i]), np.array(y[:j])) - 2 * (i + j) for i in range(31) for j in range(len(y) + 1)}
        assert 5 * top[2] - 2 * (top[0] + top[1]) == max(score.values()) and top in ends


def test_lm_base_score_is_exact_and_model_learns(spark):
    rows = made(9, 80)
    held = crc_mod("doc_id", 10) == 0
    docs = table(spark, rows)
    got = {r["doc_id"]: r for r in lm_score.lm_score(docs, held).collect()}
    out = {r["doc_id"] for r in docs.filter(held).select("doc_id").collect()}
    count = {}
    for i, x in rows:
        if i not in out:
            for w in [*space_words(x), b""]:
                count[w] = count.get(w, 0) + 1
    total, types = sum(count.values()), len(count)
    for i, x in rows:
        tokens = [*space_words(x), b""]
        want = sum(math.log10((count.get(w, 0) + 0.1) / (total + 0.1 * (types + 1))) for w in tokens)
        r = got[i]
        assert r["base_score"] == pytest.approx(want, rel=1e-9) and r["train_tokens"] == total and r["n_tokens"] == len(tokens)
        assert r["n_known"] == sum(w in count for w in tokens) and r["held_out"] == (i in out) and r["score"] < 0


def scalar_score(model, tokens, held):
    """log10 probability of a text, token by token and bit by bit."""
    mask = (1 << 32) - 1

    def mix32(x):
        x = (x ^ x >> 16) * 0x7FEB352D & mask
        return x ^ x >> 15

    def path(code, symbol):
        at = int(code.start[symbol])
        return [(int(code.node[k - (k - at) % 3]), int(code.told[k])) for k in range(at, at + int(code.size[symbol]))]

    def state(table, key, top, told, bits):
        group = (key ^ mix32((top * 0x9E3779B1 + 5) & mask)) * 0x846CA68B & mask
        return int(table[group >> 32 - bits & ~7 | told >> 5])

    def level(state, bit):
        return int(lm_score.LEVEL[held * 512 + state * 2 + bit])

    def spelling(word):
        total, so_far, power, past = 0.0, 0, 0x01000193, []
        for depth, byte in enumerate(word + b" "):
            keys = []
            for back in (2, 4):
                h = 0
                for b in range(1, back + 1):
                    h = (h * 263 + (past[-b] + 1 if b <= depth else 0)) & mask
                keys.append(mix32((h + back) & mask))
            keys.append(mix32((so_far + depth * 0x27D4EB2F) & mask))
            for node, told in path(model.spell_code, byte):
                bit = told & 1
                a, b, c = (level(state(t, k, node, told, n), bit) for t, k, n in zip(model.spells, keys, lm_score.SPELL_BITS))
                total += float(model.spell_mix[((a * lm_score.LEVELS + b) * lm_score.LEVELS + c) * 2 + bit])
            so_far = (so_far + (byte + 1) * power) & mask
            power = power * 0x01000193 & mask
            past.append(byte)
        return total

    escape = len(model.known)
    symbols = [model.known.get(w, escape) for w in tokens]
    score, others, odd, tries, hits, run = 0.0, [], 0, 0, 0, 0
    for i, (w, s) in enumerate(zip(tokens, symbols)):
        one = symbols[i - 1] if i else escape + 1
        lead = [sum(x < lm_score.MARKERS and model.kinds[x] == k for x in symbols[:i]) for k in range(lm_score.KINDS)]
        kind = lead.index(max(lead)) if max(lead) else lm_score.KINDS
        keys = mix32((kind * 0xC2B2AE35 + 77) & mask), mix32((one * 0x85EBCA6B + 1) & mask)
        strange = int(np.digitize((odd + 0.4) / (i + 4), lm_score.STRANGE))
        now = 0.0
        for node, told in path(model.code, s):
            bit = told & 1
            a, b = (level(state(t, k, node, told, n), bit) for t, k, n in zip(model.tables, keys, lm_score.BITS))
            now += float(model.mix[(((strange * lm_score.NODE_LEVELS + (told >> 1 & 15)) * lm_score.LEVELS + a) * lm_score.LEVELS + b) * 2 + bit])
        if s == escape:
            p = (0.5 + hits) / (1 + tries) if tries else 0.0
            now += math.log10(p / len(set(others))) if w in others else math.log10(1 - p) + spelling(w)
            hits, tries, odd = hits + (w in others), tries + 1, odd + 1
            others.append(w)
        then = [j for j in range(2, i) if tokens[j - 2 : j] == tokens[i - 2 : i]]
        hit = bool(then) and tokens[then[-1]] == w
        if then:
            now = (0 if hit else now) + float(model.run[int(hit), np.digitize(run, lm_score.RUNS)])
        run = run + 1 if hit else 0
        score += now
    return score


def test_lm_score_is_the_product_of_its_bits(spark):
    rows = made(9, 40) + [(500, "a b c d e f g a b c d q9 q9 a b c d e f zz zz zz zz"), (501, "x y " * 30), (None, "a b")]
    docs = table(spark, rows).withColumn("held_out", F.coalesce(crc_mod("doc_id", 10) == 0, F.lit(False)))
    *_, model = lm_score.learned(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "held_out"))
    got = [{(r["doc_id"], r["held_out"], r["n_tokens"]): r["score"] for r in lm_score.lm_score(docs.repartition(n), F.col("held_out")).collect()} for n in (1, 5)]
    assert got[0] == got[1]
    for i, x in rows:
        if i != 904:
            tokens = [*space_words(x), b""]
            held = i is not None and zlib.crc32(str(i).encode()) % 10 == 0
            assert got[0][i, held, len(tokens)] == pytest.approx(scalar_score(model, tokens, held), rel=1e-4)


def test_lm_bits_are_a_distribution(spark):
    docs = table(spark, made(9, 40)).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.lit(False).alias("held_out"))
    *_, model = lm_score.learned(docs)
    assert sum(2.0**-n for n in model.code.size) == pytest.approx(1)
    n = len(model.known) + 1
    ids = np.array([[3, 1, x if x < n - 1 else lm_score.TAIL] for x in range(n)], np.uint32)
    row = types.SimpleNamespace(ids=ids.tobytes(), size=np.full(n, 3, np.int32).tobytes(), held=np.ones(n, bool).tobytes(), tail=b"?")
    texts = lm_score.Texts(row, n - 1, model.kinds)
    each = np.empty(texts.unique)
    for i, j in texts.chunks():
        cell, _, first = lm_score.word_cells(texts, model.code, model.tables, i, j)
        each[i:j] = np.add.reduceat(model.mix[cell].astype(float), first)
    p = 10 ** each[texts.which].reshape(-1, 3)[:, 2]
    assert p.sum() == pytest.approx(1, rel=1e-4)


def test_lm_work_is_once_a_group_of_bits(spark, monkeypatch):
    rng = np.random.default_rng(3)
    code = lm_score.Code(rng.integers(1, 1000, 300))
    symbols, key, times = rng.integers(0, 300, 500), rng.integers(0, 40, 500).astype(np.uint32), rng.integers(1, 9, 500)
    sought, group = [], lm_score._group
    monkeypatch.setattr(lm_score, "_group", lambda key, *more: sought.append(len(key)) or group(key, *more))
    counts = np.zeros(2 << 12, np.uint64)
    lm_score.count_leaves(counts, code, symbols, key, times)
    assert sum(sought) == (-(-code.size[symbols] // 3)).sum()
    want = np.zeros_like(counts)
    for s, k, t in zip(symbols, key, times):
        for i in range(int(code.start[s]), int(code.start[s] + code.size[s])):
            first = int((int(k) ^ int(code.key[i])) * 0x846CA68B & 0xFFFFFFFF) >> 20 & ~7
            want[(first | int(code.told[i]) >> 5) * 2 + (int(code.told[i]) & 1)] += np.uint64(t)
    assert (lm_score.by_bit(counts) == want).all()

    states = [rng.integers(0, 231, 1 << 12).astype(np.uint8) for _ in range(2)]
    sought.clear()
    for out in (False, True):
        order, start, live = code.sorted(symbols)
        keys = [key.take(order), key.take(order) * np.uint32(7)]
        depths = list(lm_score.levels_by_depth(code, start, live, keys, lm_score.levels_of(states, out)))
        assert sum(n for n, *_ in depths) == code.size[symbols].sum()
        for n, at, told in depths:
            for k, state, level in zip(keys, states, told):
                slot = ((k[:n] ^ code.key[at]) * np.uint32(0x846CA68B) >> np.uint32(20) & np.uint32(0xFFFFFFF8)) | code.told[at] >> 5
                assert (level == lm_score.LEVEL[512 * out + state[slot].astype(int) * 2 + (code.told[at] & 1)]).all()
    assert sum(sought) == 4 * (-(-code.size[symbols] // 3)).sum()
    copy = pickle.loads(pickle.dumps(code))
    assert len(pickle.dumps(code)) < 8 * len(code.told) + 32 * len(code.size) + 2000
    assert (copy.cell == code.cell).all() and (copy.place == code.place).all()


def test_lm_blocks_hold_every_word_once(monkeypatch):
    monkeypatch.setattr(lm_score, "BLOCK_TOKENS", 12)
    rows = [(1, "\t A\x0bb  a\x1fc\u00a0\u00c9 \r\n", False), (2, "", True), (None, " ", False), (4, "\u00e9 B a\x00", True), (5, "x " * 30 + "X", False), (6, "a", False)]
    batches = [pa.RecordBatch.from_pylist([dict(zip(("doc_id", "text", "held_out"), r)) for r in some], pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("held_out", pa.bool_())])) for some in (rows[:1], [], rows[1:5], rows[5:])]
    batches[2] = pa.concat_batches([batches[0], batches[2]]).slice(1)
    got, sizes = [], []
    for block in lm_score._blocks(iter(batches)):
        (r,) = block.to_pylist()
        assert lm_score._words(r["words"]).to_pylist() == r["words"].split(b" ") and len(set(r["words"].split(b" "))) == len(r["words"].split(b" "))
        words, ids = r["words"].split(b" "), lm_score._unpacked(r["ids"])
        held, size = np.frombuffer(r["held"], bool), np.frombuffer(r["size"], np.int32)
        assert (np.sort(held) == held).all() and size.sum() == len(ids)
        sizes.append(len(ids))
        texts = zip(np.frombuffer(r["doc"], np.int64), np.frombuffer(r["null"], bool), held, np.split(ids, np.cumsum(size)[:-1]), np.frombuffer(r["length"], np.int64))
        got += [(None if no else int(d), bool(h), [words[i] for i in x], int(n)) for d, no, h, x, n in texts]
    want = [(d, h, [*space_words(x), b""], sum(len(w) + 1 for w in [*space_words(x), b""])) for d, x, h in rows]
    assert sorted(got, key=str) == sorted(want, key=str) and len(sizes) == 2


def test_tool_calls(spark):
    call = lambda i, args, need=(): {"id": i, "name": "add", "arguments": args, "depends_on": list(need)}
    rows = [
        (1, 0, "user", "go"),
        (1, 1, "assistant", json.dumps({"tool_calls": [call("b", {"y": 2, "x": 1}, ["a"]), call("a", {"x": "no"}), call("c", {"x": 1}, ["d"]), call("d", {"x": 1}, ["c"])]})),
        (1, 2, "tool", json.dumps({"tool_call_id": "b", "content": "3"})),
        (1, 3, "tool", json.dumps({"tool_call_id": "z", "content": "?"})),
        (1, 3, "tool", json.dumps({"tool_call_id": "b", "content": "later"})),
        (2, 0, "user", None), (2, 0, "user", None), (None, None, None, None), (2, 1, "assistant", "{broken"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat_format.format_chats(df, {"add": {"x": ("integer", True), "y": ("integer", False)}}, pairs=False).collect()
    by = {r["call_id"]: r for r in sorted(got, key=lambda r: r["kind"], reverse=True) if r["call_id"]}
    assert [by[k]["status"] for k in "abcdz"] == ["invalid", "ok", "cycle", "cycle", "orphan"]
    assert by["a"]["pos"] < by["b"]["pos"] and by["b"]["level"] == 1
    assert by["b"]["json"] == '{"arguments":{"x":1,"y":2},"id":"b","name":"add","result":"3","type":"tool_call"}'
    assert sum(r["kind"] == "message" for r in got) == 5
    pairs = chat_format.format_chats(df).collect()
    assert len(pairs) == 1 + 4 + 1 + 1 + 1 + 1 + 1  # the later result of b is told too


def brute_links(calls, results):
    """(call, result) pairs and lone results of one call_id, first come, first served."""
    open_, pairs, lone = [], [], []
    for turn, kind, text in sorted([(t, 0, a) for t, a in set(calls)] + [(t, 1, c) for t, c in results]):
        if kind == 0:
            open_.append((turn, text))
        elif open_:
            pairs.append((open_.pop(0), (turn, text)))
        else:
            lone.append((turn, text))
    return pairs, lone, open_


def test_calls_meet_results_as_by_brute_force(spark):
    rng = random.Random(5)
    want, calls, results = [], [], []
    for conv in range(40):
        for name in "ab":
            c = [(rng.randrange(8), json.dumps({"x": rng.randrange(3)})) for _ in range(rng.randrange(4))]
            r = [(rng.randrange(8), f"r{rng.randrange(5)}") for _ in range(rng.randrange(4))]
            calls += [(conv, t, name, "add", a, None) for t, a in c]
            results += [(conv, t, name, x) for t, x in r]
            pairs, lone, open_ = brute_links(c, r)
            want += [(conv, name, "ok", t, u) for (t, _), (u, _) in pairs] + [(conv, name, "orphan", t, t) for t, _ in lone] + [(conv, name, "unanswered", t, None) for t, _ in open_]
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    c = spark.createDataFrame(calls, "conv_id long, turn long, call_id string, name string, arguments string, depends_on array<string>")
    r = spark.createDataFrame(results, "conv_id long, turn long, call_id string, content string")
    got = [(x["conv_id"], x["call_id"], x["status"], x["turn"], x["result_turn"]) for x in chat_format.link_calls(none, c, r, {"add": {"x": ("integer", True)}}).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_words_split():
    assert space_words("A b C\x0bd") == ["a b".encode(), b"c", b"d"] and alnum_words("It's É9") == [b"it", b"s", "É9".encode()]


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs
    for name, stage in p.STAGES:
        after = stage(spark, before, sf)
        ids, kept = ({r[0] for r in x.select("doc_id").collect()} for x in (before, after))
        assert kept <= ids
        if name != p.STAGES[-1][0]:
            assert after.columns == docs.columns
        if name == "near_dedup":
            groups = brute_components([(r["doc_id"], r["text"]) for r in before.collect()], p.SIMILAR)
            assert kept == {i for i, (_, c) in groups.items() if i == c}
        before = p.saved(after, "stage")
    assert p.run(spark, sf).count() == before.count()


def test_pipeline_stages_with_repeated_and_missing_ids(spark):
    """Rows that share a doc_id, or have none, are judged one by one; extra columns stay, whatever their names."""
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.001"
    rng = random.Random(4)
    a, b, c = ([f"{k}{rng.randrange(10**6)}" for _ in range(200)] for k in "abc")
    item = spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").first()["text"]
    rows = [(5, a), (5, b), (5, b), (3, [*b, "more"]), (None, a), (None, c), (None, c), (7, []), (7, []), (8, None), (None, item.split())]
    rows = [(i, w if w is None else " ".join(w)) for i, w in rows]
    docs = table(spark, rows)
    docs = docs.select("*", *[F.lit(k).alias(n) for k, n in enumerate(["row", "id", "copies", "col", "kept", "component_id"])])
    texts = lambda d: sorted(((r["doc_id"], r["text"]) for r in d.collect()), key=str)

    got = p.near_dedup_stage(spark, docs, sf)
    assert got.columns == docs.columns
    left = [rows[i] for i in (0, 3, 5, 7, 8, 9, 10)]
    assert texts(got) == sorted(left, key=str)
    got = p.decontaminate_stage(spark, docs, sf)
    assert got.columns == docs.columns and texts(got) == sorted(rows[:10], key=str)
    got = p.mixing_stage(spark, docs, sf)
    assert got.columns == docs.columns and set(texts(got)) == set(rows)
    assert got.count() < 20 * len(rows)
    assert p.sharding_stage(spark, docs, sf).count() == len(rows)
    for name, stage in p.STAGES:
        none = stage(spark, docs.limit(0), sf)
        assert none.count() == 0 and (name == "sharding" or none.columns == docs.columns)
