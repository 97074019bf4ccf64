"""The subpackage's queries over whole tables, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat_format import format_chats
from .common import crc_mod
from .decontam import decontaminate
from .divergence import LEAST_DOCS, SCALE, TOP, source_divergence
from .lm_score import lm_score
from .mixing import mixing_rates
from .near_dedup import near_duplicates
from .packing import pack_documents
from .prefix_trie import GROUP, SHARED, prefix_trie
from .quality_model import ordinal_quality
from .quality_rules import RULES, STOP_WORDS, quality_rules
from .sharding import assign_shards, lookup_table
from .substring_dedup import repeated_passages
from .toxicity import toxicity

#: Share of tokens wanted of each language.
TARGETS = {"de": 0.2, "en": 0.45, "es": 0.15, "fr": 0.2}
SHARDS = [f"shard-{i:02d}" for i in range(16)]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    rates = mixing_rates(docs, language_labels(docs, _table(spark, sf_dir, "labels")), TARGETS)
    each = [F.get("posterior", F.lit(i)).alias(f"p_{d}") for i, d in enumerate(sorted(TARGETS))]
    return rates.select("doc_id", "n_tokens", *each, "domain", "rate", "copies")


def language_labels(docs: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows with a rating are the labelled table, by their ``key``; their label is the language."""
    rated = docs.join(labels.select("doc_id").distinct(), "doc_id", "left_semi").filter("lang is not null")
    return rated.select(F.col(key).alias("doc_id"), F.col("lang").alias("domain"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return assign_shards(docs, SHARDS)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    seen = _table(spark, sf_dir, "labels").filter(crc_mod("doc_id", 5) != 0)
    held = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False))
    return toxicity(docs, seen).select("doc_id", held.alias("held_out"), "score", "predicted", "n_clauses", "strongest")


def op6_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    seen = _table(spark, sf_dir, "labels").filter(crc_mod("doc_id", 5) != 0)
    held = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False))
    return ordinal_quality(docs, seen).select("doc_id", held.alias("held_out"), "expected_grade", "tail_probability", "kept")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    joined = F.array_join("items", ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(joined.cast("binary"), 256).alias("items_sha256"), "contaminated")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(_table(spark, sf_dir, "documents"))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score(_table(spark, sf_dir, "documents"), crc_mod("doc_id", 10) == 0)


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(_table(spark, sf_dir, "conversations"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(_table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(_table(spark, sf_dir, "conversations"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpus_pipeline import run

    return run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [op1_quality_rules, op2_mixing, op3_near_dedup, op4_sharding, op5_toxicity, op6_quality_model, op7_decontaminate, op8_substring_dedup, op9_lm_score, op10_chat_format, op11_packing, op12_divergence, op13_prefix_trie, pipeline]
    return {f.__name__: f for f in named}


_SPACE = r"[\x20\x09-\x0D]+"


def _rule_sql(r) -> str:
    parts = [f"{r.metric} < {r.low}"] if r.low is not None else []
    parts += [f"{r.metric} > {r.high}"] if r.high is not None else []
    return f"(({' or '.join(parts)}) and n_words >= {r.words}) as bad_{r.name}"


def _op1_sql() -> str:
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    ratio = lambda a, b, n: f"case when {b} = 0 then 0.0::double else {a}::double / {b} end as {n}"
    bad = " or ".join(f"bad_{r.name}" for r in RULES)
    return rf"""
    with t as (select doc_id, coalesce(text, '') as text from documents),
    w as (select doc_id, text, list_filter(regexp_split_to_array(text, '{_SPACE}'), lambda x: x <> '') as words,
        list_filter(string_split(text, chr(10)), lambda x: regexp_replace(x, '{_SPACE}', '', 'g') <> '') as lines from t),
    k as (select doc_id, i, array_to_string(words[i:i + 7], ' ') as k
        from (select doc_id, words, unnest(range(1, len(words) - 6)) as i from w)),
    d as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, k) as c from k) where c > 1),
    r as (select doc_id, count(distinct i + j) as n from d, range(8) as s(j) group by doc_id),
    c as (select w.doc_id, len(words)::bigint as n_words,
        length(regexp_replace(text, '{_SPACE}', '', 'g'))::bigint as word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
        (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
        coalesce(r.n, 0)::bigint as n_repeat_words,
        length(regexp_replace(text, '[^!?]', '', 'g'))::bigint as n_marks,
        len(list_filter(words, lambda x: lower(x) in ({stop})))::bigint as n_stop_words,
        len(lines)::bigint as n_lines from w left join r using (doc_id)),
    m as (select *, {ratio("word_chars", "n_words", "mean_word_chars")}, {ratio("n_symbols", "n_words", "symbols_per_word")},
        {ratio("n_marks", "n_words", "marks_per_word")}, {ratio("n_stop_words", "n_words", "stop_word_ratio")},
        {ratio("n_dup_lines", "n_lines", "repeated_line_ratio")}, {ratio("n_repeat_words", "n_words", "repeated_word_ratio")} from c),
    f as (select *, (n_words < 20 or 100 * n_repeat_words > 30 * n_words) as base_failed, {", ".join(map(_rule_sql, RULES))} from m)
    select *, not base_failed and not ({bad}) as kept from f"""


def _op4_sql() -> str:
    table = lookup_table(SHARDS)
    names = ", ".join(f"'{s}'" for s in SHARDS)
    return f"""
    with s as (select doc_id, source, n_chars,
        (('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 15))::bigint % {len(table)})::integer as slot from documents),
    t as (select *, {table}[slot + 1]::integer as shard from s)
    select *, [{names}][shard + 1] as shard_name from t"""


def _op7_sql() -> str:
    words = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
    return f"""
    with b as (select item_id, {words} as w from benchmark), d as (select doc_id, {words} as w from documents),
    bw as (select distinct item_id, least(13, len(w)) as n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') as k
        from (select item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) as i from b where len(w) > 0)),
    sizes as (select distinct n from bw),
    dw as (select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') as k
        from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, sizes)),
    h as (select doc_id, dw.n, i, item_id from dw join bw on dw.n = bw.n and dw.k = bw.k),
    c as (select doc_id, count(distinct i + j)::bigint as n_hit from h, range(13) as s(j) where j < n group by doc_id),
    t as (select doc_id, count(distinct item_id)::bigint as n_items, sha256(array_to_string(list_sort(list(distinct item_id::varchar)), ',')) as items_sha256 from h group by doc_id)
    select d.doc_id, len(d.w)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
        coalesce(items_sha256, sha256('')) as items_sha256,
        coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(d.w) as contaminated
    from d left join c using (doc_id) left join t using (doc_id)"""


def _op12_sql() -> str:
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    part = f"1 + ({SCALE}::hugeint * ({{}} + 1)) // ({{}})"
    return rf"""
    with d as (select row_number() over () as i, coalesce(lang, '') as lang, coalesce(source, '') as source, {low} as text from documents),
    t as (select i, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
    k as (select lang, term, count(*) as c from t group by 1, 2 having count(distinct i) >= {LEAST_DOCS}),
    v as (select lang, count(*) as v, sum(c) as n from k group by 1),
    c as (select lang, source, term, count(*) as c from t join k using (lang, term) group by 1, 2, 3),
    g as (select lang, source, coalesce(n, 0) as n from (select distinct lang, source from d) left join (select lang, source, sum(c) as n from c group by 1, 2) using (lang, source)),
    p as (select g.lang, g.source, k.term, coalesce(c.c, 0) as c, {part.format("coalesce(c.c, 0)", "g.n + v.v")} as p, {part.format("k.c", "v.n + v.v")} as q
        from g join k using (lang) join v using (lang) left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
    s as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by 1, 2, 3),
    r as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0) as value from g a join g b on a.lang = b.lang and a.source <> b.source
            left join s on s.lang = a.lang and s.source = a.source and s.item = b.source
        union all select lang, source, 'term', term, (p - q) * (p - q) // q from p where c > 0 and p > q),
    o as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from r)
    select lang, source, part, item, value::bigint as value, rank::integer as rank from o where part = 'pair' or rank <= {TOP}"""


def _op13_sql() -> str:
    step = "xor(xor(c, b) >> 1, case when xor(c, b) & 1 = 1 then 3988292384 else 0 end)"
    bits = "flatten(list_transform(string_split(conv_id::varchar, ''), lambda x: [ascii(x)::bigint, 0, 0, 0, 0, 0, 0, 0]))"
    text = "strlen(coalesce(role, ''))::varchar || ':' || coalesce(role, '') || coalesce(text, '')"
    return f"""
    with t as (select conv_id, coalesce(role, '') as role, length(coalesce(text, ''))::bigint as chars, sha256({text}) as x, turn from conversations where conv_id is not null),
    o as (select conv_id, list(x order by turn nulls first, role, x) as x, list(chars order by turn nulls first, role, x) as chars from t group by 1),
    h as (select *, xor(list_reduce(list_prepend(4294967295, {bits}), lambda c, b: {step}), 4294967295) % {SHARED} as h from o),
    r as (select h.conv_id, list_concat(coalesce(b.x, [])[:h.h], h.x[h.h + 1:]) as x, list_concat(coalesce(b.chars, [])[:h.h], h.chars[h.h + 1:]) as chars
        from h left join o b on b.conv_id = h.conv_id - h.conv_id % {GROUP}),
    p as (select conv_id, d, md5(array_to_string(x[:d], ',')) as node, md5(array_to_string(x[:d - 1], ',')) as up, case when d > 0 then chars[d] else 0 end as chars, d = len(x) as ended
        from (select *, unnest(range(0, len(x) + 1)) as d from r)),
    n as (select d, node, min(up) as up, min(conv_id) as conv_id, count(*) as n_convs, (count(*) - 1) * any_value(chars) as saved, list(conv_id order by conv_id) filter (ended) as ends from p group by 1, 2),
    m as (select n.*, u.conv_id as parent, (select count(*) from n k where k.d = n.d + 1 and k.up = n.node) as kids from n left join n u on u.d = n.d - 1 and u.node = n.up),
    path as (select distinct a.d, a.node, b.d as below_d, b.node as below from p a join p b on a.conv_id = b.conv_id and a.d <= b.d),
    s as (select path.d, path.node, sum(saved) as saved, count_if(kids = 0) as leaves from path join m on m.d = path.below_d and m.node = path.below group by 1, 2)
    select m.conv_id::bigint as conv_id, m.d::bigint as depth, case when m.d > 0 then m.parent end::bigint as parent_conv_id, m.n_convs::bigint as n_convs, m.kids::bigint as n_children,
        s.leaves::bigint as n_leaves, s.saved::bigint as saved_tokens, sha256(coalesce(array_to_string(list_transform(m.ends, lambda c: c::varchar), ','), '')) as ends_sha256
    from m join s on s.d = m.d and s.node = m.node"""


def oracle_sql() -> dict[str, str]:
    """SQL exists for the rules, the shards, the decontamination, the divergences and the trie; the others are tested by brute force."""
    return {"op1_quality_rules": _op1_sql(), "op4_sharding": _op4_sql(), "op7_decontaminate": _op7_sql(), "op12_divergence": _op12_sql(), "op13_prefix_trie": _op13_sql()}
