"""Names, keywords and keys."""

from __future__ import annotations

import re
import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def normalize_name(values: pd.Series) -> pd.Series:
    """Case-folded name without marks, punctuation and leading street words; null stays null."""

    def one(v):
        if v is None:
            return None
        v = unicodedata.normalize("NFKD", v.replace("Đ", "d").replace("đ", "d").casefold())
        v = re.sub("[^a-z0-9 ]", " ", "".join(c for c in v if not unicodedata.combining(c)))
        return re.sub(r"^(duong|pho)\s+", "", " ".join(v.split()))

    return values.map(one)


@F.pandas_udf(T.DoubleType())
def name_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity; 0 where a name is empty or missing."""
    return pd.Series([SequenceMatcher(None, a, b).ratio() if a and b else 0.0 for a, b in zip(left, right, strict=True)], dtype=float)


def name_similarity(a: Column, b: Column) -> Column:
    """The better of token overlap and Ratcliff-Obershelp ratio of two normalised names; 0 where one is empty."""
    both = (F.coalesce(F.length(a), F.lit(0)) > 0) & (F.coalesce(F.length(b), F.lit(0)) > 0)
    return F.when(both, F.greatest(token_jaccard(a, b), name_ratio(a, b))).otherwise(F.lit(0.0))


def token_jaccard(a: Column, b: Column) -> Column:
    x, y = F.array_distinct(F.split(a, " ")), F.array_distinct(F.split(b, " "))
    return F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)).cast("double")


def depth_class(cm: Column) -> Column:
    return F.when(cm.isNull(), "unknown").when(cm < 10, "<10").when(cm <= 30, "10-30").otherwise(">30")


def temporal_split(date: Column, year: Column, cutoff: str) -> Column:
    """Dated rows by date, undated rows by year; neither: train_undated."""
    first = int(cutoff[:4])
    undated = F.when(year >= first, "test_locked_undated").otherwise("train_undated")
    return F.when(date.isNull(), undated).when(date >= F.lit(cutoff).cast("date"), "test_locked").otherwise("train")


def road_name(raw: Column) -> Column:
    """Text before the first comma without a leading house number."""
    return F.trim(F.regexp_replace(F.trim(F.split(raw, ",")[0]), r"^(?i)(số\s*)?\d+[a-z]?\s+", ""))


def stable_id(*parts: Column) -> Column:
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.substring(F.sha1(text.cast("binary")), 1, 20)


# Keywords and terms, in the order in which they are tried.
PRECISION_WORDS = (("segment", ("segment", "line")), ("street", ("street", "road")), ("area", ("area", "ward", "district", "commune", "polygon")), ("point", ("point", "high", "medium", "low")))
CAUSE_WORDS = (("combined", ("combined", "both")), ("rain", ("rain",)), ("tide", ("tide",)))
FLOODED_TERMS = ("flooded", "flood", "wet", "ngap", "yes", "true", "1")
DRY_TERMS = ("not_flooded", "dry", "no_flood", "khong_ngap", "no", "false", "0")
CLASS_GROUPS = {
    "major": ("motorway", "trunk", "primary", "secondary", "motorway_link", "trunk_link", "primary_link", "secondary_link"),
    "mid": ("tertiary", "tertiary_link"),
    "minor": ("residential", "unclassified", "living_street"),
}
CLASS_RANKS = {"motorway": 8, "trunk": 7, "primary": 6, "secondary": 5, "tertiary": 4, "unclassified": 3, "residential": 2, "living_street": 1, "service": 0}


def by_keyword(text: Column, table) -> Column:
    """The first entry of (result, words) with a word in the text; unknown else, also for null."""
    lower, out = F.lower(F.coalesce(text, F.lit(""))), None
    for result, words in table:
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(lower, F.lit(w))
        out = F.when(hit, result) if out is None else out.when(hit, result)
    return out.otherwise("unknown")


def location_precision(*parts: Column) -> Column:
    return by_keyword(F.concat_ws(" ", *[F.trim(F.coalesce(p, F.lit(""))) for p in parts]), PRECISION_WORDS)


def status_of(status: Column, flag: Column) -> Column:
    """flooded, not_flooded or null: by the term, else by the flag."""
    term = F.replace(F.lower(F.trim(F.coalesce(status, F.lit("")))), F.lit(" "), F.lit("_"))
    return F.when(term.isin(*FLOODED_TERMS) , "flooded").when(term.isin(*DRY_TERMS), "not_flooded").when(flag, "flooded").when(~flag, "not_flooded")


def tags(text: Column) -> Column:
    """``"k"=>"v"`` pairs as a map; the last of a repeated key stays, null text has none."""
    text = F.coalesce(text, F.lit(""))
    pair = F.lit('"([^"]+)"=>"([^"]*)"')
    both = F.arrays_zip(F.regexp_extract_all(text, pair, F.lit(1)).alias("k"), F.regexp_extract_all(text, pair, F.lit(2)).alias("v"))
    one = lambda x: F.create_map(F.trim(x["k"]), F.trim(x["v"]))
    later = lambda m, x: F.map_concat(F.map_filter(m, lambda k, _: k != F.trim(x["k"])), one(x))
    return F.aggregate(both, F.create_map().cast("map<string,string>"), later)


def class_group(highway: Column) -> Column:
    out = F
    for group, names in CLASS_GROUPS.items():
        out = out.when(highway.isin(*names), group)
    return out.otherwise("other")


def class_rank(highway: Column) -> Column:
    """Ordinal of a road class; links and unknown classes have none."""
    return F.create_map(*[F.lit(x) for pair in CLASS_RANKS.items() for x in pair])[highway]
