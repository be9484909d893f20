"""Text functions: normal forms, tokens, themes, keyword matching, title cleaning and similarity of titles and tags."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

# Words that carry no theme, and the themes in the order in which they are tried.
STOPWORDS = "a an the and or but for to of in on at by with from my your our its this that is are was be have has do not no it i we you me so just more some all new good best hot top mix music playlist songs song list hits tracks track".split()
THEMES = {
    "mood": "sad happy chill vibe vibes love angry mood feel feelings cry crying hype energy bop bops soft dark cozy calm emotional deep melancholy heartbreak healing".split(),
    "activity": "workout gym study studying work drive driving run running sleep sleeping party dance cooking cleaning focus relax relaxing morning roadtrip road trip".split(),
    "time": "3am night midnight summer winter spring fall autumn sunday friday monday late evening afternoon day season".split(),
    "identity": "girl woman boy man aesthetic era main character healing diaspora brown black queer gay indie basic baddie soft cottagecore dark academia".split(),
    "genre": "rap hiphop hip hop pop rnb rock indie country jazz classical electronic edm metal punk soul blues reggae latin kpop afrobeats trap lofi".split(),
}

# What is stripped from a title, in this order, without regard to case.
TITLE_CLEANERS = [
    r"\s*\(feat\.?\s.*?\)",
    r"\s*\(ft\.?\s.*?\)",
    r"\s*\(with\s.*?\)",
    r"\s*feat\.?\s+[\w\s&,]+",
    r"\s*ft\.?\s+[\w\s&,]+",
    r"\s*-\s*From\s+[\"'].*",
    r"\s*\(From\s+.*?\)",
    r"\s*\(Original Song.*?\)",
    r"\s*\(Original Motion.*?\)",
    r"\s*-\s*(Remastered|Remaster).*$",
    r"\s*\(.*?(Remastered|Remaster).*?\)",
    r"\s*-\s*(Radio Edit|Album Version|Explicit|Clean|Edited).*$",
    r"\s*\(.*?(Radio Edit|Album Version|Explicit Version).*?\)",
    r"\s*-\s*(Live|Acoustic|Extended|Instrumental).*$",
]

# A genre's colour is that of the first key it contains.
GENRE_COLORS = {"pop": "#F9C74F", "hip hop": "#FB923C", "rap": "#FB923C", "rock": "#C084FC", "indie": "#A78BFA", "electronic": "#62A8FF", "dance": "#60D4F5", "r&b": "#FF5C8A", "soul": "#FF5C8A", "jazz": "#34D399", "classical": "#94A3B8", "metal": "#F87171", "country": "#FBBF24", "folk": "#86EFAC", "latin": "#FCA5A5", "k-pop": "#E879F9"}
DEFAULT_COLOR = "#64748B"


def canonical(c: Column) -> Column:
    """Lower case, word characters and single spaces only; null is empty."""
    plain = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"(?U)[^\w\s]", "")
    return F.trim(F.regexp_replace(plain, r"(?U)\s+", " "))


def title_key(c: Column) -> Column:
    """Lower case with every run of other than ASCII letters and digits as one space."""
    return F.lower(F.trim(F.regexp_replace(c, r"[^\p{Alnum}]+", " ")))


def match_key(title: Column, artist: Column) -> Column:
    """The key that records of different sources are matched by."""
    return F.concat_ws("|||", F.trim(F.lower(title)), F.trim(F.lower(artist)))


def tokens(c: Column) -> Column:
    """Lower-cased words without marks: at least two characters, no stop words, no bare numbers."""
    words = F.split(F.trim(F.regexp_replace(F.lower(c), r"(?U)[^\w\s]|\s+", " ")), r"\s+")
    return F.filter(words, lambda w: (F.length(w) >= 2) & ~w.isin(STOPWORDS) & ~w.rlike(r"^\d+$"))


def roast_words(c: Column) -> Column:
    """Words of more than two characters between spaces, commas, slashes and ampersands."""
    return F.filter(F.split(F.lower(c), r"[\s,/&]+"), lambda w: F.length(w) > 2)


def profile_words(c: Column) -> Column:
    """ASCII words, without a possessive 's, of more than one character."""
    found = F.regexp_extract_all(F.lower(c), F.lit(r"[a-z0-9']+"), F.lit(0))
    return F.filter(F.transform(found, lambda w: F.regexp_replace(w, "'s$", "")), lambda w: F.length(w) > 1)


def bounded(terms: list[str]) -> str:
    """A pattern for any of the terms as whole words; letters of any script belong to words."""
    return rf"(?U)(?<!\w)(?:{'|'.join(map(re.escape, terms))})(?!\w)"


def loose(terms: list[str]) -> str:
    """A pattern for any of the terms anywhere, inside words too."""
    return "|".join(re.escape(x) for x in terms)


def clean_title(c: Column) -> Column:
    """A title without credits, editions and the like."""
    for pattern in TITLE_CLEANERS:
        c = F.regexp_replace(c, f"(?i){pattern}", "")
    return F.trim(c)


def theme(c: Column) -> Column:
    """The first theme that has a word of the term, else other."""
    words, out = F.split(F.lower(c), " "), F.lit("other")
    for name, keys in reversed(list(THEMES.items())):
        out = F.when(F.arrays_overlap(words, F.array(*map(F.lit, keys))), name).otherwise(out)
    return out


def genre_color(c: Column) -> Column:
    out = F.lit(DEFAULT_COLOR)
    for key, color in reversed(list(GENRE_COLORS.items())):
        out = F.when(F.contains(F.lower(c), F.lit(key)), color).otherwise(out)
    return out


def jaccard(a: Column, b: Column) -> Column:
    """Common share of two arrays as sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def similar(a: Column, b: Column, least: float = 0.5) -> Column:
    """Whether two titles share at least half of the words of the one with fewer; false if one has none."""
    x, y = (F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(c), r"(?U)[^\w\s]", ""), r"\s+"), lambda w: w != "")) for c in (a, b))
    fewer = F.least(F.size(x), F.size(y))
    return F.coalesce((fewer > 0) & (F.size(F.array_intersect(x, y)) / F.greatest(fewer, F.lit(1)) >= least), F.lit(False))


def decade(year: Column) -> Column:
    return (F.floor(year / 10) * 10).cast("int")


def url_to_uri(url: Column) -> Column:
    """https://host/kind/id?query as host's last two path parts in colons: kind:id."""
    path = F.split(F.regexp_replace(url, r"[?#].*$", ""), "/")
    return F.concat_ws(":", F.element_at(path, -2), F.element_at(path, -1))


def list_id(c: Column) -> Column:
    """The 22 letters and digits that name a playlist in its address or URI, or alone; null without such."""
    named, bare = (F.regexp_extract(F.trim(c), p, 1) for p in (r"playlist[/:]([A-Za-z0-9]{22})", r"^([A-Za-z0-9]{22})$"))
    return F.when(named != "", named).when(bare != "", bare)


def first_name(c: Column) -> Column:
    """The first of several names between commas."""
    return F.trim(F.get(F.split(c, ","), F.lit(0)))


def themed(terms: DataFrame, wanted: str | None, limit: int) -> DataFrame:
    """The limit most frequent of title_terms, of one theme (without regard to case) or, for None, of any."""
    some = terms if wanted is None else terms.where(F.lower("theme") == wanted.lower())
    return some.orderBy(F.desc("count"), "term").limit(limit)


def unfence(c: Column) -> Column:
    """JSON text without the code fences around it."""
    return F.regexp_replace(c, r"^\s*(?:```(?:json)?)?\s*|\s*(?:```)?\s*$", "")


def title_terms(titles: DataFrame, min_count: int = 50, top: int = 500) -> DataFrame:
    """(term, count, pct, theme, examples): words and pairs of neighbouring words, once a title, the top most frequent.

    titles: (id, name). Pairs are neighbours once stop words are gone. Examples are the first five titles that
    hold all of the term's words. Ties go by term.
    """
    words = titles.select("id", "name", tokens(F.col("name")).alias("w"))
    pairs = F.transform(F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))), lambda x, i: F.concat_ws(" ", F.get("w", i), x))
    grams = words.select("name", F.explode(F.array_distinct(F.concat("w", pairs))).alias("term"))
    total = titles.select(F.count("name").alias("total"))
    counts = grams.groupBy("term").agg(F.count(F.lit(1)).alias("count")).where(F.col("count") >= min_count)
    best = counts.orderBy(F.desc("count"), "term").limit(top)
    distinct = words.groupBy("name").agg(F.first("w").alias("w"))
    holds = distinct.select("name", F.explode(F.array_distinct("w")).alias("word")).join(
        F.broadcast(best.select("term", F.explode(F.split("term", " ")).alias("word"))), "word"
    )
    full = holds.groupBy("term", "name").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == F.size(F.split("term", " ")))
    ranked = full.withColumn("r", F.row_number().over(W.partitionBy("term").orderBy("name"))).where("r <= 5")
    examples = ranked.groupBy("term").agg(F.array_sort(F.collect_list("name")).alias("examples"))
    return best.join(examples, "term", "left").crossJoin(F.broadcast(total)).select(
        "term", "count", F.round(F.col("count") * 100.0 / F.col("total"), 3).alias("pct"), theme(F.col("term")).alias("theme"), "examples"
    )


def initials(c: Column, k: int = 2) -> Column:
    """The first letters of a name's first k words in upper case, ? without any."""
    words = F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != "")
    return F.when(F.size(F.coalesce(words, F.array().cast("array<string>"))) == 0, "?").otherwise(F.upper(F.array_join(F.transform(F.slice(words, 1, k), lambda w: F.substring(w, 1, 1)), "")))


def parsed_choice(c: Column, choices: dict[str, list[str]]) -> Column:
    """A struct of the given fields from JSON text, fenced or not; a field whose value is none of its choices is null."""
    parsed = F.from_json(unfence(c), ", ".join(f"{name} string" for name in choices))
    return F.struct(*(F.when(parsed[name].isin(allowed), parsed[name]).alias(name) for name, allowed in choices.items()))
