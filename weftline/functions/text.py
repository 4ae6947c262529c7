"""Column functions on text, keywords and phones."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\p{Z}\x{85}]+"

# Question openings that mark a keyword as informational.
INFORMATIONAL = ("what", "how", "why", "when", "can", "does", "is", "are", "guide", "meaning")
# Words that say nothing about a page's subject.
STOPWORDS = ("about", "also", "best", "book", "business", "contact", "from", "home", "more", "near", "page", "private", "service", "site", "that", "their", "this", "with", "your")
# Words that mark a booking link.
BOOKING = ("book", "appointment", "consultation", "schedule", "calendly")
# Schema types of articles.
ARTICLE_TYPES = ("article", "blogposting", "newsarticle")


def clean_text(c) -> Column:
    """White space of any kind becomes one space; the ends are trimmed."""
    return F.trim(F.regexp_replace(c, SPACE, " "))


def tokenize(c) -> Column:
    """Runs of letters and numbers."""
    return F.regexp_extract_all(c, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def compact(c) -> Column:
    """Lower-cased a-z and 0-9 alone."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def normalize_keyword(c) -> Column:
    return F.lower(clean_text(c))


def normalize_term(c) -> Column:
    """One final s goes from words of more than five letters."""
    return F.when((F.length(c) > 5) & F.endswith(c, F.lit("s")), F.substring(c, F.lit(1), F.length(c) - 1)).otherwise(c)


def is_stopword(c) -> Column:
    return c.isin(*STOPWORDS)


def keyword_terms(c) -> Column:
    """Distinct normalized a-z words of four letters or more that are no stopwords."""
    words = F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), F.lit(0))
    return F.array_distinct(F.filter(F.transform(words, normalize_term), lambda t: (F.length(t) >= 4) & ~is_stopword(t)))


def all_terms(c) -> Column:
    """Normalized a-z words of any length."""
    return F.transform(F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), F.lit(0)), normalize_term)


def is_informational(c) -> Column:
    return c.rlike("^(" + "|".join(INFORMATIONAL) + ") ")


def is_misspelled_plural(c) -> Column:
    """Some word of four letters or more ends with a consonant and ys."""
    return c.rlike(r"(^|\s)\S+[^aeiou\s]ys(\s|$)")


def is_branded(keyword, *brands: str) -> Column:
    """The compact keyword and a brand's compact form, both of five or more, contain one another."""
    k = compact(keyword)
    tests = [F.contains(k, F.lit(b)) | F.contains(F.lit(b), k) for b in ("".join(ch for ch in brand.lower() if ch.isascii() and ch.isalnum()) for brand in brands) if len(b) >= 5]
    return (F.length(k) >= 5) & reduce(lambda a, b: a | b, tests, F.lit(False))


def is_location_code(c) -> Column:
    """Three words at most, of which one mixes a-z with digits."""
    words = F.filter(F.split(c, r"\s+"), lambda w: w != "")
    return (F.size(words) <= 3) & F.exists(words, lambda w: w.rlike("[a-z]") & w.rlike("[0-9]"))


def is_booking(text, url) -> Column:
    return F.lower(F.concat_ws(" ", text, url)).rlike("|".join(BOOKING))


def is_html(content_type) -> Column:
    return F.contains(F.lower(content_type), F.lit("html"))


def has_directive(c, directive: str) -> Column:
    """`directive` is one of the comma- or space-separated tokens."""
    return F.coalesce(F.array_contains(F.split(F.lower(c), r"[,\s]+"), directive), F.lit(False))


def has_token(c, token: str) -> Column:
    return F.coalesce(F.array_contains(F.split(F.lower(F.trim(c)), r"\s+"), token), F.lit(False))


def is_article_type(c) -> Column:
    return F.lower(F.trim(c)).isin(*ARTICLE_TYPES)


def skips_level(levels) -> Column:
    """Some heading is more than one level below the one before."""
    return (F.size(levels) > 1) & F.exists(F.zip_with(F.slice(levels, 1, F.greatest(F.size(levels) - 1, F.lit(0))), F.slice(levels, 2, F.greatest(F.size(levels) - 1, F.lit(0))), lambda a, b: b > a + 1), lambda x: x)


def phone_digits(c) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def same_phone(a, b) -> Column:
    """Seven digits or more on both sides, and equal as a whole or in the last nine."""
    x, y = phone_digits(a), phone_digits(b)
    return (F.length(x) >= 7) & (F.length(y) >= 7) & ((x == y) | ((F.length(x) >= 9) & (F.length(y) >= 9) & (F.right(x, F.lit(9)) == F.right(y, F.lit(9)))))


def importance(cpc, volume) -> Column:
    return F.when((cpc >= 15) | (volume >= 1000), 5).when((cpc >= 5) | (volume >= 100), 4).otherwise(3)


def effort(position) -> Column:
    return F.when(position <= 0, 5).when(position <= 10, 1).when(position <= 25, 2).when(position <= 40, 3).when(position <= 70, 4).otherwise(5)


def ratio(cpc, volume, position) -> Column:
    return importance(cpc, volume) / effort(position)


def gap_priority(important) -> Column:
    return F.when(important >= 4, "high").otherwise("medium")


def source_priority(c) -> Column:
    return F.when(c == "current-ranking", 0).when(c == "supplied", 1).when(c == "openrouter", 2).otherwise(3)


def priority_weight(c) -> Column:
    return F.when(c == "high", 0).when(c == "medium", 1).otherwise(2)


def count_label(n, word: str) -> Column:
    return F.concat(n.cast("string"), F.when(n == 1, f" {word}").otherwise(f" {word}s"))


def truncate(c, limit: int, dots: bool = False) -> Column:
    """The first `limit` code points; with dots, three of them stand after limit - 1 where something was cut."""
    if dots:
        return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit - 1), F.lit("..."))).otherwise(c)
    return F.substring(c, 1, limit)


def truncate_all(c, count: int, limit: int) -> Column:
    return F.transform(F.slice(c, 1, count), lambda x: F.substring(x, 1, limit))


def keyword_seeds(c, count: int = 3) -> Column:
    """The first distinct normalized keywords."""
    return F.slice(F.array_distinct(F.filter(F.transform(c, normalize_keyword), lambda x: x != "")), 1, count)


def country_of(location) -> Column:
    return F.trim(F.element_at(F.split(location, ","), -1))


def rank_label(position) -> Column:
    return F.when(position > 0, F.concat(F.lit("#"), position.cast("string"))).otherwise("Not found")


def round_metric(c, places: int) -> Column:
    return F.round(c, places)


def page_fingerprint(*columns: str, version: str = "1") -> Column:
    """A hash of a page's features; arrays count as sets, so their order doesn't matter."""
    return F.sha2(F.to_json(F.struct(F.lit(version).alias("version"), *columns)), 256)


def conversion_label(booking, phone) -> Column:
    return F.when(booking & phone, "booking and phone").when(booking, "booking").when(phone, "phone").otherwise("none")


def business_key(place_id, site_url) -> Column:
    return F.when(F.coalesce(place_id, F.lit("")) != "", F.concat(F.lit("place:"), place_id)).otherwise(F.concat(F.lit("site:"), site_url))
