"""Text functions. Column expressions where Spark has the operation; Arrow functions where it has no Unicode normal forms."""

from __future__ import annotations

import hashlib
import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def clean_text(c, most: int | None = None) -> Column:
    """Simple tags to spaces, white space collapsed, trimmed, cut to `most` characters."""
    out = F.trim(F.regexp_replace(F.regexp_replace(c, r"</?\s*\w+\s*/?>", " "), r"(?U)\s+", " "))
    return F.substring(out, 1, most) if most else out


@F.pandas_udf(StringType())
def canonical_text(s: pd.Series) -> pd.Series:
    """NFKC, white space collapsed, case folded: the identity of a text."""
    return s.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFKC", t).split()).casefold())


@F.pandas_udf(StringType())
def review_key(s: pd.Series) -> pd.Series:
    """White space collapsed, case folded: how quotes are looked up in texts."""
    return s.map(lambda t: None if t is None else " ".join(t.split()).casefold())


@F.pandas_udf(StringType())
def strip_diacritics(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", t) if not unicodedata.combining(c))))


@F.pandas_udf(StringType())
def normalize_review(s: pd.Series) -> pd.Series:
    """HTML entities decoded, white space collapsed in each line, empty lines dropped."""
    return s.map(lambda t: "\n".join(x for x in (" ".join(line.split()) for line in html.unescape(t or "").splitlines()) if x))


def review_id(c) -> Column:
    return F.sha2(canonical_text(c), 256)


def text_hash(c) -> Column:
    return F.sha2(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")), 256)


def pool_of(canonical) -> Column:
    """0 to 99 from the first 8 hex digits of the canonical text's digest."""
    return (F.conv(F.substring(F.sha2(canonical, 256), 1, 8), 16, 10).cast("long") % 100).cast("int")


def text_key(salt: str, c) -> Column:
    """24 hex digits of the digest of salt, "|" and the text with white space collapsed."""
    return F.substring(F.sha2(F.concat(F.lit(salt + "|"), F.trim(F.regexp_replace(c, r"(?U)\s+", " "))), 256), 1, 24)


@F.pandas_udf(StringType())
def group_key(s: pd.Series) -> pd.Series:
    """Digest of the canonical text without diacritics: texts that an accent-free encoder can't tell apart share it."""

    def plain(t: str) -> str:
        t = " ".join(unicodedata.normalize("NFKC", t).split()).casefold()
        return unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", t) if not unicodedata.combining(c)))

    return s.map(lambda t: None if t is None else hashlib.sha256(plain(t).encode()).hexdigest())


def clean_post(c) -> Column:
    """A post without links and @mentions, white space collapsed; hashtags and accents stay."""
    without = F.regexp_replace(F.regexp_replace(c, r"https?://\S+|www\.\S+", " "), r"(?U)@\w+", " ")
    return F.trim(F.regexp_replace(without, r"(?U)\s+", " "))


def us_date(c) -> Column:
    """Dates written month/day/year, with or without leading zeros; null where there is no such date."""
    return F.to_date(F.try_to_timestamp(c, F.lit("M/d/yyyy")))


def quote_in_text(text, quote) -> Column:
    return F.contains(review_key(text), review_key(quote))


#: What the form puts into an empty field, how a field that holds no complaint opens, and how it goes on all the same.
NO_POSITIVE, NO_NEGATIVE = "No Positive", "No Negative"
NO_COMPLAINT = r"(?i)^\W*(?:nothing|none|n\s?a\b|nil\b|no complaints?|not much|all (?:was )?(?:good|great|perfect|fine)|everything (?:was )?(?:perfect|great|fine|good|excellent|wonderful|amazing|fantastic))\b"
CONTINUES = r"(?i)\b(?:but|except|however)\b"


def stripped(c) -> Column:
    """Without white space at either end; null is empty."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")


def has_complaint(c) -> Column:
    """Something was written that isn't the form's own text and doesn't open by saying that there was nothing, unless it goes on."""
    t = stripped(c)
    return (t != "") & (F.lower(t) != NO_NEGATIVE.lower()) & (~F.rlike(t, F.lit(NO_COMPLAINT)) | F.rlike(t, F.lit(CONTINUES)))


def whole_review(negative, positive) -> Column:
    empty = [NO_POSITIVE.lower(), NO_NEGATIVE.lower(), ""]
    part = lambda label, c: F.when(~F.lower(stripped(c)).isin(*empty), F.concat(F.lit(label), stripped(c)))
    return F.concat_ws("\n\n", part("Disliked: ", negative), part("Liked: ", positive))


def label_rule(positive, negative) -> Column:
    """1 where the positive field holds text and the negative one is exactly the form's placeholder, 0 the other way round, else null:
    an empty field opposite tells nothing."""
    p, n = stripped(positive), stripped(negative)
    return F.when((p != "") & (p != NO_POSITIVE) & (n == NO_NEGATIVE), 1).when((p == NO_POSITIVE) & (n != NO_NEGATIVE) & (n != ""), 0)


#: The six cities, in their order of precedence.
CITIES = ("Amsterdam", "Barcelona", "London", "Milan", "Paris", "Vienna")


def city_of(address) -> Column:
    out = F.lit("Other")
    for c in reversed(CITIES):
        out = F.when(F.contains(address, F.lit(c)), c).otherwise(out)
    return out


def tag_list(c) -> Column:
    """The strings of a list literal such as "[' Leisure trip ', ' Couple ']", trimmed."""
    return F.transform(F.regexp_extract_all(c, F.lit(r"'([^']*)'"), F.lit(1)), lambda x: F.trim(x))


def first_of(tags, wanted: tuple[str, ...]) -> Column:
    return F.coalesce(F.try_element_at(F.filter(tags, lambda x: x.isin(*wanted)), F.lit(1)), F.lit("Unknown"))


def script_of(c) -> Column:
    """greek, latin or other by the majority of letters; ties in that order; other without letters."""
    n = {k: F.regexp_count(c, F.lit(p)) for k, p in (("greek", r"\p{IsGreek}"), ("latin", r"\p{IsLatin}"), ("letters", r"\p{L}"))}
    other = n["letters"] - n["greek"] - n["latin"]
    return F.when(n["letters"] == 0, "other").when((n["greek"] >= n["latin"]) & (n["greek"] >= other), "greek").when(n["latin"] >= other, "latin").otherwise("other")


def looks_english(c, common: str = r"(?i)\b(?:the|and|was|were|is|are|we|our|it|to|of|in|for|with|but|not|very|room|hotel|staff)\b") -> Column:
    """Nine of ten letters ASCII, and one of ten words common where there are four words at least. (The words: fixed values.)"""
    letters, ascii_ = F.regexp_count(c, F.lit(r"\p{L}")), F.regexp_count(c, F.lit("[A-Za-z]"))
    n = F.regexp_count(c, F.lit(r"\S+"))
    return (letters > 0) & (ascii_ >= 0.9 * letters) & ((n < 4) | (F.regexp_count(c, F.lit(common)) >= 0.1 * n))


def preview(c, most: int = 160) -> Column:
    t = F.trim(F.regexp_replace(c, r"(?U)\s+", " "))
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, most - 1)), F.lit("…")))


def tokens(c) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9']+)"), F.lit(1))


def stub_score(c) -> Column:
    """The first 8 bytes of a text's SHA-256, modulo 1000, over 1000."""
    return F.conv(F.substring(F.sha2(c, 256), 1, 16), 16, 10).cast("decimal(20,0)") % 1000 / F.lit(1000.0)


def softmax(a, temperature: float = 1.0) -> Column:
    e = F.transform(a, lambda x: F.exp((x - F.array_max(a)) / F.lit(temperature)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))


def sigmoid(c) -> Column:
    return 1 / (1 + F.exp(-c))


def literal_quote(text, quote) -> Column:
    """Whether the quote stands in the text, letter for letter; an empty one doesn't."""
    return F.coalesce((quote != "") & F.contains(text, quote), F.lit(False))


def mapped(c, values: dict, strict: bool = True) -> Column:
    """The value that a name stands for. An unknown name is an error, or null where not strict; null stays null."""
    known = F.try_element_at(F.create_map(*(F.lit(x) for pair in values.items() for x in pair)), c)
    return F.when(c.isNull() | known.isNotNull(), known).otherwise(F.raise_error(F.concat(F.lit("unknown value: "), c.cast("string")))) if strict else known


def encoded(c, vocabulary: dict[str, int], most: int, unknown: int = 1) -> Column:
    """The first `most` tokens of a text as ids of a vocabulary (operators/models.vocabulary bounds its size)."""
    ids = F.create_map(*(F.lit(x) for pair in vocabulary.items() for x in pair)) if vocabulary else F.lit(None).cast("map<string,int>")
    return F.transform(F.slice(tokens(c), 1, most), lambda t: F.coalesce(F.try_element_at(ids, t), F.lit(unknown)))
