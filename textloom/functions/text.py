"""Scalar text functions: tokens, shingles, hashes, similarity, code-point checks, sanitising and redaction."""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Code points that a canonical text must not hold, as (reason, character class).
FORBIDDEN = (
    ("control", r"[\x{00}-\x{08}\x{0B}\x{0C}\x{0E}-\x{1F}\x{7F}-\x{9F}]"),
    ("byte_order_mark", r"\x{FEFF}"),
    ("bidi", r"[\x{200E}\x{200F}\x{202A}-\x{202E}\x{2066}-\x{2069}]"),
    ("zero_width", r"[\x{200B}-\x{200D}\x{2060}]"),
    ("private_use", r"[\x{E000}-\x{F8FF}]"),
    ("noncharacter", r"[\x{FDD0}-\x{FDEF}\x{FFFE}\x{FFFF}]"),
)
SECRET_KEYS = "password|passwd|secret|token|api_key|apikey|authorization|credential|private_key"


def tokens(text: Column) -> Column:
    """Runs of other than white space, as an array."""
    return F.filter(F.split(text, r"[\x{09}-\x{0D}\x{20}]+"), lambda x: x != "")


def separators(text: Column) -> Column:
    """The n + 1 runs of white space around n tokens, empty at the ends where there is none."""
    return F.split(text, r"[^\x{09}-\x{0D}\x{20}]+")


def reconstruct(words: Column, gaps: Column) -> Column:
    """The text of tokens and separators."""
    return F.concat(F.array_join(F.zip_with(gaps, words, lambda g, w: F.concat(g, F.coalesce(w, F.lit("")))), ""), F.lit(""))


def character_ngrams(text: Column, n: int) -> Column:
    """Sorted distinct n-grams of characters; empty for shorter texts. One pass over a text, however long."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), 1)))


def trigrams(text: Column) -> Column:
    return character_ngrams(text, 3)


def shingles(text: Column, k: int = 5) -> Column:
    """Distinct k-character shingles; a shorter text is its own shingle."""
    return F.when(F.length(text) < k, F.array(text)).otherwise(character_ngrams(text, k))


def minhash_slot(shingle_set: Column, slot: int) -> Column:
    """Least first 16 hexadecimal digits of sha256("slot:shingle")."""
    return F.array_min(F.transform(shingle_set, lambda s: F.substring(F.sha2(F.concat(F.lit(f"{slot}:"), s), 256), 1, 16)))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def cosine(a: Column, b: Column) -> Column:
    """Cosine over the shorter length; 0 where a norm is 0."""
    n = F.least(F.size(a), F.size(b))
    left, right = F.slice(a, 1, n), F.slice(b, 1, n)
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda acc, v: acc + v)
    norm = F.sqrt(dot(left, left)) * F.sqrt(dot(right, right))
    return F.when(norm > 0, dot(left, right) / norm).otherwise(0.0)


def tagged_hash(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def forbidden_reason(text: Column) -> Column:
    """The first reason in FORBIDDEN that applies, else null."""
    out = F.lit(None).cast("string")
    for reason, pattern in reversed(FORBIDDEN):
        out = F.when(text.rlike(pattern), F.lit(reason)).otherwise(out)
    return out


def confidence_band(value: Column) -> Column:
    """high above 0.9, medium from 0.7, else low."""
    return F.when(value > 0.9, "high").when(value >= 0.7, "medium").otherwise("low")


def snippet(text: Column, size: int = 100) -> Column:
    """The longest beginning of at most `size` bytes that does not cut a character, with dots where more follows."""
    head = F.substring(text, 1, size)  # at least all that fits
    # characters until the bytes are used up
    fits = F.aggregate(
        F.split(head, ""),
        F.struct(F.lit("").alias("out"), F.lit(0).alias("bytes")),
        lambda acc, x: F.struct(F.when(acc["bytes"] + F.octet_length(x) <= size, F.concat(acc["out"], x)).otherwise(acc["out"]).alias("out"), (acc["bytes"] + F.octet_length(x)).alias("bytes")),
        lambda acc: acc["out"],
    )
    cut = F.when(F.octet_length(head) == F.length(head), head).otherwise(fits)
    return F.when(F.octet_length(text) > size, F.concat(cut, F.lit("..."))).otherwise(text)


def log_term(observed: Column, expected: Column) -> Column:
    return F.when((observed > 0) & (expected > 0), observed * F.log(observed / expected)).otherwise(0.0)


def sanitize_html(html: Column) -> Column:
    """Without script blocks, event attributes and script or data addresses."""
    out = F.regexp_replace(html, r"(?is)<script\b.*?</script\s*>", "")
    out = F.regexp_replace(out, r"""(?i)\son[a-z]+\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", "")
    return F.regexp_replace(out, r"(?i)(javascript|data):", "")


def redact(text: Column) -> Column:
    """Values of secret keys and credentials in addresses replaced by [REDACTED]."""
    out = F.regexp_replace(text, rf"(?i)\b({SECRET_KEYS})(\s*[:=]\s*)[^\s,;&]+", "$1$2[REDACTED]")
    return F.regexp_replace(out, r"([a-z][a-z0-9+.-]*://)[^/@\s]+@", "$1[REDACTED]@")


def private_ip(address: Column) -> Column:
    return address.rlike(r"^(10\.|127\.|169\.254\.|192\.168\.|172\.(1[6-9]|2[0-9]|3[01])\.|0\.|::1$|f[cd][0-9a-f]{2}:|fe80:)")


def backoff(base: Column, attempt: Column, cap: float, jitter: float, fraction: Column) -> Column:
    """Exponential backoff with a deterministic jitter; fraction lies in [0, 1)."""
    return F.least(base * F.pow(F.lit(2.0), attempt), F.lit(cap)) * (1 + jitter * (2 * fraction - 1))


def whitespace_equal(a: Column, b: Column) -> Column:
    squeeze = lambda x: F.trim(F.regexp_replace(x, r"[\x{09}-\x{0D}\x{20}]+", " "))
    return squeeze(a) == squeeze(b)


def first_difference(a: Column, b: Column) -> Column:
    """Index of the first differing character, the shorter length where one begins the other, null for equal texts."""
    letters = lambda x: F.split(x, "")
    same = F.zip_with(letters(a), letters(b), lambda x, y: x.eqNullSafe(y))
    return F.when(a == b, F.lit(None)).otherwise(F.array_position(same, False) - 1)


def reference_text(*parts: Column) -> Column:
    """Parts joined by colons, nulls left out."""
    return F.concat_ws(":", *(x.cast("string") for x in parts))


def unicode_forms(text: Column) -> Column:
    """The normal forms that a text is in, of NFC, NFD, NFKC and NFKD, joined by commas."""
    def run(texts: pd.Series) -> pd.Series:
        names = ("NFC", "NFD", "NFKC", "NFKD")
        return texts.map(lambda x: None if x is None else ",".join(names) if x.isascii() else ",".join(n for n in names if unicodedata.is_normalized(n, x)))

    return F.pandas_udf(run, StringType())(text)


def first_unexpected(text: Column, allowed: str = r"\x{20}\x{600}-\x{6FF}\x{750}-\x{77F}\x{8A0}-\x{8FF}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}") -> Column:
    """Index from 0 of the first character outside the allowed class, null where there is none."""
    before = F.length(F.regexp_extract(text, rf"^[{allowed}]*", 0))
    return F.when(before < F.length(text), before)


def fnv1a(text: Column) -> Column:
    """FNV-1a of the UTF-8 bytes, as 16 hexadecimal digits; the texts of a batch advance byte by byte together."""
    def run(texts: pd.Series) -> pd.Series:
        raw = [b"" if x is None else x.encode() for x in texts]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        order = np.argsort(-size, kind="stable")
        data, first = np.frombuffer(b"".join(raw), np.uint8), np.cumsum(size) - size
        h = np.full(len(raw), 0xCBF29CE484222325, np.uint64)
        left = len(raw)
        for k in range(int(size.max(initial=0))):
            left = int(np.searchsorted(-size[order[:left]], -k))  # texts longer than k
            some = order[:left]
            h[some] = (h[some] ^ data[first[some] + k]) * np.uint64(0x100000001B3)
        return pd.Series([None if x is None else f"{v:016x}" for x, v in zip(texts, h.tolist(), strict=True)], dtype=object)

    return F.pandas_udf(run, StringType())(text)


def cache_key(generation: Column, request: Column) -> Column:
    return F.concat_ws(":", F.lit("v1"), generation.cast("string"), F.sha2(request, 256))


def graphemes(text: Column) -> Column:
    """The extended grapheme clusters of a text: a base with its marks, joined and regional pairs, line ends."""
    return F.regexp_extract_all(text, F.lit(r"(?s)(\X)"), 1)


def grapheme_to_char(text: Column, at: Column) -> Column:
    """The index of the character at which a cluster begins; past the end, the length."""
    return F.aggregate(F.slice(graphemes(text), F.lit(1), at), F.lit(0), lambda acc, x: acc + F.length(x))


#: Fixed value: annotation signs, which end or stand beside words.
PAUSE_MARKS = r"\x{06D6}-\x{06ED}"
_BLANK = r"\x{09}-\x{0D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def lossless_tokens(text: Column) -> Column:
    """array<struct<position, surface, char_start, char_end, byte_start, byte_end, is_pause_mark, separator>>.

    A word takes the pause marks that follow it; marks without a word before them are a token. Characters are counted in
    grapheme clusters; separator is the white space before the token. Text after the last token is trailing_separator.
    """
    mark, word = f"[{PAUSE_MARKS}]", f"[^{PAUSE_MARKS}{_BLANK}]"
    pieces = F.regexp_extract_all(text, F.lit(rf"([{_BLANK}]*(?:{word}(?:{word}|{mark})*|{mark}+))"), 1)
    kind = "array<struct<position:int,surface:string,char_start:int,char_end:int,byte_start:int,byte_end:int,is_pause_mark:boolean,separator:string>>"
    start = F.struct(F.lit(0).alias("bytes"), F.lit("").alias("seen"), F.array().cast(kind).alias("out"))

    def step(acc: Column, piece: Column) -> Column:
        gap = F.regexp_extract(piece, rf"^[{_BLANK}]*", 0)
        surface = F.substr(piece, F.length(gap) + 1)
        before = F.concat(acc["seen"], gap)
        begin = acc["bytes"] + F.octet_length(gap)
        # a mark at a token's head may join the cluster before it, so clusters are counted in what has been read
        whole, lead = F.concat(before, surface), F.concat(before, F.substring(surface, 1, 1))
        one = F.struct(
            (F.size(acc["out"]) + 1).alias("position"), surface.alias("surface"), (F.size(graphemes(lead)) - 1).alias("char_start"), F.size(graphemes(whole)).alias("char_end"),
            begin.alias("byte_start"), (begin + F.octet_length(surface)).alias("byte_end"), surface.rlike(f"^{mark}").alias("is_pause_mark"), gap.alias("separator"),
        )
        return F.struct((begin + F.octet_length(surface)).alias("bytes"), whole.alias("seen"), F.concat(acc["out"], F.array(one)).cast(kind).alias("out"))

    return F.aggregate(pieces, start, step, lambda acc: acc["out"])


def trailing_separator(text: Column) -> Column:
    return F.regexp_extract(text, rf"[{_BLANK}]*\z", 0)


def byte_range(text: Column, start: Column, end: Column) -> Column:
    """struct<start, end> in bytes of a character range."""
    return F.struct(F.octet_length(F.substr(text, F.lit(1), start)).alias("start"), F.octet_length(F.substr(text, F.lit(1), end)).alias("end"))


def json_feature(features: Column, names: tuple[str, ...] = ("pattern", "verb_form", "morphological_pattern")) -> Column:
    """map<string, string> of the named features of a JSON object that are not blank, trimmed."""
    pairs = F.array(*(F.struct(F.lit(n).alias("key"), F.trim(F.get_json_object(features, f"$.{n}")).alias("value")) for n in names))
    return F.map_from_entries(F.filter(pairs, lambda x: F.coalesce(x["value"], F.lit("")) != ""))


def route_checksum(router: Column, query: Column, ids: Column) -> Column:
    """SHA-256 of a routing decision: the router, the query and the chosen ids in order."""
    return F.sha2(F.concat(router, query, F.array_join(ids, "")), 256)


def age_days(now: Column, then: Column) -> Column:
    """Days and their fraction between two timestamps."""
    return (F.unix_micros(now) - F.unix_micros(then)) / F.lit(86_400_000_000.0)


def host_allowed(url: Column, allowed: list[str]) -> Column:
    """Whether a URL's host is listed or below a listed one, and no private address."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/:?#]*)", 1))
    listed = F.lit(False)
    for one in allowed:
        listed = listed | (host == one.lower()) | F.endswith(host, F.lit("." + one.lower()))
    return listed & ~private_ip(F.regexp_replace(host, r"[\[\]]", ""))
