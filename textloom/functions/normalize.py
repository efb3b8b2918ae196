"""Normalisation rules as Column functions, and the profiles that chain them.

A rule is an ordered list of (pattern, replacement) pairs whose syntax Java and RE2 share, so the same table makes the
Spark column and the SQL of other engines. Rules with look-ahead (affixes) have a Java form only. NFC is the one rule
without a built-in and runs as an Arrow UDF, which gets only the texts that hold a character from U+0300 on.

A chain of rules is planned before it becomes a column: neighbouring deletions are one pattern, neighbouring maps one
translation, and a text of ASCII alone takes only the rules that can touch it.
"""

from __future__ import annotations

import hashlib
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Unicode classes, character maps and affixes of the rules, their names, and the profiles.
SPACE = r"[\x{09}-\x{0D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
ARABIC_DIGITS = "".join(chr(0x0660 + k) for k in range(10)) + "".join(chr(0x06F0 + k) for k in range(10))
MAPS = {
    "N06": ("\u0622\u0623\u0625\u0624\u0626\u0621", "\u0627\u0627\u0627\u0648\u064a"),
    "N07": ("\u0671", "\u0627"),
    "N08": ("\u0649", "\u064a"),
    "N09": ("\u0629", "\u0647"),
    "N10": ("\u06a9\u06cc\u06c0\u06c1", "\u0643\u064a\u0647\u0647"),
    "N13": (ARABIC_DIGITS, "0123456789" * 2),
}
PATTERNS = {
    "N01": [(SPACE + "+", " "), ("^ | $", "")],
    "N02": [(r"\x{0640}", "")],
    "N03": [(r"[\x{064B}-\x{0652}\x{0656}-\x{065F}]", "")],
    "N04": [(r"[\x{06D6}-\x{06ED}\x{0615}\x{0617}-\x{061A}]", "")],
    "N05": [(r"\x{0670}", "")],
    "N11": [(r"[\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2066}-\x{2069}\x{FEFF}]", "")],
    "N12": [(r"[\x{21}-\x{2F}\x{3A}-\x{40}\x{5B}-\x{60}\x{7B}-\x{7E}\x{060C}\x{061B}\x{061F}\x{066A}-\x{066D}\x{06D4}]", "")],
    "N14": [(r"[\x{06D6}-\x{06DB}]", "")],
    "N15": [(r"[\x{FEF5}\x{FEF6}]", "\u0644\u0622"), (r"[\x{FEF7}\x{FEF8}]", "\u0644\u0623"), (r"[\x{FEF9}\x{FEFA}]", "\u0644\u0625"), (r"[\x{FEFB}\x{FEFC}]", "\u0644\u0627")],
    "N17": [(" ", "")],
}
#: Java only: look-ahead or back references.
JAVA_PATTERNS = {
    "N18": [("(?s)^(?:(?:\u0627\u0644|\u0644\u0644)(?=\\p{IsAlphabetic}.))+", "")],
    "N19": [("(?s)^(?:[\u0648\u0641](?=\\p{IsAlphabetic}.))+", "")],
    "N20": [("(?s)^(?:[\u0628\u0644\u0643](?=\\p{IsAlphabetic}.))+", "")],
    "N21": [("(?s)^(..+?)(?:\u0647\u0645\u0627|\u0647\u0645|\u0647\u0646|\u0647\u0627|\u0643\u0645|\u0643\u0646|\u0646\u064a|\u0646\u0627|\u0647|\u0643|\u064a)+$", "$1")],
    "N22": [(r"(?s)(.)\1{2,}", "$1$1")],
}
NAMES = {
    "N01": "whitespace_collapse", "N02": "strip_tatweel", "N03": "strip_harakat", "N04": "strip_quranic_marks", "N05": "strip_superscript_alef",
    "N06": "normalize_hamza_forms", "N07": "normalize_wasla", "N08": "normalize_alif_maqsura", "N09": "normalize_ta_marbuta", "N10": "normalize_persian_codepoints",
    "N11": "strip_zero_width_and_bidi", "N12": "strip_punctuation", "N13": "fold_digits", "N14": "strip_pause_marks", "N15": "expand_presentation_forms",
    "N16": "nfc", "N17": "remove_spaces", "N18": "strip_definite_article", "N19": "strip_conjunction_prefix", "N20": "strip_preposition_prefix",
    "N21": "strip_pronoun_suffix", "N22": "dedupe_repeated_letters",
}
PROFILES = {
    "L0.exact": (),
    "L1.ws": ("N01", "N11", "N16"),
    "L2.marks": ("N01", "N11", "N16", "N04", "N14"),
    "L3.diacritics": ("N01", "N11", "N16", "N04", "N14", "N03", "N05", "N02"),
}
PROFILES["L4.hamza"] = (*PROFILES["L3.diacritics"], "N07", "N06", "N08")
PROFILES["L5.codepoints"] = (*PROFILES["L4.hamza"], "N10", "N13", "N09", "N15")
PROFILES["L6.skeleton"] = (*PROFILES["L5.codepoints"], "N12", "N17")
PROFILES["L7.affix"] = (*PROFILES["L5.codepoints"], "N18", "N19", "N20", "N21")
PROFILES["L8.fuzzy"] = PROFILES["L5.codepoints"]


#: Rules that leave texts without a character from U+0300 on as they are.
BEYOND = frozenset(("N02", "N03", "N04", "N05", "N06", "N07", "N08", "N09", "N10", "N11", "N13", "N14", "N15", "N16", "N18", "N19", "N20", "N21"))
_DELETIONS = frozenset(("N02", "N03", "N04", "N05", "N11", "N12", "N14", "N17"))


def reaches(text: Column) -> Column:
    """Whether a text holds a character from U+0300 on: below, no mark, sign or letter that the rules know, and all is NFC."""
    return (F.octet_length(text) != F.length(text)) & text.rlike(r"[^\x{00}-\x{2FF}]")


def _nfc(text: Column, needed: Column | None = None) -> Column:
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: x if x is None else unicodedata.normalize("NFC", x))

    # Python gets null where nothing can change; the test is on what the text was made of, so that the text is named once
    needed = reaches(text) if needed is None else needed
    return F.when(needed, F.pandas_udf(run, StringType())(F.when(needed, text))).otherwise(text)


def rule(rule_id: str, text: Column) -> Column:
    """One rule applied to a string column; null stays null."""
    if rule_id == "N16":
        return _nfc(text)
    if rule_id in MAPS:
        return F.translate(text, *MAPS[rule_id])
    for pattern, replacement in PATTERNS.get(rule_id) or JAVA_PATTERNS[rule_id]:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def composed(rule_ids: list[str]) -> tuple[str, str]:
    """Maps in turn as one (from, to) translation; what has no counterpart is deleted."""
    table: dict[str, str] = {}
    for one in rule_ids:
        a, b = MAPS[one]
        step = {x: b[k] if k < len(b) else "" for k, x in enumerate(a)}
        table = {x: step.get(y, y) for x, y in table.items()} | {x: y for x, y in step.items() if x not in table}
    kept = [x for x in table if table[x]]
    return "".join(kept) + "".join(x for x in table if not table[x]), "".join(table[x] for x in kept)


def _chain(rule_ids: list[str], text: Column, needed: Column) -> Column:
    at = 0
    while at < len(rule_ids):
        family = _DELETIONS if rule_ids[at] in _DELETIONS else MAPS if rule_ids[at] in MAPS else ()
        upto = at + 1
        while upto < len(rule_ids) and rule_ids[upto] in family:
            upto += 1
        some = rule_ids[at:upto]
        if some == ["N16"]:
            text = _nfc(text, needed)
        elif upto == at + 1:
            text = rule(some[0], text)
        elif family is _DELETIONS:
            inner = "".join(pattern.strip("[]") if pattern[0] == "[" else pattern for one in some for pattern, _ in PATTERNS[one])
            text = F.regexp_replace(text, f"[{inner}]", "")
        else:
            text = F.translate(text, *composed(some))
        at = upto
    return text


def pipeline(rule_ids: tuple[str, ...] | list[str], text: Column) -> Column:
    """The rules in turn. A text that holds nothing from U+0300 on takes only the rules that can touch it."""
    rule_ids, needed = list(rule_ids), reaches(text)
    if not BEYOND.intersection(rule_ids):
        return _chain(rule_ids, text, needed)
    short = text
    for one in rule_ids:
        if one == "N01":
            short = F.trim(F.regexp_replace(short, r"[\x{09}-\x{0D} \x{85}\x{A0}]+", " "))
        elif one not in BEYOND:
            short = rule(one, short)
    return F.when(needed, _chain(rule_ids, text, needed)).otherwise(short)


def profile(name: str, text: Column) -> Column:
    """A registered profile applied to a string column."""
    return pipeline(REGISTRY.get(name), text)


def explain(rule_ids: tuple[str, ...] | list[str], text: Column) -> Column:
    """array<struct<rule, text>>: the text after each rule."""
    steps = []
    for one in rule_ids:
        text = rule(one, text)
        steps.append(F.struct(F.lit(NAMES[one]).alias("rule"), text.alias("text")))
    return F.array(*steps)


def persian_hint(text: Column) -> Column:
    """Whether folding Persian letters changes a text."""
    return text != rule("N10", text)


def rules_of(profile: str | list[str] | tuple[str, ...]) -> tuple[str, ...]:
    """The rules of a registered profile, or ad-hoc rules as they are."""
    if isinstance(profile, str):
        return REGISTRY.get(profile)
    if unknown := [x for x in profile if x not in NAMES]:
        raise ValueError(f"unknown rules {unknown}")
    return tuple(profile)


def adhoc_label(rule_ids: tuple[str, ...] | list[str]) -> str:
    return "adhoc:" + hashlib.sha256(",".join(rule_ids).encode()).hexdigest()[:12]


class ProfileRegistry:
    """Append-only: a known key takes the same rules only."""

    def __init__(self, known: dict[str, tuple[str, ...]]) -> None:
        self._known = dict(known)

    def get(self, name: str) -> tuple[str, ...]:
        if name not in self._known:
            raise KeyError(f"unknown profile {name}")
        return self._known[name]

    def register(self, name: str, rule_ids: tuple[str, ...]) -> None:
        unknown = [x for x in rule_ids if x not in NAMES]
        if unknown:
            raise ValueError(f"unknown rules {unknown}")
        if self._known.setdefault(name, tuple(rule_ids)) != tuple(rule_ids):
            raise ValueError(f"profile {name} is registered with other rules")

    def latest(self, prefix: str) -> str:
        """The last registered name that begins so."""
        found = [x for x in self._known if x.startswith(prefix)]
        if not found:
            raise KeyError(f"unknown profile {prefix}")
        return found[-1]

    def names(self) -> list[str]:
        return sorted(self._known)


REGISTRY = ProfileRegistry(PROFILES)


def sql(rule_ids: tuple[str, ...] | list[str], text: str) -> str:
    """The rules as DuckDB SQL, for those that need no look-ahead."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    for one in rule_ids:
        if one == "N16":
            text = f"nfc_normalize({text})"
        elif one in MAPS:
            a, b = MAPS[one]
            text = f"translate({text}, {quote(a)}, {quote(b)})"
        else:
            for pattern, replacement in PATTERNS[one]:
                text = f"regexp_replace({text}, {quote(pattern)}, {quote(replacement)}, 'g')"
    return text
