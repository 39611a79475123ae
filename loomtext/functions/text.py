"""Column functions on text. White space is what Python's ``str.split`` takes for it, in both engines' regular
expressions; look-arounds are avoided, so the same patterns can be checked in SQL."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomtext.functions.let import let

WS = r"[\t-\r\x1c-\x1f\x85\p{Z}]"


def strip(col: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(col, rf"\A{WS}+|{WS}+\z", "")


def tokens(col: Column) -> Column:
    """The pieces between white space; null for null, empty for blank."""
    return F.filter(F.split(col, f"{WS}+"), lambda x: x != "")


def _ascii_tables() -> tuple[str, str, list[tuple[str, str]]]:
    """(characters, their ASCII counterparts, [(character, several letters)]), by decomposition; then characters to drop
    follow the first list without a counterpart."""
    #: What has no decomposition to ASCII.
    extra = {"ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "ð": "d", "þ": "th", "“": '"', "”": '"', "‘": "'", "’": "'", "–": "-", "—": "-", "‐": "-", "−": "-", "α": "a", "β": "b", "γ": "g", "δ": "d", "κ": "k", "μ": "m"}
    single, several = {}, []
    for o in [*range(0xA0, 0x250), *range(0x2000, 0x2040), *range(0xFB00, 0xFB07), *range(0xFF01, 0xFF5F), 0x3000]:
        ch = chr(o)
        plain = extra.get(ch) or "".join(c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c)).replace("‐", "-")
        if plain != ch and plain.isascii() and plain:
            single.update({ch: plain}) if len(plain) == 1 else several.append((ch, plain))
    single |= {k: v for k, v in extra.items() if len(v) == 1}
    drop = "".join(map(chr, [*range(0x300, 0x370), 0xAD, 0x200B, 0x200C, 0x200D, 0x200E, 0x200F, 0x2060, 0xFEFF]))
    return "".join(single) + drop, "".join(single.values()), several


FROM_CHARS, TO_CHARS, SEVERAL = _ascii_tables()


def unidecoder(col: Column) -> Column:
    """Latin letters with marks, compatibility forms, quotes, dashes and common Greek letters in ASCII; combining marks
    and characters without width go; other scripts stay."""


    def several(c: Column) -> Column:
        return reduce(lambda c, x: F.replace(c, F.lit(x[0]), F.lit(x[1])), SEVERAL, c)

    def slow(c: Column) -> Column:
        return F.translate(F.when(c.rlike("[" + "".join(x for x, _ in SEVERAL) + "]"), several(c)).otherwise(c), FROM_CHARS, TO_CHARS)

    return let(col, lambda c: F.when(F.octet_length(c) == F.length(c), c).otherwise(slow(c)))


def dedash(col: Column) -> Column:
    """Words that were hyphenated over a line end or space, rejoined."""
    return F.regexp_replace(col, rf"(\w)-{WS}+(\w)", "$1$2")


SENTENCE = r"[^.!?]+[.!?]*|[.!?]+"


def titlecaps(col: Column) -> Column:
    """Sentences that are wholly upper case, in lower case."""
    parts = F.regexp_extract_all(col, F.lit(SENTENCE), F.lit(0))
    return F.array_join(F.transform(parts, lambda s: F.when(s.rlike(r"\p{Lu}") & ~s.rlike(r"\p{Ll}"), F.lower(s)).otherwise(s)), "")


def separated_parenthesis(col: Column, min_keep_length: int = 10) -> Column:
    """Content in parentheses leaves its sentence; what is long enough follows as a sentence of its own."""

    def split(c: Column) -> Column:
        kept = F.filter(F.regexp_extract_all(c, F.lit(r"\(([^()]*)\)"), F.lit(1)), lambda x: F.length(x) >= min_keep_length)
        own = F.array_join(F.transform(kept, lambda x: F.concat(x, F.lit("."))), " ")
        rest = F.regexp_replace(c, rf"{WS}*\([^()]*\)", "")
        return let(own, lambda o: F.when(o != "", F.concat(rest, F.lit(" "), o)).otherwise(rest))

    return let(col, lambda c: F.when(c.contains("("), split(c)).otherwise(c))


#: Symbols and the words that stand for them.
SYMBOLS = (("&", " and "), ("%", " percent"), (">", " greater than "), ("<", " less than "), ("=", " equals "), ("#", " number "), ("~", " approximately "))


def token_replacement(col: Column, symbols: tuple[tuple[str, str], ...] = SYMBOLS) -> Column:
    """Symbols as words, and single spaces between words."""
    worded = reduce(lambda c, x: F.replace(c, F.lit(x[0]), F.lit(x[1])), symbols, col)
    return F.regexp_replace(worded, " +", " ")


def decaps_text(col: Column) -> Column:
    """Words of at most one capital in lower case; others (acronyms, mixed case) as they are."""
    return F.array_join(F.transform(tokens(col), lambda w: F.when(w.rlike("[A-Z].*[A-Z]"), w).otherwise(F.lower(w))), " ")


#: English words of closed classes, by the names of the word classes that can be left out.
WORD_CLASSES = {
    "pronoun": "anyone each either he her here him i it me neither none one she some such that them there these they this those us we what which who whom you".split(),
    "possessive": "his its my our their whose your".split(),
    "verb": "am are be been being can could did do does had has have having is may might must shall should was were will would".split(),
    "adverb": "again also before how however more most not now off once only out so then thus too up very when where why yet".split(),
    "adjective": "all any both few many other own same several".split(),
    "connector": (
        "a about above after against although among an and as at because between but by during for from further if in into nor of on or over per since than the though "
        "through to under until upon via whereas whether while with within without no"
    ).split(),
}
#: The classes whose words are told by their form, and those that only a tagger can tell.
BY_FORM, BY_TAGGER = ("punctuation", "symbol", "cardinal"), ("unknown",)
POS_CLASSES = (*WORD_CLASSES, *BY_FORM, *BY_TAGGER)
CARDINAL = r"\A[+-]?[0-9][0-9.,/:%-]*\z"
PUNCTUATION = r"""\A[.,;:!?'"()\[\]{}-]+\z"""
SYMBOL = r"\A[^\p{L}\p{N}]+\z"


def closed_words(blacklist: Sequence[str] = POS_CLASSES) -> list[str]:
    return sorted({w for c in blacklist for w in WORD_CLASSES.get(c, ())})


def pos_tokenizer(col: Column, blacklist: Sequence[str] = POS_CLASSES) -> Column:
    """Without words of the word classes in ``blacklist``. Closed classes are told by their words, numbers, symbols and
    punctuation by their form; with ``punctuation`` it also goes from the ends of words. ValueError for another class."""
    unknown = [c for c in blacklist if c not in POS_CLASSES]
    if unknown:
        raise ValueError(f"unknown word classes {unknown}; there are {list(POS_CLASSES)}")
    forms = {"cardinal": lambda w: w.rlike(CARDINAL), "punctuation": lambda w: w.rlike(PUNCTUATION), "symbol": lambda w: w.rlike(SYMBOL) & ~w.rlike(PUNCTUATION)}
    bare = (lambda w: F.rtrim(w, F.lit(".,;:!?"))) if "punctuation" in blacklist else (lambda w: w)
    words = closed_words(blacklist)

    def kept(w: Column) -> Column:
        out = w != ""
        if words:
            out = out & ~F.lower(F.rtrim(w, F.lit(".,;:!?"))).isin(*words)
        return reduce(lambda c, f: c & ~forms[f](w), [f for f in BY_FORM if f in blacklist], out)

    return F.array_join(F.filter(F.transform(tokens(col), bare), kept), " ")


#: The chain by name; acronyms and dictionaries need tables and are in ``operators.parse``.
CHAIN = {f.__name__: f for f in (unidecoder, dedash, titlecaps, separated_parenthesis, token_replacement, decaps_text, pos_tokenizer)}
