"""One consistent form for texts that look the same (problem 1).

The form of a text is defined by ``canonical``:

* compatibility forms become their plain letters, except superscripts and subscripts, which stay;
* accents are composed (NFC), however they were written;
* characters without width go; white space of any kind and length is one space, none at the ends;
* hyphens of the same length are ``-``; longer dashes and quotes stay as they are;
* a letter of another script with the shape of a Latin letter becomes that letter; in a word that holds
  Cyrillic letters of their own shape, and no more Latin ones of their own, Latin letters become Cyrillic.

Method: a quick check splits the text into stable stretches and unstable segments. A character is stable when it is
a starter, is its own normal form, can't compose with one before it and has no look-alike; this class covers all planes.
Cyrillic letters are stable in words of their own script that hold a letter of their own shape. Only the segments are
normalised, with the word around them as boundary context (for composition and for the script of the word), and spliced
into the unchanged rest. The check is one search for a class of characters, made in Arrow batches: the same class as a
regular expression of the JVM took four times as long. Only texts that changed come back from Python.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Letters of other scripts that have the shape of a Latin letter, and those letters, by script. Of several for
#: one Latin letter the first stands for it in a Cyrillic word.
CYRILLIC = "АВСЕНІЈКМОРЅТУХԜ" + "асԁеһіјорԛѕѵԝху" + "ԌӀԚѴҮӏү"
CYRILLIC_AS = "ABCEHIJKMOPSTYXW" + "acdehijopqsvwxy" + "GIQVYly"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ" + "νορυϲϳ"
GREEK_AS = "ABEZHIKMNOPTYX" + "vopucj"
ARMENIAN = "ԼՕՍՏ" + "զհյոսցօ"
ARMENIAN_AS = "LOUS" + "qhjnugo"
COPTIC = "ⲂⲎⲒⲔⲘⲚⲞⲢⲤⲦⲨⲬ" + "ⲟⲣⲥⲭ"
COPTIC_AS = "BHIKMNOPCTYX" + "opcx"
CHEROKEE = "ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᎡᏚᎢᏙᎳᎽᏃ"
CHEROKEE_AS = "ABCDEGHJKLMPRSTVWYZ"
LISU = "ꓮꓐꓚꓓꓰꓝꓖꓧꓲꓙꓗꓡꓟꓠꓳꓑꓣꓢꓔꓴꓦꓪꓫꓬꓜ"
LISU_AS = "ABCDEFGHIJKLMNOPRSTUVWXYZ"
#: Hyphens as long as the ASCII one (the soft hyphen has no width).
HYPHENS = "‐‑⁃﹣－"

_TO_LATIN = dict(zip(CYRILLIC + GREEK + ARMENIAN + COPTIC + CHEROKEE + LISU, CYRILLIC_AS + GREEK_AS + ARMENIAN_AS + COPTIC_AS + CHEROKEE_AS + LISU_AS, strict=True))
_TO_CYRILLIC = dict(zip(CYRILLIC_AS[::-1], CYRILLIC[::-1], strict=True))
_CYRILLIC_SET, _HYPHEN_SET = set(CYRILLIC), set(HYPHENS)


def _invisible(ch: str) -> bool:
    """Format characters, controls that are no white space, variation selectors, fillers and joiners."""
    o = ord(ch)
    if ch.isspace():
        return False
    return (
        unicodedata.category(ch) in ("Cf", "Cc")
        or o in (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0)
        or 0x180B <= o <= 0x180F
        or 0xFE00 <= o <= 0xFE0F
        or 0xE0100 <= o <= 0xE01EF
    )


@lru_cache(maxsize=65536)
def _decomposed(ch: str) -> str:
    """Full decomposition of one character: canonical, and of compatibility forms other than super- and subscripts.
    Spacing accents (whose decomposition starts with a space) stay."""
    if ch.isspace():
        return " "
    if _invisible(ch):
        return ""
    if ch in _HYPHEN_SET:
        return "-"
    raw = unicodedata.decomposition(ch)
    if not raw:
        return unicodedata.normalize("NFD", ch)  # Hangul decomposes by rule
    kind, _, rest = raw.partition(">") if raw[0] == "<" else ("", "", raw)
    if kind in ("<super", "<sub"):
        return ch
    parts = [chr(int(x, 16)) for x in rest.split()]
    if kind and parts[0] == " ":
        return ch
    return "".join(map(_decomposed, parts))


#: Blocks of letters that compose with the one before them by rule, and surrogates.
_JAMO, _SURROGATES = ((0x1100, 0x11FF), (0xA960, 0xA97F), (0xD7B0, 0xD7FF)), (0xD800, 0xDFFF)
_CYRILLIC_BLOCK = (0x400, 0x52F)


def _stable(o: int) -> bool:
    ch = chr(o)
    if ch == " ":
        return True
    flat = unicodedata.normalize("NFD", ch)
    return (
        _decomposed.__wrapped__(ch) == flat
        and unicodedata.is_normalized("NFC", ch)
        and unicodedata.combining(ch) == 0
        and not unicodedata.category(ch).startswith("M")
        and (_CYRILLIC_BLOCK[0] <= o <= _CYRILLIC_BLOCK[1] or flat[0] not in _TO_LATIN)
    )


#: Stretches of code points that are stable one and all, so they need no look: ideographs, syllables, private and free planes.
_ALL_STABLE = ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3), (0xE000, 0xF8FF), (0x20000, 0x2F7FF), (0x2FA20, 0xDFFFF), (0xF0000, 0x10FFFF))


@lru_cache(maxsize=1)
def stable_ranges() -> tuple[tuple[int, int], ...]:
    """Ranges of stable code points, of all planes. Cyrillic letters are among them: their words are judged apart."""
    out = [list(x) for x in _ALL_STABLE]
    skipped = sorted([*_ALL_STABLE, _SURROGATES, *_JAMO])
    for a, b in zip([0x20, *[b + 1 for _, b in skipped]], [*[a for a, _ in skipped], 0x110000], strict=True):
        for o in range(a, b):
            if _stable(o):
                if out[-1][1] == o - 1:
                    out[-1][1] = o
                else:
                    out.append([o, o])
    return tuple(sorted((a, b) for a, b in out))


def _unstable() -> str:
    return "[^" + "".join(rf"\U{a:08x}-\U{b:08x}" if b > a else rf"\U{a:08x}" for a, b in stable_ranges()) + "]"


def _cyrillic_words() -> str:
    """A place in a word of Cyrillic letters that may change: all of them have look-alikes, or another script is next to
    them. A composed letter counts by its base."""
    letter, block = r"[^\W\d_]", r"\u{:04x}-\u{:04x}".format(*_CYRILLIC_BLOCK)
    alike = "".join(chr(o) for o in range(_CYRILLIC_BLOCK[0], _CYRILLIC_BLOCK[1] + 1) if unicodedata.normalize("NFD", chr(o))[0] in _CYRILLIC_SET)
    other = rf"(?:(?![{block}]){letter})"
    return rf"(?<!{letter})[{alike}]+(?!{letter})|[{block}](?={other})|{letter}(?<![{block}])(?=[{block}])"


@lru_cache(maxsize=1)
def _segments() -> tuple[re.Pattern, re.Pattern, re.Pattern]:
    """(the start of an unstable segment, the same where there are Cyrillic letters, the rest of its word and segment)."""
    return re.compile(_unstable()), re.compile(_unstable() + "|" + _cyrillic_words()), re.compile(r"(?:\w|" + _unstable() + ")*")


_CYRILLIC_LETTER = re.compile("[\u0400-\u052f]")
_WORD = re.compile(r"[^\W\d_]+(?:[̀-ͯ]+[^\W\d_]*)*")


def _one_script(m: re.Match) -> str:
    """The letters of a decomposed word, brought to one script."""
    w = m.group()
    if w.isascii():
        return w
    cyrillic = sum("Ѐ" <= c <= "ԯ" and c not in _CYRILLIC_SET for c in w)
    if cyrillic:
        latin = sum("LATIN" in unicodedata.name(c, "") and c not in _TO_CYRILLIC for c in w)
        if cyrillic >= latin:
            return "".join(_TO_CYRILLIC.get(c, c) for c in w)
    return "".join(_TO_LATIN.get(c, c) for c in w)


@lru_cache(maxsize=65536)
def _normal_segment(s: str) -> str:
    flat = "".join(map(_decomposed, s))
    flat = unicodedata.normalize("NFC", _WORD.sub(_one_script, unicodedata.normalize("NFD", flat)))
    return flat


def canonical(text: str | None) -> str | None:
    """The one form of ``text``; None for None. Long texts take time in proportion to their length."""
    if text is None:
        return None
    if not text.isascii() or not text.isprintable():
        unstable, in_cyrillic, run = _segments()
        if _CYRILLIC_LETTER.search(text):  # a search of its own, as it is much cheaper than looking around at every place
            unstable = in_cyrillic
        out, done = [], 0
        m = unstable.search(text)
        while m:
            start = m.start()
            # boundary context: the rest of the word to the left, or the one character that an accent may join
            left = start
            while left > done and (text[left - 1].isalnum() or text[left - 1] == "_"):
                left -= 1
            if left == start and left > done:
                left -= 1
            end = run.match(text, start).end()
            out.append(text[done:left])
            out.append(_normal_segment(text[left:end]) if end - left < 200 else _normal_segment.__wrapped__(text[left:end]))
            done = end
            m = unstable.search(text, end)
        out.append(text[done:])
        text = "".join(out)
    if "  " in text or text[:1] == " " or text[-1:] == " ":
        text = " ".join(x for x in text.split(" ") if x)
    return text


@F.arrow_udf(T.StringType())
def changed(texts: pa.Array) -> pa.Array:
    """The forms of the texts that are not in it yet; null for the others, which thus needn't come back."""
    return pa.array([None if (form := canonical(x)) == x else form for x in texts.to_pylist()], pa.string())


def canonical_text(col: Column) -> Column:
    """Column form of ``canonical``. Null gives null; an empty or blank text gives ''."""
    return F.coalesce(changed(col), col)


def fingerprint(col: Column) -> tuple[Column, Column]:
    """128 bits of a text as two longs, so that texts of a large collection can be grouped without moving them."""
    return F.xxhash64(col), F.xxhash64(F.lit(7919), col)

