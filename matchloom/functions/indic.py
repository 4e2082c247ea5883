"""Romanisation of the Indic scripts U+0900 to U+0D7F.

What a letter sounds like follows from its Unicode name ("BENGALI LETTER KA" is k), so no table of code points is needed. A consonant carries an
inherent "a", unless a vowel sign replaces it, a virama silences it, or the word ends.
"""

from __future__ import annotations

import re
import unicodedata

# Letters whose name does not spell their sound; of any other name doubled consonants are one.
SOUNDS = {"C": "ch", "CH": "chh", "SS": "sh", "KHH": "kh", "GHH": "g", "DDDH": "r", "EE": "e", "OO": "o", "VOCALIC R": "ri", "VOCALIC RR": "ri", "VOCALIC L": "li", "VOCALIC LL": "li", "AU LENGTH MARK": "au", "CANDRABINDU": "n", "ANUSVARA": "n", "VISARGA": "h"}
_NAMED = re.compile(r"(LETTER|VOWEL SIGN|SIGN|LENGTH MARK) (?:CHILLU |CANDRA |SHORT |LONG )?((?:VOCALIC )?[A-Z]+)$")
_VOWELS = frozenset("A AA I II U UU E EE AI O OO AU".split())


def _sound(letter: str) -> str:
    return SOUNDS.get(letter) or (letter if letter in _VOWELS else re.sub(r"(.)\1+", r"\1", letter)).lower()


def _sorted_out() -> tuple[dict[str, str], dict[str, str], str, dict[int, str]]:
    """Consonants, vowel signs, viramas, and what any other character of the blocks becomes."""
    consonants, signs, viramas, rest = {}, {}, "", {}
    for code in range(0x0900, 0x0D80):
        c, name = chr(code), unicodedata.name(chr(code), "")
        rest[code] = ""
        m = _NAMED.search(name)
        kind, letter = (m[1], m[2]) if m else ("", "")
        if name.endswith("AU LENGTH MARK"):
            signs[c] = SOUNDS["AU LENGTH MARK"]
        elif name.endswith("SIGN VIRAMA"):
            viramas += c
        elif unicodedata.digit(c, None) is not None:
            rest[code] = str(unicodedata.digit(c))
        elif kind == "VOWEL SIGN":
            signs[c] = _sound(letter)
        elif kind == "LETTER" and "CHILLU" in name:
            rest[code] = _sound(letter)
        elif kind == "LETTER" and (letter in _VOWELS or letter.startswith("VOCALIC")):
            rest[code] = _sound(letter)
        elif kind == "LETTER" and letter.endswith("A"):
            consonants[c] = _sound(letter[:-1])
        elif kind == "SIGN" and letter in SOUNDS:
            rest[code] = SOUNDS[letter]
    return consonants, signs, viramas, rest | dict.fromkeys(map(ord, "‌‍"), "")


_CONSONANTS, _SIGNS, _VIRAMAS, _REST = _sorted_out()
_SILENT = "".join(chr(code) for code, latin in _REST.items() if not latin and chr(code) not in _CONSONANTS and chr(code) not in _SIGNS and chr(code) not in _VIRAMAS)
_SYLLABLE = re.compile(f"([{''.join(_CONSONANTS)}])[{_SILENT}]*(?:([{''.join(_SIGNS)}])|([{_VIRAMAS}]|(?=\\s|$)))?")
_ALL = _REST | {ord(c): latin for c, latin in _SIGNS.items()}


def transliterate(text: str) -> str:
    """Indic letters in Latin; everything else as it is."""
    return _SYLLABLE.sub(lambda m: _CONSONANTS[m[1]] + (_SIGNS[m[2]] if m[2] else "a" if m[3] is None else ""), text).translate(_ALL)
