"""Cutting a text into words and marked spans for the recogniser of personal information.

A span that has the outline of an e-mail address, a number, a street address,
a link or a time code becomes one token; what it means is left to the model.
Every replacement made before cutting keeps the number of code points, so
positions hold in the original text.
"""

from __future__ import annotations

import re
from bisect import bisect_right

#: Same-length replacements: wide forms, dashes, odd spaces.
_WIDE = {0xFF01 + i: 0x21 + i for i in range(94)}
_FLAT = _WIDE | {ord(c): "-" for c in "‐‑‒–—−"} | {ord(c): " " for c in "\u00a0\u2007\u2008\u2009\u200a\u202f\u3000\u2002\u2003"} | {ord("’"): "'"}

_AT = r"(?:\s*[\[({<]\s*(?:at|@)\s*[\])}>]\s*|\s+at\s+)"
_DOT = r"(?:\s*[\[({<]\s*(?:dot|\.)\s*[\])}>]\s*|\s+dot\s+)"
_LABEL = r"[a-z0-9](?:[a-z0-9-]*[a-z0-9])?"
_LOCAL = r"[\w](?:[\w.+%'-]*[\w])?"
EMAIL = re.compile(
    rf"{_LOCAL}(?:\s?@\s?{_LABEL}(?:(?:\.|{_DOT}){_LABEL})+|{_AT}{_LABEL}(?:(?:{_DOT}){_LABEL})(?:(?:\.|{_DOT}){_LABEL})*"
    rf"|\s*[\[({{<]\s*(?:at|@)\s*[\])}}>]\s*{_LABEL}(?:(?:\.|{_DOT}){_LABEL})+)",
    re.IGNORECASE,
)
_MAYBE_EMAIL = re.compile(r"@|[\[({<]\s*at\s*[\])}>]|\bat\b[^\n]{1,60}\bdot\b", re.IGNORECASE)
LINK = re.compile(r"(?:https?://|www\.)\S+|(?<![\w.])@\w+", re.IGNORECASE)

_END = r"(?![\w]|[.,:/-]?\d)"
_S = r"[ .\-/]"
#: Outlines of numbers; the first that fits names the token.
NUMBER = re.compile(
    r"(?<![\w])(?<![\d][.,:/-])(?=[+(\d]|[A-Za-z]{1,2}[ -]?\d|[A-Z]{2}-)(?:"
    r"(?P<time>\d{1,2}:\d\d(?::\d\d)?(?:[.,]\d{1,3})?)"
    rf"|(?P<date>\d\d[./]\d\d[./](?:19|20)\d\d{_END})"
    rf"|(?P<money>\d{{1,3}}(?:,\d{{3}})+{_END})"
    r"|(?P<code>[A-Z]{2}-[A-Z0-9]{3}-\d\d-\d{5})"
    rf"|(?P<shelf>\d{{4}}-\d{{3}}-\d\d{_END})"
    r"|(?P<long>\d{12,})"
    rf"|(?P<world>\+\d{{1,3}}(?:{_S}?\(\d{{1,4}}\)\d?)?(?:{_S}?\d{{1,5}}){{2,6}}{_END})"
    rf"|(?P<person>[A-Z]{{2}} ?\d\d ?\d\d ?\d\d ?[A-Z]\b)"
    rf"|(?P<social>\d{{3}}[- ]\d\d[- ]\d{{4}}{_END})"
    rf"|(?P<dotted>\d{{3}}\.\d{{3}}\.\d{{3}}-\d\d{_END})"
    rf"|(?P<quad>\d{{4}}-\d{{4}}-\d{{4}}-\d{_END})"
    rf"|(?P<birth>\d{{6}}[-+A]\d{{3}}[A-Z]\b)"
    rf"|(?P<tax>\d\d[ /]\d{{2,3}}[ /]\d{{3}}[ /]\d{{4}}{_END})"
    rf"|(?P<licence>[A-Z]{{1,2}}[ -]?\d{{3}}[ -]?\d{{5}}{_END})"
    rf"|(?P<card>[A-Z]\d\d ?\d{{3}} ?\d{{3}}{_END})"
    rf"|(?P<pass>[A-Z]{{1,2}} ?\d{{7,8}}{_END})"
    rf"|(?P<abroad>00\d{{1,3}} \d{{2,4}}(?:{_S}\d{{2,5}}){{1,3}}{_END})"
    rf"|(?P<paren>\(\d{{2,5}}\) ?\d{{2,5}}(?:{_S}?\d{{2,5}}){{1,3}}{_END})"
    rf"|(?P<ten>\d{{3}}{_S}\d{{3}}{_S}\d{{4}}{_END})"
    rf"|(?P<pairs>0\d(?:{_S}?\d\d){{4}}{_END})"
    rf"|(?P<trunk>0\d{{2,4}}[ /.-]?(?:\d{{3,5}}[ /.-]?)?\d{{3,8}}{_END})"
    rf"|(?P<seven>\d{{3}}{_S}\d{{4}}{_END})"
    rf"|(?P<run>\d{{7,11}}{_END})"
    r"|(?P<digits>\d[\d.,:/-]*)"
    r")"
)
#: Outlines that only ever spell one thing.
NUMBER_SHAPES = [*NUMBER.groupindex]

_STREET = r"(?:street|str|st|road|rd|lane|ln|court|ct|terrace|ter|close|cl|boulevard|blvd|avenue|ave|drive|dr)"
_NO = r"(?:no\.? ?|nr\.? ?|nº ?|# ?)"
_PLAIN = r"(?!(?:the|a|an|of|in|on|at|and|to|for|is|was|minutes?|stars|take|take)\b)[^\W\d_][\w'-]*"
ADDRESS = re.compile(
    rf"(?<![\w:/.,-])(?P<numbered>(?:{_NO})?\d{{1,4}} ?[a-z]?(?: ?(?:bis|ter))?,? "
    rf"(?:(?:rue|avenue|av\.|boulevard|bd|chemin|quai|place|allée|impasse)(?: (?:de la|des|de|du|d'\w+|de l'\w+|\w[\w'-]*))? ?\w[\w'-]*|(?:{_PLAIN} ){{1,2}}{_STREET}\b(?! test)))"
    rf"|(?<!\w)(?P<named>(?:calle|plaza|avenida|paseo|camino|carrera)(?: \w[\w'-]*){{1,4}},? (?:{_NO})?\d{{1,4}}[a-z]?\b)"
    rf"|(?<!\w)(?P<joined>[^\W\d_]+(?:gasse|straße|strasse|weg|platz|allee|str\.) (?:{_NO})?\d{{1,4}}[a-z]?\b)",
    re.IGNORECASE,
)
_HOUSE = re.compile(r"(?:\w[\w'-]* (?:house|cottage|villa|hall|lodge|manor)),?\s+$", re.IGNORECASE)
_MAYBE_STREET = re.compile(r"gasse|stra(?:ß|ss)e|weg |platz |allee |str\. ?\d|calle |plaza |avenida |paseo |camino |carrera |\d[a-z]?,? |\d ?(?:bis|ter) ", re.IGNORECASE)
WORD = re.compile(r"[^\W\d_]+(?:['\-][^\W\d_]+)*|\n|[^\w\s]|\w+")


def flatten(text: str) -> str:
    return text if text.isascii() else text.translate(_FLAT)


def spans(flat: str) -> list[tuple[int, int, str]]:
    """Marked spans ``(start, end, outline)``, ordered, never overlapping; the earlier kind wins."""
    found: list[tuple[int, int, str]] = []
    if _MAYBE_EMAIL.search(flat):
        found += [(m.start(), m.end(), "<email>") for m in EMAIL.finditer(flat)]
    taken = sorted(found)
    for pattern, maybe in ((LINK, "/" in flat or "@" in flat or "www." in flat), (ADDRESS, _MAYBE_STREET.search(flat)), (NUMBER, True)):
        if not maybe:
            continue
        starts = [s for s, _, _ in taken]
        for m in pattern.finditer(flat):
            start, end = m.start(), m.end()
            kind = m.lastgroup or "link"
            if pattern is ADDRESS and kind == "numbered":
                house = _HOUSE.search(flat, max(0, start - 40), start)
                if house:
                    start = house.start()
            at = bisect_right(starts, start)
            if (at and taken[at - 1][1] > start) or (at < len(taken) and taken[at][0] < end):
                continue
            found.append((start, end, f"<{kind}>"))
        taken = sorted(found)
    return taken


def cut(text: str) -> tuple[str, list[tuple[int, int, str]]]:
    """The flat text and its tokens ``(start, end, form)``: marked spans, words in lower case, marks, line ends."""
    flat = flatten(text)
    out: list[tuple[int, int, str]] = []
    at = 0
    for start, end, kind in spans(flat):
        out += [(m.start(), m.end(), m[0]) for m in WORD.finditer(flat, at, start)]
        out.append((start, end, kind))
        at = end
    out += [(m.start(), m.end(), m[0]) for m in WORD.finditer(flat, at)]
    return flat, out
