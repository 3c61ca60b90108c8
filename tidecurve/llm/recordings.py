"""Reading a recording's title and artist: core words, version, guests; and comparing two readings."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from functools import lru_cache

#: Label words of other recordings and of mere releases, guests, and collective artists.
OTHER = {
    "live": "live", "demo": "demo", "acoustic": "acoustic", "unplugged": "acoustic", "instrumental": "instrumental",
    "remix": "remix", "karaoke": "cover", "tribute": "cover", "style": "cover", "cover": "cover",
}
RELEASE = ("remastered", "remaster", "original", "album", "single", "version", "film", "mono", "stereo", "deluxe", "bonus", "edition", "soundtrack", "edit")
GUEST = ("feat", "ft", "featuring", "with")
COLLECTIVE = {"variousartists", "various", "va", "unknown", "unknownartist", "diverse", "soundtrack", "originalcast", "na", "varios", "verschiedene"}
#: Stands for the dots of a text cut short while it is read.
CUT = "\x02"
FILLER = {"the", "a", "an", "and", "of", "in", "for", "no", "my", "to", "pt", "part"}

_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*", re.UNICODE)
_BRACKET = re.compile(r"[(\[{]([^()\[\]{}]*)(?:[)\]}]|$)")
_WRAPPED = re.compile(r"^\s*[(\[«“\"'‘]+(.*?)[)\]»”\"'’]+\s*$", re.DOTALL)
_GUEST = re.compile(r"[\s,(\[-]+(?:feat|ft|featuring)\b\.?\s*(.*)$", re.IGNORECASE)
_PRIMARY = re.compile(r"\s*(?:;|/|\bfeat\b\.?|\bft\b\.?|\bfeaturing\b)\s*", re.IGNORECASE)


def plain(text: str) -> str:
    """Lower case without accents; ``&`` reads ``and``."""
    folded = unicodedata.normalize("NFKD", text.replace("_", " ").replace("&", " and ").replace("…", CUT)).casefold()
    return folded if folded.isascii() else "".join(c for c in folded if not unicodedata.combining(c))


def words(text: str) -> list[str]:
    return [w.replace("'", "").replace("’", "") for w in _WORD.findall(text)]


def near(a: str, b: str) -> bool:
    """At most one insertion, deletion, substitution or swap of neighbours apart."""
    if a == b:
        return True
    n, m = len(a), len(b)
    if abs(n - m) > 1:
        return False
    i = 0
    while i < min(n, m) and a[i] == b[i]:
        i += 1
    if n == m:
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    return a[i + 1 :] == b[i:] if n > m else a[i:] == b[i + 1 :]


@lru_cache(maxsize=100_000)
def label_word(word: str) -> str | None:
    """The label word that ``word`` spells, typing errors included."""
    for known in (*OTHER, *RELEASE):
        if word == known or (len(known) >= 4 and len(word) >= 3 and near(word, known)):
            return known
    return None


def label_kind(segment: str) -> tuple[str, str] | None:
    """What a bracketed or trailing label says: (kind, detail); kind '' for a mere release label; None: no label."""
    own = words(segment)
    if not own:
        return "", ""
    if own[0] in GUEST:
        return "", ""
    cut = segment.rstrip().endswith(CUT)
    known = [label_word(w) for w in own]
    kinds = [OTHER[k] for k in known if k in OTHER]
    if "cover" in kinds:
        return "cover", ""
    if kinds:
        kind = kinds[0]
        if kind == "remix":
            return kind, "".join(w for w, k in zip(own, known) if k != "remix")
        detail = "".join(own[2:]) if kind == "live" and len(own) > 2 and not cut else ""
        return kind, detail
    if any(k in RELEASE for k in known):
        return "", ""
    if cut:
        start = next((w for w in own if not w.isdigit()), "")
        for full in (*RELEASE, *GUEST, *OTHER):
            if full.startswith(start):
                return OTHER.get(full, ""), ""
    return None


@dataclass(slots=True)
class Reading:
    tokens: list[str]  # core words of the title
    compact: str  # the same, joined, without a leading article
    cut: bool  # the title was cut short
    version: str  # kinds, sorted
    detail: str  # remixer or place
    artist: list[str]  # words of the performers' names
    lead: list[str]  # words of the first performer only
    guests: bool


def read_title(title: str) -> tuple[list[str], str, bool, str, str]:
    text = plain(title).strip()
    wrapped = _WRAPPED.match(text)
    if wrapped and not any(c in wrapped[1] for c in ")]"):
        text = wrapped[1]
    elif text[:1] in "([" and text[-2:] in (")]", "))", "])"):
        text = text[1:-1]
    cut = text.endswith((CUT, "..."))
    kinds, detail = set(), ""
    whole = text

    def label(match: re.Match) -> str:
        nonlocal detail
        said = label_kind(match[1])
        if said is None or match.start() == 0 or (match.start() and match.string[match.start() - 1].isalnum()):
            return match[0].strip("()[]{}") if match.start() and match.string[match.start() - 1].isalnum() else " " + match[1] + " "
        if said[0]:
            kinds.add(said[0])
            detail = detail or said[1]
        return " "

    for _ in range(2):
        text = _BRACKET.sub(label, text)
    text = _GUEST.sub("", text)
    while " - " in text:
        head, _, tail = text.rpartition(" - ")
        said = label_kind(tail)
        if said is None or not head.strip():
            break
        if said[0]:
            kinds.add(said[0])
            detail = detail or said[1]
        text = head
    own = words(text)
    while len(own) > 1 and own[-1] in OTHER and own[-1] not in ("style", "live", "cover"):
        kinds.add(OTHER[own[-1]])
        if own.pop() == "remix" and len(own) > 2:
            detail = detail or own.pop()
    if not own:
        own = words(whole)
    joined = "".join("pt" if w == "part" else w for w in own).replace("donot", "dont")
    if len(joined) > 6 and joined.startswith(("the", "hte", "teh")):
        joined = joined[3:]
    return own, joined, cut, "+".join(sorted(kinds)), detail


@lru_cache(maxsize=50_000)
def read(title: str, artist: str | None) -> Reading:
    tokens, compact, cut, version, detail = read_title(title)
    names, lead, guests = [], [], False
    if artist and artist.strip():
        text = plain(artist)
        if "".join(words(text)) not in COLLECTIVE:
            parts = [p for p in _PRIMARY.split(text) if p.strip()]
            names = [w for w in words(text) if w not in ("the", "and", *GUEST)] or words(text)
            lead = [w for w in words(parts[0]) if w not in ("the", "and")] if parts else names
            lead = lead or names
            guests = len(parts) > 1
    return Reading(tokens, compact, cut, version, detail, names, lead, guests)


def same_word(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if len(a) == 1 or len(b) == 1:
        return 0.6 if a[0] == b[0] else 0.0
    return 0.8 if len(a) > 3 and len(b) > 3 and near(a, b) else 0.0


def covered(small: list[str], large: list[str]) -> tuple[float, str]:
    """How well every word of ``small`` finds a word of its own in ``large``, and those words joined; 0 where one finds none."""
    left, total, full, found = list(large), 0.0, False, {}
    for k in sorted(range(len(small)), key=lambda k: -len(small[k])):
        w = small[k]
        best = max(left, key=lambda x: same_word(w, x), default=None)
        how = same_word(w, best) if best is not None else 0.0
        if not how:
            return 0.0, ""
        full |= how >= 0.8 and len(w) > 1
        left.remove(best)
        found[k] = best
        total += how
    return (total / len(small), "".join(found[k] for k in range(len(small)))) if full and small else (0.0, "")


def same_artist(a: Reading, b: Reading) -> tuple[float | None, str, str]:
    """Likeness of the performers both sides name, and how each side spells them; None where one side names nobody."""
    if not a.artist or not b.artist:
        return None, "".join(a.artist), "".join(b.artist)
    joined_a, joined_b, lead_a, lead_b = ("".join(x) for x in (a.artist, b.artist, a.lead, b.lead))
    if joined_a == joined_b:
        return 1.0, joined_a, joined_b
    of_a, of_b = covered(a.lead, b.artist), covered(b.lead, a.artist)
    if of_a[0] or of_b[0]:
        return (of_a[0], lead_a, of_a[1]) if of_a[0] >= of_b[0] else (of_b[0], of_b[1], lead_b)
    if len(joined_a) > 5 and near(joined_a, joined_b):
        return 0.8, joined_a, joined_b
    if len(a.lead) > 1 and len(lead_a) > 5 and near(lead_a, lead_b):
        return 0.8, lead_a, lead_b
    return 0.0, "", ""


def _digits(tokens: list[str]) -> list[str]:
    return [w for w in tokens if w.isdigit()]


def title_likeness(a: Reading, b: Reading, known) -> float:
    """1 for equal cores, less for typing errors, 0 for other titles; ``known`` tells words of the language."""
    if a.compact == b.compact:
        return 1.0
    if a.cut or b.cut:
        short, long = sorted((a.compact, b.compact), key=len)
        if len(short) >= 4 and long.startswith(short):
            return 0.9
        if a.cut and b.cut or len(short) < 6:
            return 0.0
        long = long[: len(short)]
        return 0.7 if near(short, long) else 0.0
    if sorted(_digits(a.tokens)) != sorted(_digits(b.tokens)):
        return 0.0
    if not near(a.compact, b.compact):
        return 0.0
    if len(a.tokens) == len(b.tokens):
        other = [(x, y) for x, y in zip(a.tokens, b.tokens) if x != y]
        if len(other) == 1 and min(map(len, other[0])) > 3 and known(other[0][0]) and known(other[0][1]):
            return 0.5
    return 0.85


def version_fits(a: Reading, b: Reading) -> bool:
    if a.version != b.version:
        return False
    if a.detail and b.detail and a.detail != b.detail:
        return near(a.detail, b.detail) or a.detail.startswith(b.detail[:4]) and (a.cut or b.cut)
    return True
