"""Phrases around private names in the given tables, to judge the recogniser by; it is never trained on them."""

import re

_W = r"[^\W\d_]+(?:['\-][^\W\d_]+)*"
_N = rf"(?:[^\W\d_]\. {_W}|{_W}, {_W}|{_W} (?:[^\W\d_]\. )?{_W})"
_N1 = rf"(?:(?:[^\W\d_]\. )?{_W})"
_TITLE = r"(?:mr|mrs|ms|dr)\.? "
#: What stands around private names in the given tables; N two-part name, S single name, T courtesy title.
_CARRIERS = [
    "neighbour (N) for the tickets", "give the badge to (N) please", "our projectionist, (N), broke", r"i sat next to (N) from\b",
    "refund goes to (N), ", "ship the poster to (N), ", "delete my data: (N) ", r"\bmy \w+ (N) still has", "card of (N), no", "sent by (N) <",
    r"regards, (N) \(", r"\bbest,\s*\n\s*(N)\s*\n", "signed, (N)", "greetings to (N)", r"greetings to (?:N) and (N)", r"my name is (N) and\b", r"it was (N) who filmed",
    "tickets for (N) are at", "posted by (N)", "accreditation: (N), ", "the uploader, (N), moved", "invoice to (N), ", "contact: (N), ",
    r"ich heiße (N) und\b", "m'appelle (N), appelez", "me llamo (N) y mi", "cordialement,\\s+(N)", "saludos,\\s+(N)", r"grüßen\s*\n\s*(N)", r"\bcall (N) on ",
    "ask for T(S) at the desk", "dear T(S), thank you for your entry", r"(N) wrote: ", r"(N) \(row \d", "cc: (N)", r"cc: (?:N); (N)", r"\bhi (S),", r"(N) / (?=[+(\d])",
]
CARRIERS = [
    (re.match(r"\(N\)( wrote: | \\\(row | / )", c), re.compile(re.sub(r"\(\?:N\)", lambda _: f"(?:{_N})", re.sub(r"\((N|S)\)", lambda m: f"({_N if m[1] == 'N' else _N1})", c)).replace(" T(", f" {_TITLE}("), re.IGNORECASE))
    for c in _CARRIERS
]


def _found(anchor: str | None, carrier: re.Pattern, flat: str):
    """Matches of ``carrier``; one that begins with a name is only tried before its anchor."""
    if anchor is None:
        yield from carrier.finditer(flat)
        return
    at = flat.find(anchor)
    while at >= 0:
        m = carrier.search(flat, max(0, at - 60), at + len(anchor) + 2)
        if m:
            yield m
        at = flat.find(anchor, at + 1)


def named(flat: str) -> set[int]:
    """Where a phrase says that a name starts."""
    return {m.start(1) for anchored, carrier in CARRIERS for m in _found(anchored and anchored[1].replace("\\", ""), carrier, flat)}
