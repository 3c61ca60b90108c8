"""Text functions: sentences, names, paths, clocks, fuzzy ratio."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Abbreviations, sites and sentence openers of the sentence splitter.
PREFIXES = ("Mr", "St", "Mrs", "Ms", "Dr")
SUFFIXES = ("Inc", "Ltd", "Jr", "Sr", "Co")
STARTERS = ("Mr", "Mrs", "Ms", "Dr", r"He\s", r"She\s", r"It\s", r"They\s", r"Their\s", r"Our\s", r"We\s", r"But\s", r"However\s", r"That\s", r"This\s", "Wherever")
SITES = ("com", "net", "org", "io", "gov")

_any = "|".join
_OPENS = f" (?:{_any(STARTERS)})"
#: What stands before and after a full stop that ends no sentence: (pattern before, pattern after, after negated).
HELD = [
    (f"(?:{_any(PREFIXES)})", "", False),  # a title
    ("", f"(?:{_any(SITES)})", False),  # a site's name
    ("Ph", r"D\.", False), (r"Ph\.D", "", False),  # a degree
    (" [A-Z]", "", False), (r"\s[A-Z]", " ", False),  # an initial
    ("[A-Z]", r"[A-Z]\.", False), (r"[A-Z]\.[A-Z]", _OPENS, True),  # capitals with stops, unless a sentence opens behind them
    (f" (?:{_any(SUFFIXES)})", _OPENS, True),  # a company or a junior, likewise
]
#: Marks put into the text while it is cut: a held full stop, the end of a sentence.
_HOLD, _END = "\x01", "\x02"


def sentences(text: Column) -> Column:
    """Array of sentences; text after the last terminator is dropped.

    Every full stop is looked at once, with what stands around it: it is held
    (``HELD``), it belongs to a company's name before a new sentence and goes,
    or it ends its sentence, as ``?`` and ``!`` always do.  A quote behind
    terminators is drawn before them.  Each full stop is judged by the text as
    it stands, whatever was decided for its neighbours.
    """
    # the stop comes first in the patterns, so that nothing is tried where there is none
    behind = lambda p: rf"(?<={p}\.)" if p else ""
    held = r"\.(?:" + _any(behind(before) + (f"(?{'!' if negated else '='}{after})" if after else "") for before, after, negated in HELD) + ")"
    own = F.concat(F.lit(" "), F.translate(text, "\n", " "), F.lit("  "))
    own = F.regexp_replace(own, held, _HOLD)
    own = F.regexp_replace(own, rf"\.(?<= (?:{_any(SUFFIXES)})\.)(?={_OPENS})", _END)
    own = F.regexp_replace(own, r'(\?!?\.?|!\.?|\.)"', '"$1')
    parts = F.split(F.regexp_replace(own, r"[.?!]", f"$0{_END}"), _END)
    return F.transform(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), lambda s: F.trim(F.translate(s, _HOLD, ".")))


def sentences_sql(column: str) -> str:
    """The same in SQL, character by character: ``l`` is the list of characters, ``i`` a full stop's place in it."""
    before, after = "array_to_string(l[greatest(i - 6, 1):i - 1], '')", "array_to_string(l[i + 1:i + 12], '')"
    tests = [
        " and ".join([*([f"regexp_matches({before}, '{b}$')"] if b else []), *([f"{'not ' if negated else ''}regexp_matches({after}, '^{a}')"] if a else [])])
        for b, a, negated in HELD
    ]
    goes = f"regexp_matches({before}, ' (?:{_any(SUFFIXES)})$') and regexp_matches({after}, '^{_OPENS}')"
    marked = f"array_to_string(list_transform(range(1, len(l) + 1), lambda i: case when l[i] <> '.' then l[i] when {' or '.join(f'({t})' for t in tests)} then chr(1) when {goes} then chr(2) else l[i] end), '')"
    quoted = rf"""regexp_replace({marked}, '(\?!?\.?|!\.?|\.)"', '"\1', 'g')"""
    listed = rf"(select list_transform(string_split(regexp_replace({quoted}, '([.?!])', '\1' || chr(2), 'g'), chr(2))[:-2], lambda s: trim(replace(s, chr(1), '.'))) from (select string_split(' ' || replace({column}, chr(10), ' ') || '  ', '') as l) q)"
    return listed


def hms(seconds: Column) -> Column:
    """``1h04m36s``."""
    s = seconds.cast("bigint")
    return F.format_string("%dh%02dm%02ds", F.expr("0") + F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def clock(seconds: Column) -> Column:
    s = seconds.cast("bigint")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def strip_year(title: Column) -> Column:
    """The title before `` (1999``; null where there is no year; the closing bracket is optional."""
    name = F.regexp_extract(title, r"^(.+) \(\d+\)?$", 1)
    return F.when(name != "", name)


def base26_path(i: Column, leaf: int = 100) -> Column:
    """Three letters of base 26 for every ``leaf`` consecutive items."""
    n = F.floor(i / leaf).cast("int")
    letter = lambda v: F.char((65 + v % 26).cast("int"))
    return F.concat_ws("/", letter(F.floor(n / 676)), letter(F.floor(n / 26)), letter(n))


def ratio(a: Column, b: Column) -> Column:
    """Similarity 0..100 from the edit distance."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 100.0).otherwise(F.round(100.0 * (1 - F.levenshtein(a, b) / longest), 4))


def indel_ratio(a: str, b: str) -> float:
    """0..100: twice the longest common subsequence over both lengths."""
    if not a and not b:
        return 100.0
    before = [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(before[j] + 1 if x == y else max(before[j + 1], row[j]))
        before = row
    return 200.0 * before[-1] / (len(a) + len(b))
