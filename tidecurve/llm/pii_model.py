"""A skip-chain conditional random field over the tokens of ``pii_lexer``.

Every token has a label.  Besides what is looked for there is ``other``, the
names of characters, artists, crew and places, so that a name is decided
against the names around it and not against plain words.  Potentials:

node   the token and its neighbours by form, and how often a name-like token
       occurs in its text, alone or beside others;
chain  the labels of neighbouring tokens;
skip   the labels of distant tokens of one text that are equal or similar,
       such as two mentions of one person.

All weights are trained together, by pseudo-likelihood: each token's label
given the text and the labels it is tied to.  Labels to train on come from
general evidence (``evidence``); where there is none a label stays open, is
filled in by the half-trained field where that is sure, and training goes on.
Prediction passes messages along chains and skip links until they rest.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np

from tidecurve.llm import pii_lexer as X
from tidecurve.llm.recordings import near

LABELS = ["O", "name", "name+", "other", "other+", "email", "phone", "id_number", "address"]
O, NB, NI, OB, OI, EM, PH, ID, AD = range(9)
COUNT = len(LABELS)
OPEN = -1
BEFORE, AFTER = 5, 4
OFFSETS = range(-BEFORE, AFTER + 1)
PAD, LOW, UP, CAP, LETTER, OTHER_DIGITS = range(6)
_GENERIC = ["<pad>", "<low>", "<up>", "<cap>", "<letter>", "<digits>", "<proper-low>", "<proper-up>", "<proper-cap>"]
PROPER_LOW, PROPER_UP, PROPER_CAP = 6, 7, 8
#: Kinds of name-like tokens: once, twice or more often in the text; alone, or beside another one.
KINDS, NEAR = 7, range(-2, 3)
#: Share of documents in which a form must occur to be a feature of its own, and documents at least.
LEAST_SHARE, LEAST_DOCS = 6.7e-4, 4
EPOCHS, BATCH, RATE, DECAY, PAIR_DECAY = 4, 4096, 0.25, 1e-6, 1e-4
#: Share of ties left out of a step, so that a token's own features must tell as well.
UNTIED = 0.5
#: Share of the tokens an epoch takes: looked for, other names of several parts, all that is name-like, and the rest.
TAKEN = (1.0, 0.3, 0.1, 0.05)
#: Belief from which on the half-trained field fills in an open label.
SURE = 0.9
ACTIVE, STILL, MOST_ROUNDS = 0.02, 5e-2, 100
#: Added to the score of a label that cannot follow.
_NEVER = np.zeros((COUNT, COUNT), np.float32)
for _a in range(COUNT):
    _NEVER[_a, NI] = 0 if _a in (NB, NI) else -8
    _NEVER[_a, OI] = 0 if _a in (OB, OI) else -8

_NUMERIC = (EM, PH, ID, AD)

#: Labels that agree across a skip link; one weight for equal and one for similar tokens holds for all of them.
_AGREE = np.equal.outer(np.array([0, 1, 1, 2, 2, 3, 4, 5, 6]), np.array([0, 1, 1, 2, 2, 3, 4, 5, 6])).astype(np.float32)

# --- evidence ------------------------------------------------------------------------------------------------------
#: Words that in letters and messages stand before a person's name, in four languages.
COURTESY = {"mr", "mrs", "ms", "dr", "herr", "frau", "mme", "sr", "sra"}
GREETING = {"dear", "hi", "hello", "hallo", "hola", "bonjour", "liebe", "lieber", "cher", "chère"}
CLOSING = {"regards", "best", "sincerely", "signed", "cordialement", "saludos", "grüßen", "grüße"}
HEADING = {"from", "to", "cc", "contact", "attn"}
INTRODUCING = {("name", "is"), ("ich", "heiße"), ("m'appelle",), ("me", "llamo"), ("je", "m'appelle")}
OWNING = {"my", "our"}
#: Verbs of a quoted letter's heading, and marks and words between persons named together.
QUOTING = {("wrote", ":"), ("schrieb", ":"), ("escribió", ":"), ("écrit", ":")}
JOINING = {"and", "und", "et", "y", ";", "&"}
PHONES = {"<world>", "<abroad>", "<paren>", "<ten>", "<pairs>", "<trunk>", "<seven>"}
NUMBERS = {"<person>", "<social>", "<dotted>", "<quad>", "<birth>", "<tax>", "<licence>", "<card>", "<pass>"}
STREETS = {"<numbered>", "<named>", "<joined>"}
CONTACT = {"<email>", "<run>"} | PHONES | NUMBERS | STREETS
#: What an outline may mean at all.
MAY = {EM: {"<email>"}, PH: PHONES | {"<run>"}, ID: NUMBERS | {"<run>", "<trunk>"}, AD: STREETS}
_ID_WORDS = {"passport", "licence", "license", "insurance", "tax", "identity", "id", "social", "ausweisnummer", "dni", "identité", "no", "número", "nummer"}
#: Tokens between a name and the contact that belongs to it, and between an address and the place that does.
REACH, PLACE = 8, 5
#: Short forms whose full stop ends no sentence.
SHORT = {"no", "nr", "tel", "st", "ave"}

Tokens = list[tuple[int, int, str]]


@dataclass
class Vocabulary:
    forms: dict[str, int]  # forms that are features of their own
    proper: set[str]  # words written with a capital inside sentences

    def namelike(self, form: str) -> bool:
        if len(form) < 2 or not form[0].isalpha():
            return False
        low = form.lower()
        return low in self.proper or (low not in self.forms and not form.startswith(("http", "www")))

    def spans(self, tokens: Tokens) -> list[tuple[int, int, list[int]]]:
        """Runs of name-like tokens ``(first, behind last, name-like ones)``, with initials and ``Surname, Given``."""
        n, like, out, i = len(tokens), [self.namelike(t[2]) for t in tokens], [], 0
        # a rare word in small letters is a name only beside a proper one
        small = [k for k in range(n) if like[k] and tokens[k][2].islower() and tokens[k][2] not in self.proper]
        proper = lambda k: 0 <= k < n and like[k] and (tokens[k][2].lower() in self.proper)
        for k in small:
            like[k] = proper(k - 1) or (k > 1 and tokens[k - 1][2] in (".", ",") and (proper(k - 2) or len(tokens[k - 2][2]) == 1))
        initial = lambda k: k + 1 < n and len(tokens[k][2]) == 1 and tokens[k][2].isalpha() and tokens[k + 1][2] == "."
        close = lambda k: tokens[k][0] - tokens[k - 1][1] <= 1
        while i < n:
            if not like[i] and not (initial(i) and i + 2 < n and like[i + 2]):
                i += 1
                continue
            j, words = i, []
            while j < n and (j == i or close(j)):
                if like[j]:
                    words.append(j)
                    j += 1
                elif initial(j) and j + 2 < n and like[j + 2]:
                    j += 2
                elif tokens[j][2] == "," and words and j + 1 < n and like[j + 1] and j - i == 1:
                    j += 1
                else:
                    break
            out.append((i, j, words))
            i = max(j, i + 1)
        return out


def numbers(flat: str, tokens: Tokens, y: np.ndarray) -> None:
    """Evidence for numbers: their outline, and for doubtful ones the words before."""
    for i, (start, end, form) in enumerate(tokens):
        if form == "<email>":
            y[i] = EM
        elif form in PHONES and not (form == "<trunk>" and flat[start:end].isdigit() and end - start < 10):
            y[i] = PH
        elif form in NUMBERS:
            y[i] = ID
        elif form in STREETS:
            y[i] = AD
        elif form in ("<run>", "<trunk>"):
            before = {t[2].lower() for t in tokens[max(0, i - 4) : i]}
            digits = sum(c.isdigit() for c in flat[start:end])
            y[i] = ID if before & _ID_WORDS and digits in (8, 9) else PH if digits in (10, 11) else ID if digits in (8, 9) and before & {"data", ":"} else O


def evidence(vocabulary: Vocabulary, flat: str, tokens: Tokens, common: set[str]) -> np.ndarray:
    """Labels of one text, ``OPEN`` where nothing tells.

    A private person is who is greeted, signs, introduces himself, is titled
    or owned (my, our), heads a message or is quoted, is named together with
    such a person, or has a contact behind the name in the same sentence; what
    stands behind an address is a place.  A person's rarer names stand for that
    person wherever they come again in the text.  Another
    name is one that comes again in its text, that many texts have (``common``)
    or that is credited (by).  Two-part names without either stay open.
    """
    y = np.zeros(len(tokens), np.int8)
    numbers(flat, tokens, y)
    low = [t[2].lower() for t in tokens]
    often, last_told, people, spans = Counter(low), -1, set(), []
    for first, behind, words in vocabulary.spans(tokens):
        if not words:
            continue
        before = low[max(0, first - 3) : first]
        while before and before[-1] in ("\n", ".", ","):
            mark, before = before[-1], before[:-1]
            if mark == "." and (not before or before[-1] not in COURTESY):
                before = []
        last = before[-1] if before else ""
        direct = first and low[first - 1] == last  # nothing but a space between
        told = last in COURTESY or (last in GREETING and direct) or last in CLOSING
        if len(words) > 1 or len(low[first]) == 1:
            told |= (last == ":" and len(before) > 1 and before[-2] in HEADING) or tuple(before[-2:]) in INTRODUCING or (last,) in INTRODUCING
            told |= len(before) > 1 and before[-2] in OWNING and tokens[first - 1 if direct else first - 2][2].islower()
            told |= tuple(low[behind : behind + 2]) in QUOTING or (first - 1 == last_told and low[first - 1] in JOINING)
            placed = any(tokens[k][2] in STREETS for k in range(max(0, first - PLACE), first))
            for k in range(behind, min(behind + REACH, len(tokens)) if not placed else 0):
                if low[k] in ("!", "?", ";") or (low[k] == "." and low[k - 1] not in SHORT):
                    break
                if tokens[k][2] in CONTACT:
                    told = True
                    break
        if told:
            kind, last_told = NB, behind
        elif len(words) == 1 and len(low[first]) > 1:
            cased = tokens[first][2][0].isupper() and low[words[0]] in vocabulary.proper
            kind = OB if cased else O
        elif any(often[low[k]] > 1 for k in words) or " ".join(low[k] for k in words) in common:
            kind = OB
        elif last == "by" and first > 2 and tokens[first - 2][2][0].isupper() and tokens[first - 3][2][0].isupper():
            kind = OB
        else:
            kind = OPEN
        if told and len(words) > 1:
            people.update(low[k] for k in words if low[k] not in vocabulary.proper)
        spans.append((first, behind, words, kind))
    for first, behind, words, kind in spans:
        if kind != NB and any(low[k] in people for k in words):
            kind = NB
        for k in range(first, behind):
            if y[k] == O:
                y[k] = kind if kind in (O, OPEN) or k == first else kind + 1
    return y


# --- features ------------------------------------------------------------------------------------------------------
def _case(form: str) -> int:
    if len(form) == 1:
        return LETTER if form.isalpha() else LOW
    return UP if form.isupper() else CAP if form[0].isupper() else LOW


@dataclass
class Model:
    vocabulary: Vocabulary
    nodes: np.ndarray  # (offsets, forms, labels)
    kinds: np.ndarray  # (near, kinds, labels)
    chain: np.ndarray  # (labels, labels)
    skips: np.ndarray  # agreement across a link of equal and of similar tokens
    memo: dict[str, int] = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return {**self.__dict__, "memo": {}}

    def _code(self, form: str) -> int:
        if form[0].isdigit():
            return OTHER_DIGITS
        low = form.lower()
        if low in self.vocabulary.proper:
            return {UP: PROPER_UP, CAP: PROPER_CAP}.get(_case(form), PROPER_LOW)
        known = self.vocabulary.forms.get(low)
        return known if known is not None else _case(form)

    def impossible(self) -> np.ndarray:
        """(forms, labels): what is added to the score of a label that a form cannot have."""
        out = np.zeros((self.nodes.shape[1], COUNT), np.float32)
        out[:, _NUMERIC] = -8
        for label, outlines in MAY.items():
            for outline in outlines:
                at = self.vocabulary.forms.get(outline)
                if at is not None:
                    out[at] = np.where(np.isin(np.arange(COUNT), _NUMERIC), out[at], -8)
                    out[at, [O, label]] = 0
        return out

    def code(self, tokens: Tokens) -> list[int]:
        if len(self.memo) > 500_000:
            self.memo.clear()
        out = []
        for _, _, form in tokens:
            c = self.memo.get(form)
            if c is None:
                c = self.memo[form] = self._code(form)
            out.append(c)
        return out


@dataclass
class Laid:
    """Texts laid end to end with pads between: codes, kinds, bounds and skip links of their tokens."""

    codes: np.ndarray
    kinds: np.ndarray
    bounds: list[tuple[int, int]]
    links: np.ndarray  # (links, 3): token, later token, 0 equal or 1 similar

    @staticmethod
    def of(model: Model, docs: list[Tokens]) -> Laid:
        gap = max(BEFORE, AFTER)
        codes, kinds, bounds, links, at = [[PAD] * gap], [[0] * gap], [], [], gap
        for tokens in docs:
            codes += [model.code(tokens), [PAD] * gap]
            own, tied = _kinds_and_links(model.vocabulary, tokens)
            kinds += [own, [0] * gap]
            links += [(at + u, at + v, k) for u, v, k in tied]
            bounds.append((at, at + len(tokens)))
            at += len(tokens) + gap
        flat = lambda x: np.array([v for part in x for v in part], np.int32)
        return Laid(flat(codes), flat(kinds), bounds, np.array(links, np.int64).reshape(-1, 3))

    def inside(self) -> np.ndarray:
        out = np.zeros(len(self.codes), bool)
        for start, end in self.bounds:
            out[start:end] = True
        return out


def _kinds_and_links(vocabulary: Vocabulary, tokens: Tokens) -> tuple[list[int], list[tuple[int, int, int]]]:
    """What kind of name-like token each is, and the links from each to the next equal and the next similar one."""
    like = [i for i, t in enumerate(tokens) if vocabulary.namelike(t[2])]
    low = [tokens[i][2].lower() for i in like]
    often, out, links = Counter(low), [0] * len(tokens), []
    beside = set(like)
    for i, form in zip(like, low):
        out[i] = min(often[form], 3) + (3 if i - 1 in beside or i + 1 in beside else 0)
    last: dict[str, int] = {}
    starts: dict[str, dict[str, int]] = {}
    for i, form in zip(like, low):
        if form in last:
            links.append((last[form], i, 0))
        elif len(form) > 4:
            for part in (form[:3], form[-3:]):
                for other, at in starts.get(part, {}).items():
                    if near(other, form) and (at, i, 1) not in links[-4:]:
                        links.append((at, i, 1))
        last[form] = i
        for part in (form[:3], form[-3:]):
            starts.setdefault(part, {})[form] = i
    return out, links


def vocabulary_of(counts: dict[str, tuple[int, int, int, int, int]], documents: int) -> Vocabulary:
    """From word counts ``(documents, lower case, capital, upper case, capital inside a sentence)`` over the whole corpus."""
    least = max(LEAST_DOCS, LEAST_SHARE * documents)
    proper = {
        w for w, (_, lower, capital, upper, inner) in counts.items()
        if inner >= 2 and inner >= 0.6 * (inner + lower) and inner >= 0.2 * capital and len(w) > 2 and w not in COURTESY
    }
    forms = {f: i for i, f in enumerate(_GENERIC)}
    for form in sorted(f for f, c in counts.items() if c[0] >= least and f not in proper):
        forms.setdefault(form, len(forms))
    for mark in (".", ",", ":", ";", "!", "?", "(", ")", "<", ">", "/", "-", "\"", "\n", *sorted(f"<{k}>" for k in ("email", "link", *X.NUMBER_SHAPES, "numbered", "named", "joined"))):
        forms.setdefault(mark, len(forms))
    return Vocabulary(forms, proper)


def count_words(docs: list[Tokens]) -> dict[str, tuple[int, int, int, int, int]]:
    """The counts ``vocabulary_of`` wants, of texts already cut; ``personal`` counts whole corpora in the JVM."""
    out: dict[str, list[int]] = {}
    for tokens in docs:
        before, seen = "", set()
        for _, _, form in tokens:
            if form[0].isalpha():
                low = form.lower()
                c = out.setdefault(low, [0] * 5)
                c[0] += low not in seen
                seen.add(low)
                c[1] += form == low
                c[3] += form != low and form == form.upper() and len(form) > 1
                c[2] += form != low and not (form == form.upper() and len(form) > 1)
                c[4] += form != low and not (form == form.upper() and len(form) > 1) and before[:1].isalpha()
            before = form
    return {w: tuple(c) for w, c in out.items()}


# --- training ------------------------------------------------------------------------------------------------------
def train(texts: list[str], vocabulary: Vocabulary | None = None, seed: int = 0) -> Model:
    """Fit on a bounded sample of texts; the same sample gives the same model."""
    cut = [X.cut(t) for t in texts if t]
    docs = [tokens for _, tokens in cut]
    vocabulary = vocabulary or vocabulary_of(count_words(docs), len(docs))
    full = Counter(name for tokens in docs for name in {" ".join(tokens[k][2].lower() for k in words) for _, _, words in vocabulary.spans(tokens) if len(words) > 1})
    common = {name for name, n in full.items() if n >= max(3, 0.002 * len(docs))}
    size = len(vocabulary.forms)
    zeros = lambda *shape: np.zeros(shape, np.float32)
    model = Model(vocabulary, zeros(len(OFFSETS), size, COUNT), zeros(len(NEAR), KINDS, COUNT), zeros(COUNT, COUNT), zeros(2))
    laid = Laid.of(model, docs)
    y = np.full(len(laid.codes), OPEN, np.int8)
    for (start, end), (flat, tokens) in zip(laid.bounds, cut):
        y[start:end] = evidence(vocabulary, flat, tokens, common)
    rng = np.random.default_rng(seed)
    _fit(model, laid, y, rng)
    labels, sure = _predicted(model, laid)
    fill = laid.inside() & (y == OPEN) & (sure >= SURE)
    y[fill] = labels[fill]
    _fit(model, laid, y, rng)
    return model


def _fit(model: Model, laid: Laid, y: np.ndarray, rng: np.random.Generator) -> None:
    """Adaptive gradient steps on the pseudo-likelihood of all labels that are not open."""
    known = (y != OPEN) & laid.inside()
    sought = known & np.isin(y, (NB, NI, EM, PH, ID, AD))
    likely = (y > 0) | (laid.kinds > 0) | np.isin(laid.codes, (LOW, UP, CAP, OTHER_DIGITS))
    share = np.select([sought, laid.kinds > KINDS // 2, likely], TAKEN[:3], TAKEN[3])
    # labels of pads and open ones tie to nothing: row COUNT of the widened pair weights is zero
    tied = np.where((y == OPEN) | ~laid.inside(), COUNT, y).astype(np.int64)
    partners = np.full((2, 2, len(y)), len(y))  # kind, earlier or later, token
    for u, v, kind in laid.links:
        partners[kind, 1, u], partners[kind, 0, v] = v, u
    tied = np.append(tied, COUNT)
    params = [model.nodes, model.kinds, model.chain, model.skips]
    squares = [np.full_like(p, 1e-3) for p in params]
    agree = np.pad(_AGREE, ((0, 1), (0, 0)))
    reach, close, impossible = np.asarray(OFFSETS), np.asarray(NEAR), model.impossible()

    def step(which: int, index, slope: np.ndarray, decay: float) -> None:
        squares[which][index] += slope**2
        params[which][index] -= (RATE * slope / np.sqrt(squares[which][index]) + decay * params[which][index]).astype(np.float32)

    for _ in range(EPOCHS):
        rows = np.flatnonzero(known & (rng.random(len(y)) < share))
        rng.shuffle(rows)
        for at in range(0, len(rows), BATCH):
            pick = rows[at : at + BATCH]
            features, kinds = laid.codes[pick[:, None] + reach], laid.kinds[pick[:, None] + close]
            untied = rng.random(len(pick)) < UNTIED
            left, right = np.where(untied, COUNT, tied[pick - 1]), np.where(untied, COUNT, tied[pick + 1])
            chain = np.pad(model.chain + _NEVER, ((0, 1), (0, 1)))
            total = chain[left, :COUNT] + chain[:COUNT, right].T + impossible[laid.codes[pick]]
            for k in range(len(OFFSETS)):
                total += model.nodes[k][features[:, k]]
            for k in range(len(NEAR)):
                total += model.kinds[k][kinds[:, k]]
            untied = rng.random(len(pick)) < UNTIED
            ends = [(kind, np.where(untied, COUNT, tied[partners[kind, way, pick]])) for kind in (0, 1) for way in (0, 1)]
            for kind, end in ends:
                total += model.skips[kind] * agree[end]
            p = np.exp(total - total.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(pick)), y[pick]] -= 1
            for k in range(len(OFFSETS)):
                unique, where = np.unique(features[:, k], return_inverse=True)
                step(0, (k, unique), np.stack([np.bincount(where, p[:, c], len(unique)) for c in range(COUNT)], 1), DECAY)
            for k in range(len(NEAR)):
                slope = np.stack([np.bincount(kinds[:, k], p[:, c], KINDS) for c in range(COUNT)], 1)
                step(1, k, slope, DECAY)
            slope = np.zeros((COUNT + 1, COUNT))
            np.add.at(slope, left, p)
            back = np.zeros((COUNT + 1, COUNT))
            np.add.at(back, right, p)
            step(2, slice(None), slope[:COUNT] + back[:COUNT].T, PAIR_DECAY)
            for kind in (0, 1):
                step(3, kind, np.sum([(agree[end] * p).sum() for own, end in ends if own == kind]), PAIR_DECAY)


# --- prediction ----------------------------------------------------------------------------------------------------
def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def _through(log: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Log of the (n, labels) potentials summed through a matrix of weights."""
    top = log.max(1, keepdims=True)
    return top + np.log(np.exp(log - top) @ weights)


def _chain_beliefs(nodes: np.ndarray, chain: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Log beliefs of (windows, steps, labels) chains of the given lengths."""
    n, steps, k = nodes.shape
    onward = np.exp(chain.astype(np.float64))
    ahead, back = np.zeros_like(nodes), np.zeros_like(nodes)
    ahead[:, 0] = nodes[:, 0]
    for t in range(1, steps):
        ahead[:, t] = nodes[:, t] + _through(ahead[:, t - 1], onward)
    for t in range(steps - 2, -1, -1):
        following = _through(nodes[:, t + 1] + back[:, t + 1], onward.T)
        back[:, t] = np.where((t + 1 < length)[:, None], following, 0)
    beliefs = ahead + back
    return beliefs - _logsum(beliefs, 2)[:, :, None]


def predict(model: Model, docs: list[Tokens], skip: bool = True) -> list[np.ndarray]:
    """Labels of every token of every text.  ``skip`` False leaves the skip links out."""
    laid = Laid.of(model, docs)
    if not skip:
        laid.links = laid.links[:0]
    labels, _ = _predicted(model, laid)
    return [labels[s:e] for s, e in laid.bounds]


def _predicted(model: Model, laid: Laid) -> tuple[np.ndarray, np.ndarray]:
    """Label and belief in it of every token."""
    n = len(laid.codes)
    wide = lambda x, before, after: np.concatenate([np.zeros(before, x.dtype), x, np.zeros(after, x.dtype)])
    codes, kinds = wide(laid.codes, BEFORE, AFTER), wide(laid.kinds, -NEAR[0], NEAR[-1])
    scores = model.impossible()[laid.codes]
    for k in range(len(OFFSETS)):
        scores += model.nodes[k][codes[k : k + n]]
    for k in range(len(NEAR)):
        scores += model.kinds[k][kinds[k : k + n]]
    scores -= _logsum(scores, 1)[:, None]
    labels, sure, inside = np.zeros(n, np.int8), np.ones(n), laid.inside()
    # plain words far from anything name-like or likely keep the label O without messages
    live = inside & ((scores[:, O] < np.log1p(-ACTIVE)) | (laid.kinds > 0))
    near_by = live.copy()
    near_by[1:] |= live[:-1]
    near_by[:-1] |= live[1:]
    near_by &= inside
    windows = np.flatnonzero(np.diff(np.concatenate([[0], near_by.astype(np.int8), [0]]))).reshape(-1, 2)
    if len(windows):
        beliefs = _beliefs(model, laid, scores, windows)
        at = np.flatnonzero(near_by)
        labels[at], sure[at] = beliefs[at].argmax(1), np.exp(beliefs[at].max(1))
    return labels, sure


def _beliefs(model: Model, laid: Laid, scores: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Log beliefs after loopy message passing: exact along each window, messages along the skip links, until they rest."""
    u, v, kind = laid.links.T if len(laid.links) else np.zeros((3, 0), np.int64)
    chain, share = model.chain + _NEVER, np.expm1(model.skips[kind].astype(np.float64))[:, None]
    to_v, to_u = np.zeros((len(u), COUNT), np.float32), np.zeros((len(u), COUNT), np.float32)
    length = windows[:, 1] - windows[:, 0]
    beliefs = scores.copy()
    of = np.repeat(np.arange(len(windows)), length)  # window of each token in one
    home = np.full(len(scores), -1)
    home[np.concatenate([np.arange(a, b) for a, b in windows])] = of
    pending, moving = np.ones(len(windows), bool), np.ones(len(u), bool)
    for _ in range(MOST_ROUNDS):
        nodes = scores.copy()
        np.add.at(nodes, v, to_v)
        np.add.at(nodes, u, to_u)
        order = np.flatnonzero(pending)
        order = order[np.argsort(length[order], kind="stable")]
        for part in np.array_split(order, max(1, len(order) // 512)):
            if len(part):
                steps = np.arange(int(length[part].max()))
                index = windows[part, 0][:, None] + np.minimum(steps, length[part][:, None] - 1)
                real = steps < length[part][:, None]
                beliefs[index[real]] = _chain_beliefs(nodes[index] * real[:, :, None], chain, length[part])[real]
        if not moving.any():
            break
        at = np.flatnonzero(moving)
        next_v = _message(beliefs[u[at]] - to_u[at], share[at])
        next_u = _message(beliefs[v[at]] - to_v[at], share[at])
        moved = np.maximum(np.abs(next_v - to_v[at]).max(1), np.abs(next_u - to_u[at]).max(1))
        to_v[at], to_u[at] = 0.5 * (to_v[at] + next_v), 0.5 * (to_u[at] + next_u)
        # links that moved wake the windows at their ends, and those the links that end there
        awake = np.zeros(len(windows) + 1, bool)
        still = at[moved >= STILL]
        awake[home[u[still]]] = awake[home[v[still]]] = True
        pending = awake[:-1]
        moving = awake[home[u]] | awake[home[v]]
        if not len(still):
            pending[:] = False
            pending[np.unique(np.concatenate([home[u[at]], home[v[at]]]))] = True
            moving = np.zeros(len(u), bool)
    return beliefs


def _message(cavity: np.ndarray, share: np.ndarray) -> np.ndarray:
    """What one end's beliefs say to the other: all labels alike, and ``share`` more for one that agrees."""
    p = np.exp(cavity - cavity.max(1, keepdims=True))
    out = p.sum(1, keepdims=True) + share * (p @ _AGREE)
    return np.log(out / out.sum(1, keepdims=True)).astype(np.float32)


def entities(model: Model, tokens: Tokens, labels: np.ndarray) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` in order.

    A name runs on over its following tokens.  An exact check follows the
    labels: a number or address must have a fitting outline, and a name begins
    and ends with a word that is no everyday one; an initial before it and the
    given name before that belong to it.
    """
    out: list[tuple[int, int, str]] = []
    common = lambda i: tokens[i][2].lower() in model.vocabulary.forms or not tokens[i][2][0].isalpha()
    word = lambda i: i >= 0 and tokens[i][2][0].isalpha()
    i, n = 0, len(tokens)
    marked = np.flatnonzero((labels != O) & (labels != OB) & (labels != OI))
    at, done = 0, -1
    while at < len(marked):
        i = int(marked[at])
        at += 1
        if i <= done:
            continue
        label, (start, end, form) = labels[i], tokens[i]
        if label >= EM:
            if form in MAY[label]:
                out.append((start, end, LABELS[label]))
            continue
        last = i
        while last + 1 < n and labels[last + 1] == NI:
            last += 1
        done = last
        first = i
        while first <= last and common(first) and not (len(tokens[first][2]) == 1 and word(first) and first + 2 <= last and tokens[first + 1][2] == "."):
            first += 1
        while last >= first and common(last):
            last -= 1
        if first > last:
            continue
        if first >= 2 and tokens[first - 1][2] == "." and len(tokens[first - 2][2]) == 1 and word(first - 2):
            first -= 2
            if word(first - 1) and not common(first - 1) and tokens[first][0] - tokens[first - 1][1] == 1:
                first -= 1
        out.append((tokens[first][0], tokens[last][1], "name"))
    return out
