"""A minimal acyclic transducer from words to token ids, in one memory-mappable block.

Words are added in byte order; finished suffixes are merged with equal ones
right away (Daciuk's incremental construction), so the automaton is minimal at
every step.  Each edge counts the words that sort before it among its state's
words; the sum along a path is the word's number, and the number leads to its
ids.

Layout, little-endian int32 unless noted::

    states, edges, words, ids          header
    first edge of each state           states + 1
    target of each edge                edges
    words skipped by each edge         edges
    first id of each word              words + 1
    ids                                ids
    label of each edge                 edges bytes
    final flag of each state           states bytes
"""

from __future__ import annotations

import mmap
from array import array
from collections.abc import Iterable, Iterator


class Builder:
    """Add words in strictly increasing byte order, then ``finish``."""

    def __init__(self) -> None:
        self.register: dict[tuple, int] = {}
        self.states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []
        self.open: list[list] = [[False, []]]  # per depth: final, [(label, state or None)]
        self.last = b""

    def _freeze(self, node: list) -> int:
        shape = (node[0], tuple(node[1]))
        at = self.register.get(shape)
        if at is None:
            at = self.register[shape] = len(self.states)
            self.states.append(shape)
        return at

    def _close(self, depth: int) -> None:
        while len(self.open) - 1 > depth:
            state = self._freeze(self.open.pop())
            edges = self.open[-1][1]
            edges[-1] = (edges[-1][0], state)

    def add(self, word: bytes) -> None:
        if self.open[0][0] or self.open[0][1]:
            assert word > self.last, "words must come sorted and once"
        same = 0
        while same < min(len(word), len(self.last)) and word[same] == self.last[same]:
            same += 1
        self._close(same)
        for byte in word[same:]:
            self.open[-1][1].append((byte, None))
            self.open.append([False, []])
        self.open[-1][0] = True
        self.last = word

    def finish(self, outputs: Iterable[list[int]]) -> bytes:
        """The block; ``outputs`` are the ids of the words in the order they were added."""
        self._close(0)
        root = self._freeze(self.open[0])
        words_below = [0] * len(self.states)
        for at, (final, edges) in enumerate(self.states):  # targets are frozen before their sources
            words_below[at] = final + sum(words_below[to] for _, to in edges)
        order = [root, *(s for s in range(len(self.states)) if s != root)]
        place = {state: at for at, state in enumerate(order)}
        first, target, skip, labels, finals = array("i", [0]), array("i"), array("i"), bytearray(), bytearray()
        for state in order:
            final, edges = self.states[state]
            before = int(final)
            for label, to in edges:
                labels.append(label)
                target.append(place[to])
                skip.append(before)
                before += words_below[to]
            first.append(len(target))
            finals.append(final)
        starts, ids = array("i", [0]), array("i")
        for out in outputs:
            ids.extend(out)
            starts.append(len(ids))
        head = array("i", [len(order), len(target), len(starts) - 1, len(ids)])
        return b"".join([*(x.tobytes() for x in (head, first, target, skip, starts, ids)), bytes(labels), bytes(finals)])


class Transducer:
    """Read-only view of a block; a mapped file is shared by the workers of a machine."""

    def __init__(self, block: bytes | mmap.mmap) -> None:
        self.block = block
        view = memoryview(block)
        states, edges, words, ids = view[:16].cast("i")
        at = 16
        parts = []
        for n in (states + 1, edges, edges, words + 1, ids):
            parts.append(view[at : at + 4 * n].cast("i"))
            at += 4 * n
        self.first, self.target, self.skip, self.starts, self.ids = parts
        self.labels, self.finals = at, at + edges
        self.states, self.words = states, words

    @classmethod
    def open(cls, path: str) -> Transducer:
        with open(path, "rb") as file:
            return cls(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ))

    def get(self, word: bytes) -> list[int] | None:
        """Ids of ``word``, or None where it is not in the lexicon."""
        return next(self.walk([word]))

    def walk(self, words: Iterable[bytes]) -> Iterator[list[int] | None]:
        """``get`` of every word; where words come sorted, what a word shares with the last is not walked again."""
        find, first, labels, skips, target = self.block.find, self.first, self.labels, self.skip, self.target
        finals, starts, ids, block = self.finals, self.starts, self.ids, self.block
        last, path = b"", [(0, 0)]  # state and number after each byte of the last word, as far as it led
        for word in words:
            same, most = 0, min(len(path) - 1, len(word), len(last))
            while same < most and word[same] == last[same]:
                same += 1
            del path[same + 1 :]
            state, number = path[-1]
            for at in range(same, len(word)):
                edge = find(word[at : at + 1], labels + first[state], labels + first[state + 1])
                if edge < 0:
                    yield None
                    break
                number += skips[edge - labels]
                state = target[edge - labels]
                path.append((state, number))
            else:
                yield ids[starts[number] : starts[number + 1]].tolist() if block[finals + state] else None
            last = word


def compile_lexicon(words: dict[bytes, list[int]]) -> bytes:
    builder = Builder()
    ordered = sorted(words)
    for word in ordered:
        builder.add(word)
    return builder.finish(words[w] for w in ordered)
