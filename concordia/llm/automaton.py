"""Suffix automata over words, with the smallest rank among the texts that hold each state's strings."""

from __future__ import annotations


class SuffixAutomaton:
    """Recognises all substrings of some word sequences. ``least[state]`` is the smallest rank of a sequence that has them."""

    def __init__(self, sequences: list[tuple[list, int]]):
        self.next: list[dict] = [{}]
        self.link, self.size, self.least = [-1], [0], [float("inf")]
        for words, rank in sequences:
            last = 0
            for w in words:
                last = self._add(last, w, rank)
        for state in sorted(range(1, len(self.size)), key=self.size.__getitem__, reverse=True):
            up = self.link[state]
            if self.least[state] < self.least[up]:
                self.least[up] = self.least[state]

    def _new(self, size: int, edges: dict, link: int, least) -> int:
        self.next.append(edges)
        self.size.append(size)
        self.link.append(link)
        self.least.append(least)
        return len(self.size) - 1

    def _split(self, p: int, w, q: int) -> int:
        """The state of p's longest string and w, apart from q, whose strings also have longer ones."""
        copy = self._new(self.size[p] + 1, dict(self.next[q]), self.link[q], float("inf"))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def _add(self, last: int, w, rank) -> int:
        q = self.next[last].get(w)
        if q is not None:
            state = q if self.size[q] == self.size[last] + 1 else self._split(last, w, q)
            self.least[state] = min(self.least[state], rank)
            return state
        state, p = self._new(self.size[last] + 1, {}, 0, rank), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = state
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[state] = q if self.size[q] == self.size[p] + 1 else self._split(p, w, q)
        return state

    def windows(self, words: list, length: int):
        """(start, smallest rank) of each window of the words that some sequence holds: matching statistics, cut at length."""
        state = matched = 0
        for i, w in enumerate(words):
            while state and w not in self.next[state]:
                state = self.link[state]
                matched = self.size[state]
            if w in self.next[state]:
                state, matched = self.next[state][w], matched + 1
            else:
                matched = 0
            while self.size[self.link[state]] >= length if state else False:
                state = self.link[state]
            if matched >= length:
                matched = length
                yield i + 1 - length, self.least[state]


class CountingAutomaton:
    """All substrings of some word sequences, and at how many places each ends (the size of its endpos set).

    The strings of a state end at the same places, so they have one count: that of the places where the state's longest string
    was read, and, along the suffix links, of all states whose strings end in it.
    """

    def __init__(self):
        self.words: list = []
        self.next: list[dict] = [{}]
        self.link, self.size, self.count, self.end = [-1], [0], [0], [-1]

    def add(self, sequence: list) -> None:
        following, link, size, count, end = self.next, self.link, self.size, self.count, self.end
        at, last = len(self.words), 0
        self.words += sequence
        for at, w in enumerate(sequence, at):
            q = following[last].get(w)
            if q is not None and size[q] == size[last] + 1:
                count[q] += 1
                last = q
                continue
            new, p = len(size), last
            if q is None:
                following.append({})
                size.append(size[last] + 1)
                count.append(1)
                end.append(at)
                link.append(0)
                while p >= 0 and w not in following[p]:
                    following[p][w] = new
                    p = link[p]
                last = new
                if p < 0:
                    continue
                q = following[p][w]
                if size[q] == size[p] + 1:
                    link[new] = q
                    continue
            # the strings of q up to p's longest and w also end where the others don't
            copy = len(size)
            following.append(dict(following[q]))
            size.append(size[p] + 1)
            end.append(end[q])
            link.append(link[q])
            link[q] = copy
            if last == new:
                count.append(0)
                link[new] = copy
            else:
                count.append(1)
                last = copy
            while p >= 0 and following[p].get(w) == q:
                following[p][w] = copy
                p = link[p]

    def substrings(self, least: int, most: int):
        """(first word, end, count) of each different substring of least to most words: where one occurrence stands, and how many there are."""
        size, link, count = self.size, self.link, self.count
        for state in sorted(range(1, len(size)), key=size.__getitem__, reverse=True):
            count[link[state]] += count[state]
        for state in range(1, len(size)):
            shortest = size[link[state]] + 1
            if shortest <= most:
                stop = self.end[state] + 1
                for n in range(max(least, shortest), min(most, size[state]) + 1):
                    yield stop - n, stop, count[state]
