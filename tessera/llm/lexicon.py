"""A minimal acyclic transducer over byte strings, and the exact byte-level merges beside it.

The automaton shares suffixes: two states with equal continuations are one. Every edge
carries the number of words that sort before it under its state, so the edge outputs of a
path add up to the word's number, which points to its token ids.
"""

from __future__ import annotations

import base64
import heapq
import os
import re
from functools import lru_cache

import numpy as np

#: The pattern that splits text before the merges, as published with the vocabulary files. A fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


_ASCII_SPACE = r"\t-\r "


def _ranges(prop: str, chars: str) -> str:
    """The characters with a property as ranges of a class; by the same library whose pattern it stands for."""
    import regex

    out = []
    for m in regex.finditer(rf"{prop}+", chars):
        run = m.group()
        a = 0
        while a < len(run):
            b = a
            while b + 1 < len(run) and ord(run[b + 1]) == ord(run[b]) + 1:
                b += 1
            out.append(f"\\U{ord(run[a]):08x}-\\U{ord(run[b]):08x}")
            a = b + 1
    return "".join(out)


#: The first character that the split of Latin texts doesn't know.
_LATIN = 0x250
_BEYOND = re.compile(f"[^\\x00-{chr(_LATIN - 1)}]").search


@lru_cache(maxsize=3)
def splitter(end: int):
    """A function that splits texts of characters below ``end`` as PATTERN does; written out by short character classes it is several times as fast."""
    if end == 128:
        space, letter, digit = _ASCII_SPACE, "A-Za-z", "0-9"
    else:
        every = "".join(map(chr, [*range(min(end, 0xD800)), *range(0xE000, end)]))
        space, letter, digit = _ranges(r"\s", every), _ranges(r"\p{L}", every), _ranges(r"\p{N}", every)
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{digit}]+| ?[^{space}{letter}{digit}]+|[{space}]+(?![^{space}])|[{space}]+").findall


def split(text: str) -> list[str]:
    return splitter(128 if text.isascii() else 0x110000 if _BEYOND(text) else _LATIN)(text)


def tokenizer_file(name: str = "byte_bpe_50k.tiktoken", folder: str | None = None) -> str:
    return os.path.join(folder or os.environ.get("TESSERA_TOKENIZERS", "/opt/tokenizers"), name)


@lru_cache(maxsize=4)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge(word: bytes, rank: dict[bytes, int]) -> list[int]:
    """Token ids of one word: always the pair of the lowest rank, the first of equals, by a heap, so long words cost n log n."""
    if word in rank:
        return [rank[word]]
    n = len(word)
    part: list[bytes | None] = [word[i : i + 1] for i in range(n)]
    nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, 2) for i in range(n - 1) if (r := rank.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        r, i, size = heapq.heappop(heap)
        a = part[i]
        if a is None or (j := nxt[i]) >= n or len(a) + len(part[j]) != size or rank.get(a + part[j]) != r:
            continue
        part[i], part[j] = a + part[j], None
        nxt[i] = k = nxt[j]
        if k < n:
            prv[k] = i
            ab = part[i] + part[k]
            if (q := rank.get(ab)) is not None:
                heapq.heappush(heap, (q, i, len(ab)))
        if (p := prv[i]) >= 0:
            ab = part[p] + part[i]
            if (q := rank.get(ab)) is not None:
                heapq.heappush(heap, (q, p, len(ab)))
    return [rank[x] for x in part if x is not None]


class Lexicon:
    """Arrays of the compiled automaton; see compile_words. States: first[s]..first[s+1] are its edges, by byte."""

    NAMES = ("first", "byte", "target", "before", "final", "at", "ids")

    def __init__(self, arrays: dict[str, np.ndarray]):
        for k in self.NAMES:
            setattr(self, k, arrays[k])
        self.root = len(self.first) - 2
        # what a step reads: plain views of the mapped arrays
        self._first, self._target, self._before, self._at = (memoryview(np.asarray(x)) for x in (self.first, self.target, self.before, self.at))
        self._final, self._byte = memoryview(np.asarray(self.final).view(np.uint8)), np.asarray(self.byte).tobytes()

    def get(self, word: bytes) -> list[int] | None:
        s, number = self.root, 0
        first, find, target, before = self._first, self._byte.find, self._target, self._before
        for c in word:
            k = find(c, first[s], first[s + 1])
            if k < 0:
                return None
            number += before[k]
            s = target[k]
        if not self._final[s]:
            return None
        return self.ids[self._at[number] : self._at[number + 1]].tolist()

    def save(self, folder: str) -> None:
        os.makedirs(folder, exist_ok=True)
        for k in self.NAMES:
            np.save(os.path.join(folder, f"{k}.npy"), getattr(self, k))

    @classmethod
    def mapped(cls, folder: str) -> Lexicon:
        return cls({k: np.load(os.path.join(folder, f"{k}.npy"), mmap_mode="r") for k in cls.NAMES})


def compile_words(words: dict[bytes, list[int]]) -> Lexicon:
    """Compile words with their ids. Words go in by byte order, so all but the newest path is final and can be shared."""
    known: dict[tuple, int] = {}
    states: list[tuple] = []  # (final, ((byte, target), ...))

    def frozen(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in known:
            known[key] = len(states)
            states.append(key)
        return known[key]

    order = sorted(words)
    path: list[list] = [[False, []]]  # the newest path, root first
    last = b""
    for w in order:
        same = 0
        while same < min(len(w), len(last)) and w[same] == last[same]:
            same += 1
        while len(path) - 1 > same:
            node = path.pop()
            path[-1][1].append((last[len(path) - 1], frozen(node)))
        for _ in w[same:]:
            path.append([False, []])
        path[-1][0] = True
        last = w
    while len(path) > 1:
        node = path.pop()
        path[-1][1].append((last[len(path) - 1], frozen(node)))
    if states:
        known.pop((path[0][0], tuple(path[0][1])), None)  # the root stays last
    frozen(path[0])
    below = []  # words under a state; targets come before their sources
    for final, edges in states:
        below.append(int(final) + sum(below[t] for _, t in edges))
    first, byte, target, before = [0], [], [], []
    for final, edges in states:
        seen = int(final)
        for c, t in edges:
            byte.append(c)
            target.append(t)
            before.append(seen)
            seen += below[t]
        first.append(len(byte))
    ids = [words[w] for w in order]
    return Lexicon({
        "first": np.array(first, np.int64), "byte": np.array(byte, np.uint8), "target": np.array(target, np.int64), "before": np.array(before, np.int64),
        "final": np.array([f for f, _ in states], bool), "at": np.cumsum([0, *map(len, ids)]).astype(np.int64), "ids": np.array([x for i in ids for x in i], np.int32),
    })
