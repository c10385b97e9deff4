"""Abusive, hateful or sexual content.

A bidirectional gated recurrent network with attention pooling reads every window of WINDOW
words of a text, one from each word on; a word comes in as the embedding of
itself, if training knew it, and the mean of those of its character trigrams, after disguises (spaced or dotted
letters, digits and signs for letters) are undone. A text's score is the highest of its
windows. The weights are trained by ``abuse_train`` in numpy and lie beside this module,
with the threshold that the training documents gave.

Defined results: null, empty and blank texts score 0; texts of any length are read whole;
rows that repeat score alike; a null source is reported as a source of its own.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 10
BUCKETS, DIM, HIDDEN = 16_384, 24, 16
#: Windows that are scored at once.
AT_ONCE = 4096
WEIGHTS = os.path.join(os.path.dirname(__file__), "abuse_weights.npz")
#: Distinct words that a task keeps projected at once: 0.6 KB each.
HELD = 40_000
GRAMS = 100_000

_SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_][ .\-_*]{1,2}){3,}[^\W\d_](?![^\W_])")
_LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "$": "s", "@": "a", "!": "i", "+": "t", "€": "e"})
_WORD = re.compile(r"[^\W_](?:[\w$@!*+'’#%.\-]*[\w$@*+])?|[$@][\w$@!*+]+")
_INNER = re.compile(r"(?<=[^\W\d_])[.\-_](?=[^\W\d_](?:[.\-_]|\b))")
#: Letters of other scripts that look like Latin ones. Fixed values.
_ALIKE = str.maketrans("аеорсухіјѕԁһԛԝАВЕКМНОРСТХУІЈЅαοενρτικ", "aeopcyxijsdhqwABEKMHOPCTXYIJSaoevptik")
_HIDDEN = re.compile("[\u00ad\u200b-\u200f\u2060-\u2064\ufeff\u0300-\u036f]")
_MIXED = re.compile(r"[^\W\d_]*[A-Za-z][^\W\d_]*")
_CASES = re.compile(r"(?<=[a-z]{3})(?=[A-Z][a-z]{2})|(?<=[^\W_]{2})_+(?=[^\W_]{2})")
_LONG = re.compile(r"([^\W\d_])\1{2,}")


def _plain(text: str) -> str:
    """Letters of other scripts, hidden marks and other widths undone, in words that are partly Latin."""
    t = _HIDDEN.sub("", unicodedata.normalize("NFKC", text))
    return _MIXED.sub(lambda m: m.group() if m.group().isascii() else m.group().translate(_ALIKE), t)


def tokens(text: str) -> list[str]:
    """The words of a text with disguises undone."""
    if not text.isascii():
        text = _plain(text)
    text = _CASES.sub(" ", _LONG.sub(r"\1", text))
    t = _SPACED.sub(lambda m: re.sub(r"[ .\-_*]", "", m.group()), text)
    out = []
    for w in _WORD.findall(t.lower()):
        if w.isalpha():
            out.append(w)
        elif "/" in w or "." in w or "-" in w or "'" in w or "’" in w:
            w = _INNER.sub("", w)
            out += [x for x in re.split(r"[.\-_'’]", w) if x] or ["0"]
        elif w.isdigit():
            out.append("0")
        else:
            letters = sum(c.isalpha() for c in w)
            out.append(w.translate(_LEET).rstrip("+") if letters >= len(w) / 3 and not re.fullmatch(r"[a-z]*\d+[a-z]?|0x\w+|[a-f0-9]+", w) else w)
    return out


def _hashed(word: str) -> tuple[int, tuple[int, ...]]:
    b = f"<{word}>"
    grams = [b[i : i + 3] for i in range(len(b) - 2)] or [b]
    return zlib.crc32(word.encode("utf-8", "replace")), tuple(zlib.crc32(("#" + g).encode("utf-8", "replace")) % BUCKETS for g in grams)


_held = lru_cache(maxsize=200_000)(_hashed)


def hashed(word: str) -> tuple[int, tuple[int, ...]]:
    """The hash of a word and the buckets of all its character trigrams; long words aren't held."""
    return _held(word) if len(word) <= 24 else _hashed(word)


def places(hashes: list[int], owner: np.ndarray) -> np.ndarray:
    """The rows of words in the table of words: their buckets where they own them, else the last row, which stands for unknown words."""
    h = np.array(hashes, np.int64)
    return np.where(owner[h % BUCKETS] == h, h % BUCKETS, BUCKETS)


def windows(n: int) -> np.ndarray:
    """The starts of the windows over n words: every word from which a whole window follows, or the first of a shorter text."""
    return np.arange(max(1, n - WINDOW + 1) if n else 0)


def gate(x: np.ndarray) -> np.ndarray:
    """The logistic curve by straight lines; what it reads is scaled beforehand."""
    return np.clip(x, 0, 1, out=x)


def soft(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|), in place."""
    x /= np.abs(x) + 1
    return x


class Network:
    def __init__(self, p: dict[str, np.ndarray]):
        self.p = {k: np.asarray(v, np.float32) for k, v in p.items() if k != "owner"}
        self.owner = np.asarray(p["owner"], np.int64)
        self.threshold = float(self.p.get("threshold", 0.5))
        # gates are clip(x / 4 + 1 / 2): scaled here once
        self.x = np.concatenate([self.p["fx"], self.p["bx"]], axis=1)
        self.b = np.concatenate([self.p["fb"], self.p["bb"]])
        self.h = {}
        for i, s in enumerate("fb"):
            w, k = self.p[s + "h"].copy(), 3 * i * HIDDEN
            w[:, : 2 * HIDDEN] /= 4
            self.x[:, k : k + 2 * HIDDEN] /= 4
            self.b[k : k + 2 * HIDDEN] = self.b[k : k + 2 * HIDDEN] / 4 + 0.5
            self.h[s] = np.ascontiguousarray(w)

    @classmethod
    def load(cls, path: str = WEIGHTS) -> Network:
        with np.load(path) as z:
            return cls({k: z[k] for k in z.files})

    def embed(self, words: list[str]) -> np.ndarray:
        """Word and mean trigram embeddings side by side."""
        h = [hashed(w) for w in words]
        at = np.cumsum([0, *(len(g) for _, g in h)])
        mean = []
        a = 0
        while a < len(h):
            # words of about GRAMS trigrams at once, at least one
            b = max(a + 1, int(np.searchsorted(at, at[a] + GRAMS, "right")) - 1)
            grams = self.p["char"][np.fromiter((x for _, g in h[a:b] for x in g), np.int64, int(at[b] - at[a]))]
            mean.append(np.add.reduceat(grams, at[a:b] - at[a], axis=0) / np.diff(at[a : b + 1])[:, None])
            a = b
        mean = np.concatenate(mean)
        return np.concatenate([self.p["word"][places([w for w, _ in h], self.owner)], mean], axis=1)

    def project(self, x: np.ndarray) -> np.ndarray:
        """What both directions add for an input: 2 times 3 gates."""
        return x @ self.x + self.b

    def _run(self, projected: np.ndarray, idx: np.ndarray, mask: np.ndarray | None, side: str) -> np.ndarray:
        """What attention and output read of the states of one direction: (places, windows, 2)."""
        steps, n = idx.shape
        wh, bn = self.h[side], self.p[side + "n"]
        k = 0 if side == "f" else HIDDEN
        heads = np.stack([self.p["u"][k : k + HIDDEN], self.p["o"][k : k + HIDDEN]], axis=1)
        h, d = np.zeros((n, HIDDEN), np.float32), 2 * HIDDEN
        out = np.empty((steps, n, 2), np.float32)
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            g = projected[idx[t]]
            gh = h @ wh
            rz = g[:, :d]
            rz += gh[:, :d]
            gate(rz)
            c = gh[:, d:]
            c += bn
            c *= rz[:, :HIDDEN]
            c += g[:, d:]
            soft(c)
            c -= h
            c *= rz[:, HIDDEN:]
            if mask is not None:
                c *= mask[t][:, None]
            h += c
            np.matmul(h, heads, out=out[t])
        return out

    def scores(self, projected: tuple[np.ndarray, np.ndarray], idx: np.ndarray, mask: np.ndarray | None) -> np.ndarray:
        """Probabilities of windows given as columns of indices into projected words (forward and backward); mask: 0 where a window is over."""
        out = np.empty(idx.shape[1], np.float32)
        for a in range(0, len(out), AT_ONCE):
            i, m = idx[:, a : a + AT_ONCE], None if mask is None else mask[:, a : a + AT_ONCE]
            x = self._run(projected[0], i, m, "f") + self._run(projected[1], i, m, "b")
            e = x[:, :, 0] if m is None else x[:, :, 0] + (m - 1) * 1e9
            w = np.exp(e - e.max(axis=0))
            out[a : a + AT_ONCE] = _sigmoid((w * x[:, :, 1]).sum(axis=0) / w.sum(axis=0) + self.p["ob"])
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Scorer:
    """Scores texts in a task; keeps projected words."""

    def __init__(self, network: Network | None = None):
        self.net = network or Network.load()
        self.rows = (np.empty((HELD, 3 * HIDDEN), np.float32), np.empty((HELD, 3 * HIDDEN), np.float32))
        self.at: dict[str, int] = {}

    def _keep(self, new: list[str]) -> None:
        if len(self.at) + len(new) > HELD:
            self.at = {}
        if len(new) > len(self.rows[0]):  # one text of very many distinct words
            self.rows = tuple(np.empty((len(new), 3 * HIDDEN), np.float32) for _ in range(2))
        for k in range(0, len(new), 4096):
            words = new[k : k + 4096]
            x, n = self.net.project(self.net.embed(words)), len(self.at)
            for half in (0, 1):
                self.rows[half][n : n + len(words)] = x[:, half * 3 * HIDDEN : (half + 1) * 3 * HIDDEN]
            self.at.update((w, n + i) for i, w in enumerate(words))

    def windows_of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(score of every window, number of the text it belongs to)."""
        toks = [tokens(t) if t else [] for t in texts]
        words = {w for t in toks for w in t}
        new = words.difference(self.at)
        if len(self.at) + len(new) > HELD:
            self.at, new = {}, words
        if new:
            self._keep(sorted(new))
        n = np.array([len(t) for t in toks], np.int64)
        starts = [windows(x) for x in n.tolist()]
        of = np.repeat(np.arange(len(texts)), [len(s) for s in starts])
        out = np.zeros(len(of), np.float32)
        if not len(of):
            return out, of
        at = self.at
        flat = np.array([at[w] for t in toks for w in t] + [0] * WINDOW, np.int32)
        base = np.concatenate([[0], np.cumsum(n)[:-1]])[of] + np.concatenate(starts)
        whole = n[of] >= WINDOW
        for part, short in ((np.flatnonzero(whole), False), (np.flatnonzero(~whole), True)):
            for k in range(0, len(part), 16 * AT_ONCE):
                p = part[k : k + 16 * AT_ONCE]
                idx = flat[base[p][None, :] + np.arange(WINDOW)[:, None]]
                mask = (np.arange(WINDOW)[:, None] < n[of[p]][None, :]).astype(np.float32) if short else None
                out[p] = self.net.scores(self.rows, idx, mask)
        return out, of

    def scores(self, texts: list[str | None]) -> np.ndarray:
        distinct = {t: i for i, t in enumerate(dict.fromkeys(texts))}
        s, of = self.windows_of(list(distinct))
        best = np.zeros(len(distinct), np.float32)
        np.maximum.at(best, of, s)
        return best[[distinct[t] for t in texts]]


def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", extra: tuple[str, ...] = (), weights: str | None = None) -> DataFrame:
    """(id_col, extra columns, score) of every row."""
    kinds = dict(df.dtypes)
    net = Network.load(weights or WEIGHTS)

    def run(batches):
        s = Scorer(net)
        for b in batches:
            for a in range(0, b.num_rows, 256):
                part = b.slice(a, 256)
                got = s.scores(part.column(part.num_columns - 1).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(got.astype(np.float64))], names=[id_col, *extra, "score"])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (id_col, *extra)) + ", score double"
    return df.select(id_col, *extra, text_col).mapInArrow(run, schema)


def threshold(weights: str | None = None) -> float:
    """From what score on a text counts, as the training documents gave it."""
    return Network.load(weights or WEIGHTS).threshold


def rates(scored: DataFrame, source_col: str = "source", at: float | None = None) -> DataFrame:
    """(source, n_docs, n_flagged, rate) per source."""
    bad = F.sum((F.col("score") >= (threshold() if at is None else at)).cast("long"))
    return scored.groupBy(source_col).agg(F.count(F.lit(1)).alias("n_docs"), bad.alias("n_flagged"), (bad / F.count(F.lit(1))).alias("rate"))
