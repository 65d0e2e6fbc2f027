"""Keeping only the story of a page (problem 6).

A recurrent block labeller: the lines of an article, its title in front, are a
sequence of blocks.  Each block is a vector of its hashed words and of its path in the
page (how it is set apart from its neighbours, where it lies, how it is
punctuated); a bidirectional LSTM in numpy reads the sequence and labels
every block with the whole document as context.

The network is trained here, on a bounded sample of articles whose blocks are labelled
by rules that need the sample's own statistics and the list of sites (``weak_labels``): furniture phrases, names of
sites in titles, unpunctuated lines, and cross-headings, which are told from other unpunctuated lines by
occurring word for word inside the sample's sentences.  The phrases and the names are
no inputs of the network: it has to find them in the words.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondhan.llm.lookalike import latinised, plain
from sondhan.llm.sampling import bounded_sample
from sondhan.session import spread

WORD_BUCKETS = 1 << 14
WORD_SIZE = 24
HIDDEN_SIZE = 16
SHAPES = 22
#: Lines (with padding) that one step of the network holds.
CELLS = 20_000
SAMPLE = 2_500

# A choice of this library, for the training labels only: parts of phrases that only the furniture of a page holds, in the languages of the corpus.
FURNITURE = (
    "we use cookies|cookie policy|কুকি ব্যবহার করি|कुकीज़ का उपयोग|usamos cookies|wir verwenden cookies|utilisons des cookies|©|copyright 20|all rights reserved|tous droits réservés|"
    "alle rechte vorbehalten|todos los derechos|সর্বস্বত্ব|सर्वाधिकार|stores small files on your device|আপনার যন্ত্রে ছোট ফাইল|accept all|সব মেনে নিন"
)
_FURNITURE = re.compile(FURNITURE)
_END = re.compile(r"[.।!?…][\"'”’»)\]]*$")
_INNER_END = re.compile(r"[.।!?][\"'”’»)]* +\S")
_SEPARATORS = re.compile(r"[|›»·•/>]")
_DASHED = re.compile(r"\s[-–—|:·»]+\s")
_BULLET = re.compile(r"^[*»•\[>-]")
_WORD = re.compile(r"[^\s\d!-/:-@\[-`{-~০-৯०-९।‘’“”„«»‹›–—…|•·©°]+")
_DIGIT = re.compile(r"[0-9০-৯०-९]")


def folded(text: str) -> str:
    return latinised(plain(text))


def words(line: str) -> list[str]:
    return _WORD.findall(line.lower())


def blocks(title: str | None, body: str) -> tuple[list[str], list[int]]:
    """The title and the lines that are not blank, with their numbers (0: title, lines from 1)."""
    lines = [(0, folded(title or "")), *((i + 1, folded(line)) for i, line in enumerate(body.split("\n")))]
    kept = [(i, x) for i, x in lines if i == 0 or x.strip()]
    return [x for _, x in kept], [i for i, _ in kept]


def shapes(texts: list[str], numbers: list[int]) -> np.ndarray:
    """Path and shape of each block: one row of SHAPES values a block."""
    n, out = len(texts), np.zeros((len(texts), SHAPES), np.float32)
    for k, t in enumerate(texts):
        w, size = len(t.split()), max(1, len(t))
        before = numbers[k] - numbers[k - 1] if k > 1 else 3
        after = numbers[k + 1] - numbers[k] if k + 1 < n else 3
        ends = _DASHED.split(t)
        has_case = any(c.isascii() and c.isalpha() for c in t)
        out[k] = (
            k == 0, bool(_END.search(t)), bool(_INNER_END.search(t)), min(len(_SEPARATORS.findall(t)), 6) / 3, bool(_BULLET.match(t)),
            w == 1, w <= 3, w <= 6, min(w, 60) / 30, t.count(",") > 0, ":" in t, "|" in t, len(_DIGIT.findall(t)) / size, has_case and t.upper() == t,
            before == 1, before == 2, after == 1, after == 2, k / n, (n - k) / n,
            k == 0 and len(ends) > 1, len(ends) > 1 and min(len(ends[0].split()), len(ends[-1].split())) <= 3,
        )
    return out


def hashed(line: str) -> list[int]:
    return [zlib.crc32(x.encode()) % WORD_BUCKETS for x in words(line)] or [0]


def sites_pattern(names: list[str]) -> re.Pattern | None:
    found = sorted({folded(x).lower().strip() for x in names if x and x.strip()}, key=len, reverse=True)
    return re.compile("|".join(map(re.escape, found))) if found else None


def weak_labels(articles: list[tuple[list[str], list[int]]], sites: re.Pattern | None) -> list[np.ndarray]:
    """1 for furniture, 0 for the story, by rules over the sample itself."""
    phrases: Counter = Counter()
    alone: Counter = Counter()
    for texts, _ in articles:
        for t in texts[1:]:
            w = words(t)
            if not _END.search(t) and 2 <= len(w) <= 7:
                alone[" ".join(w)] += 1
    for texts, _ in articles:
        for t in texts[1:]:
            if _END.search(t) and not _FURNITURE.search(t.lower()):
                w = words(t)
                for size in range(2, 8):
                    for i in range(len(w) - size + 1):
                        g = " ".join(w[i : i + size])
                        if g in alone:
                            phrases[g] += 1
    headings = {g for g, n in phrases.items() if n >= 3 and n >= alone[g]}
    out = []
    for texts, _ in articles:
        y = np.zeros(len(texts), np.float32)
        for k, t in enumerate(texts):
            low = t.lower()
            if k == 0:
                y[k] = bool(sites and sites.search(low))
            elif _FURNITURE.search(low) or (_SEPARATORS.search(t) and not _END.search(t)):
                y[k] = 1
            elif not _END.search(t):
                y[k] = not (" ".join(words(t)) in headings and not _BULLET.match(t))
        out.append(y)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _groups(order: np.ndarray, lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Documents of like length, so many together that the padded lines are no more than CELLS (a longer document is alone)."""
    start = 0
    for end in range(1, len(order) + 1):
        if end == len(order) or (end + 1 - start) * int(lengths[order[end]]) > CELLS:
            yield order[start:end]
            start = end


class BlockLabeller:
    """Bidirectional LSTM over block vectors with a logistic output, trained by Adam."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        d, h = WORD_SIZE + SHAPES, HIDDEN_SIZE
        self.p = {"words": rng.normal(0, 0.1, (WORD_BUCKETS, WORD_SIZE)).astype(np.float32)}
        for way in ("f", "b"):
            self.p[f"w{way}"] = rng.normal(0, 1 / np.sqrt(d + h), (d + h, 4 * h)).astype(np.float32)
            bias = np.zeros(4 * h, np.float32)
            bias[h : 2 * h] = 1.0
            self.p[f"bias{way}"] = bias
        self.p["out"] = rng.normal(0, 0.1, 2 * h + d).astype(np.float32)
        self.p["bias"] = np.zeros(1, np.float32)

    def vectors(self, ids: np.ndarray, offsets: np.ndarray, shape: np.ndarray) -> np.ndarray:
        sums = np.add.reduceat(self.p["words"][ids], offsets[:-1], axis=0)
        return np.concatenate([sums / np.sqrt(np.diff(offsets))[:, None].astype(np.float32), shape], 1)

    def _run(self, way: str, x: np.ndarray, keep: list | None) -> np.ndarray:
        """x: time, batch, size; padded steps have a zero mask in the last place of keep's partner."""
        w, b, h = self.p[f"w{way}"], self.p[f"bias{way}"], HIDDEN_SIZE
        d = x.shape[2]
        state, cell = np.zeros((x.shape[1], h), np.float32), np.zeros((x.shape[1], h), np.float32)
        inputs = x @ w[:d] + b
        out = np.zeros((x.shape[0], x.shape[1], h), np.float32)
        for t in range(x.shape[0]):
            z = inputs[t] + state @ w[d:]
            i, f, o, g = _sigmoid(z[:, :h]), _sigmoid(z[:, h : 2 * h]), _sigmoid(z[:, 2 * h : 3 * h]), np.tanh(z[:, 3 * h :])
            if keep is not None:
                keep.append((i, f, o, g, cell, state))
            cell = f * cell + i * g
            state = o * np.tanh(cell)
            out[t] = state
        return out

    def _back(self, way: str, x: np.ndarray, keep: list, grad: np.ndarray, into: dict) -> np.ndarray:
        w, h, d = self.p[f"w{way}"], HIDDEN_SIZE, x.shape[2]
        ds, dc = np.zeros_like(keep[0][5]), np.zeros_like(keep[0][4])
        dz_all = np.zeros((x.shape[0], x.shape[1], 4 * h), np.float32)
        for t in range(x.shape[0] - 1, -1, -1):
            i, f, o, g, c0, s0 = keep[t]
            c1 = f * c0 + i * g
            tc = np.tanh(c1)
            ds = ds + grad[t]
            dc = dc + ds * o * (1 - tc * tc)
            dz = np.concatenate([dc * g * i * (1 - i), dc * c0 * f * (1 - f), ds * tc * o * (1 - o), dc * i * (1 - g * g)], 1)
            dz_all[t] = dz
            ds, dc = dz @ w[d:].T, dc * f
            into[f"w{way}"][d:] += s0.T @ dz
        into[f"w{way}"][:d] += np.tensordot(x, dz_all, ([0, 1], [0, 1]))
        into[f"bias{way}"] += dz_all.sum((0, 1))
        return dz_all @ w[:d].T

    @staticmethod
    def _reversed(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Each sequence backwards, its padding still at the end."""
        t = np.arange(x.shape[0])[:, None]
        at = np.where(t < lengths[None], lengths[None] - 1 - t, t)
        return np.take_along_axis(x, at[:, :, None], 0)

    def score(self, ids, offsets, shape, lengths: np.ndarray) -> np.ndarray:
        """Probability of furniture for each block of documents laid end to end."""
        v = self.vectors(ids, offsets, shape)
        starts = np.concatenate([[0], np.cumsum(lengths)])
        out = np.zeros(len(v), np.float32)
        order = np.argsort(lengths, kind="stable")
        for group in _groups(order, lengths):
            n, x = lengths[group], np.zeros((int(lengths[group].max()), len(group), v.shape[1]), np.float32)
            for j, doc in enumerate(group):
                x[: n[j], j] = v[starts[doc] : starts[doc + 1]]
            y = self._logits(x, n)[0]
            for j, doc in enumerate(group):
                out[starts[doc] : starts[doc + 1]] = y[: n[j], j]
        return _sigmoid(out)

    def _logits(self, x: np.ndarray, n: np.ndarray, keep: tuple | None = None):
        f = self._run("f", x, keep and keep[0])
        xr = self._reversed(x, n)
        b = self._reversed(self._run("b", xr, keep and keep[1]), n)
        z = np.concatenate([f, b, x], 2)
        return z @ self.p["out"] + self.p["bias"], z, xr

    def train(self, docs: list[tuple[list[list[int]], np.ndarray, np.ndarray]], epochs: int = 4, rate: float = 0.01, batch: int = 32, seed: int = 3) -> None:
        """docs: (word ids of each block, shapes, labels)."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        h, step = HIDDEN_SIZE, 0
        docs = sorted((d for d in docs if len(d[2])), key=lambda d: len(d[2]))
        groups = [docs[i : i + batch] for i in range(0, len(docs), batch)]
        for epoch in range(epochs):
            for at in rng.permutation(len(groups)):
                group = groups[at]
                n = np.array([len(d[2]) for d in group])
                ids = np.array([i for d in group for b in d[0] for i in b])
                sizes = np.array([len(b) for d in group for b in d[0]])
                offsets = np.concatenate([[0], np.cumsum(sizes)])
                v = self.vectors(ids, offsets, np.concatenate([d[1] for d in group]))
                t, j = np.concatenate([np.arange(k) for k in n]), np.repeat(np.arange(len(n)), n)
                x, y, mask = np.zeros((n.max(), len(n), v.shape[1]), np.float32), np.zeros((n.max(), len(n)), np.float32), np.zeros((n.max(), len(n)), np.float32)
                x[t, j], y[t, j], mask[t, j] = v, np.concatenate([d[2] for d in group]), 1.0
                keep: tuple[list, list] = ([], [])
                logit, z, xr = self._logits(x, n, keep)
                dl = (_sigmoid(logit) - y) * mask / mask.sum()
                g = {k: np.zeros_like(p) for k, p in self.p.items()}
                g["out"], g["bias"] = np.tensordot(z, dl, ([0, 1], [0, 1])), np.array([dl.sum()], np.float32)
                dz = dl[:, :, None] * self.p["out"]
                dx = self._back("f", x, keep[0], dz[:, :, :h], g) + dz[:, :, 2 * h :]
                dx += self._reversed(self._back("b", xr, keep[1], self._reversed(dz[:, :, h : 2 * h], n), g), n)
                dv = dx[t, j][:, :WORD_SIZE] / np.sqrt(sizes)[:, None]
                np.add.at(g["words"], ids, np.repeat(dv, sizes, 0))
                step += 1
                for k, p in self.p.items():
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    s[k] = 0.999 * s[k] + 0.001 * g[k] ** 2
                    p -= rate * (0.5 if epoch == epochs - 1 else 1.0) * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)


def fit(articles: list[tuple[str | None, str]], site_names: list[str], epochs: int = 4) -> BlockLabeller:
    sites = sites_pattern(site_names)
    cut = [blocks(t, b) for t, b in articles]
    labels = weak_labels(cut, sites)
    model = BlockLabeller()
    model.train([([hashed(x) for x in texts], shapes(texts, numbers), y) for (texts, numbers), y in zip(cut, labels, strict=True)], epochs)
    return model


def label_blocks(df: DataFrame, key: str, title: str, body: str, site_names: list[str], sample: int = SAMPLE) -> DataFrame:
    """(key, line_no, furniture double): every block of every article with a body that is not blank.

    line_no 0 is the title; lines count from 1, blank ones counted but left out.  A null
    title is an empty block.  ``sample`` bounds the articles that train the labeller;
    every article is labelled, whole.  ``site_names`` is a list of fixed size (one a source).
    """
    solid = df.filter(F.col(body).rlike("[^\\s\\u00a0\\u3000]"))
    rows = bounded_sample(df, key, [title, body], f"`{body}` rlike '[^ ]'", sample, 17)
    model = fit([(r[0], r[1]) for r in rows], site_names)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for start in range(0, len(big), 500):
                batch = big.slice(start, 500)
                cut = [blocks(t, b) for t, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
                lengths = np.array([len(texts) for texts, _ in cut])
                ids = [hashed(x) for texts, _ in cut for x in texts]
                offsets = np.concatenate([[0], np.cumsum([len(i) for i in ids])])
                shape = np.concatenate([shapes(texts, numbers) for texts, numbers in cut])
                p = model.score(np.array([i for x in ids for i in x]), offsets, shape, lengths)
                at = np.repeat(np.arange(len(cut), dtype=np.int32), lengths)
                lines = pa.array([i for _, numbers in cut for i in numbers], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), lines, pa.array(p.astype(float), pa.float64())], ["key", "line_no", "furniture"])

    return spread(solid.select(key, title, body)).mapInArrow(run, f"`{key}` {kind}, line_no long, furniture double")
