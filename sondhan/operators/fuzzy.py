"""Approximate word matching: the vocabulary join and the fuzzy ranker."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from sondhan.functions.text import jaccard, trigrams
from sondhan.operators.blocks import block_join
from sondhan.session import materialise


def lcs_ratio(a: str, b: str) -> float:
    """200 * LCS / (la + lb) by one bit-parallel pass."""
    if not a or not b:
        return 0.0
    if a == b:
        return 100.0
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | (1 << i)
    full, s = (1 << len(a)) - 1, (1 << len(a)) - 1
    for c in b:
        u = s & where.get(c, 0)
        s = ((s + u) | (s - u)) & full
    return 200.0 * (len(a) - s.bit_count()) / (len(a) + len(b))


def _codes(texts: list[str], width: int) -> np.ndarray:
    """Code points, one row a text, filled up with zeros to ``width``."""
    return np.array(texts, dtype=f"<U{width}").view(np.uint32).reshape(len(texts), width)


def paired_ratios(a: list[str], b: list[str]) -> np.ndarray:
    """``lcs_ratio`` of many pairs at once; texts of over 64 letters one by one."""
    out = np.zeros(len(a))
    sizes = np.array([[len(x), len(y)] for x, y in zip(a, b, strict=True)]).reshape(-1, 2)
    fits = (sizes.max(1) <= 64) & (sizes.min(1) > 0) & np.array(["\0" not in x and "\0" not in y for x, y in zip(a, b, strict=True)], bool)
    for i in np.flatnonzero(~fits):
        out[i] = lcs_ratio(a[i], b[i])
    rows = np.flatnonzero(fits)
    rows = rows[np.argsort(sizes[rows].max(1), kind="stable")]
    for start in range(0, len(rows), 4096):
        at = rows[start : start + 4096]
        width = -(-int(sizes[at, 0].max()) // 8) * 8
        x, y = _codes([a[i] for i in at], width), _codes([b[i] for i in at], int(sizes[at, 1].max()))
        full = np.where(sizes[at, 0] == 64, np.uint64(2**64 - 1), (np.uint64(1) << (sizes[at, 0] % 64).astype(np.uint64)) - np.uint64(1))
        s, bits = full.copy(), np.zeros((len(at), 8), np.uint8)
        for j in range(y.shape[1]):
            bits[:, : width // 8] = np.packbits(x == y[:, j, None], axis=1, bitorder="little")
            u = s & bits.view("<u8")[:, 0]
            s = np.where(y[:, j] == 0, s, ((s + u) | (s - u)) & full)
        out[at] = 200.0 * (sizes[at, 0] - np.bitwise_count(s)) / sizes[at].sum(1)
    return out


@F.pandas_udf(DoubleType())
def lcs_ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(paired_ratios(a.tolist(), b.tolist()), dtype="float64")


def token_set_ratio(a: str, b: str) -> float:
    """Rounded best ratio of the common words and either side's rest."""
    x, y = set(a.lower().split()), set(b.lower().split())
    if not x or not y:
        return 0.0
    both, left, right = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    p, q = f"{both} {left}".strip(), f"{both} {right}".strip()
    return float(max(round(lcs_ratio(both, p)), round(lcs_ratio(both, q)), round(lcs_ratio(p, q))))


@F.pandas_udf(DoubleType())
def token_set_ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([token_set_ratio(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="float64")


def lcs_ratios(term: str, letters: np.ndarray, codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``lcs_ratio`` of a term of up to 63 letters with many words at once.

    ``codes``: one row a word, numbers into ``letters``, filled up with the number of a letter no term has; ``sizes``: their lengths.
    """
    where = {c: sum(1 << i for i, x in enumerate(term) if x == c) for c in set(term)}
    table = np.array([where.get(chr(c), 0) if c else 0 for c in letters], np.uint64)
    full = np.uint64((1 << len(term)) - 1)
    s = np.full(len(codes), full, np.uint64)
    for j in range(codes.shape[1]):
        u = s & table[codes[:, j]]
        s = ((s + u) | (s - u)) & full
    return 200.0 * (len(term) - np.bitwise_count(s)) / (len(term) + sizes)


def _ratio_block(low: float, threshold: float):
    def run(terms: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[list, np.ndarray, np.ndarray]] = []
        words = words.assign(n=words["word"].str.len()).sort_values("n", kind="stable") if len(words) else words
        if len(words) and len(terms):
            names, sizes = words["word"].to_numpy(), words["n"].to_numpy()
            short = sizes < 200  # longer words are few and measured one by one
            letters, codes = np.unique(np.array(names[short].tolist() or [""], dtype="U").view(np.uint32).reshape(max(1, short.sum()), -1), return_inverse=True)
            codes = codes.reshape(max(1, short.sum()), -1)
            for term in terms["term"]:
                a, b = np.searchsorted(sizes, [low * len(term) - 1e-9, len(term) / low + 1e-9])
                c = min(b, int(short.sum())) if len(term) < 64 and "\0" not in term else a
                ratio = np.zeros(b - a)
                if c > a:
                    ratio[: c - a] = lcs_ratios(term, letters, codes[a:c, : int(sizes[c - 1])], sizes[a:c])
                for i in range(max(a, c), b):
                    ratio[i - a] = lcs_ratio(term, names[i])
                ratio = np.round(ratio)
                at = np.flatnonzero(ratio >= threshold)
                found.append(([term] * len(at), names[a:b][at], ratio[at]))
        flat = [x for f in found for x in f[0]]
        kept = [f for f in found if len(f[0])]
        columns = [np.concatenate([f[i] for f in kept]).tolist() if kept else [] for i in (1, 2)]
        return pd.DataFrame({"term": pd.Series(flat, dtype=object), "word": pd.Series(columns[0], dtype=object), "sim": pd.Series(columns[1], dtype="float64")})

    return run


def vocabulary_match(terms: DataFrame, vocab: DataFrame, threshold: float = 70.0, ratio: bool = True) -> DataFrame:
    """(term, word, sim): words of the vocabulary as similar to a term as ``threshold`` or more.

    Similarity is the greater of trigram Jaccard (times 100) and, with ``ratio``, the
    rounded LCS ratio.  Jaccard pairs meet on a shared trigram; for the ratio the terms, which are a stated set, meet the vocabulary in
    blocks and are measured within the band of lengths the threshold allows, all words of a block at once.  No pair is lost.
    """
    t = terms.select(F.lower("term").alias("term")).distinct().filter("term <> ''").withColumn("tg", F.array_distinct(trigrams(F.col("term"))))
    v = vocab.select(F.lower("word").alias("word")).distinct().filter("word <> ''")
    v = materialise(v) if ratio else v  # read for the trigrams, the count and the blocks
    v = v.withColumn("wg", F.array_distinct(trigrams(F.col("word"))))
    met = t.select("term", "tg", F.explode("tg").alias("g")).join(v.select("word", "wg", F.explode("wg").alias("g")), "g")
    # of the trigrams a pair shares it is measured at the first only
    met = met.filter(F.get(F.array_intersect("tg", "wg"), F.lit(0)) == F.col("g"))
    close = met.select("term", "word", (100 * jaccard(F.col("tg"), F.col("wg"))).alias("sim")).filter(F.col("sim") >= threshold)
    if not ratio:
        return close
    low = (threshold - 0.5) / (200 - (threshold - 0.5))
    banded = block_join(t.select("term"), v.select("word"), "term", "word", _ratio_block(low, threshold), "term string, word string, sim double")
    return close.unionByName(banded).groupBy("term", "word").agg(F.max("sim").alias("sim"))


def fuzzy_scores(asked: DataFrame, matches: DataFrame, postings: DataFrame) -> DataFrame:
    """(query_id, doc_id, score): sum over query terms and matching words of sim / 100 for the documents that hold the word."""
    hits = asked.join(matches, "term").select("query_id", "qtf", "sim", F.col("word").alias("w"))
    words = postings.select("doc_id", F.col("term").alias("w"))
    return hits.join(words, "w").groupBy("query_id", "doc_id").agg(F.sum(F.col("qtf") * F.col("sim") / 100).alias("score"))
