"""Spelling-neutral forms of names in Latin and Bangla letters (used by problem 7)."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from sondhan.llm.lookalike import latinised

# Bangla letters in Latin ones (consonants carry no vowel of their own here).
CONSONANTS = dict(zip(
    "ক খ গ ঘ ঙ চ ছ জ ঝ ঞ ট ঠ ড ঢ ণ ত থ দ ধ ন প ফ ব ভ ম য র ল শ ষ স হ ৎ ং ঃ ঁ".split(),
    "k kh g gh ng ch chh j jh n t th d dh n t th d dh n p ph b bh m j r l sh sh s h t ng h n".split(), strict=True,
)) | {"ড়": "r", "ঢ়": "rh", "য়": "y"}
VOWELS = dict(zip("অ আ ই ঈ উ ঊ ঋ এ ঐ ও ঔ".split(), "o a i i u u ri e oi o ou".split(), strict=True))
SIGNS = dict(zip("া ি ী ু ূ ৃ ে ৈ ো ৌ".split(), "a i i u u ri e oi o ou".split(), strict=True)) | {"্": "", "়": ""}

# A choice of this library: forms of address and small words that are no part of a name.
TITLES = (
    "dr doctor md mohd mohammad mr mrs ms miss prof professor engr engineer adv advocate justice sir begum alhaj sheikh the of and late hon "
    "ডা ডাঃ মো মোঃ মোহাম্মদ বেগম অধ্যাপক প্রকৌশলী অ্যাডভোকেট বিচারপতি জনাব দি ও এবং শেখ আলহাজ"
)

# A choice of this library: kinds of bodies and places with their abbreviations and Bangla words.
KINDS = {
    "limited": "ltd ltd. লিমিটেড লি", "council": "cncl coun coun. পরিষদ", "bank": "bk bnk ব্যাংক", "university": "univ uni বিশ্ববিদ্যালয়", "hospital": "hosp hsptl হাসপাতাল",
    "association": "assn assoc সমিতি", "foundation": "fdn fndn ফাউন্ডেশন", "institute": "inst instt ইনস্টিটিউট", "bazar": "bazaar bzr baz বাজার", "union": "un up ইউনিয়ন",
    "upazila": "upazilla upz উপজেলা", "municipality": "mun municip muni পৌরসভা",
}

_TITLE = frozenset(unicodedata.normalize("NFC", t) for t in TITLES.split())
_KIND = {unicodedata.normalize("NFC", w): k for k, words in KINDS.items() for w in (k, *words.split())}
_BRACKETS = re.compile(r"\([^)]*\)|\[[^]]*\]")
_OWNER = re.compile(r"['’]s\b")
_SPLIT = re.compile(r"[\s.,;:&/\"'’‘“”()\-–—_]+")
_LATIN_PAIRS = [("ck", "k"), ("ph", "f"), ("bh", "v"), ("chh", "ch"), ("q", "k"), ("x", "ks"), ("w", "v"), ("z", "j"), ("ee", "i"), ("oo", "u"), ("y", "i"), ("c", "k")]


def latin(word: str) -> str:
    """A Bangla word in Latin letters; a consonant without sign or virama in mid-word has no vowel."""
    out = []
    for ch in word.replace("ড়", "ড়").replace("ঢ়", "ঢ়").replace("য়", "য়"):
        out.append(CONSONANTS.get(ch) or VOWELS.get(ch) or SIGNS.get(ch, ch if ch.isascii() else ""))
    return "".join(out)


def sound(word: str) -> str:
    """Latin letters reduced to what survives usual spelling differences."""
    w = "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c))
    w = w.replace("ch", "\x01")
    for a, b in _LATIN_PAIRS:
        w = w.replace(a, b)
    w = w.replace("\x01", "ch")
    return re.sub(r"(.)\1+", r"\1", w)


@lru_cache(maxsize=100_000)
def _near_kind(word: str) -> str:
    """The kind whose word this is with a typo or two, or ''."""
    for full, kind in _KIND.items():
        if len(full) >= 5 and edits(word, full, 2 if len(full) >= 7 else 1) <= (2 if len(full) >= 7 else 1):
            return kind
    return ""


@lru_cache(maxsize=200_000)
def _spoken(word: str) -> str:
    return sound(latin(word)) if any("ঀ" <= c <= "৿" for c in word) else sound(word)


def parts(name: str) -> tuple[str, tuple[str, ...]] | None:
    """(kind, name tokens): kind is the word for the sort of body or place, '' for a person.

    None for a name without a letter.  Titles, brackets, possessives and the order of parts are dropped
    (tokens stay in the written order of the form "given family"; "family, given" is turned round).
    """
    s = unicodedata.normalize("NFC", latinised(unicodedata.normalize("NFKC", name))).lower()
    s = _OWNER.sub("", _BRACKETS.sub(" ", s)).strip()
    if s.count(",") == 1:
        a, b = s.split(",")
        s = f"{b} {a}"
    kind, tokens = "", []
    for w in _SPLIT.split(unicodedata.normalize("NFC", s)):
        if not w or w in _TITLE or not any(c.isalpha() for c in w):
            continue
        if w in _KIND or (not kind and len(w) >= 5 and _near_kind(w)):
            kind = _KIND.get(w) or _near_kind(w)
            continue
        tokens.append(_spoken(w))
    tokens = [t for t in tokens if t]
    return (kind, tuple(tokens)) if tokens or kind else None


def edits(a: str, b: str, most: int) -> int:
    """Edit distance with neighbour swaps, cut off above ``most``."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row, older = row, [i], before
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if older and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, older[j - 2] + 1)
            row.append(d)
        before = last
        if min(row) > most:
            return most + 1
    return row[-1]


@lru_cache(maxsize=300_000)
def token_match(s: str, t: str) -> float:
    """1 equal, 0.9 / 0.8 a typo or two, 0.6 a short form, 0.5 an initial, 0 otherwise."""
    if s == t:
        return 1.0
    if len(s) > len(t):
        s, t = t, s
    if len(s) == 1 or s in ("th", "dh", "kh", "gh", "ch", "sh", "ph", "jh"):
        return 0.5 if t.startswith(s) else 0.0
    if len(s) >= 4:
        d = edits(s, t, 2 if len(s) >= 7 else 1)
        if d <= 1:
            return 0.9
        if d == 2 and len(s) >= 7:
            return 0.8
    if 4 <= len(s) <= 6 and s[-1] in "aeiou" and t.startswith(s[:-1]):
        return 0.6
    return 0.0


def align(a: tuple[str, ...], b: tuple[str, ...]) -> tuple[float, int, int]:
    """(score 0..1, full matches, weak matches) of two names; 0 if both have a part the other contradicts."""
    if len(a) > len(b):
        a, b = b, a
    left, total, full, weak, unmatched = list(b), 0.0, 0, 0, 0
    for s in sorted(a, key=len, reverse=True):
        best, at = 0.0, -1
        for i, t in enumerate(left):
            v = token_match(s, t)
            if v > best:
                best, at = v, i
        if at < 0 and len(s) >= 8 and len(left) >= 2:  # two parts written as one
            for i, t in enumerate(left):
                for j, u in enumerate(left):
                    if i != j and edits(s, t + u, 1) <= 1:
                        best, at = 0.9, i
                        partner = u
                        break
                if at >= 0:
                    left.pop(at)
                    left.remove(partner)
                    total, full = total + 1.8, full + 2
                    break
            if best:
                continue
        if at < 0:
            unmatched += 1
            continue
        left.pop(at)
        total += best
        full, weak = full + (best >= 0.8), weak + (best < 0.8)
    if unmatched and left:
        return 0.0, full, weak
    return total / max(len(a), len(b)), full, weak


def same_name(kind_a: str, a: tuple[str, ...], kind_b: str, b: tuple[str, ...]) -> float:
    """How far two names agree, 0 if they cannot be spellings of one name."""
    if kind_a and kind_b and kind_a != kind_b:
        return 0.0
    score, full, weak = align(a, b)
    if full >= 2 or (full == 1 and weak >= 1 and len(a) == len(b)):
        return score
    return score if full == 1 and len(a) == len(b) == 1 and min(len(a[0]), len(b[0])) >= 8 else 0.0
