"""One form for texts that look the same but differ in characters (problem 5).

1. ``plain`` undoes what no reader can see: widths, ligatures, decomposed accents,
   invisible characters, kinds of blanks.  Compatibility forms that do look different
   (superscripts, fractions, circled figures) stay.
2. Script-aware repair: each token that mixes Latin, Cyrillic, Greek or Armenian letters gets the script
   that dominates it, and the letters of the others that look like letters of that script are
   substituted, in whichever direction, but only if the repaired token is in the vocabulary of the corpus.  A token that is all of one script is left
   alone, but for tokens made of look-alikes only inside a text of another script
   (``candidates`` tells them apart): single letters and short words of a disguised text are such.
   The vocabulary is counted before it is joined with the few candidates.

Texts are then equal if and only if their forms are.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondhan.session import materialise, spread

# Letters of other scripts that look like Latin ones, and the Latin ones in the same order; after the bars Cyrillic, Greek and Armenian ones.
LOOKALIKES = {
    "cyrillic": ("АВЕЅІЈКМНОРСТУХԜԌѴҮаеорсухіјѕԁһӏԛԝѵү", "ABESIJKMHOPCTYXWGVYaeopcyxijsdhlqwvy"),
    "greek": ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονϲραγυ", "ABEZHIKMNOPTYXovcpayu"),
    "armenian": ("ՕՍՏօսհզց", "OUSouhqg"),
}
LOOKALIKE = {ord(a): b for other, latin in LOOKALIKES.values() for a, b in zip(other, latin, strict=True)}
#: The same the other way round, for tokens of which most letters are Cyrillic or Greek; of letters that look alike the first stands.
BACK = {name: {ord(b): a for a, b in reversed(list(zip(other, latin, strict=True)))} for name, (other, latin) in LOOKALIKES.items()}

#: Latin letters that some letter of another script looks like.
_TWINNED = frozenset(map(ord, LOOKALIKE.values()))

# Characters without a look of their own.
INVISIBLE = [0xAD, 0x34F, 0x61C, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180E, 0x200B, 0x200C, 0x200D, 0x200E, 0x200F, *range(0x202A, 0x202F), *range(0x2060, 0x2070), 0xFEFF, *range(0xFE00, 0xFE10)]
_HIDDEN = re.compile("[" + "".join(map(chr, INVISIBLE)) + "]+")
#: Runs of blanks other than a single space.
BLANKS = re.compile(r"[^\S\n ][^\S\n]*| [^\S\n]+")
_ODD = re.compile("[^\x00-\x7fऀ-৿‐-‧‰-›]")
# letters that a joiner shapes visibly (ya-phala after ra) keep it
_SHAPED = re.compile("র‍(?=্)")
_KEEP = ""
#: Characters above the Latin ones that are neither Indic nor plain punctuation: those that may have another form.
_FORMED = re.compile("[^\x00-\u024fऀ-৿‐-‧‰-›]")
_WIDE = ("<wide>", "<narrow>", "<noBreak>")
_OTHER = re.compile("[\u0370-\u058f]")
_TOKEN = re.compile(r"[^\W\d_][^\W\d_̀-ͯ'’]*", re.UNICODE)


@lru_cache(maxsize=100_000)
def _form(ch: str) -> str:
    kind = unicodedata.decomposition(ch).partition(" ")[0]
    if kind in _WIDE or 0xFB00 <= ord(ch) <= 0xFB06:
        return unicodedata.normalize("NFKC", ch)
    return ch


def plain(text: str) -> str:
    """The text without differences that cannot be seen; blanks become single spaces, line feeds stay."""
    if _ODD.search(text):
        text = _HIDDEN.sub("", _SHAPED.sub("র" + _KEEP, text))
        text = _FORMED.sub(lambda m: _form(m[0]), text)
        text = unicodedata.normalize("NFC", text).replace(_KEEP, "‍")
    elif not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    text = BLANKS.sub(" ", text)
    if " \n" in text or "\n " in text:
        text = text.replace(" \n", "\n").replace("\n ", "\n")
    return text.strip("\n ")


def latinised(text: str) -> str:
    """The text with all look-alikes in Latin letters, for comparisons that do not ask for the script."""
    return text.translate(LOOKALIKE) if _OTHER.search(text) else text


def _latin(ch: str) -> bool:
    return ch.isascii() or 0xC0 <= ord(ch) <= 0x24F


def script_of(ch: str) -> str:
    """latin, cyrillic, greek, armenian or '' for a letter of another script or no letter."""
    c = ord(ch)
    if not ch.isalpha():
        return ""
    return "latin" if _latin(ch) else "greek" if 0x370 <= c <= 0x3FF else "cyrillic" if 0x400 <= c <= 0x52F else "armenian" if 0x530 <= c <= 0x58F else ""


def _into(token: str, script: str) -> str | None:
    """The token with the look-alikes of other scripts replaced by letters of ``script``; None if some letter has none."""
    latin = token.translate(LOOKALIKE)
    fixed = latin if script == "latin" else "".join(c if script_of(c) == script else BACK[script].get(ord(x), c) for c, x in zip(token, latin, strict=True))
    return fixed if all(script_of(c) in (script, "") for c in fixed) else None


def candidates(text: str) -> dict[str, list[str]]:
    """Tokens that mix scripts and what they would be in their dominant script.

    The dominant script of a token is the one that most of its letters without a look-alike are of: those say for sure
    which script was meant.  Where there are none, or as many of each, all its scripts are tried, and
    the token that is most frequent in the vocabulary stands.
    A token without any Latin letter is tried as Latin only if it is made of Latin look-alikes wholly and the letters of the
    text around it are Latin or look-alikes of Latin ones almost without exception: what a reader
    takes for a Latin text then mixes the scripts.
    """
    if not _OTHER.search(text):
        return {}
    disguised = None
    found: dict[str, list[str]] = {}
    for token in set(_TOKEN.findall(text)):
        if not _OTHER.search(token):
            continue
        # what a letter says only if no other script has one that looks like it
        scripts = Counter(s for s in map(script_of, token) if s)
        sure = Counter(script_of(c) for c in token if c.isalpha() and ord(c) not in LOOKALIKE and ord(c) not in _TWINNED)
        tried = [s for s in scripts if sure[s] == max(sure[x] for x in scripts)] if len(scripts) > 1 else []
        if not scripts["latin"] and not sure:
            if disguised is None:
                letters = [c for c in text if c.isalpha()]
                disguised = sum(map(_latin, letters)) > len(letters) / 2 or sum(_latin(c) or ord(c) in LOOKALIKE for c in letters) > 0.9 * len(letters)
            tried += ["latin"] * disguised
        fixed = [f for s in sorted(tried, key=lambda s: (s != "latin", -scripts[s], s)) if (f := _into(token, s))]
        if fixed:
            found[token] = fixed
    return found


def repair(text: str, known: dict[str, str]) -> str:
    return _TOKEN.sub(lambda m: known.get(m[0], m[0]), text) if known else text


#: Words of Latin letters, or of letters that a repair into another script can give.
_SPOKEN = "[A-Za-z\\u00c0-\\u024f]+|[\\u0370-\\u03ff]+|[\\u0400-\\u052f]+|[\\u0531-\\u0587]+"


def _hash(*texts: str) -> bytes:
    return xxhash.xxh3_128_digest("\x00".join(texts).encode("utf-8", "surrogatepass"))


def look_forms(df: DataFrame, key: str, texts: list[str]) -> DataFrame:
    """(key, raw binary, look binary): hashes of the texts of a row as they are and in their one form.

    Rows with a null or blank text are left out.  Texts are read whole.
    """
    kind = df.schema[key].dataType.simpleString()
    n = len(texts)
    schema = f"k {kind}, raw binary, look binary, texts array<string>, tokens array<struct<token string, fixed string, turn int>>"

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, raw, look, kept, tokens = [], [], [], [], []
            for i, row in enumerate(zip(*[batch.column(j + 1).to_pylist() for j in range(n)], strict=True)):
                forms = [plain(t) for t in row]
                if not all(f.strip() for f in forms):
                    continue
                mixed: dict[str, list[str]] = {}
                for f in forms:
                    mixed |= candidates(f)
                keep.append(i)
                raw.append(_hash(*row))
                look.append(_hash(*forms))
                kept.append(forms if mixed else None)
                tokens.append([{"token": a, "fixed": b, "turn": turn} for a, way in mixed.items() for turn, b in enumerate(way)] or None)
            arrays = [
                batch.column(0).take(pa.array(keep, pa.int32())), pa.array(raw, pa.binary()), pa.array(look, pa.binary()), pa.array(kept, pa.list_(pa.string())),
                pa.array(tokens, pa.list_(pa.struct([("token", pa.string()), ("fixed", pa.string()), ("turn", pa.int32())]))),
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["k", "raw", "look", "texts", "tokens"])

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            look = []
            for forms, known in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                fixed = {x["token"]: x["fixed"] for x in sorted(known or [], key=lambda x: (x["n"], -x["turn"]))}  # the most frequent stands
                look.append(_hash(*[repair(f, fixed) for f in forms]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(look, pa.binary())], ["k", "raw", "look"])

    solid = df.filter(" and ".join(f"`{t}` is not null" for t in texts)).select(key, *texts)
    rows = materialise(spread(solid).mapInArrow(first, schema))
    asked = rows.filter("tokens is not null").select("k", F.explode("tokens").alias("t")).select("k", "t.token", "t.fixed", "t.turn")
    wanted = asked.select("fixed").distinct()
    # the vocabulary: words of a single script, counted in each task before they are shuffled, so a common word is one row a task
    spoken = solid.select(F.explode(F.array(*[F.col(t) for t in texts])).alias("text"))
    spoken = spoken.select(F.explode(F.regexp_extract_all("text", F.lit(_SPOKEN), F.lit(0))).alias("fixed"))
    known = wanted.join(spoken.groupBy("fixed").agg(F.count(F.lit(1)).alias("n")), "fixed")
    fixes = asked.join(known, "fixed").groupBy("k").agg(F.collect_list(F.struct("token", "fixed", "turn", "n")).alias("known"))
    mixed = rows.filter("tokens is not null").join(fixes, "k", "left").select("k", "raw", "texts", "known")
    repaired = mixed.mapInArrow(second, f"k {kind}, raw binary, look binary")
    return rows.filter("tokens is null").select("k", "raw", "look").unionByName(repaired).withColumnRenamed("k", key)


def same_look_pairs(df: DataFrame, key: str, texts: list[str]) -> DataFrame:
    """(a, b), a < b: rows of one look whose characters differ.

    Exact copies are no pair.  Classes of exact copies meet, once each two, and their members are then
    written out: n copies beside one variant take n rows and no comparison of the copies with each other.
    """
    rows = materialise(look_forms(df, key, texts))
    classes = rows.select("look", "raw").distinct()
    several = classes.groupBy("look").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("look")
    classes = classes.join(several, "look", "left_semi")
    met = classes.select("look", F.col("raw").alias("ra")).join(classes.select("look", F.col("raw").alias("rb")), "look").filter("ra < rb")
    left, right = rows.select("look", F.col("raw").alias("ra"), F.col(key).alias("x")), rows.select("look", F.col("raw").alias("rb"), F.col(key).alias("y"))
    pairs = met.join(left, ["look", "ra"]).join(right, ["look", "rb"]).filter("x <> y")
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
