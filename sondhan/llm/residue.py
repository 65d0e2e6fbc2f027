"""Template residue, filler and error pages (problem 10).

1. A text is cut into units (lines, cells, sentences).  Each unit is normalised and its
   numbers, addresses, dates, request ids and the names inside placeholders are masked, so that copies of
   one message have one hash whatever they carry.
2. The exact hashes are grouped over documents and sources.  A group that recurs in several
   documents of several sources is a message if its text matches the placeholder, filler or phrase rules
   (``judge``), or if most of the documents that hold it are otherwise made of residue:
   this learns the messages no phrase rule knows.
3. A document is residue if it has messages and what is left of it is no longer than a headline and
   a first sentence (``path`` ``recurring``).
4. Units that match the rules but do not recur are a fallback of their own: documents that are residue only
   with their help have the ``path`` ``rules``.

Words in quotation marks are mentions and never residue; a placeholder inside a full sentence of prose is a mention too.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
import xxhash

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondhan.operators.timestamps import MONTHS
from sondhan.session import materialise, spread

# Notations of template engines, as regular expressions over lower-case text; of any length up to their closing sign.
PLACEHOLDERS = [
    r"\{\{\{?[^{}]*\}?\}\}", r"\$\{[^{}]*\}", r"#\{[^{}]*\}", r"<%=?[^%]*%>", r"\{%[^%]*%\}", r"\{[^\W\d][^{}\s]*\}",
    r"%[^\W\d][^%\s]{2,}%", r"__[^\W\d][^\s]*?__", r"\$[^\W\d][^$\s]{2,}\$", r"\*\|[^|]+\|\*", r"<<[^<>]+>>", r"\[\[[^\[\]]+\]\]",
    r"\[(?:insert )?[^\W\d][^\[\]\s]{2,}\]", r"@model\.\w+", r"<!--[^>]*-->", r"(?<!\w)(?:undefined|null|nan)(?!\w)",
]

# Words of the usual Latin filler.
FILLER = (
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis "
    "nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat "
    "nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum"
)

# Phrase rules, a choice of this library: parts of messages that stand in place of a story, lower case, figures masked as #, alternatives as (a|b).
PHRASES = [
    # demands for scripts
    "javascript (is disabled|is required|deaktiviert|einschalten|aktivieren|para ver|pour lire)", "(enable|activate|turn on|allow|activer|activez|active|activar|requires|needs) (javascript|scripts)",
    "switch it on and reload", "noscript", "browser does not support", "please upgrade", "if nothing appears", "(জাভাস্ক্রিপ্ট|স্ক্রিপ্ট) (চালু|সক্রিয়|বন্ধ)",
    "(जावास्क्रिप्ट|स्क्रिप्ट) (चालू|सक्रिय|बंद)", "লোড হচ্ছে", "loading...", "rendered on the client",
    # errors of servers and addresses
    "# (not found|forbidden|bad gateway|service unavailable|internal server|গেটওয়ে)", "page not found", "page you requested", "page introuvable", "page demandée",
    "página (no encontrada|que busca)", "seite nicht gefunden", "angeforderte seite", "could not be located", "this page (isn't|isn’t|is not) available", "may have been (removed|mistyped)",
    "access denied", "zugriff verweigert", "accès refusé", "acceso denegado", "permission to (view|access)", "(server|origin) (was unable|did not)", "serveur n'a pas", "servidor no pudo",
    "server antwortet nicht", "internal server error", "bad gateway", "service unavailable", "gateway time", "too many requests", "under maintenance", "systems are busy", "unusual activity",
    "verify that you are a human", "check to continue", "contact the webmaster", "something went wrong", "session (expired|has expired)", "traceback (most recent", "keyerror", "failed to open stream",
    "apache server at", "at render (", "request id h", "পাতাটি খুঁজে", "আপনি যে পাতা", "পাতা দেখার অনুমতি", "সার্ভারে সমস্যা", "সার্ভার আপনার অনুরোধ", "গেটওয়ে ত্রুটি", "প্রবেশাধিকার নেই",
    "অনেক বেশি অনুরোধ", "মানুষ কি না", "কিছু একটা ভুল", "সেশনের মেয়াদ", "রক্ষণাবেক্ষণের কাজ", "আবার চেষ্টা করুন", "লিংকটি ভুল", "ঠিকানাটি আবার", "কর্তৃপক্ষের সঙ্গে যোগাযোগ করুন",
    "প্রচ্ছদে ফিরে যান", "पृष्ठ खोज रहे", "पृष्ठ नहीं मिला", "सर्वर में त्रुटि", "फिर कोशिश करें", "मुखपृष्ठ पर लौटें", "try again later", "réessayez plus tard", "inténtelo más tarde",
    "später erneut", "zurück zur startseite", "return to the home", "vuelva al inicio", "revenez à l'accueil", "refresh the page", "check the spelling of the address", "use the search box",
    "quote the reference", "(ray|incident) h",
    # filler
    "(sample|placeholder|dummy|filler) (text|copy|paragraph)", "your (text|story text) here", "insert body copy", "type the summary", "content coming soon", "todo write", "asdf asdf",
    "test test test", "blindtext", "platzhalter", "hier steht ihr text", "votre texte ici", "texte d'exemple", "escriba aquí su texto", "texto de prueba", "নমুনা লেখা", "অনুচ্ছেদ শুধু নকশার",
    "এখানে লেখা বসবে", "শিরোনাম এখানে", "বিস্তারিত আসছে", "পরীক্ষামূলক লেখা", "यहाँ पाठ लिखें", "नमूना पाठ", "titre ici", "título aquí",
]

_HIDDEN = re.compile("[\u00ad\u200b\u200c\u200e\u200f\u2060\ufeff]")
_TAGS = re.compile(r"</?[a-z][a-z0-9]*(?:\s[^<>]*)?/?>")
_ADDRESS = re.compile(r"https?://\S+|www\.\S+|[\w.+-]+@[\w-]+\.[\w.]+")
_DIGIT = re.compile(r"\d")
_NUMBER = re.compile(r"(\b(?=[0-9a-f]*\d)[0-9a-f]{8,}\b)|\d[\d.,:/-]*\d|\d")
_ENDS = re.compile(r"[\n\r]+|(?<![*|])\|+(?!\*)|(?<=[.।!?])\s+")
_QUOTED = re.compile("\"[^\"]*\"|“[^”]*”|«[^»]*»|»[^«]*«|‘[^’]*’|„[^“]*“")
_HOLDER = re.compile("|".join(PLACEHOLDERS))
#: What a placeholder cannot do without.
SIGNS = ["{", "%", "[", "$", "__", "*|", "@model", "<<", "<!--", "undefined", "null", " nan", "nan "]
ERRORS = ["error", "erreur", "fehler", "ত্রুটি", "त्रुटि"]
_ERROR = re.compile(rf"(?<!\w)(?:{'|'.join(ERRORS)}) #(?! because)")
_STOPS = re.compile(r"[.।!?]")
_WORD = re.compile(r"[\w#]")
_FILLER = frozenset(FILLER.split())
_MONTHS = frozenset(m for names in MONTHS.values() for m in names.split())
_DATE = re.compile(r"#(?:st|nd|rd|th)?,?(?: (?:de )?#(?:st|nd|rd|th)?,?)+")


def _expand(pattern: str) -> list[str]:
    parts = [p.split("|") for p in re.split(r"\(([^()]*\|[^()]*)\)", pattern)]
    return ["".join(x) for x in itertools.product(*parts)]


@cache
def _machine() -> ahocorasick.Automaton:
    machine = ahocorasick.Automaton()
    for word in _FILLER:
        if len(word) >= 5:
            machine.add_word(word, 0)  # the unit is looked at closely; no phrase of its own
    for word in [*SIGNS, *(f"{word} #" for word in ERRORS)]:
        machine.add_word(word, 0)
    for phrase in itertools.chain.from_iterable(map(_expand, PHRASES)):
        machine.add_word(phrase, len(phrase))
    machine.make_automaton()
    return machine


def _mask(m: re.Match) -> str:
    return "h" if m[1] else "#"


def units_of(text: str) -> list[str]:
    """Normalised, masked units: tags dropped, spaces single, lower case, figures #, addresses @, request ids h."""
    s = text.lower()
    if not s.isascii():
        s = _HIDDEN.sub("", s)
    if "<" in s:
        s = _TAGS.sub(" ", s)
    if "@" in s or "www." in s or "://" in s:
        s = _ADDRESS.sub("@", s)
    out = []
    for part in _ENDS.split(s):
        if _DIGIT.search(part):
            part = _NUMBER.sub(_mask, part)
        u = " ".join(part.split())
        if _WORD.search(u) or "{" in u:
            out.append(u)
    return out


def suspect(unit: str) -> bool:
    """Whether a unit has anything a rule could match: one pass for all phrases and signs."""
    return unit == "nan" or next(_machine().iter(unit), None) is not None


def shape_of(unit: str, signs: bool = True) -> str:
    """The text a unit is grouped by: dates masked, placeholders (if it may have any) without the names they hold."""
    if "#" in unit:
        words = unit.split(" ")
        if not _MONTHS.isdisjoint(w.rstrip(".,") for w in words):
            figure = lambda i: 0 <= i < len(words) and words[i].startswith("#")
            near = [w.rstrip(".,") in _MONTHS and (figure(i - 1) or figure(i + 1) or (figure(i + 2) and figure(i - 2))) for i, w in enumerate(words)]
            unit = _DATE.sub("#", " ".join("#" if n else w for n, w in zip(near, words, strict=True)))
    return _HOLDER.sub("{}", unit) if signs else unit


def judge(unit: str) -> tuple[int, int, int]:
    """(words, words left outside residue, residue spans) of a normalised unit, by the placeholder, filler and phrase rules."""
    words = unit.count(" ") + 1
    if not suspect(unit):
        return words, words, 0
    tokens = unit.split()
    filler = len(_FILLER.intersection(t.strip(".,") for t in tokens)) >= min(4, words)
    open_text = _QUOTED.sub(" q ", unit)
    holders = len(_HOLDER.findall(open_text))
    bare = _HOLDER.sub(" ", open_text)
    hits = [(end - n + 1) for end, n in _machine().iter(bare) if n] + [m.start() for m in _ERROR.finditer(bare)]
    hits = [i for i in hits if i == 0 or not bare[i].isalnum() or not bare[i - 1].isalnum()]
    if holders and holders <= 2 and not hits and len(bare.split()) >= 8 and unit[-1] in ".।!?":
        return words, words, 0  # a sentence about a placeholder
    spans = holders
    if filler and not hits:
        run = [t.strip(".,") in _FILLER for t in bare.split()]
        if sum(run) >= 0.7 * len(run) or "lorem ipsum dolor" in bare:
            return words, len(run) - sum(run), spans + 1
    if hits:
        spans += len(hits)
        first = min(hits)
        stop = _STOPS.search(bare, first)
        bare = bare[:first] + (bare[stop.end() :] if stop else "")
    left = len(bare.split())
    if holders:
        left = max(0, left - 2 * holders)  # labels before a placeholder belong to it
    return words, left, spans


def _unit_rows(df: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """One row a distinct unit of a document (``times``: how often it holds it) and one a document (null hash), with the document's sums."""
    kind = df.schema[key].dataType.simpleString()
    names = ["hash", "times", "words", "left", "spans", "all_words", "all_left", "all_spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, value in enumerate(batch.column(1).to_pylist()):
                # units of one shape are one unit
                shapes: dict[str, list[int]] = {}
                whole = [0, 0, 0]
                for u, n in Counter(units_of(value)).items():
                    odd = suspect(u)
                    words, left, spans = judge(u) if odd else (u.count(" ") + 1,) * 2 + (0,)
                    row = shapes.setdefault(shape_of(u, odd), [0, 0, 0, 0])
                    for c, x in enumerate((1, words, left, spans)):
                        row[c] += n * x
                        if c:
                            whole[c - 1] += n * x
                at += [i] * (len(shapes) + 1)
                rows += [(xxhash.xxh3_64_intdigest(u) - 2**63, *row, *whole) for u, row in shapes.items()]
                rows.append((None, 1, *whole, *whole))
            index = pa.array(at, pa.int32())
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 8
            arrays = [batch.column(0).take(index), batch.column(2).take(index), *[pa.array(c, pa.int64() if n == "hash" else pa.int32()) for c, n in zip(columns, names, strict=True)]]
            yield pa.RecordBatch.from_arrays(arrays, ["k", "src", *names])

    solid = df.filter(F.col(text).rlike("[^\\s\\u00a0\\u3000]")).select(key, text, F.col(source).cast("string"))
    return spread(solid).mapInArrow(run, f"k {kind}, src string, hash long, " + ", ".join(f"{n} int" for n in names[1:]))


def residue_documents(
    df: DataFrame, key: str, text: str, source: str, most_left: int = 40, min_docs: int = 3, min_sources: int = 2, share: float = 0.6,
) -> DataFrame:
    """(key, spans, left_words, is_residue, path) for every document whose text is not null or blank.

    ``most_left``: words a headline and a first sentence may hold.  ``min_docs``, ``min_sources``: in how many
    documents and sources a masked unit must recur to be grouped as a message; ``share``: in what share of
    residue documents, if no rule knows it.  ``path`` is ``recurring`` for documents that their recurring messages alone make
    residue, ``rules`` for those that need units that do not recur, null for the rest.  Rows of a repeated key are
    judged as one document.  Null sources count as one source.  Texts and units are read whole.
    """
    rows = materialise(_unit_rows(df, key, text, source))
    units = rows.filter("hash is not null")
    # a unit's company: is the rest of its document residue?
    rest_bad = (F.col("all_spans") > F.col("spans")) & (F.col("all_left") - F.col("left") <= most_left)
    by_source = units.groupBy("hash", "src").agg(F.count(F.lit(1)).alias("n"), F.count_if(rest_bad).alias("bad"), F.max("spans").alias("spans"))
    stats = by_source.groupBy("hash").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.count(F.lit(1)).alias("sources"), F.max("spans").alias("by_rule"))
    known = F.col("by_rule") > 0
    messages = stats.filter((F.col("n") >= min_docs) & (F.col("sources") >= min_sources) & (known | (F.col("bad") >= share * F.col("n")))).select("hash", (~known).alias("learned"))

    # what the messages of a document take from it; only units that are messages are joined and shuffled again
    saved = F.when(F.col("learned"), F.col("words")).otherwise(F.col("words") - F.col("left"))
    held = units.join(messages, "hash").groupBy("k").agg(
        F.sum(F.when(F.col("learned"), F.col("times")).otherwise(F.col("spans"))).alias("messages"), F.sum(saved).alias("saved"),
        F.sum(F.when(F.col("learned"), F.col("times")).otherwise(0)).alias("learned"), F.sum(F.when(F.col("learned"), F.col("left")).otherwise(0)).alias("learned_left"),
    )
    whole = rows.filter("hash is null").groupBy("k").agg(F.sum("words").alias("words"), F.sum("left").alias("left"), F.sum("spans").alias("spans"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = whole.join(held, "k", "left").select(
        "k", (F.col("spans") + zero("learned")).cast("int").alias("spans"), (F.col("left") - zero("learned_left")).cast("int").alias("left_words"),
        ((zero("messages") > 0) & (F.col("words") - zero("saved") <= most_left)).alias("recurring"),
    )
    found = (F.col("spans") > 0) & (F.col("left_words") <= most_left)
    return out.select(F.col("k").alias(key), "spans", "left_words", found.alias("is_residue"), F.when(found, F.when(F.col("recurring"), "recurring").otherwise("rules")).alias("path"))
