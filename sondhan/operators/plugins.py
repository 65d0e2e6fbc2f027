"""What outside models may be put in for, with deterministic built-ins: translators, language detectors, entity extractors.

Embedders are in ``semantic``.  A plug-in is created by the caller and sent to the workers with the plan.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ENTITIES = "array<struct<text:string,label:string,start:int,end:int,confidence:double>>"
_KIND = pa.list_(pa.struct([("text", pa.string()), ("label", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("confidence", pa.float64())]))


class Translator(Protocol):
    def translate(self, texts: list[str], target: list[str]) -> list[str | None]: ...


class LanguageDetector(Protocol):
    def detect(self, texts: list[str]) -> list[str | None]: ...


class EntityExtractor(Protocol):
    def extract(self, text: str) -> list[dict]:
        """Dicts with word or text, label or entity_group, start, end, score."""


class MapTranslator:
    """Looks whole texts up, whatever their case; null for those it does not know."""

    def __init__(self, known: dict[str, str]):
        self.known = {k.lower(): v for k, v in known.items()}

    def translate(self, texts: list[str], target: list[str]) -> list[str | None]:
        return [self.known.get(t.strip().lower()) for t in texts]


class ScriptDetector:
    """bn if over ``share`` of the text is Bengali, unknown if blank, else en."""

    def __init__(self, share: float = 0.3):
        self.share = share

    def detect(self, texts: list[str]) -> list[str | None]:
        return ["unknown" if not t.strip() else "bn" if sum("ঀ" <= c <= "৿" for c in t) > self.share * len(t) else "en" for t in texts]


class CapitalRuns:
    """English built-in: runs of two or more capitalised words."""

    _RUN = re.compile(r"[A-Z][a-z]+(?: [A-Z][a-z]+)+")

    def extract(self, text: str) -> list[dict]:
        return [{"word": m[0], "entity_group": "MISC", "start": m.start(), "end": m.end(), "score": 1.0} for m in self._RUN.finditer(text)]


class Gazetteer:
    """Finds the names of a list as whole words; for Bangla, which has no capitals.  ``names``: name to label."""

    def __init__(self, names: dict[str, str]):
        self.names = dict(names)
        self._find = re.compile("(?<!\\w)(?:" + "|".join(re.escape(n) for n in sorted(names, key=len, reverse=True)) + ")(?!\\w)") if names else None

    def extract(self, text: str) -> list[dict]:
        return [{"word": m[0], "entity_group": self.names[m[0]], "start": m.start(), "end": m.end(), "score": 1.0} for m in self._find.finditer(text)] if self._find else []


def label_of(raw: str, others: dict[str, str] | None = None) -> str | None:
    """PERSON, ORG or LOC by what the model's label contains, else what ``others`` says."""
    for part, label in (("PER", "PERSON"), ("ORG", "ORG"), ("LOC", "LOC")):
        if part in raw.upper():
            return label
    return (others or {}).get(raw)


def tidy_entities(found: list[dict], least: float = 0.5, others: dict[str, str] | None = None) -> list[dict]:
    """Entities of known labels with a score of ``least`` or more, without subword marks, each (text, label) once, the first wins."""
    out, seen = [], set()
    for e in found:
        score, label = float(e.get("score", 1.0)), label_of(e.get("entity_group") or e.get("label") or e.get("entity") or "", others)
        text = (e.get("word") or e.get("text") or "").strip().replace("##", "").strip()
        if score >= least and label and text and (text, label) not in seen:
            seen.add((text, label))
            out.append({"text": text, "label": label, "start": int(e.get("start") or 0), "end": int(e.get("end") or 0), "confidence": round(score, 3)})
    return out


def extract_entities(df: DataFrame, key: str, text: str, lang: str, extractors: dict[str, EntityExtractor], least: float = 0.5, others: dict[str, str] | None = None) -> DataFrame:
    """(key, entities): each text by the extractor of its language.

    A language without extractor, a null or blank text and a text at which the extractor fails give an empty
    list, and the run goes on.  Texts are read whole.  ``others`` maps labels of the models beside person, organisation and place.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for value, code in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                tool = extractors.get(code)
                try:
                    found.append(tidy_entities(tool.extract(value), least, others) if tool and value and value.strip() else [])
                except Exception:  # one text must not end the run
                    found.append([])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, _KIND)], ["key", "entities"])

    return df.select(key, text, F.col(lang).cast("string")).mapInArrow(run, f"`{key}` {kind}, entities {ENTITIES}")


def translate(df: DataFrame, key: str, text: str, target: str, translator: Translator) -> DataFrame:
    """(key, translated): the text itself where the translator has none or fails; null stays null."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, goals = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            try:
                made = translator.translate([t or "" for t in texts], goals)
            except Exception:
                made = [None] * len(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if t is None else m if m else t for t, m in zip(texts, made, strict=True)], pa.string())], ["key", "translated"])

    return df.select(key, text, F.col(target).cast("string")).mapInArrow(run, f"`{key}` {kind}, translated string")


def detect(df: DataFrame, key: str, text: str, detector: LanguageDetector) -> DataFrame:
    """(key, language) by a detector; null texts are blank."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(detector.detect([t or "" for t in batch.column(1).to_pylist()]), pa.string())], ["key", "language"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, language string")
