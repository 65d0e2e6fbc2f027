"""Languages of documents and of their paragraphs (problem 4).

A mixture model over words and character trigrams.  Its components are the languages,
Bangla and Hindi once in their own and once in Latin letters.  It is fitted by
expectation-maximisation on all documents, started from a few function words a
language, so wrong or missing labels do no harm (labels are not used at all).

For each document EM then estimates the proportions of the languages from the
likelihoods of its paragraphs; a language besides the main one is kept only if it raises
the log-likelihood by more than a penalty that grows with the log of the document's
length, and the paragraphs are judged anew within the languages kept.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondhan.llm.lookalike import latinised, plain
from sondhan.session import materialise, spread

# A choice of this library: function words that start the components.
SEEDS = {
    "en": "the of and to in is that was for with it as said by at from has have not this which be are or an but more been will would about after they were",
    "fr": "le la les des est une dans pour que qui et du au sur par pas plus avec ce cette ont été sont il elle selon mais leur aux",
    "es": "el los las una que por con para del se su al es no más como fue este esta según pero sus han ha y dicen",
    "de": "der die das und ist nicht mit für ein eine den dem des zu von auf sich auch wird wurde nach bei noch hat im aus",
    "bn": "এবং এই হয়েছে করা বলেন তবে কিন্তু থেকে জন্য আরও না ও কোনো বলে হবে করেছে এ নিয়ে যে তা",
    "bn_latn": "ache hobe kore bole keu amra tobe ei ebong jonno kintu chilo korche bolen nai kichu amader theke aro niye hoyeche koren janan",
    "hi": "है के की में को से का और ने पर हैं नहीं यह कि कहा लिए गया एक भी इस",
    "hi_latn": "hai hain nahi nahin mein aur liye kiya gaya bahut kaha unhone lekin yeh iske raha rahe sakta wale",
}
COMPONENTS = list(SEEDS)
CODES = ["en", "bn", "hi", "fr", "es", "de"]
OWNER = np.array([CODES.index(c.split("_")[0]) for c in COMPONENTS])
BUCKETS = 1 << 14
WORDS = 30_000
#: Components in borrowed letters with their function words: names and page furniture look like them, but hold none of these.
BORROWED = {j: frozenset(SEEDS[c].split()) for j, c in enumerate(COMPONENTS) if "_" in c}
#: Log-likelihood of a word of such a paragraph not to be one of those function words (about every fifth is).
UNSPOKEN = float(np.log(1 - 0.2))
LOUDEST = 12.0
#: Words each component keeps of its own, so that those of a rare language are not crowded out by the frequent words of the others.
OWN_WORDS = 4_000
SCRIPTS = ["bn" if c == "bn" else "hi" if c == "hi" else "latn" for c in COMPONENTS]

_TOKEN = re.compile(r"[^\s\d!-/:-@\[-`{-~০-৯०-९।॥‘’“”„«»‹›–—…|•·©°]+")


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(latinised(plain(text)).lower())


def _grams(word: str) -> list[int]:
    padded = f"^{word}$"
    return [zlib.crc32(padded[i : i + 3].encode()) % BUCKETS for i in range(len(padded) - 2)]


def _script(word: str) -> str:
    c = word[len(word) // 2]
    return "bn" if "ঀ" <= c <= "৿" else "hi" if "ऀ" <= c <= "ॿ" else "latn"


class LanguageModel:
    """Log-likelihood vectors of words, one value a component; size bounded by WORDS and BUCKETS."""

    def __init__(self, words: dict[str, int], word_p: np.ndarray, gram_log: np.ndarray, blend: float = 0.7):
        self.words, self.word_p, self.gram_log, self.blend = words, word_p, gram_log, blend

    def vector(self, word: str) -> np.ndarray:
        row = self.words.get(word)
        known = self.word_p[row] if row is not None else np.zeros(len(COMPONENTS), np.float32)
        return self.blended(known[None], self.gram_log[_grams(word)].sum(0, keepdims=True))[0].astype(np.float32)

    def blended(self, known: np.ndarray, spelled: np.ndarray) -> np.ndarray:
        """Log-likelihoods of words, one row each, from their probabilities as known words and the log-likelihoods of their trigrams.

        The trigrams of a word, however long it is, speak for its best component by LOUDEST at most: a word of no language decides nothing.
        """
        spelled = np.maximum(spelled, spelled.max(1, keepdims=True) - LOUDEST)
        return np.logaddexp(np.log(self.blend * known.astype(float) + 1e-300), np.log(1 - self.blend) + spelled)


def _sums(matrix: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Row sums of consecutive, possibly empty, runs of a matrix."""
    total = np.vstack([np.zeros((1, matrix.shape[1])), np.cumsum(matrix, 0, dtype=np.float64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


class Chunk:
    """The paragraphs that hold words of some documents: word numbers, their runs, the trigrams of the distinct words, and whose paragraphs they are."""

    #: Documents and characters a chunk is filled with.
    DOCUMENTS, CHARACTERS = 1000, 2_000_000
    FIELDS = "words array<string>, ids array<int>, sizes array<int>, gram_id array<int>, gram_sizes array<int>, doc array<int>, place array<int>"

    def __init__(self, words: list[str], ids: np.ndarray, sizes: np.ndarray, gram_id: np.ndarray, gram_sizes: np.ndarray, doc: np.ndarray, place: np.ndarray):
        self.words, self.ids, self.gram_id, self.doc, self.place = words, ids, gram_id, doc, place
        self.sizes, self.offsets, self.gram_off = sizes, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), np.concatenate([[0], np.cumsum(gram_sizes)]).astype(np.int64)
        self.para, self.gram_word = np.repeat(np.arange(len(sizes)), sizes), np.repeat(np.arange(len(words)), gram_sizes)

    @staticmethod
    def arrays(texts: list[str]) -> tuple[list[str], list[int], list[int], list[int], list[int], list[int], list[int]]:
        vocabulary: dict[str, int] = {}
        ids, sizes, doc, place = [], [], [], []
        for d, text in enumerate(texts):
            for k, p in enumerate(text.split("\n\n"), 1):
                if t := tokens(p):
                    ids += [vocabulary.setdefault(w, len(vocabulary)) for w in t]
                    sizes.append(len(t))
                    doc.append(d)
                    place.append(k)
        grams = [_grams(w) for w in vocabulary]
        return list(vocabulary), ids, sizes, [x for g in grams for x in g], [len(g) for g in grams], doc, place

    @classmethod
    def of(cls, texts: list[str]) -> Chunk:
        words, *numbers = cls.arrays(texts)
        return cls(words, *[np.array(x, np.int64) for x in numbers])

    def unspoken(self) -> np.ndarray:
        """Log-likelihoods of paragraphs of n words to hold no function word of a borrowed component; 0 for those that hold one."""
        out = np.zeros((len(self.sizes), len(COMPONENTS)))
        for j, own in BORROWED.items():
            has = np.array([w in own for w in self.words], float)
            out[:, j] = np.where(_sums(has[self.ids][:, None], self.offsets)[:, 0] == 0, UNSPOKEN * self.sizes, 0.0)
        return out

    def counts(self, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected counts of the words and trigrams by component."""
        k = len(COMPONENTS)
        n = np.stack([np.bincount(self.ids, r[self.para, j], len(self.words)) for j in range(k)], 1)
        return n, np.stack([np.bincount(self.gram_id, n[self.gram_word, j], BUCKETS) for j in range(k)], 1)

    def start(self) -> tuple[np.ndarray, np.ndarray]:
        """(shares of the components, clear paragraphs a component) by script and function words alone."""
        k = len(COMPONENTS)
        row = {w: i for i, w in enumerate(self.words)}
        seed = np.zeros((len(self.words), k))
        for j, words in enumerate(SEEDS.values()):
            for w in words.split():
                if w in row:
                    seed[row[w], j] += 2.0
        allowed = np.array([[0.0 if s == _script(w) else -8.0 for s in SCRIPTS] for w in self.words])
        hits, fits = _sums(seed[self.ids], self.offsets), _sums(allowed[self.ids], self.offsets)
        r = _softmax(hits + np.maximum(fits, -200))
        r[(hits.max(1) == 0) & (fits[:, 0] == 0)] = 0.0  # Latin letters, no function word: wait
        return r, ((hits >= 4) & (hits > np.sort(hits, 1)[:, [-2]])).sum(0)

    def likelihoods(self, model: LanguageModel) -> np.ndarray:
        """Log-likelihoods of the paragraphs, a column a component."""
        known = np.vstack([model.word_p, np.zeros((1, len(COMPONENTS)))])[[model.words.get(w, -1) for w in self.words]]
        logp = model.blended(known, _sums(model.gram_log[self.gram_id], self.gram_off))
        return _sums(logp[self.ids], self.offsets) + self.unspoken()

    def judge(self, model: LanguageModel, prior: np.ndarray) -> np.ndarray:
        return _softmax(self.likelihoods(model) + prior)


class Totals:
    """What a task, or the table, adds up over its chunks: trigram counts, shares, tokens and clear paragraphs a component; word counts by row or word."""

    def __init__(self, rows: int = 0):
        k = len(COMPONENTS)
        self.grams, self.rest, self.n = np.zeros((BUCKETS, k)), np.zeros((3, k)), np.zeros((rows, k))

    def add(self, chunk: Chunk, r: np.ndarray, clear: np.ndarray | float = 0.0) -> np.ndarray:
        n, g = chunk.counts(r)
        self.grams += g
        self.rest += [r.sum(0), n.sum(0), np.zeros(len(COMPONENTS)) + clear]
        return n

    def add_judged(self, chunk: Chunk, model: LanguageModel, prior: np.ndarray) -> None:
        n = self.add(chunk, chunk.judge(model, prior))
        at = np.array([model.words.get(w, -1) for w in chunk.words], np.int64)
        np.add.at(self.n, at[at >= 0], n[at >= 0])

    def rows(self) -> tuple[np.ndarray, np.ndarray]:
        """(numbers, values): trigrams, then the three sums, then words; rows of zeros left out."""
        every = np.vstack([self.grams, self.rest, self.n])
        at = np.flatnonzero(every.any(1))
        return at, every[at]

    @classmethod
    def of(cls, at: np.ndarray, values: np.ndarray, rows: int) -> Totals:
        out, every = cls(rows), np.zeros((BUCKETS + 3 + rows, len(COMPONENTS)))
        every[at] = values
        out.grams, out.rest, out.n = every[:BUCKETS], every[BUCKETS : BUCKETS + 3], every[BUCKETS + 3 :]
        return out


def _model(words: dict[str, int], totals: Totals, absent: np.ndarray) -> tuple[LanguageModel, np.ndarray]:
    """(model, log of the shares of the components) of expected counts."""
    shares, held = np.where(absent, 0.0, totals.rest[0]), np.where(absent, 0.0, totals.rest[1])
    grams = np.where(absent, 0.0, totals.grams)
    gram_log = np.log((grams + 0.02) / (grams.sum(0) + 0.02 * BUCKETS))
    gram_log[:, absent] = -60.0
    word_p = np.where(absent, 0.0, totals.n) / np.maximum(held, 50.0)
    return LanguageModel(words, word_p.astype(np.float32), gram_log.astype(np.float32)), np.log((shares + 1) / (shares.sum() + len(COMPONENTS)))


def _absent(clear: np.ndarray) -> np.ndarray:
    """Components in Latin letters no paragraph at all speaks clearly for; they would only split a neighbour's paragraphs."""
    return (clear == 0) & np.array([x == "latn" for x in SCRIPTS])


def _still(before: np.ndarray, now: np.ndarray) -> bool:
    """Whether the shares of the components no longer change: by under a thousandth of themselves, or of all paragraphs by under one in 100,000."""
    p, q = np.exp(before), np.exp(now)
    return bool((np.abs(p - q) <= np.maximum(1e-3 * p, 1e-5)).all())


def fit(texts: list[str], rounds: int = 8) -> LanguageModel:
    """EM over the paragraphs of some texts, in one process; as many as ``rounds``, or until the shares stand still."""
    chunk = Chunk.of(texts)
    if not len(chunk.ids):
        return LanguageModel({}, np.zeros((0, len(COMPONENTS))), np.full((BUCKETS, len(COMPONENTS)), -np.log(BUCKETS)))
    count = np.bincount(chunk.ids)
    first = Totals()
    n = first.add(chunk, *chunk.start())
    order = [i for i in sorted(range(len(count)), key=lambda i: (-count[i], chunk.words[i])) if count[i] > 1][:WORDS]
    words = {chunk.words[i]: row for row, i in enumerate(order)}
    first.n = n[order]
    absent = _absent(first.rest[2])
    model, prior = _model(words, first, absent)
    for _ in range(rounds - 1):
        totals = Totals(len(words))
        totals.add_judged(chunk, model, prior)
        before = prior
        model, prior = _model(words, totals, absent)
        if _still(before, prior):
            break
    return model


def split_all(df: DataFrame, key: str, text: str) -> DataFrame:
    """The documents of a table as rows of chunks, their words split once, kept in the shared folder."""
    kind = df.schema[key].dataType.simpleString()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, start, held = batch.column(1).to_pylist(), 0, 0
            for end, t in enumerate(texts, 1):
                held += len(t)
                if end == len(texts) or end - start == Chunk.DOCUMENTS or held + len(texts[end]) > Chunk.CHARACTERS:
                    keys, arrays = batch.column(0).slice(start, end - start), Chunk.arrays(texts[start:end])
                    columns = [pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys)]
                    columns += [pa.array([x], pa.list_(t)) for x, t in zip(arrays, [pa.string(), *[pa.int32()] * 6], strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, ["keys", "words", "ids", "sizes", "gram_id", "gram_sizes", "doc", "place"])
                    start, held = end, 0

    return materialise(spread(df.select(key, text)).mapInArrow(split, f"keys array<{kind}>, {Chunk.FIELDS}"))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, Chunk]]:
    for batch in batches:
        for i in range(len(batch)):
            numbers = [batch.column(j)[i].values.to_numpy(zero_copy_only=False).astype(np.int64) for j in range(2, 8)]
            yield batch.column(0)[i].values, Chunk(batch.column(1)[i].values.to_pylist(), *numbers)


def fit_all(held: DataFrame, rounds: int = 8) -> LanguageModel:
    """EM over the paragraphs of all documents of a table (``split_all``); as many as ``rounds``, or until the shares stand still.

    A round is one pass over the split words that adds up counts of BUCKETS trigrams and of the words that are
    the WORDS most frequent ones or among the OWN_WORDS most frequent of a component.  Only these sums reach the driver.
    """
    k = len(COMPONENTS)
    sums = [f"c{j}" for j in range(k)]
    fields = ", ".join(f"{c} double" for c in sums)

    def seeded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = Totals()
        for _, chunk in _chunks(batches):
            if len(chunk.ids):
                n = totals.add(chunk, *chunk.start())
                yield pa.RecordBatch.from_arrays([pa.array([-1] * len(n), pa.int32()), pa.array(chunk.words, pa.string()), pa.array(np.bincount(chunk.ids).astype(float)), *map(pa.array, n.T.copy())], ["at", "word", "n", *sums])
        at, values = totals.rows()
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([""] * len(at), pa.string()), pa.array(np.zeros(len(at))), *map(pa.array, values.T.copy())], ["at", "word", "n", *sums])

    def collected(rows: DataFrame, size: int) -> Totals:
        found = rows.select("at", *sums).toArrow()
        return Totals.of(found.column(0).to_numpy(), np.stack([found.column(j + 1).to_numpy() for j in range(k)], 1), size)

    counts = materialise(held.mapInArrow(seeded, f"at int, word string, n double, {fields}").groupBy("at", "word").agg(*[F.sum(c).alias(c) for c in ["n", *sums]]))
    first = collected(counts.filter("at >= 0"), 0)
    repeated = counts.filter("at < 0 and n > 1")
    chosen = repeated.orderBy(F.desc("n"), "word").limit(WORDS)
    for c in sums:
        chosen = chosen.unionByName(repeated.filter(F.col(c) > 0).orderBy(F.desc(c), "word").limit(OWN_WORDS))
    table = chosen.dropDuplicates(["word"]).toArrow().sort_by("word")
    words = {w: i for i, w in enumerate(table.column("word").to_pylist())}
    first.n = np.stack([table.column(c).to_numpy() for c in sums], 1)
    absent = _absent(first.rest[2])
    model, prior = _model(words, first, absent)
    for _ in range(rounds - 1):

        def judged(batches: Iterator[pa.RecordBatch], model=model, prior=prior) -> Iterator[pa.RecordBatch]:
            totals = Totals(len(model.words))
            for _, chunk in _chunks(batches):
                if len(chunk.ids):
                    totals.add_judged(chunk, model, prior)
            at, values = totals.rows()
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *map(pa.array, values.T.copy())], ["at", *sums])

        rows = held.mapInArrow(judged, f"at int, {fields}").groupBy("at").agg(*[F.sum(c).alias(c) for c in sums])
        before = prior
        model, prior = _model(words, collected(rows, len(words)), absent)
        if _still(before, prior):
            break
    return model


def decide(chunk: Chunk, model: LanguageModel, n: int, rounds: int = 12, penalty: float = 6.0, min_words: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(main language of each of the ``n`` documents of a chunk or -1, its share, language of each paragraph, its probability), as numbers of CODES.

    A paragraph of fewer than ``min_words`` words (a menu, a name) follows the document.
    """
    size, doc = chunk.sizes.astype(float), chunk.doc
    fine = chunk.likelihoods(model)
    like = np.full((len(size), len(CODES)), -np.inf)
    for j, owner in enumerate(OWNER):  # a language is as likely as the better of its scripts
        like[:, owner] = np.maximum(like[:, owner], fine[:, j])
    first = np.searchsorted(doc, np.arange(n + 1))
    weight = _sums(size[:, None], first)[:, 0]
    share = np.full((n, len(CODES)), 1 / len(CODES))
    for _ in range(rounds):
        r = _softmax(like + np.log(share[doc] + 1e-9))
        share = (_sums(r * size[:, None], first) + 0.5) / (weight[:, None] + 0.5 * len(CODES))
    # penalised choice of the set of languages
    main = share.argmax(1)
    base = like[np.arange(len(size)), main[doc]]
    gain = _sums(np.maximum(like - base[:, None], 0.0), first)
    kept = gain > penalty + np.log1p(weight[:, None])
    kept[np.arange(n), main] = True
    r = _softmax(np.where(kept[doc], like + np.log(share[doc] + 1e-9), -1e9))
    total = _sums(r * size[:, None], first)
    main = total.argmax(1)
    best, sure = r.argmax(1), r.max(1)
    short = size < min_words
    best[short], sure[short] = main[doc][short], r[short, main[doc][short]]
    confidence = total[np.arange(n), main] / np.maximum(weight, 1.0)
    return np.where(weight > 0, main, -1), confidence, best, sure


class Judge:
    """Languages of texts in one process."""

    def __init__(self, model: LanguageModel):
        self.model = model

    def documents(self, bodies: list[str], **settings) -> list[list[tuple[int, str | None, float]]]:
        """For each body [(0, main language, confidence), (k, language, confidence) for each paragraph k, from 1].

        A paragraph without words has the language None and confidence 0; so has a body without any words.
        """
        chunk = Chunk.of(bodies)
        out = [[(k, None, 0.0) for k in range(b.count("\n\n") + 2)] for b in bodies]
        if len(chunk.ids):
            main, share, best, sure = decide(chunk, self.model, len(bodies), **settings)
            for d, rows in enumerate(out):
                if main[d] >= 0:
                    rows[0] = (0, CODES[main[d]], float(share[d]))
            for d, k, b, s in zip(chunk.doc, chunk.place, best, sure, strict=True):
                out[d][k] = (int(k), CODES[b], float(s))
        return out


def identify(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, segment, language, confidence): segment 0 is the document, k >= 1 its k-th paragraph if in another language.

    Rows with null or blank text are left out; a text without a single word gets one row
    with null language and confidence 0.  Every document has its part in the model and is judged, whole.
    """
    solid = df.filter(F.col(text).rlike("[^\\s\\u00a0\\u3000]")).select(key, text)
    held = split_all(solid, key, text)
    model = fit_all(held)
    kind = df.schema[key].dataType.simpleString()
    codes = pa.array([*CODES, None], pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, chunk in _chunks(batches):
            n = len(keys)
            main, share, best, sure = decide(chunk, model, n) if len(chunk.ids) else (np.full(n, -1), np.zeros(n), *[np.zeros(0)] * 2)
            other = np.flatnonzero(best != main[chunk.doc]) if len(chunk.ids) else np.zeros(0, np.int64)
            at = np.concatenate([np.arange(n), chunk.doc[other]]).astype(np.int64)
            segment = np.concatenate([np.zeros(n), chunk.place[other]]).astype(np.int64)
            language = np.concatenate([np.where(main < 0, len(CODES), main), best[other]]).astype(np.int64)
            confidence = np.concatenate([np.where(main < 0, 0.0, share), sure[other]]).astype(float)
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(at)), pa.array(segment), codes.take(pa.array(language)), pa.array(confidence)], ["key", "segment", "language", "confidence"])

    return held.mapInArrow(run, f"`{key}` {kind}, segment long, language string, confidence double")
