"""Problem 9: missing or wrong language labels, and texts that change language between paragraphs.

A word is the average of hashed embeddings of its subwords, a paragraph the average of its words, and
a linear softmax over that average gives its language: averaged hashed subword embeddings, trained by
stochastic gradient descent in numpy on the fixed table of labelled samples.  Confidences are
temperature-scaled on held-out samples, and a paragraph whose scaled confidence is under the
calibrated threshold is rejected: it takes the language of its document.

Defined results: null, empty and letterless texts have no language and are no cases; ties go to the
language first in alphabetical order; labels are compared as codes, whatever their spelling.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS, DIM, EPOCHS, SEED = 1 << 15, 24, 30, 7
SHORT = 12  # words under which a paragraph is held to the stricter threshold
MAX_SAMPLES = 5000  # bound on labelled rows read for fitting
PARA_SCHEMA = "doc_id bigint, para_no int, lang string, confidence double, n_letters int, rejected boolean"

# ISO codes of the sampled languages and the spellings labels come in.
NAMES: dict[str, tuple[str, ...]] = {
    "ar": ("ara", "arabic"), "de": ("deu", "ger", "german", "deutsch"), "en": ("eng", "english"), "es": ("spa", "spanish", "español", "castellano"),
    "fr": ("fra", "fre", "french", "français"), "hi": ("hin", "hindi"), "it": ("ita", "italian", "italiano"), "ja": ("jpn", "japanese", "日本語"),
    "nl": ("nld", "dut", "dutch", "nederlands"), "pt": ("por", "portuguese", "português"), "ru": ("rus", "russian", "русский"), "th": ("tha", "thai"),
    "uk": ("ukr", "ukrainian", "українська"), "zh": ("zho", "chi", "chinese", "中文", "cmn"),
}
UNKNOWN = ("", "unknown", "und", "unk", "n/a", "na", "none", "null", "?", "-", "xx", "zxx", "mul", "other", "undefined", "undetermined", "nan", "tbd")

# A run of letters of a script written with spaces, or a single letter of one written without.
_WORD = re.compile("[ぁ-ヿ㐀-鿿]|[฀-๿]{1,4}|[^\\W\\d_ぁ-ヿ㐀-鿿฀-๿]+(?:[̀-ًͯ-ٕऀ-ःऺ-ॏॢॣ]+[^\\W\\d_]*)*")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def subwords(word: str) -> list[str]:
    """The word and its character n-grams of one to four, with its edges marked."""
    w = f"<{word}>"
    return [w] + [w[i : i + n] for n in (2, 3, 4) for i in range(len(w) - n + 1)] + [c for c in word]


def _hash(s: str) -> int:
    h = 2166136261
    for b in s.encode():
        h = ((h ^ b) * 16777619) & 0xFFFFFFFF
    return h % BUCKETS


class Model:
    """Embeddings, softmax and calibration."""

    def __init__(self, samples: Iterable[tuple[str, str]]):
        data = sorted((lang, t) for lang, t in samples if lang and t)
        self.langs = sorted({lang for lang, _ in data})
        y = np.array([self.langs.index(lang) for lang, _ in data])
        bags = [self._bag(words(t)) for _, t in data]
        rng = np.random.default_rng(SEED)
        held = rng.random(len(data)) < 0.2
        emb, w, b = self._train(bags, y, ~held, rng)
        logits = np.array([self._logits(x, emb, w, b) for x in bags])
        pieces, of = self._pieces(data, held, y, emb, w, b)
        # scaled on pieces as short as headings: whole samples are told too easily to calibrate anything
        self.temperature = self._scale(pieces, of)
        p = self._softmax(logits[held] / self.temperature)
        right = p.argmax(1) == y[held]
        self.accuracy = float(right.mean()) if len(right) else 1.0
        # reject under the confidence at which held-out pieces, short as headings or whole, are right 199 times in 200
        short = self._softmax(pieces / self.temperature) if len(of) else np.ones((1, len(self.langs)))
        self.reject_short = self._least(short.max(1), short.argmax(1) == of if len(of) else np.ones(1, bool), floor=0.97)
        long = np.array([len(words(t)) >= SHORT for _, t in data])[held]
        self.reject = self._least(p.max(1)[long], right[long], floor=0.8)
        emb, w, b = self._train(bags, y, np.ones(len(data), bool), np.random.default_rng(SEED))
        self.table = (emb @ w).astype(np.float32)  # language scores of each subword: the average commutes with the linear layer
        self.bias = b.astype(np.float32)

    def _pieces(self, data: list, held: np.ndarray, y: np.ndarray, emb: np.ndarray, w: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores and languages of held-out runs of SHORT // 3 words."""
        logits, of = [], []
        for i in np.flatnonzero(held):
            ws = words(data[i][1])
            for j in range(0, len(ws), SHORT // 3):
                logits.append(self._logits(self._bag(ws[j : j + SHORT // 3]), emb, w, b))
                of.append(y[i])
        return np.array(logits).reshape(-1, len(self.langs)), np.array(of, np.int64)

    @staticmethod
    def _least(conf: np.ndarray, right: np.ndarray, floor: float) -> float:
        """The least confidence from which on answers are right 199 times in 200."""
        if not len(conf):
            return floor
        for c in np.arange(floor, 0.985, 0.01):
            sure = conf >= c
            if sure.any() and right[sure].mean() >= 0.995:
                return float(c)
        return 0.98

    @staticmethod
    def _bag(ws: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Hashed subwords of all words and their weights in the average of averages."""
        ids, weights = [], []
        for w in ws:
            s = subwords(w)
            ids += [_hash(x) for x in s]
            weights += [1 / (len(s) * len(ws))] * len(s)
        return np.array(ids, np.int64), np.array(weights, np.float64)

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(-1, keepdims=True))
        return e / e.sum(-1, keepdims=True)

    @staticmethod
    def _logits(bag: tuple[np.ndarray, np.ndarray], emb: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (emb[bag[0]] * bag[1][:, None]).sum(0) @ w + b

    def _train(self, bags: list, y: np.ndarray, use: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        k = len(self.langs)
        emb = rng.normal(0, 0.1, (BUCKETS, DIM))
        w = rng.normal(0, 0.3, (DIM, k))
        b = np.zeros(k)
        own = np.flatnonzero(use)
        for epoch in range(EPOCHS):
            rate = 2.0 * (1 - epoch / EPOCHS)
            for i in rng.permutation(own):
                ids, weights = bags[i]
                if not len(ids):
                    continue
                h = (emb[ids] * weights[:, None]).sum(0)
                p = self._softmax(h @ w + b)
                p[y[i]] -= 1
                gh = w @ p
                w -= rate * 0.5 * np.outer(h, p)
                b -= rate * 0.02 * p
                np.subtract.at(emb, ids, rate * 8 * weights[:, None] * gh)
        return emb, w, b

    def _scale(self, logits: np.ndarray, y: np.ndarray) -> float:
        """The temperature that makes held-out confidences fit best; never one that sharpens them."""
        best, at = 1e9, 1.0
        if not len(y):
            return at
        for t in np.geomspace(1, 10, 41):
            p = self._softmax(logits / t)
            loss = -np.log(np.maximum(p[np.arange(len(y)), y], 1e-12)).mean()
            if loss < best:
                best, at = loss, float(t)
        return at


class Tagger:
    """Scores paragraphs with a model; keeps the score of each word it has met, up to a bound."""

    LIMIT = 400_000

    def __init__(self, model: Model):
        self.m = model
        self.at: dict[str, int] = {}
        self.rows = np.zeros((4096, len(model.langs)), np.float32)

    def _word(self, w: str) -> int:
        if len(self.at) >= self.LIMIT:
            self.at.clear()
        n = self.at[w] = len(self.at)
        if n == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[n] = self.m.table[[_hash(x) for x in subwords(w)]].mean(0)
        return n

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities, numbers of words and of letters per text; a text without letters has no words."""
        if len(self.at) > self.LIMIT // 2:
            self.at.clear()
        ids, sizes, letters = [], [], []
        get = self.at.get
        for t in texts:
            ws = words(t)
            sizes.append(len(ws))
            letters.append(sum(map(len, ws)))
            for w in ws:
                n = get(w)
                ids.append(self._word(w) if n is None else n)
        n = np.array(sizes)
        p = np.zeros((len(texts), len(self.m.langs)), np.float32)
        some = np.flatnonzero(n)
        if len(some):
            starts = np.concatenate([[0], np.cumsum(n[some])[:-1]])
            z = np.add.reduceat(self.rows[ids], starts, axis=0) / n[some][:, None] + self.m.bias
            p[some] = Model._softmax(z / self.m.temperature)
        return p, n, np.array(letters)


def fit(samples: DataFrame) -> Model:
    return Model((r[0], r[1]) for r in samples.select("lang", "text").where("lang is not null and text is not null").orderBy("lang", "text").limit(MAX_SAMPLES).collect())


def code(label: Column) -> Column:
    """The code a label means: capitals, regions, three letters and names aside; null where it says nothing."""
    base = F.regexp_replace(F.lower(F.trim(label)), "[-_].*$", "")
    spelled = F.create_map(*[F.lit(x) for c, names in NAMES.items() for n in (c, *names) for x in (n, c)])
    whole = F.lower(F.trim(label))
    known = F.coalesce(F.try_element_at(spelled, whole), F.try_element_at(spelled, base))
    return F.when(label.isNull() | whole.isin(*UNKNOWN) | ~whole.rlike("\\p{L}"), None).otherwise(F.coalesce(known, base))


_TAGGERS: dict[int, Tagger] = {}


def _tagger(model: Model) -> Tagger:
    if id(model) not in _TAGGERS:
        _TAGGERS.clear()
        _TAGGERS[id(model)] = Tagger(model)
    return _TAGGERS[id(model)]


_BREAK = re.compile(r"\n[^\S\n]*\n\s*")


def _tag(texts: list[str], tagger: Tagger) -> Iterator[tuple[int, list[tuple[int, int, float, int, bool]]]]:
    """Per text its paragraphs with (number, language, confidence, letters, rejected); those rejected as doubtful follow the document."""
    paras, owner = [], []
    for i, t in enumerate(texts):
        ps = _BREAK.split(t)
        paras += ps
        owner += [i] * len(ps)
    p, sizes, letters = tagger.score(paras)
    best, conf = p.argmax(1), p.max(1)
    sure = (sizes > 0) & (conf >= np.where(sizes < SHORT, tagger.m.reject_short, tagger.m.reject))
    owner = np.array(owner, np.int64)
    cuts = np.flatnonzero(np.diff(owner, prepend=-1))
    for a, b in zip(cuts, [*cuts[1:], len(owner)]):
        if not sizes[a:b].any():
            continue
        known = np.unique(best[a:b][sure[a:b]])
        if not len(known):  # all rejected: the document is judged as one
            known = np.array([int((p[a:b] * letters[a:b, None]).sum(0).argmax())])
        out = []
        for j in range(a, b):
            if sizes[j]:
                l = int(best[j]) if sure[j] else int(known[p[j, known].argmax()])
                out.append((j - a + 1, l, float(p[j, l]), int(letters[j]), not sure[j]))
        yield int(owner[a]), out


def segments(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per paragraph with letters: language, confidence (1 at most), letters, and whether its own language was rejected as doubtful.

    A rejected paragraph has the likeliest of the languages that its document is surely in, with its own confidence in that.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = _tagger(shared.value)
        langs = shared.value.langs
        for b in batches:
            ids, out = b.column(0).to_pylist(), [[], [], [], [], [], []]
            for i, ps in _tag(b.column(1).to_pylist(), tagger):
                for no, l, c, n, rejected in ps:
                    for col, x in zip(out, (ids[i], no, langs[l], round(c, 4), n, bool(rejected))):
                        col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.string()), pa.array(out[3], pa.float64()), pa.array(out[4], pa.int32()), pa.array(out[5], pa.bool_())], names=["doc_id", "para_no", "lang", "confidence", "n_letters", "rejected"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull()).mapInArrow(run, PARA_SCHEMA)


def documents(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document with letters: its label as a code, its main language with confidence, all its languages."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    schema = "doc_id bigint, label string, main_lang string, confidence double, langs array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = _tagger(shared.value)
        names = shared.value.langs
        for b in batches:
            ids, labels, out = b.column(0).to_pylist(), b.column(2).to_pylist(), [[], [], [], [], []]
            for i, ps in _tag(b.column(1).to_pylist(), tagger):
                share: dict[int, float] = {}
                for _, l, c, n, _ in ps:
                    share[l] = share.get(l, 0) + n
                main = min(share, key=lambda x: (-share[x], x))
                conf = sum(c * n for _, l, c, n, _ in ps if l == main) / max(1, sum(share.values()))
                for col, x in zip(out, (ids[i], labels[i], names[main], round(conf, 4), sorted(names[x] for x in share))):
                    col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string()), pa.array(out[3], pa.float64()), pa.array(out[4], pa.list_(pa.string()))], names=["doc_id", "label", "main_lang", "confidence", "langs"])

    src = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), code(F.col(lang_col)).alias("label"))
    return src.where(F.col("text").isNotNull()).mapInArrow(run, schema)


def mislabelled(docs: DataFrame) -> DataFrame:
    """(doc_id, lang) of documents without a label, with another language's, or of several languages."""
    case = F.col("label").isNull() | (F.size("langs") > 1) | ~F.array_contains("langs", F.coalesce("label", F.lit("")))
    return docs.where(case).select("doc_id", F.explode("langs").alias("lang"))
