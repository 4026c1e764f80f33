"""Problem 3: text that was decoded with the wrong character encoding.

A hidden Markov model labels every non-ASCII character of a text with either the *clean* state or the
state of one encoding pair (true encoding -> encoding wrongly used to decode).  ASCII characters are
the same bytes in all those encodings, so they carry no evidence and are skipped.  Emissions are the
character distributions of clean sample text and of the same text passed through each pair, counted
over every row of the sample tables (``lang_samples`` and ``eval_items``).
Each labelled span is then inverted with its state's transform, and accepted when the inversion is
valid and reads more like clean text under a character-bigram model of the same samples.

Defined results: null or ASCII-only texts have no spans; a span that lost bytes (U+FFFD, bytes that do
not decode) is reported as not restorable and left as it is.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliowright.llm.lookalikes import LATIN_TWIN
from foliowright.session import spread

# Fixed values: (true encoding, encoding it was read in); "twice" marks a double round.
PAIRS: tuple[tuple[str, str], ...] = (
    ("utf-8", "latin-1"), ("utf-8", "cp1252"), ("utf-8", "cp1250"), ("utf-8", "cp1251"), ("utf-8", "cp437"),
    ("utf-8", "cp850"), ("utf-8", "cp866"), ("utf-8", "mac_roman"), ("utf-8", "koi8_r"), ("utf-8", "gb18030"),
    ("utf-8", "cp932"), ("utf-8", "big5"), ("utf-8 twice", "cp1252"), ("utf-8 twice", "latin-1"),
    ("cp1252", "cp437"), ("cp1252", "cp850"), ("cp1252", "mac_roman"), ("cp1252", "cp1251"), ("cp1252", "cp1253"),
    ("cp1252", "cp1250"), ("mac_roman", "cp1252"), ("cp437", "cp1252"), ("cp850", "cp1252"),
    ("cp1251", "cp1252"), ("cp1251", "koi8_r"), ("cp1251", "cp866"), ("cp1251", "mac_roman"),
    ("koi8_r", "cp1251"), ("koi8_r", "cp1252"), ("koi8_r", "cp866"), ("cp866", "cp1251"), ("cp866", "cp1252"),
    ("cp866", "koi8_r"), ("cp1256", "cp1252"), ("iso8859_6", "cp1252"), ("gb18030", "cp1252"), ("big5", "cp1252"),
    ("cp932", "cp1252"), ("euc_jp", "cp1252"), ("cp932", "gb18030"), ("gb18030", "cp932"),
    ("big5", "gb18030"), ("cp1252", "utf-8"),
)
LOST = len(PAIRS) - 1  # bytes of another encoding read as UTF-8: what remains is U+FFFD
ENTER, STAY, LEAVE = -4.5, -0.03, -2.0
MIN_GAIN, MIN_RATIO = 3.0, 6.0
CYRILLIC = ("cp1251", "koi8_r", "cp866")
SPAN_SCHEMA = "render_id bigint, start int, stop int, garbled string, restored string, true_encoding string, read_as string, restorable boolean"


def _as_bytes(s: str, codec: str) -> bytes:
    """Encode; bytes the single-byte code pages leave undefined stand as C1 controls, the web's way."""
    try:
        return s.encode(codec)
    except UnicodeEncodeError:
        out = bytearray()
        for c in s:
            if 0x80 <= ord(c) < 0xA0:
                out.append(ord(c))
            else:
                try:
                    out += c.encode(codec)
                except UnicodeEncodeError:
                    if codec in ("cp1252", "cp1250") and ord(c) < 256:
                        out.append(ord(c))
                    elif c == "\ufffd":
                        out.append(0xFF)
                    else:
                        raise
        return bytes(out)


def _as_text(b: bytes, codec: str) -> str:
    """Decode; undefined bytes of a code page become C1 controls, broken sequences U+FFFD."""
    if codec in ("cp1252", "cp1250", "cp1251", "cp1253"):
        out = []
        for x in b:
            try:
                out.append(bytes((x,)).decode(codec))
            except UnicodeDecodeError:
                out.append(chr(x))
        return "".join(out)
    return b.decode(codec, "replace")


def garble(text: str, k: int) -> str | None:
    """What pair ``k`` makes of a clean text, or None where the true encoding cannot hold it."""
    true, read = PAIRS[k]
    try:
        if true.endswith(" twice"):
            once = _as_text(text.encode("utf-8"), read)
            return _as_text(once.encode("utf-8"), read)
        return _as_text(text.encode(true), read)
    except UnicodeEncodeError:
        return None


def ungarble(span: str, k: int) -> tuple[str, int] | None:
    """The inverse of pair ``k`` and the number of places it could not decode; None if it cannot apply."""
    true, read = PAIRS[k]
    if k == LOST:
        return None
    try:
        raw = _as_bytes(span, read)
        if true.endswith(" twice"):
            raw = _as_bytes(raw.decode("utf-8"), read)
            true = "utf-8"
    except (UnicodeEncodeError, UnicodeDecodeError):
        return None
    out = raw.decode(true, "replace")
    return out, out.count("\ufffd")


def contexts(codes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """12 kinds of neighbourhood of the characters at ``at``: ASCII letters beside a character are evidence too."""
    n = len(codes)
    prev = np.where(at > 0, codes[np.maximum(at - 1, 0)], 10)
    nxt = np.where(at < n - 1, codes[np.minimum(at + 1, n - 1)], 10)
    lower = lambda c: (c >= 97) & (c <= 122)
    upper = lambda c: (c >= 65) & (c <= 90)
    left = np.where(prev > 127, 0, np.where(lower(prev) | upper(prev), 1, 2))
    right = np.where(nxt > 127, 0, np.where(lower(nxt), 1, np.where(upper(nxt), 2, 3)))
    return left * 4 + right


N_CTX = 12
MARKS = "“”‘’«»„…–—©°¿¡"  # marks of ordinary prose that few samples hold
SYMBOLS = "£€¥°§±×½¼¾©®™•·²³ªº¢µ†‡¶→←↑↓★☆♪№℃"  # symbols that stand correctly in prose
_SAME = str.maketrans({"“": '"', "”": '"', "„": '"', "«": '"', "»": '"', "’": "'", "‘": "'", "‚": "'", "–": "-", "—": "-", "¬": "-", "\n": " ", "…": ".", "\u00a0": " ", "\u2007": " ", "\u202f": " ", "\u3000": " ", "\u00ad": None, "\u200b": None, "\u200c": None, "\u200d": None, "\u2060": None, "\ufeff": None, "\u180e": None})


def typographic(text: str) -> str:
    """A text with its straight marks as printers set them: samples that lack these marks say nothing of their garbled forms."""
    text = re.sub(r'"([^"\n]*)"', "\u201c\\1\u201d", text)
    return re.sub(r"(?<=\w)'(?=\w)", "\u2019", text)


# Forms of the samples that are counted, and their weights: as they are, in capitals, with printers' marks.
FORMS = (1.0, 0.1, 0.5)
UNI, BI = 2 * len(FORMS), 2 * len(FORMS) + 1  # kinds of counts after the characters and the sizes of each form
COUNT_SCHEMA = "lang string, kind int, state int, key bigint, n bigint"


def tally(lang: str, texts: list[str]) -> Iterator[tuple[str, int, int, np.ndarray, np.ndarray]]:
    """(language, kind, state, keys, counts) of clean texts of one language; counts of parts of a table add up to those of the whole.

    Kind ``f`` counts the characters of form ``f`` with their neighbourhoods, in state 0 as they are, in state j as pair j - 1 makes them;
    kind ``len(FORMS) + f`` holds sizes: the length, and in state 0 the lines that the form changes, else those the pair cannot hold.
    """
    plain = "\n".join(texts)
    t = f"\n{plain}\n".translate(_SAME)
    codes = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    yield "", UNI, 0, *np.unique(codes[1:], return_counts=True)
    yield "", BI, 0, *np.unique(codes[:-1] << 21 | codes[1:], return_counts=True)
    for f, s in enumerate((plain, plain.upper(), typographic(plain))):
        for j in range(len(PAIRS) + 1):
            g, odd = (s, int(s != plain)) if j == 0 else (garble(s, j - 1), 0)
            if g is None:  # some character is not in the true encoding: take the lines that are
                lines = [garble(y, j - 1) for y in s.split("\n")]
                g, odd = "\n".join(x for x in lines if x), lines.count(None)
            yield lang, len(FORMS) + f, j, np.arange(2), np.array([len(g) + bool(g), odd])
            codes = np.frombuffer(g.encode("utf-32-le", "surrogatepass"), "<u4")
            at = np.flatnonzero(codes > 127)
            if len(at):
                yield lang, f, j, *np.unique(codes[at].astype(np.int64) * N_CTX + contexts(codes, at), return_counts=True)


class Model:
    """Emission tables of the HMM and the clean-text bigram model, from the counts of clean samples (``tally``), summed.

    A state's emission of a character with its neighbourhood is its likelihood in the sample language
    that fits best, in the clean state as in the others, so that no state wins by being of one language.
    """

    def __init__(self, tallies: dict[tuple[str, int, int], tuple[np.ndarray, np.ndarray]]):
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys, n = tallies.get(("", UNI, 0), none)
        self.uni = Counter(dict(zip(map(chr, keys.tolist()), n.tolist())))
        keys, n = tallies.get(("", BI, 0), none)
        self.bi = Counter({(chr(k >> 21), chr(k & 0x1FFFFF)): x for k, x in zip(keys.tolist(), n.tolist())})
        counts: list[dict[str, Counter]] = [{} for _ in range(len(PAIRS) + 1)]
        for lang, kind, j in sorted(tallies):
            if kind >= len(FORMS):
                continue
            size, odd = tallies[lang, len(FORMS) + kind, j][1]
            whole, changed = tallies[lang, len(FORMS) + kind, 0][1]
            if kind and not changed or j and odd and size < 0.3 * whole:
                continue
            keys, n = tallies[lang, kind, j]
            if j:  # a pair that leaves a language as it is has nothing to tell about it
                own, other = (_by_char(*tallies.get((lang, kind, i), none)) for i in (0, j))
                if sum((own & other).values()) > 0.5 * sum(own.values()):
                    continue
            c = counts[j].setdefault(lang, Counter())
            for key, x in zip(keys.tolist(), n.tolist()):
                c[key] += FORMS[kind] * x
        for c in counts[0].values():
            total = sum(c.values())
            for mark in MARKS + SYMBOLS + "\u00a0\u00ad\u00ac":
                c[ord(mark) * N_CTX] += 0.001 * total
        chars = sorted({key // N_CTX for group in counts for c in group.values() for key in c})
        self.chars = chars
        v, kinds = len(chars), 6
        at_ = {c: i for i, c in enumerate(chars)}
        emit = np.full((v + kinds, N_CTX, len(PAIRS) + 1), 1e-9)
        for j, group in enumerate(counts):
            wide = j > 0 and PAIRS[j - 1][1] in ("gb18030", "cp932", "big5")
            floor = 2e-6 if wide else 2e-5
            for c in group.values():
                total = sum(c.values())
                m = np.zeros((v, N_CTX))
                for key, x in c.items():
                    m[at_[key // N_CTX], key % N_CTX] = x
                n = m.sum(1, keepdims=True)
                ctx = (m.sum(0) + 1) / (total + N_CTX)
                p = (n / (total + 20)) * (m + 3 * ctx) / (n + 3)
                emit[:v, :, j] = np.maximum(emit[:v, :, j], p)
            emit[:, :, j] = np.maximum(emit[:, :, j], floor / N_CTX)
        # letters the clean samples lack stay likely there, by kind of character
        clean_unseen = (1e-3, 1e-3, 1e-3, 1e-4, 2e-5, 1e-7)  # latin letter, other alphabet, han/kana, mark, symbol, control/private
        sampled = {key // N_CTX for c in counts[0].values() for key in c}
        for i, c in enumerate(chars):
            if c not in sampled:
                emit[i, :, 0] = clean_unseen[_kind(c)] / N_CTX
        for i in range(kinds):
            emit[v + i, :, 0] = clean_unseen[i] / N_CTX
            for j in range(1, len(PAIRS) + 1):
                if PAIRS[j - 1][1] in ("gb18030", "cp932", "big5"):
                    emit[v + i, :, j] = (1e-6, 1e-6, 3e-4, 1e-6, 1e-5, 1e-4)[i] / N_CTX
        for c in MARKS:
            emit[at_[ord(c)], :, 0] = np.maximum(emit[at_[ord(c)], :, 0], 0.012)
        for c in SYMBOLS + "\u00a0\u00ad\u00ac":
            emit[at_[ord(c)], :, 0] = np.maximum(emit[at_[ord(c)], :, 0], 0.0006)
        fffd = at_.get(0xFFFD)
        if fffd is not None:
            emit[fffd, :, 0] = 1e-7
        self.emit = np.log(emit).reshape((v + kinds) * N_CTX, -1).astype(np.float32)
        for c in SYMBOLS:
            self.uni[c] += 40
        self.total = sum(self.uni.values())
        self.cache: dict[tuple[str, str], float] = {}

    def table(self) -> np.ndarray:
        """Code point -> number of the character in ``emit``."""
        v = len(self.chars)
        out = np.full(0x110000, v + 4, np.int32)
        for lo, hi, kind in _KINDS:
            out[lo:hi] = v + kind
        out[self.chars] = np.arange(v)
        return out

    def score(self, s: str) -> float:
        """Log probability of a string under the clean bigram model; quotation marks and dashes count as one."""
        s = s.translate(_SAME)
        out, cache = 0.0, self.cache
        for pair in zip(s, s[1:]):
            p = cache.get(pair)
            if p is None:
                a, b = pair
                u = max((self.uni.get(b, 0) + (0.05 if b.isalpha() else 0.005)) / (self.total + 50), 1e-5 if ord(b) < 128 else 0)
                p = cache[pair] = math.log((self.bi.get(pair, 0) + 4 * u) / (self.uni.get(a, 0) + 4))
            out += p
        return out


# Blocks by kind (0 latin letter, 1 other alphabet, 2 han/kana, 3 mark, 4 symbol, 5 control/private).
_KINDS = (
    (0x80, 0xA0, 5), (0xC0, 0x250, 0), (0x300, 0x370, 3), (0x370, 0x590, 1), (0x590, 0x1200, 1), (0x1E00, 0x1F00, 0),
    (0x2000, 0x2070, 3), (0x3000, 0x3100, 2), (0x3400, 0xA000, 2), (0xAC00, 0xD7B0, 2), (0xE000, 0xF900, 5),
    (0xFF00, 0xFF61, 2), (0xFF61, 0xFFA0, 4), (0xFFFD, 0xFFFE, 5), (0x20000, 0x32000, 2),
)


def _kind(o: int) -> int:
    for lo, hi, kind in _KINDS:
        if lo <= o < hi:
            return kind
    return 4


class Decoder:
    """Labels texts with a fitted model; one per Python worker."""

    def __init__(self, model: Model):
        self.m, self.lut = model, model.table()
        self.gain = model.emit[:, 1:] - model.emit[:, :1]
        self.pos = np.maximum(self.gain, 0)

    def labels(self, texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(index of text, positions of its non-ASCII characters, their states with 0 clean, their rows in ``emit``), for texts with any span."""
        if not texts:
            return
        codes = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
        ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
        at = np.flatnonzero(codes > 127)
        if not len(at):
            return
        ids = self.lut[codes[at]] * N_CTX + contexts(codes, at)
        row = np.searchsorted(ends, at, "right")
        cut = np.flatnonzero(np.diff(row, prepend=-1))
        rows, sizes = row[cut], np.diff(np.append(cut, len(row)))
        # a span needs a total gain beyond the price of entering and leaving: most texts end here
        need = -(ENTER + LEAVE)
        live = np.zeros(len(cut), bool)
        step = max(1, 400_000 // max(1, int(sizes.mean())))
        for i in range(0, len(cut), step):
            hi = cut[i + step] if i + step < len(cut) else len(ids)
            s = np.add.reduceat(self.pos[ids[cut[i] : hi]], cut[i : i + step] - cut[i], axis=0)
            live[i : i + step] = s.max(1) > need
        todo = np.flatnonzero(live)
        todo = todo[np.argsort(sizes[todo], kind="stable")]
        i = 0
        while i < len(todo):
            j, longest = i, 0
            while j < len(todo) and (j - i + 1) * max(longest, sizes[todo[j]]) <= 150_000:
                longest = max(longest, int(sizes[todo[j]]))
                j += 1
            j = max(j, i + 1)
            part = todo[i:j]
            longest = int(sizes[part].max())
            obs = np.full((longest, len(part)), -1, np.int64)
            for n, r in enumerate(part):
                obs[: sizes[r], n] = ids[cut[r] : cut[r] + sizes[r]]
            path = self._viterbi(obs)
            for n, r in enumerate(part):
                p = path[: sizes[r], n]
                if p.any():
                    r0 = rows[r]
                    begin = ends[r0] - len(texts[r0]) - 1
                    part_ids = slice(cut[r], cut[r] + sizes[r])
                    yield int(r0), at[part_ids] - begin, p, ids[part_ids]
            i = j

    def _viterbi(self, obs: np.ndarray) -> np.ndarray:
        """Best state paths, all columns at once; a garbled state is entered from and left to clean only."""
        steps, n = obs.shape
        k = self.gain.shape[1]
        stay = np.zeros((steps, n, k), bool)
        origin = np.zeros((steps, n), np.int16)
        c = np.zeros(n, np.float32)
        g = np.full((n, k), -1e9, np.float32)
        for t in range(steps):
            seen = obs[t] >= 0
            e = self.gain[np.where(seen, obs[t], 0)]
            e[~seen] = 0
            enter = (c + ENTER)[:, None]
            keep = g + STAY
            stay[t] = keep >= enter
            best = g.argmax(1)
            out = g[np.arange(n), best] + LEAVE
            leaves = out > c
            origin[t] = np.where(leaves, best + 1, 0)
            g = np.maximum(keep, enter) + e
            c = np.where(leaves, out, c)
        path = np.zeros((steps, n), np.int16)
        final = np.where(g.max(1) + LEAVE > c, g.argmax(1) + 1, 0)
        state = final.astype(np.int64)
        idx = np.arange(n)
        for t in range(steps - 1, -1, -1):
            path[t] = state
            bad = state > 0
            st = stay[t][idx, np.maximum(state - 1, 0)]
            state = np.where(bad, np.where(st, state, 0), origin[t])
        return path

    def spans(self, texts: list[str]) -> Iterator[tuple[int, int, int, str | None, int]]:
        """(index, start, stop, restored or None, pair) of every accepted span."""
        for i, at, path, ids in self.labels(texts):
            t = texts[i]
            edge = np.flatnonzero(np.diff(path, prepend=0) != 0)
            edge = [*edge.tolist(), len(path)]
            for a, b in zip(edge, edge[1:]):
                k = int(path[a]) - 1
                if k < 0:
                    continue
                ratio = self.gain[ids[a:b]].sum(0)
                found = self.judge(t, int(at[a]), int(at[b - 1]) + 1, k, ratio, b - a)
                if found:
                    yield (i, *found)

    def judge(self, t: str, start: int, stop: int, k: int, ratio: np.ndarray, events: int) -> tuple[int, int, str | None, int] | None:
        """The exact check after the model: the inverse must hold and read better than what stands there."""
        if k == LOST:
            return (start, stop, None, k) if "\ufffd" in t[start:stop] else None
        if ratio[k] < MIN_RATIO:
            return None
        best = None
        piece = t[start:stop]
        order = [k] + [j for j in np.argsort(-ratio)[:5].tolist() if j not in (k, LOST) and ratio[j] > 0.5 * ratio[k]]
        old: dict[tuple[int, int], float] = {}
        for j in order:
            multi = PAIRS[j][0] in ("cp932", "big5", "gb18030", "euc_jp")
            for a in (start, start - 1) if multi else (start,):
                for b in (stop, stop + 1) if stop < len(t) and t[stop] != "\n" and (multi or "utf-8" in PAIRS[j][0]) else (stop,):
                    if a < 0:
                        continue
                    back = ungarble(t[a:b], j)
                    if back is None or back[0] == t[a:b]:
                        continue
                    s, lost = back
                    if lost > 0.12 * events and lost > t[a:b].count("\ufffd"):
                        continue
                    bad = sum(0x80 <= ord(c) < 0xA0 or 0xE000 <= ord(c) < 0xF900 for c in s)
                    if len(s) == b - a and 2 * sum(x != y for x, y in zip(s, t[a:b])) < events:
                        continue  # an inverse that leaves most characters as they are explains nothing
                    if (a, b) not in old:
                        old[a, b] = self.m.score(t[max(0, a - 1) : b + 1])
                    new = self.m.score(t[max(0, a - 1) : a] + s + t[b : b + 1]) - 7 * (lost + bad)
                    gain = new - old[a, b]
                    if PAIRS[j][0] in CYRILLIC and PAIRS[j][1] in CYRILLIC:  # capitals alone prove nothing
                        gain = min(gain, self.m.score(s.lower()) - self.m.score(t[a:b].lower()))
                    single = PAIRS[j][0] not in ("utf-8", "utf-8 twice") and not multi
                    least = (25.0 if PAIRS[j][1] in CYRILLIC else 10.0) if single and PAIRS[j][0] in CYRILLIC else MIN_GAIN
                    if gain > least and (best is None or gain > best[0]):
                        best = (gain, a, b, None if lost or bad else s, j, new)
        if best:
            if events <= 6:  # a lone letter of another script, or a compatibility form, may only pass for an ordinary one
                for twin in (piece.translate(LATIN_TWIN), unicodedata.normalize("NFKC", piece)):
                    if twin != piece and self.m.score(t[max(0, start - 1) : start] + twin + t[stop : stop + 1]) > best[5] - 2:
                        return None
            return best[1:5]
        # bytes that are gone (dropped controls, U+FFFD): the traces themselves are proof enough
        traces = sum(0x80 <= ord(c) < 0xA0 or 0xE000 <= ord(c) < 0xF900 or c == "\ufffd" for c in piece)
        return (start, stop, None, k) if traces >= 2 else None


def _by_char(keys: np.ndarray, n: np.ndarray) -> Counter:
    """Counts of characters in any neighbourhood."""
    out: Counter = Counter()
    for key, x in zip((keys // N_CTX).tolist(), n.tolist()):
        out[key] += x
    return out


def fit(samples: DataFrame) -> Model:
    """Fit on all (lang, text) of a table of clean samples: counted where the rows are, so only sums reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            by: dict[str, list[str]] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                parts = list(tally(lang, texts))
                sizes = [len(keys) for *_, keys, _ in parts]
                cols = [np.repeat(np.array([x[i] for x in parts]), sizes) for i in range(3)]
                cols += [np.concatenate([x[i] for x in parts]) for i in (3, 4)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64()))], names=["lang", "kind", "state", "key", "n"])

    rows = samples.select(F.coalesce("lang", F.lit("")).alias("lang"), "text").where("text <> ''")
    table = spread(rows).mapInArrow(run, COUNT_SCHEMA).groupBy("lang", "kind", "state", "key").agg(F.sum("n").alias("n"))
    sums = table.groupBy("lang", "kind", "state").agg(F.sort_array(F.collect_list(F.struct("key", "n"))).alias("c"))
    c = F.col("c")
    out = sums.select("lang", "kind", "state", c["key"].alias("keys"), c["n"].alias("counts")).toArrow()
    lists = [[x.values.to_numpy() for x in out.column(k)] for k in (3, 4)]
    return Model(dict(zip(zip(*(out.column(k).to_pylist() for k in range(3))), zip(*lists))))


_DECODERS: dict[int, Decoder] = {}


def decoder(model: Model) -> Decoder:
    """The worker's decoder for a model, built once."""
    key = id(model)
    if key not in _DECODERS:
        _DECODERS.clear()
        _DECODERS[key] = Decoder(model)
    return _DECODERS[key]


def garbled_rows(df: DataFrame, model: Model, id_col: str = "render_id", text_col: str = "text") -> DataFrame:
    """Ids of rows with at least one garbled span. Repeated rows give one id each time; callers take distinct ids."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = decoder(shared.value)
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            hit = dict.fromkeys(i for i, *_ in d.spans(texts))
            yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in hit], pa.int64())], names=["row_id"])

    src = df.select(F.col(id_col).cast("long").alias("row_id"), F.col(text_col).alias("text")).where(F.col("text").rlike("[^\\x00-\\x7F]"))
    return src.mapInArrow(run, "row_id bigint")


def restore(df: DataFrame, model: Model, id_col: str = "render_id", text_col: str = "text") -> DataFrame:
    """Per garbled row: the text with every restorable span given back, the spans' number and encodings.

    Columns: row_id, restored_text, n_spans, n_restored, pairs.  Rows without a span are not returned.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    names = ["row_id", "restored_text", "n_spans", "n_restored", "pairs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = decoder(shared.value)
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            by: dict[int, list] = {}
            for i, *span in d.spans(texts):
                by.setdefault(i, []).append(span)
            out = [[], [], [], [], []]
            for i, spans in by.items():
                t, pairs = texts[i], set()
                for start, stop, s, k in sorted(spans, key=lambda x: -x[0]):
                    pairs.add(f"{PAIRS[k][0]} as {PAIRS[k][1]}")
                    if s is not None:
                        t = t[:start] + s + t[stop:]
                for col, x in zip(out, (ids[i], t, len(spans), sum(x[2] is not None for x in spans), ", ".join(sorted(pairs)))):
                    col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.int32()), pa.array(out[4], pa.string())], names=names)

    src = df.select(F.col(id_col).cast("long").alias("row_id"), F.col(text_col).alias("text")).where(F.col("text").rlike("[^\\x00-\\x7F]"))
    return src.mapInArrow(run, "row_id bigint, restored_text string, n_spans int, n_restored int, pairs string")
