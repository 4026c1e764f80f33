"""Problem 7: passages of evaluation items inside a training corpus.

A distributed positional inverted index: the corpus is cut into segments (the batches of its
partitions), and each segment stores every term of its documents, in order, with the delta-coded
places of its tokens.  The index knows nothing of the items: it is written as a table once, and any set
of items is searched in it without another pass over the texts.  Document frequencies of the test terms
are summed from it, and a search intersects offset-adjusted posting lists, rarest test terms first.

Terms are words (runs of letters and digits, case ignored), and single letters or digits for items in
scripts written without spaces; those are indexed for documents that hold such a script, or, where an
item has a passage without one, for all (``chars="all"``).  Items are searched in blocks of at most
``MAX_QUERY_CHARS``, whose number follows their size.

Defined results: null and empty documents or items match nothing; items shorter than the least
passage match nothing exactly; repeated rows of a document give one row.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliowright.session import shared_path

WORDS, CHARS = 16, 24  # least passage in words, and in letters of scripts without spaces
MISSES = 3  # terms of a least passage that a proximity match may lack
NEAR = 3  # rarest terms of a window whose lists are intersected before the rest is looked at
UNSPACED = ("zh", "ja")
MAX_QUERY_CHARS = 20_000_000  # characters of the items that are searched at once
SEGMENT_CHARS = 3_000_000  # characters of a segment; documents are never split
STRIDE = 1 << 32  # a posting is document number * STRIDE + position
INDEX_SCHEMA = "segment bigint, kind string, docs array<bigint>, starts binary, terms binary, counts binary, postings binary"
MATCH_SCHEMA = "doc_id bigint, item_id bigint, longest int, item_from int, doc_from int, kind string"


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per code point: its case-folded form, whether it is a letter or digit, and a random 64-bit value of that form."""
    n = 0x110000
    fold = np.arange(n, dtype=np.uint32)
    alnum = np.zeros(n, bool)
    for o in range(0x32000):  # no letters or digits beyond
        if 0xD800 <= o < 0xE000:
            continue
        c = chr(o)
        alnum[o] = c.isalnum()
        f = c.casefold()
        if len(f) == 1:
            fold[o] = ord(f)
    value = np.random.default_rng(20240229).integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return fold, alnum, value[fold]


BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


@lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up = np.cumprod(np.full(n, BASE, np.uint64))
        down = np.cumprod(np.full(n, BASE_INVERSE, np.uint64))
    return up, down


BLOCK = 1 << 22


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def unfolded(text: str) -> str:
    """Letters whose case-folding has several characters, written out."""
    return text.replace("ß", "ss").replace("ẞ", "ss") if "ß" in text or "ẞ" in text else text


def word_hashes(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and 64-bit hash of every run of letters and digits, case ignored; all in vector operations."""
    _, alnum, value = _tables()
    starts, hashes = [], []
    at = 0
    while at < len(codes):
        stop = min(len(codes), at + BLOCK)
        while stop < len(codes) and alnum[codes[stop]] and alnum[codes[stop - 1]] and stop - at < 2 * BLOCK:
            stop += 1
        part = codes[at:stop]
        word = alnum[part]
        edge = np.diff(word.astype(np.int8), prepend=0, append=0)
        a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        up, down = _powers(2 * BLOCK + 2)
        with np.errstate(over="ignore"):
            s = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value[part] * up[: len(part)])])
            hashes.append((s[b] - s[a]) * down[a])
        starts.append(a + at)
        at = stop
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(starts), np.concatenate(hashes)


def terms_of(text: str, chars: bool) -> list[int]:
    """The terms of a text in order: hashes of words, or folded code points."""
    codes = codes_of(unfolded(text))
    if not chars:
        return word_hashes(codes)[1].tolist()
    fold, alnum, _ = _tables()
    return fold[codes[alnum[codes]]].tolist()


def _han(codes: np.ndarray) -> np.ndarray:
    return ((codes >= 0x3040) & (codes < 0x3100)) | ((codes >= 0x3400) & (codes < 0xA000))


class Query:
    """The items as sequences of term numbers."""

    def __init__(self, items: list[tuple[int, str, str]]):
        vocab: dict[tuple[bool, int], int] = {}
        self.items: list[tuple[int, bool, np.ndarray]] = []
        self.only_han = True  # whether every least passage of characters holds one that only unspaced scripts have
        for item_id, lang, text in items:
            chars = lang in UNSPACED
            raw = terms_of(text or "", chars)
            self.items.append((item_id, chars, np.array([vocab.setdefault((chars, t), len(vocab)) for t in raw], np.int32)))
            if chars:
                han = _han(np.array(raw, np.uint32)).astype(int)
                run = np.convolve(han, np.ones(CHARS, int), "valid") if len(han) >= CHARS else np.ones(1, int)
                self.only_han &= bool((run > 0).all())
        self.size = len(vocab)
        by_kind = {False: [], True: []}
        for (chars, t), i in vocab.items():
            by_kind[chars].append((t, i))
        self.hashes = {k: np.array([t for t, _ in sorted(v)], np.uint64) for k, v in by_kind.items()}
        self.numbers = {k: np.array([i for _, i in sorted(v)], np.int64) for k, v in by_kind.items()}

    def plan(self, df: np.ndarray) -> list[list[tuple[int, ...]]]:
        """Per item the sets of offsets to start from: the rarest terms of each window of the least length."""
        out = []
        for _, chars, ts in self.items:
            w = CHARS if chars else WORDS
            cost = df[ts]
            sets: dict[tuple[int, ...], None] = {}
            for i in range(len(ts) - w + 1):
                window = cost[i : i + w]
                if window.min() == 0:  # a term the corpus lacks: no match covers this window
                    continue
                if sets and (last := next(reversed(sets)))[0] >= i and max(last) < i + w:
                    continue  # the set chosen before lies in this window too
                sets[tuple(sorted((i + np.argsort(window, kind="stable")[:NEAR]).tolist()))] = None
            out.append(list(sets))
        return out


    def near_plan(self, df: np.ndarray, misses: int) -> list[list[tuple[int, ...]]]:
        """Per item the sets of offsets for proximity: ``misses + 2`` rarest terms of each window, of which two must agree."""
        out = []
        for _, chars, ts in self.items:
            w = CHARS if chars else WORDS
            cost = df[ts]
            sets: dict[tuple[int, ...], None] = {}
            for i in range(len(ts) - w + 1):
                if (cost[i : i + w] == 0).sum() > misses:
                    continue
                if sets and (last := next(reversed(sets)))[0] >= i and last[-1] < i + w:
                    continue
                sets[tuple(sorted((i + np.argsort(cost[i : i + w], kind="stable")[: misses + 2]).tolist()))] = None
            out.append(list(sets))
        return out


def blocks(items: DataFrame) -> list[DataFrame]:
    """The items in as many parts as their size asks for; each part fits a task."""
    own = items.select(F.col("item_id").cast("long").alias("item_id"), "lang", "text").where("item_id is not null")
    size = own.agg(F.sum(F.length("text"))).first()[0] or 0
    n = size // MAX_QUERY_CHARS + 1
    return [own] if n == 1 else [own.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) for k in range(n)]


def read_items(items: DataFrame) -> Query:
    rows = items.select(F.col("item_id").cast("long"), "lang", "text").where("item_id is not null").distinct().orderBy("item_id", "lang", "text").collect()
    return Query([tuple(r) for r in rows])


def _pack(d: np.ndarray) -> bytes:
    """Gaps in two bytes each, larger ones beside."""
    big = np.flatnonzero(d > 0xFFFF)
    small = np.where(d > 0xFFFF, 0, d).astype("<u2")
    return len(big).to_bytes(4, "little") + big.astype("<u4").tobytes() + d[big].astype("<u4").tobytes() + small.tobytes()


def _unpack(b: bytes) -> np.ndarray:
    n = int.from_bytes(b[:4], "little")
    big = np.frombuffer(b, "<u4", n, 4)
    gaps = np.frombuffer(b, "<u4", n, 4 + 4 * n)
    d = np.frombuffer(b, "<u2", offset=4 + 8 * n).astype(np.int64)
    d[big] = gaps
    return d


def _inverted(doc: np.ndarray, term: np.ndarray, n_docs: int) -> tuple[bytes, bytes, bytes, bytes]:
    """(first token of each document, terms, their counts, gaps between their places) of a segment's tokens in order."""
    starts = np.searchsorted(doc, np.arange(n_docs + 1))
    order = np.argsort(term, kind="stable")
    sorted_ = term[order]
    cuts = np.flatnonzero(np.diff(sorted_, prepend=sorted_[:1] ^ np.uint64(1))) if len(term) else np.zeros(0, np.int64)
    gaps = np.diff(order, prepend=0)
    gaps[cuts] = order[cuts]  # a term's first place stands whole
    counts = np.diff(np.append(cuts, len(term)))
    return starts.astype("<u4").tobytes(), sorted_[cuts].astype("<u8").tobytes(), counts.astype("<u4").tobytes(), _pack(gaps)


def _segment(texts: list[str], every: bool) -> Iterator[tuple[str, list[int], tuple[bytes, bytes, bytes, bytes]]]:
    """Of a segment: (kind, which of its documents, the inverted lists), words first."""
    joined = [unfolded(t) for t in texts]
    codes = codes_of("\n".join(joined))
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in joined), np.int64, len(joined)))
    start, h = word_hashes(codes)
    yield "words", list(range(len(texts))), _inverted(np.searchsorted(ends, start, "right"), h, len(texts))
    fold, alnum, _ = _tables()
    at = np.flatnonzero(alnum[codes])
    doc = np.searchsorted(ends, at, "right")
    held = np.ones(len(texts), bool)
    if not every:
        held[:] = False
        held[np.unique(np.searchsorted(ends, np.flatnonzero(_han(codes)), "right"))] = True
    keep = held[doc]
    number = np.cumsum(held) - 1
    if keep.any():
        yield "chars", np.flatnonzero(held).tolist(), _inverted(number[doc[keep]], fold[codes[at[keep]]].astype(np.uint64), int(held.sum()))


def build_index(docs: DataFrame, chars: str = "unspaced", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index: for each segment and kind of term its documents and inverted lists."""
    every = chars == "all"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, count = TaskContext.get().partitionId(), 0
        ids: list[int] = []
        texts: list[str] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal count
            rows = [((part << 32) + count, kind, [ids[i] for i in held], *lists) for kind, held, lists in _segment(texts, every)]
            count += 1
            ids.clear()
            texts.clear()
            types = (pa.int64(), pa.string(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], x) for k, x in enumerate(types)], names=["segment", "kind", "docs", "starts", "terms", "counts", "postings"])

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids.append(i)
                texts.append(t)
                size += len(t)
                if size >= SEGMENT_CHARS:
                    yield flush()
                    size = 0
        if ids:
            yield flush()

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return src.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & (F.length("text") > 0)).mapInArrow(run, INDEX_SCHEMA)


class Lists:
    """The posting lists of a query's terms in one segment, decoded when they are first used."""

    def __init__(self, q: Query, chars: bool, starts: bytes, terms: bytes, counts: bytes, postings: bytes | None = None):
        own = np.frombuffer(terms, "<u8")
        self.counts = np.frombuffer(counts, "<u4").astype(np.int64)
        want = q.hashes[chars]
        j = np.searchsorted(own, want)
        ok = np.zeros(len(want), bool)
        inside = j < len(own)
        ok[inside] = own[j[inside]] == want[inside]
        self.at = dict(zip(q.numbers[chars][ok].tolist(), j[ok].tolist()))
        self.ends = np.cumsum(self.counts)
        self.starts = np.frombuffer(starts, "<u4").astype(np.int64)
        self.postings = postings
        self.gaps: np.ndarray | None = None
        self.cache: dict[int, np.ndarray] = {}

    def __contains__(self, t: int) -> bool:
        return t in self.at

    def size(self, t: int) -> int:
        return int(self.counts[self.at[t]])

    def of(self, t: int) -> np.ndarray:
        """Documents and positions of a term, ascending."""
        if t not in self.cache:
            if self.gaps is None:
                self.gaps = _unpack(self.postings)
            end = int(self.ends[self.at[t]])
            token = np.cumsum(self.gaps[end - self.size(t) : end])
            doc = np.searchsorted(self.starts, token, "right") - 1
            self.cache[t] = doc * STRIDE + token - self.starts[doc]
        return self.cache[t]


def _segments(q: Query, b: pa.RecordBatch) -> Iterator[tuple[bool, list[int], Lists]]:
    """(whether of characters, documents, lists) of the segments of a batch that hold terms of the query."""
    for kind, docs, starts, terms, counts, postings in zip(*(b.column(k) for k in range(6))):
        chars = kind.as_py() == "chars"
        if len(q.hashes[chars]):
            lists = Lists(q, chars, starts.as_py(), terms.as_py(), counts.as_py(), postings.as_py())
            if lists.at:
                yield chars, docs.as_py(), lists


_COLUMNS = ("kind", "docs", "starts", "terms", "counts", "postings")


def frequencies(index: DataFrame, query: Query) -> np.ndarray:
    """Postings of each query term in the whole corpus; as many numbers as the items have terms."""
    shared = index.sparkSession.sparkContext.broadcast(query)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shared.value.size, np.int64)
        for b in batches:
            for kind, starts, terms, counts in zip(*(b.column(k) for k in range(4))):
                lists = Lists(shared.value, kind.as_py() == "chars", starts.as_py(), terms.as_py(), counts.as_py())
                for t, j in lists.at.items():
                    total[t] += lists.counts[j]
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["term", "n"])

    out = np.zeros(query.size, np.int64)
    for term, n in index.select("kind", "starts", "terms", "counts").mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n")).collect():
        out[term] = n
    return out


def _within(p: np.ndarray, want: np.ndarray) -> np.ndarray:
    j = np.searchsorted(p, want)
    j[j == len(p)] = len(p) - 1
    return p[j] == want


def search(index: DataFrame, query: Query, plan: list[list[tuple[int, ...]]], least_words: int = WORDS, least_chars: int = CHARS) -> DataFrame:
    """Documents with a run of an item's terms: the longest run of each document and item.

    Within a segment the lists of a window's rarest terms, shifted by their offsets, are intersected;
    each alignment that is left is followed through the lists of all the item's terms.
    """
    shared = index.sparkSession.sparkContext.broadcast((query, plan))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, sets = shared.value
        names = ["doc_id", "item_id", "longest", "item_from", "doc_from", "kind"]
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string())
        for b in batches:
            for kind, ids, lists in _segments(q, b):
                rows = list(_search(q, sets, kind, ids, lists, least_words, least_chars))
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate(types)], names=names)

    return index.select(*_COLUMNS).mapInArrow(run, MATCH_SCHEMA)


def _search(q: Query, sets: list[list[tuple[int, ...]]], kind: bool, ids: list[int], lists: Lists, least_words: int, least_chars: int) -> Iterator[tuple]:
    of = lists.of
    for (item_id, chars, ts), own in zip(q.items, sets):
        if chars != kind:
            continue
        least = least_chars if chars else least_words
        found = []
        for offsets in own:
            terms = [int(ts[i]) for i in offsets]
            if not all(t in lists for t in terms):
                continue
            order = sorted(range(len(offsets)), key=lambda i: lists.size(terms[i]))
            diag = of(terms[order[0]]) - offsets[order[0]]
            for i in order[1:]:
                diag = diag[_within(of(terms[i]), diag + offsets[i])]
                if not len(diag):
                    break
            if len(diag):
                found.append(diag)
        if not found:
            continue
        diag = np.unique(np.concatenate(found))
        hit = np.zeros((len(ts), len(diag)), bool)
        for i, t in enumerate(ts.tolist()):
            if t in lists:
                hit[i] = _within(of(t), diag + i)
        longest, start = _runs(hit)
        for d in np.flatnonzero(longest >= least):
            k = int(diag[d]) + int(start[d])
            yield ids[k // STRIDE], item_id, int(longest[d]), int(start[d]) + 1, k % STRIDE + 1, "chars" if chars else "words"


def search_near(index: DataFrame, query: Query, plan: list[list[tuple[int, ...]]], misses: int) -> DataFrame:
    """Passages with at least all but ``misses`` terms of a least passage, each at most ``misses`` places from where the others put it: best one per document and item."""
    shared = index.sparkSession.sparkContext.broadcast((query, plan))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, sets = shared.value
        names = ["doc_id", "item_id", "matched", "of", "item_from", "doc_from"]
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
        for b in batches:
            for kind, ids, lists in _segments(q, b):
                rows = list(_search_near(q, sets, kind, ids, lists, misses))
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate(types)], names=names)

    return index.select(*_COLUMNS).mapInArrow(run, "doc_id bigint, item_id bigint, matched int, of int, item_from int, doc_from int")


def _search_near(q: Query, sets: list[list[tuple[int, ...]]], kind: bool, ids: list[int], lists: Lists, misses: int) -> Iterator[tuple]:
    of = lists.of
    for (item_id, chars, ts), own in zip(q.items, sets):
        if chars != kind:
            continue
        w = CHARS if chars else WORDS
        found = []
        for offsets in own:
            shifted = [of(int(ts[i])) - i for i in offsets if int(ts[i]) in lists]
            if len(shifted) >= 2:
                # words put in or left out shift what follows by at most ``misses``: two of the terms agree within that
                diag = np.sort(np.concatenate(shifted))
                near = np.searchsorted(diag, diag + misses, "right") - np.searchsorted(diag, diag - misses, "left")
                found.append(diag[near >= 2])
        if not found:
            continue
        diag = np.unique(np.concatenate(found))
        if not len(diag):
            continue
        hit = np.zeros((len(ts) + 1, len(diag)), np.int32)
        for i, t in enumerate(ts.tolist()):
            if t in lists:
                p = of(t)
                j = np.searchsorted(p, diag + i - misses)
                hit[i + 1] = p[np.minimum(j, len(p) - 1)] - (diag + i - misses) <= 2 * misses
                hit[i + 1] &= j < len(p)
        total = np.cumsum(hit, axis=0)
        windows = total[w:] - total[:-w]
        if not len(windows):
            continue
        best, start = windows.max(0), windows.argmax(0)
        for d in np.flatnonzero(best >= w - misses):
            k = int(diag[d]) + int(start[d])
            yield ids[(k + w - 1) // STRIDE], item_id, int(best[d]), w, int(start[d]) + 1, max(1, k % STRIDE + 1 if k % STRIDE < STRIDE // 2 else 1)


def _runs(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Longest run of True per column and where it starts."""
    n = hit.shape[1]
    best, start, run = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i, row in enumerate(hit):
        run = np.where(row, run + 1, 0)
        more = run > best
        best = np.where(more, run, best)
        start = np.where(more, i - run + 1, start)
    return best, start


def indexed(spark: SparkSession, docs: DataFrame, chars: str = "unspaced") -> DataFrame:
    """Build the index, write it to the shared folder and read it back: later stages survive lost executors."""
    path = shared_path(spark, "postings")
    build_index(docs, chars).write.mode("overwrite").parquet(path)
    return spark.read.schema(INDEX_SCHEMA).parquet(path)


class Searcher:
    """An indexed corpus, searched for any number of item sets."""

    def __init__(self, spark: SparkSession, docs: DataFrame):
        self.spark, self.docs = spark, docs
        self.index: dict[str, DataFrame] = {}

    def _of(self, query: Query) -> DataFrame:
        """The index that holds all terms a query needs."""
        chars = "unspaced" if query.only_han else "all"
        if chars not in self.index:
            self.index[chars] = self.index.get("all") or indexed(self.spark, self.docs, chars)
        return self.index[chars]

    def _union(self, items: DataFrame, one) -> DataFrame:  # noqa: ANN001
        out = None
        for part in blocks(items):
            query = read_items(part)
            index = self._of(query)
            found = one(index, query, frequencies(index, query))
            out = found if out is None else out.unionByName(found)
        return out

    def matches(self, items: DataFrame) -> DataFrame:
        """All exact phrase matches: (doc_id, item_id, longest, item_from, doc_from, kind), one row per pair."""
        found = self._union(items, lambda index, query, df: search(index, query, query.plan(df)))
        best = F.max(F.struct("longest", F.struct(-F.col("doc_from"), -F.col("item_from")).alias("at"), "kind"))
        return found.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", F.col("b.longest").alias("longest"), (-F.col("b.at.col2")).alias("item_from"), (-F.col("b.at.col1")).alias("doc_from"), F.col("b.kind").alias("kind"))

    def near_matches(self, items: DataFrame, misses: int = MISSES) -> DataFrame:
        """Proximity matches: (doc_id, item_id, matched, of, item_from, doc_from), the fullest window of each pair.

        A window of the least length counts if all but ``misses`` of its terms stand in the document, each at most ``misses``
        places from where the others put it; so words may be changed, put in or left out.
        """
        found = self._union(items, lambda index, query, df: search_near(index, query, query.near_plan(df, misses), misses))
        best = F.max(F.struct("matched", "of", (-F.col("doc_from")).alias("d"), (-F.col("item_from")).alias("i"))).alias("b")
        pairs = found.groupBy("doc_id", "item_id").agg(best)
        return pairs.select("doc_id", "item_id", F.col("b.matched").alias("matched"), F.col("b.of").alias("of"), (-F.col("b.i")).alias("item_from"), (-F.col("b.d")).alias("doc_from"))


def matches(spark: SparkSession, docs: DataFrame, items: DataFrame) -> DataFrame:
    return Searcher(spark, docs).matches(items)


def near_matches(spark: SparkSession, docs: DataFrame, items: DataFrame, misses: int = MISSES) -> DataFrame:
    return Searcher(spark, docs).near_matches(items, misses)
