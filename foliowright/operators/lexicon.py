"""Protected terms: loading, order, variants, and repairs that leave them alone.

A text is parted into gaps and protected spans in the row itself: spans are headings, phrases and
bounded single words; a repair runs over the gaps only, and both are joined again.  Terms come from
a small table (hundreds per profile) and are checked against ``MAX_TERMS`` before they become a pattern.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliowright.functions import text as T

OPEN, CLOSE = "\ue001", "\ue002"
MAX_TERMS, MAX_PROFILES = 20_000, 200  # of a profile, and of a run; more are cleaned in several runs, each over its own profiles
NEVER = ("Chapter",)


def cleaned(terms: DataFrame) -> DataFrame:
    """(profile, term): comments and blanks gone."""
    t = terms.select("profile", T.strip(F.regexp_replace("term", r"(?s)#.*$", "")).alias("term"))
    return t.where("term <> ''").distinct()


def ordered(terms: DataFrame) -> DataFrame:
    """(profile, term, rank): phrases first, each group longest first, then alphabetical."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("profile").orderBy(F.contains(F.col("term"), F.lit(" ")).desc(), F.length("term").desc(), "term")
    return cleaned(terms).withColumn("rank", F.row_number().over(w).cast("long"))


def variants(terms: DataFrame) -> DataFrame:
    """(profile, term): single words of two letters or more also with ``'s``, ``’s`` and ``s``."""
    t = cleaned(terms)
    more = t.where(~F.contains(F.col("term"), F.lit(" ")) & (F.length("term") >= 2))
    return t.unionByName(more.select("profile", F.explode(F.array(*[F.concat("term", F.lit(x)) for x in ("'s", "’s", "s")])).alias("term"))).distinct()


def from_json(df: DataFrame, json_col: str) -> DataFrame:
    """Terms of a JSON lexicon: a list, or an object with a list called terms; anything else has none."""
    flat = F.coalesce(F.from_json(json_col, "array<string>"), F.from_json(json_col, "struct<terms:array<string>>")["terms"])
    return df.select("profile", F.explode(flat).alias("term"))


def load(terms: DataFrame, profile: str) -> tuple[str, ...]:
    """The terms of a profile in order, as a literal; a fixed, small table."""
    rows = ordered(terms.where(F.col("profile") == profile)).orderBy("rank").limit(MAX_TERMS + 1).collect()
    if len(rows) > MAX_TERMS:
        raise ValueError(f"{profile} has more than {MAX_TERMS} terms")
    return tuple(r["term"] for r in rows)


def load_all(terms: DataFrame) -> dict[str, tuple[str, ...]]:
    """The terms of every profile in order; profiles are counted against ``MAX_PROFILES`` before they are read."""
    names = [r[0] for r in terms.select("profile").where("profile is not null").distinct().orderBy("profile").limit(MAX_PROFILES + 1).collect()]
    if len(names) > MAX_PROFILES:
        raise ValueError(f"more than {MAX_PROFILES} profiles; clean them in several runs")
    return {p: load(terms, p) for p in names}


def _quoted(s: str) -> str:
    return "".join("\\" + c if c in r"\^$.|?*+()[]{}-&" else c for c in s)


class Mask:
    """Parts texts into gaps and protected spans."""

    def __init__(self, terms: tuple[str, ...], headings: bool = True):
        usable = [t for t in terms if len(t) >= 2 and t not in NEVER]
        phrases = sorted((t for t in usable if " " in t), key=lambda t: (-len(t), t))
        words = {t for t in usable if " " not in t}
        words = sorted(words | {w + x for w in words for x in ("'s", "’s", "s")}, key=lambda t: (-len(t), t))
        whole = [r"(?m:^[^\S\n]*(?:Chapter)\s+\d[^\n]*)"] if headings else []
        whole += [r"\s+".join(map(_quoted, p.split())) for p in phrases]
        self.phrases = f"(?iuU){'|'.join(whole)}" if whole else None
        span = f"{OPEN}[^{CLOSE}]*{CLOSE}"
        self.spans = f"(?iuU){span}" + (f"|(?<![A-Za-z])(?:{'|'.join(map(_quoted, words))})(?![A-Za-z])" if words else "")

    def marked(self, c: Column) -> Column:
        return F.regexp_replace(c, self.phrases, f"{OPEN}$0{CLOSE}") if self.phrases else c

    def gaps(self, c: Column) -> Column:
        return F.split(self.marked(c), self.spans, -1)

    def hits(self, c: Column) -> Column:
        return F.regexp_extract_all(self.marked(c), F.lit(self.spans), F.lit(0))

    def apply(self, c: Column, repair: Callable[[Column], Column]) -> Column:
        """The text with the repair made in its gaps."""
        m = self.marked(c)
        fixed = F.transform(F.split(m, self.spans, -1), repair)
        spans = F.concat(F.regexp_extract_all(m, F.lit(self.spans), F.lit(0)), F.array(F.lit("")))
        return F.translate(F.array_join(F.zip_with(fixed, spans, lambda g, h: F.concat(g, h)), ""), OPEN + CLOSE, "")


class Finder:
    """Finds the protected spans of a text by two automata: phrases anywhere, then single words with no letter (a-z) beside them.

    Of spans that begin at one place the longest counts, and none overlaps another; case and the kind of white space
    inside a phrase make no difference.
    """

    def __init__(self, terms: tuple[str, ...]):
        import ahocorasick

        usable = {re.sub(r"\s+", " ", t.lower()) for t in terms if len(t) >= 2 and t not in NEVER}
        words = {t for t in usable if " " not in t}
        words |= {w + x for w in words for x in ("'s", "’s", "s")}
        self.phrases, self.words = (self._automaton(ahocorasick, g) for g in ({t for t in usable if " " in t}, words))

    @staticmethod
    def _automaton(ahocorasick, group: set[str]):  # noqa: ANN001, ANN205
        a = ahocorasick.Automaton()
        for t in group:
            a.add_word(t, t)
        if group:
            a.make_automaton()
        return a if group else None

    @staticmethod
    def _first(hits: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
        out: list[tuple[int, int, str]] = []
        for a, size, t in sorted(hits):
            if not out or a >= out[-1][0] - out[-1][1]:
                out.append((a, size, t))
        return out

    def spans(self, text: str) -> list[str]:
        t = re.sub(r"\s+", " ", text.lower())
        found = self._first([(end + 1 - len(x), -len(x), x) for end, x in self.phrases.iter(t)]) if self.phrases else []
        out = [x for _, _, x in found]
        if self.words is None:
            return out
        edges = [0] + [e for a, size, _ in found for e in (a, a - size)] + [len(t)]
        for a, b in zip(edges[::2], edges[1::2]):  # between the phrases
            gap = t[a:b]
            hits = [(end + 1 - len(x), -len(x), x) for end, x in self.words.iter(gap)]
            beside = lambda i, gap=gap: 0 <= i < len(gap) and "a" <= gap[i] <= "z"
            out += [x for _, _, x in self._first([h for h in hits if not beside(h[0] - 1) and not beside(h[0] - h[1])])]
        return out


def term_counts(df: DataFrame, id_col: str, text_col: str, terms: dict[str, tuple[str, ...]]) -> DataFrame:
    """(id, profile, term, n): how often each protected term of each profile stands in each text; null texts have none."""
    shared = df.sparkSession.sparkContext.broadcast(terms)  # a few profiles, each checked against MAX_TERMS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finders = {p: Finder(t) for p, t in shared.value.items()}
        for b in batches:
            rows = [(i, p, t, n) for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for p, f in finders.items() for t, n in Counter(f.spans(text)).items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((b.schema.types[0], pa.string(), pa.string(), pa.int64()))], names=[id_col, "profile", "term", "n"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.where(F.col(text_col).isNotNull()).select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, profile string, term string, n bigint")


def span_counts(df: DataFrame, id_col: str, profile_col: str, first: str, second: str, terms: dict[str, tuple[str, ...]]) -> DataFrame:
    """(id, profile, before, after): protected spans of two texts of a row, by the terms of its profile; null texts have none."""
    shared = df.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finders = {p: Finder(t) for p, t in shared.value.items()}
        none = Finder(())
        for b in batches:
            ids, profiles, x, y = (b.column(k).to_pylist() for k in range(4))
            n = [[len(finders.get(p, none).spans(t or "")) for p, t in zip(profiles, texts)] for texts in (x, y)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n[0], pa.int64()), pa.array(n[1], pa.int64())], names=[id_col, "profile", "before", "after"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, F.col(profile_col).alias("profile"), first, second).mapInArrow(run, f"`{id_col}` {kind}, profile string, before bigint, after bigint")
