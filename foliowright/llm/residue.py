"""Problem 2: template residue, filler and error pages where prose belongs.

Every record is cut into units (lines and sentences); the skeleton of a unit is its words, with hosts,
identifiers and numbers as slots.  Short records (pages) whose units have the same words are aligned and
counted as wholes, and their units are counted in records full of story.  A page that repeats far more
often than story holds its units (a likelihood ratio) is a *page template*: a default left in place of
the chapter, an error page, a notice.  No list of phrases has a part in that, so the language and the
wording do not matter; a sentence of the story with a slot spliced into it keeps the story's words.

Pages are aligned further where they agree but for one word, their beginning or their end: that place is
an *induced slot*, if the pages that share the rest outweigh what story can hold of it (never more than it
holds of the rarest word).  Words that no page template could rest on are told by their own counts first,
so only few units are aligned.

Slots that retain a variable name, a default (filler words) or a blank are residue wherever they stand
at the edge of a unit, also after a cut piece of a sentence.  A record is a case when it has residue
and at most one true sentence beside its heading.

Defined results: null, empty and white-space records are no cases; a record of headings only is none;
repeated rows count once; a page template needs some twenty pages, so rarer wordings that fit no induced
slot are not found, on small corpora above all.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliowright.llm.sentences import BEFORE_NAMES

MAX_TRUE = 1
PAGE_UNITS = 4  # a record with more units of text is story
IN_STORY = 0.25  # what story talks of stands there at least so often for once on a page
EVIDENCE = 4.5  # natural logarithm of the likelihood ratio that makes a page template
LEAST_KEPT = 3  # words that an induced template keeps beside its slot, and at least half of all

# How template languages mark a variable or a tag.
VARIABLE = re.compile(
    r"\{\{[^{}]*\}\}|\{%[^{}]*%\}|\{#[^{}]*#\}|[$#]\{[^{}]*\}|\{[A-Za-z_][\w.\- ]*\}|<%[^<>]*%>|<\?[^<>]*\?>|\[\[[^\[\]]*\]\]|%[A-Za-z_][\w.]*%|%\([a-z_]+\)s|\$[A-Za-z_]\w*\$|@@[A-Za-z_]\w*@@|__[A-Za-z][A-Za-z_.]*__"
    r"|<[A-Za-z]+_[A-Za-z_.]+>|<[A-Za-z]+\.[A-Za-z_.]+>|<[A-Z_]{4,}>|\[(?:INSERT|ENTER|YOUR|ADD|PLACEHOLDER)[^\[\]]*\]|\[[^\[\]]*\b(?:TBD|TBA|TODO|HERE)\]|<(?:INSERT|ENTER|YOUR)[^<>]*>|\bT[OB]DO?: ?[\w.]+"
)
TAG = re.compile(r"</?[a-z][a-z0-9]*(?:\s[^<>]*)?>")
LONE_TAG = re.compile(r"^</?[A-Za-z][\w.]*>$")
UNDEFINED = re.compile(r"^(?:undefined|null|none|nan|n/a|\[object object\]|todo|tbd|tba|xxx+|\.{3,}|_{3,}|-{3,})[.!]?$", re.I)
MARKS = re.compile(r"[{}<>\[\]$%@]|__|TODO|TBD|TO:")

# The vocabulary of filler.
LOREM = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing adipisicing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum".split()
)
BABBLE = frozenset("blah bla foo bar baz qux asdf qwerty test dummy xxx text".split())

HEADING = re.compile(r"^\s*(?:chapter|kapitel|chapitre|cap[ií]tulo|capitolo|hoofdstuk|глава|розділ|الفصل|अध्याय|บทที่)\s*[\d,.]+|^\s*第\s*[\d一二三四五六七八九十百千]+\s*[章話话回节節]", re.I)
_UP = "A-ZÀ-ÖØ-ÞА-ЯЁІЇЄҐ"
_LOW = "a-zß-öø-ÿа-яёіїєґ"
# Where a unit may end: a line break, or a mark before white space or another sentence.
_END = re.compile(
    rf"[\n.!?؟।。！？](?:(?<=\n)\n*|(?<=[.!?؟।])\s+(?=[\"“„«(]?[^\W\d_{_LOW}]|[\"“„«(¿¡])|(?<=[.!?؟।])[\"”»“]\s+(?=[\"“„«(¿¡]*[{_UP}])|(?<=[。！？])(?![”」』’）。！？])|(?<=[。！？])[”」』](?=[“「『]))"
)
_QUOTED = re.compile("«[^«»\n]*»|“[^“”\n]*”|„[^„“”\n]*[“”]|\"[^\"\n]*\"|「[^「」\n]*」")
_HELD = str.maketrans(".!?。！？", "·¡¿、，，")
_ABBREVIATIONS = frozenset(BEFORE_NAMES)

# Scripts without spaces: each character is a word.
_LONE = "฀-๿぀-ヿ㐀-鿿가-힯"
_HOST = r"https?://\S+|\b(?:[a-z0-9-]+\.)+(?:example|com|net|org|info|io)\b"
_IDENT = r"\b(?=[0-9a-f-]*\d)(?=[0-9a-f-]*[a-f])[0-9a-f]{6,}(?:-[0-9a-f]+)*\b|\b[0-9a-f]{8,}\b"
_TOKEN = re.compile(rf"(?P<h>{_HOST})|(?P<x>{_IDENT})|(?P<n>\d+(?:[.,]\d+)*)|(?P<w>[{_LONE}]|[^\W\d_{_LONE}]+(?:[’'][^\W\d_{_LONE}]+)*)", re.I)
_PLAIN = re.compile(rf"[{_LONE}]|[^\W\d_{_LONE}]+(?:[’'][^\W\d_{_LONE}]+)*")
_SLOTTED = re.compile(r"\d|[.:](?=[A-Za-z/])")


def _goes_on(unit: str) -> bool:
    """Whether a unit ends with an abbreviation, an initial or a number."""
    if unit[-1] != ".":
        return False
    last = unit[max(unit.rfind(" "), unit.rfind("\t"), -1) + 1 : -1].lstrip("\"“„«(¿¡‘'")
    last = last if last in _ABBREVIATIONS else re.split(r"\W", last)[-1]
    return last in _ABBREVIATIONS or len(last) == 1 and last.isalpha() or last.isdecimal()


def units(text: str, cut: list[str] | None = None) -> list[str]:
    """Lines and, inside them, sentences; ``cut`` takes those that would end where an abbreviation may go on."""
    out: list[str] = []
    glue = False
    text = _QUOTED.sub(lambda m: m.group().translate(_HELD), text)  # a quotation is not cut inside
    ends = [m.end() for m in _END.finditer(text)]
    start = 0
    for end in (*ends, len(text)):
        piece = text[start:end]
        u = piece.strip()
        start = end
        if not u:
            glue = False
            continue
        if glue:
            if cut is not None:
                cut.append(out[-1])
            out[-1] += " " + u
        else:
            out.append(u)
        glue = piece[-1] != "\n" and _goes_on(u)
    return out


def words_of(unit: str) -> list[str]:
    """The words of a unit in lower case, with a slot (⟨h⟩, ⟨x⟩ or ⟨n⟩) for each host, identifier and number."""
    if not _SLOTTED.search(unit):
        return _PLAIN.findall(unit.lower())
    return [f"⟨{m.lastgroup}⟩" if m.lastgroup != "w" else m.group().lower() for m in _TOKEN.finditer(unit)]


def skeleton(unit: str) -> str:
    """The words and slots of a unit."""
    return " ".join(words_of(unit))


def filler(words: list[str]) -> bool:
    """Whether words are the default text of layouts, or one word over and over."""
    low = [w.lower() for w in words]
    if len(low) >= 4 and sum(w in LOREM for w in low) >= 0.7 * len(low):
        return True
    return len(low) >= 3 and len(set(low)) <= max(1, len(low) // 3) and sum(w in BABBLE for w in low) >= 0.7 * len(low)


def slot(unit: str) -> tuple[str, str] | None:
    """(kind, text beside it) of a slot that was left as it is; None where a unit has none.

    A marker at an edge of its unit stands where text should; one in the middle may be talked of, and is a
    slot only if there is little beside it.
    """
    marks = list(VARIABLE.finditer(unit))
    if not marks:
        return ("blank", "") if UNDEFINED.match(unit) else ("variable", "") if LONE_TAG.match(unit) else None
    rest = TAG.sub(" ", VARIABLE.sub(" ", unit))
    words = _PLAIN.findall(rest)
    edge = not re.search(r"\w", TAG.sub("", unit[marks[-1].end() :])) or not re.search(r"\w", TAG.sub("", unit[: marks[0].start()]))
    if edge or len(words) <= 4 or sum(map(len, words)) < 0.5 * len(unit):
        return "variable", rest.strip() if len(words) > 4 else ""
    return None


def parts(text: str) -> tuple[list[list[str]], list[tuple[str, str]], list[str]]:
    """Words of the units of text, (kind, marker or words) of slots left as they are, and units cut at abbreviations."""
    texts: list[list[str]] = []
    slots: list[tuple[str, str]] = []
    cut: list[str] = []
    marked = MARKS.search(text) is not None
    for u in units(text, cut):
        if HEADING.match(u) and not (marked and VARIABLE.search(u)):
            continue
        if marked and MARKS.search(u) and (left := slot(u)) is not None:
            mark = VARIABLE.search(u)
            slots.append((left[0], mark.group() if mark else u))
            u = left[1]
            if not u:
                continue
        elif len(u) < 20 and UNDEFINED.match(u):
            slots.append(("blank", u))
            continue
        w = words_of(u)
        if len(w) <= 3 and sum(len(x) for x in w if x[0] != "⟨") <= 3 and not any("฀" <= x[0] for x in w if x[0] != "⟨"):
            continue  # a host, number or identifier only
        if (w[0] in LOREM or w[0] in BABBLE or w[-1] in LOREM) and filler(w):
            slots.append(("default", " ".join(w[:3])))
            continue
        texts.append(w)
    return texts, slots, cut


def _number(s: str) -> int:
    n = xxhash.xxh3_64_intdigest(s)
    return n - (1 << 64) if n >> 63 else n


def key(words: list[str]) -> int:
    """A number for the words of a unit, whatever is in its slots and wherever words are parted."""
    s = "".join(words)
    return _number(_ANY_SLOT.sub("", s) if "⟨" in s else s)


_ANY_SLOT = re.compile("⟨.⟩")


def _whole_words(words: list[str], cut: bool) -> list[str]:
    if "⟨h⟩" in words:  # hosts are spliced into words
        near = {i + d for i, w in enumerate(words) if w == "⟨h⟩" for d in (-1, 0, 1)}
        words = [w if i not in near else "" for i, w in enumerate(words)]
    return words[1:-1] if cut else words


SCHEMA = "src string, row_id bigint, n_text int, whole bigint, keys array<bigint>, skeletons array<string>, slots array<struct<kind:string,mark:string>>, words array<struct<word:string,n_page:bigint,n_story:bigint>>"
_SLOTS = pa.list_(pa.struct([("kind", pa.string()), ("mark", pa.string())]))
_WORDS = pa.list_(pa.struct([("word", pa.string()), ("n_page", pa.int64()), ("n_story", pa.int64())]))
_ARROW = pa.schema([("src", pa.string()), ("row_id", pa.int64()), ("n_text", pa.int32()), ("whole", pa.int64()), ("keys", pa.list_(pa.int64())), ("skeletons", pa.list_(pa.string())), ("slots", _SLOTS), ("words", _WORDS)])


def scan(df: DataFrame, id_col: str, text_col: str, src: str, cut: bool = False) -> DataFrame:
    """One row per record with text: its number of units of text, their keys, the skeletons of pages, slots left as they are.

    A row without ``src`` holds the words of a batch, with the units of pages and of stories they are in; where records are ``cut``
    out of a text, the first and last word of a unit may be pieces and are not counted, nor are words beside a host.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in _ARROW]
            seen: tuple[Counter, Counter] = (Counter(), Counter())
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                texts, slots, open_ = parts(t)
                if not texts and not slots:
                    continue
                page = len(texts) <= PAGE_UNITS
                for s in texts:
                    seen[0 if page else 1].update(_whole_words(s, cut))
                keys = [key(s) for s in texts]
                if not page:
                    keys = list(set(keys + [key(s) for s in map(words_of, open_) if s]))
                row = (src, i, len(texts), key(list(chain.from_iterable(texts))) if page else None, keys, [" ".join(s) for s in texts] if page else [], [{"kind": k, "mark": m} for k, m in slots] if page else [], None)
                for col, x in zip(out, row):
                    col.append(x)
            words = [{"word": w, "n_page": seen[0][w], "n_story": seen[1][w]} for w in seen[0] if w[:1] not in ("", "⟨")]
            words += [{"word": w, "n_page": 0, "n_story": n} for w, n in seen[1].items() if w not in seen[0] and w[:1] not in ("", "⟨")]
            for col, x in zip(out, (None, None, None, None, None, None, None, words)):
                col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _ARROW)], schema=_ARROW)

    rows = df.select(F.col(id_col).cast("long").alias("row_id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    return rows.mapInArrow(run, SCHEMA)


def evidence(n_page: Column, n_story: Column) -> Column:
    """How much likelier a template's places are if it makes pages than if story talks of it; 0 where they are not."""
    n = n_page + n_story
    first = n_page * F.log(n_page * (1 + IN_STORY) / n)
    second = F.when(n_story > 0, n_story * F.log(n_story * (1 + IN_STORY) / (n * IN_STORY))).otherwise(0.0)
    return F.when(n_page * (1 + IN_STORY) > n, first + second).otherwise(0.0)


def confirmed(records: DataFrame) -> DataFrame:
    """(key, n_page, n_story) of the units of pages that repeat as wholes, however they are laid out, and that story does not hold."""
    pages = records.where(f"n_text between 1 and {PAGE_UNITS}").select("src", "row_id", "whole", "keys").distinct()
    # pages of the same layout are summed before they meet, so a page that a third of all rows repeat is one row
    alike = pages.groupBy("whole", "keys").agg(F.count("*").alias("n"))
    wholes = alike.groupBy("whole").agg(F.sum("n").alias("n_page")).where(evidence(F.col("n_page"), F.lit(0)) >= EVIDENCE)
    each = alike.join(wholes, "whole").select("keys", "n_page", F.explode(F.array_distinct("keys")).alias("key"))
    told = records.where(f"n_text > {PAGE_UNITS}").select("src", "row_id", F.explode("keys").alias("key"))
    told = told.join(each.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.count_distinct("src", "row_id").alias("n_story"))
    units = each.join(told, "key", "left").fillna(0, ["n_story"])
    sure = units.groupBy("keys", "n_page").agg(F.max("n_story").alias("most"), F.collect_list(F.struct("key", "n_story")).alias("units"))  # at most PAGE_UNITS
    sure = sure.where(evidence(F.col("n_page"), F.col("most")) >= EVIDENCE).select("n_page", F.explode("units").alias("u"))
    return sure.groupBy("u.key").agg(F.sum("n_page").alias("n_page"), F.max("u.n_story").alias("n_story"))


def page_words(records: DataFrame) -> DataFrame:
    """(word, n_story): words that stand on pages far more often than in story; any template rests on one of them."""
    each = records.where("src is null").select(F.explode("words").alias("w")).select("w.*")
    return each.groupBy("word").agg(F.sum("n_page").alias("n_page"), F.sum("n_story").alias("n_story")).where(evidence(F.col("n_page"), F.col("n_story")) >= EVIDENCE).select("word", "n_story")


def variants(skeleton: str, known: dict[int, int]) -> Iterator[tuple[str, int]]:
    """(template, most) of a skeleton as it is and with one word, its beginning or its end left open, where enough is kept.

    ``known`` has the places of its page words and how often story holds them; ``most`` is how often story can hold what is kept.
    """
    w = skeleton.split(" ")
    n = len(w)
    plain = [0]
    for x in w:
        plain.append(plain[-1] + (x[0] != "⟨"))
    spans = [(n, n)] + [(i, i + 1) for i in range(n)] + [(0, k) for k in range(2, n // 2 + 1)] + [(n - k, n) for k in range(2, n // 2 + 1)]
    for a, b in spans:
        held = [c for i, c in known.items() if not a <= i < b]
        if held and plain[-1] - plain[b] + plain[a] >= LEAST_KEPT:
            yield " ".join(w[:a] + ["*"] * (a < b) + w[b:]), min(held)


def _spread(skeletons: DataFrame, text: bool = False) -> DataFrame:
    """(key, n_whole, most, template) of every skeleton with its page words; templates by number, or as text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, whole, most, made = [], [], [], []
            for k, n, s, known in zip(*(b.column(i).to_pylist() for i in range(4))):
                for t, m in variants(s, {x["at"]: x["n_story"] for x in known}):
                    keys.append(k)
                    whole.append(n)
                    most.append(m)
                    made.append(t if text else _number(t))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(whole, pa.int64()), pa.array(most, pa.int64()), pa.array(made, pa.string() if text else pa.int64())], names=["key", "n_whole", "most", "template"])

    kind = "string" if text else "bigint"
    return skeletons.select("key", "n_whole", "skeleton", "known").mapInArrow(run, f"key bigint, n_whole bigint, most bigint, template {kind}")


def _shared(made: DataFrame) -> DataFrame:
    """(template, n_fillings, n_page) of the templates that pages share far more often than story can.

    Each row is another skeleton, so another filling; fillings as many as the pages are text of their own, beside a phrase.
    """
    t = made.where("n_whole > 0").groupBy("template").agg(F.count("*").alias("n_fillings"), F.sum("n_whole").alias("n_page"), F.min("most").alias("most"))
    return t.where((2 * F.col("n_fillings") <= F.col("n_page")) & (evidence(F.col("n_page"), F.col("most")) >= EVIDENCE)).select("template", "n_fillings", "n_page")


class Residue:
    """Templates and cases over one written table of ``scan`` rows; ``write`` keeps a small table for later stages."""

    def __init__(self, records: DataFrame, write: Callable[[DataFrame, str], DataFrame]):
        self.write, self.records = write, records.where("src is not null")
        self.pages = self.records.where(f"n_text <= {PAGE_UNITS}")
        self.confirmed = write(confirmed(self.records), "page-templates")
        self.skeletons = write(self._skeletons(write(page_words(records), "page-words")), "page-skeletons")

    def _units(self) -> DataFrame:
        both = F.arrays_zip(F.col("keys").alias("key"), F.col("skeletons").alias("skeleton"))
        at = self.pages.select("src", "row_id", "n_text", F.posexplode(both).alias("pos", "u"))
        return at.select("src", "row_id", "n_text", "pos", "u.key", "u.skeleton")

    def _skeletons(self, words: DataFrame) -> DataFrame:
        """(key, skeleton, known, n_whole): skeletons with page words, and how many pages each fills, alone or beside page templates."""
        u = self._units().select("*", F.posexplode(F.split("skeleton", " ", -1)).alias("at", "word")).join(words, "word")
        u = u.groupBy("src", "row_id", "n_text", "pos", "key", "skeleton").agg(F.collect_set(F.struct("at", "n_story")).alias("known"))  # the words of a unit
        sure = self._units().join(self.confirmed.select("key"), "key", "left_semi").groupBy("src", "row_id").agg(F.collect_set("pos").alias("sure"))  # at most PAGE_UNITS
        u = u.join(sure, ["src", "row_id"], "left")
        whole = F.col("n_text") - F.coalesce(F.size(F.array_remove("sure", F.col("pos"))), F.lit(0)) <= 1
        return u.groupBy("key", "skeleton").agg(F.first("known").alias("known"), F.sum(whole.cast("long")).alias("n_whole"))

    def page_keys(self) -> DataFrame:
        """(key): skeletons that are page templates, or that fit a template with an induced slot."""
        # a shared template has a filling that comes twice, so templates of skeletons that do are all there can be
        twice = self.write(_spread(self.skeletons.where("n_whole > 1")).select("template").distinct(), "page-slots")
        made = self.write(_spread(self.skeletons).join(twice, "template", "left_semi"), "page-fillings")
        fits = made.join(_shared(made).select("template"), "template", "left_semi").select("key").distinct()
        told = self.records.where(f"n_text > {PAGE_UNITS}").select(F.explode("keys").alias("key"))
        return self.confirmed.select("key").unionByName(fits.join(told, "key", "left_anti")).distinct()

    def cases(self) -> DataFrame:
        """(src, row_id) where residue stands in place of prose."""
        left = self.pages.where(f"size(slots) > 0 and n_text <= {MAX_TRUE}").select("src", "row_id")
        held = self._units().select("src", "row_id", "n_text", "pos", "key").join(self.page_keys(), "key", "left_semi")
        whole = held.groupBy("src", "row_id").agg(F.count_distinct("pos").alias("n_held"), F.max("n_text").alias("n_text"))
        return left.unionByName(whole.where(f"n_text - n_held <= {MAX_TRUE}").select("src", "row_id")).distinct()

    def templates(self) -> DataFrame:
        """(template, slot, filling, n_fillings, n_records): page templates, their induced slots, and slots left as they are.

        ``slot`` is ``none`` for a template that repeats as it is, ``word``, ``beginning`` or ``end`` for an induced
        slot, and ``variable``, ``default`` or ``blank`` for one that kept its marker, which is then the ``filling``.
        """
        none, n = F.lit(None).cast("string"), F.count("*").alias("n_records")
        repeated = self._units().join(self.confirmed, "key").select("skeleton", "n_page").distinct()
        whole = repeated.select(F.col("skeleton").alias("template"), F.lit("none").alias("slot"), none.alias("filling"), F.lit(1).cast("long").alias("n_fillings"), F.col("n_page").alias("n_records"))
        at = F.when(F.startswith("template", F.lit("* ")), "beginning").when(F.endswith("template", F.lit(" *")), "end").otherwise("word")
        open_ = _shared(_spread(self.skeletons, text=True)).where("n_fillings > 1").select("template", at.alias("slot"), none.alias("filling"), "n_fillings", F.col("n_page").alias("n_records"))
        marks = self.pages.select("src", "row_id", "n_text", F.explode(F.array_distinct("slots")).alias("s")).distinct()
        kept = marks.groupBy(F.when(F.col("n_text") == 0, "*").otherwise("text *").alias("template"), F.col("s.kind").alias("slot"), F.col("s.mark").alias("filling")).agg(n)
        return whole.unionByName(open_).unionByName(kept.select("template", "slot", "filling", F.lit(1).cast("long").alias("n_fillings"), "n_records"))
