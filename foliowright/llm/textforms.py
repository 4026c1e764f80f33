"""Problem 1: texts that look the same but are stored with different characters.

Every token's *resolved script set* is the intersection of its characters' script sets (Unicode's script
extensions, augmented with Japanese, Korean and Bopomofo writing as UTS #39 has it; characters common to
all scripts have all).  A token whose set is empty mixes scripts; when one script can spell it with
look-alike letters it is a mixed-script confusable and the spelling that changes fewest letters is chosen
(the text's own script at a tie).  A token whose set lacks the text's script, spelled only with look-alikes
of that script and not part of a phrase in its own, is a whole-script confusable.  What remains is
normalised: compatibility forms of letters, digits and ideographs, letters stored in pieces, invisible
characters and blanks.

Defined results: null stays null and is no case, an empty text is no case; quotation marks, dashes,
symbols, East Asian full-width punctuation, Thai, Arabic and Indic spelling are left as they are, and so
are ordinal signs, superscript digits and fractions.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliowright.llm import mojibake
from foliowright.llm.lookalikes import PHONETIC_TO_LATIN, TO_CYRILLIC, TO_GREEK, TO_LATIN

# What no reader sees, and the blanks that are not the plain space or a break.
INVISIBLE = "\u00ad\u034f\u061c\u180e\u200b\u200c\u200d\u200e\u200f\u202a-\u202e\u2060-\u2064\u2066-\u2069\ufeff"
BLANK = "\t\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000"
MARKS = "\u0300-\u036f\u0653-\u0655\u3099\u309a"
# Compatibility kinds that are another shape of the same letter; raised ones are for letters only, fractions never.
_RAISED = ("<super>", "<sub>")
_KINDS = ("<wide>", "<narrow>", "<font>", "<compat>", "<initial>", "<medial>", "<final>", "<isolated>", "<circle>", "<square>")
# Ranges whose ordinary spelling has a compatibility decomposition or an excluded composition.
_ORDINARY = ((0x0E00, 0x0EFF), (0x0900, 0x0DFF), (0x0F00, 0x0FFF), (0x3130, 0x318F), (0x0600, 0x06FF), (0x2000, 0x206F), (0x2070, 0x209F), (0x20A0, 0x20FF))


@lru_cache(1)
def forms() -> dict[str, str]:
    """Each compatibility or singleton form of a letter, digit or ideograph with its ordinary spelling; by rule."""
    out = {}
    for o in range(0xA1, sys.maxunicode + 1):
        if 0xAC00 <= o < 0xD7B0 or 0xE000 <= o < 0xF900 or any(a <= o <= b for a, b in _ORDINARY):
            continue
        c = chr(o)
        d = unicodedata.decomposition(c)
        if not d or c in "ªº²³¹¼½¾":
            continue
        kind = d.split()[0]
        plain = unicodedata.normalize("NFKC", c)
        radical = 0x2E80 <= o < 0x2FE0
        if kind[0] == "<":
            letter = unicodedata.category(c)[0]
            squared = 0x3200 <= o < 0x3400 and all(x in "()./" or unicodedata.category(x)[0] in "LN" for x in plain)  # words set into one square or circle
            if plain[0] == " " or not (kind in _KINDS and (radical or squared or letter in "LN") or kind in _RAISED and letter == "L"):
                continue
        elif unicodedata.normalize("NFC", c) == c or unicodedata.category(c)[0] not in "LN":
            continue
        if plain != c:
            out[c] = plain
    for c in "KÅΩ":  # Kelvin, Angstrom and Ohm signs are letters
        out[c] = unicodedata.normalize("NFC", c)
    return out


def plain(text: Column) -> Column:
    """JVM test for texts that cannot hold a case: ASCII without tabs."""
    return ~text.rlike("[^\\x00-\\x08\\x0A-\\x7F]")


_LATIN = re.compile("[A-Za-z\u00aa\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u1e00-\u1eff]")
_ALIEN = re.compile("[\u0370-\u03ff\u1f00-\u1fff\u0400-\u052f\u0530-\u058f\u13a0-\u13ff\ua4d0-\ua4ff]")
_PHONETIC = re.compile("[" + "".join(PHONETIC_TO_LATIN) + "]")


@lru_cache(1)
def _doubtful() -> re.Pattern[str]:
    """Any character that unify() may change by itself; beyond the basic plane, any at all, which keeps the set a bitmap."""
    return re.compile(f"[{INVISIBLE}{BLANK}{MARKS}" + "".join(re.escape(c) for c in forms() if ord(c) < 0x10000) + "\U00010000-\U0010ffff]")


def suspicious(text: str) -> bool:
    """Holds for every possible case and few others."""
    return bool(_doubtful().search(text)) or bool(_PHONETIC.search(text)) or bool(_ALIEN.search(text) and _LATIN.search(text)) or bool(_GREEK.search(text) and _CYRILLIC.search(text))


_GREEK, _CYRILLIC = re.compile("[\u0370-\u03ff]"), re.compile("[\u0400-\u052f]")
_DROP = re.compile(f"[{INVISIBLE}]")
_SPACE = re.compile(f"[{BLANK}]")
_PIECES = re.compile(f"[^\\W\\d_][{MARKS}]+")
_TOKEN = regex.compile(r"[\p{L}\p{M}]+(?:['’ʼ][\p{L}\p{M}]+)*")
# Scripts that can spell a token by look-alikes, and the tables that do.
_TWINS = {"Latin": TO_LATIN, "Cyrillic": TO_CYRILLIC, "Greek": TO_GREEK}
# Names of the scripts in use, and the writing systems some of them belong to together.
SCRIPTS = (
    "Latin", "Greek", "Cyrillic", "Armenian", "Hebrew", "Arabic", "Syriac", "Thaana", "Devanagari", "Bengali", "Gurmukhi", "Gujarati", "Oriya", "Tamil", "Telugu", "Kannada", "Malayalam", "Sinhala", "Thai", "Lao", "Tibetan",
    "Myanmar", "Georgian", "Hangul", "Ethiopic", "Cherokee", "Khmer", "Mongolian", "Hiragana", "Katakana", "Bopomofo", "Han", "Yi", "Lisu", "Coptic", "Glagolitic",
)
SYSTEMS = {"Han": ("Japanese", "Korean", "Hanb"), "Hiragana": ("Japanese",), "Katakana": ("Japanese",), "Hangul": ("Korean",), "Bopomofo": ("Hanb",)}
_EXTENDED = tuple((name, regex.compile(rf"\p{{Script_Extensions={name}}}")) for name in SCRIPTS)
_ALL = regex.compile(r"[\p{Script_Extensions=Common}\p{Script_Extensions=Inherited}]")


@lru_cache(65536)
def scripts(c: str) -> frozenset[str] | None:
    """The augmented script extensions of a character; None for one that goes with all scripts."""
    own = {name for name, rx in _EXTENDED if rx.match(c)}
    if not own:
        return None if _ALL.match(c) or unicodedata.category(c)[0] == "M" else frozenset(("other",))
    for name in tuple(own):
        own.update(SYSTEMS.get(name, ()))
    return frozenset(own)


def resolved(token: str) -> frozenset[str] | None:
    """The resolved script set of a token: the scripts that all its characters have in common; None for all."""
    out: frozenset[str] | None = None
    for s in map(scripts, token):
        if s is not None:
            out = s if out is None else out & s
    return out


def _spell(token: str, script: str) -> str | None:
    """The token in one script, or None where a letter has no look-alike there."""
    out = []
    for c in token:
        s = scripts(c)
        if s is None or script in s:
            out.append(c)
        elif c in _TWINS[script]:
            out.append(_TWINS[script][c])
        else:
            return None
    return "".join(out)


def _foreign(text: str) -> str:
    """The text with mixed-script and whole-script confusables spelled in one script."""
    tokens = []
    count = dict.fromkeys(_TWINS, 0)
    for m in _TOKEN.finditer(text):
        w = m.group()
        found = resolved(w)
        tokens.append((m.start(), w, found))
        for s in count.keys() & found if found else ():
            count[s] += len(w)
    own = max(count, key=lambda s: count[s])
    change = []
    for n, (at, w, found) in enumerate(tokens):
        if found is not None and not found:  # mixed scripts
            order = [own] + [s for s in _TWINS if s != own]
            # the spelling that changes fewest letters, the text's own script at a tie
            options = [(sum(a != b for a, b in zip(w, x)), i, x) for i, s in enumerate(order) if (x := _spell(w, s)) is not None]
            if options:
                change.append((at, w, min(options)[2]))
        elif found and own not in found and count[own]:  # wholly of another script
            x = _spell(w, own)
            if x is None:
                continue
            near = [tokens[i] for i in (n - 1, n + 1) if 0 <= i < len(tokens)]
            # a phrase of the foreign script: a neighbour of that script that no look-alikes could spell
            if any(f and f & found and own not in f and _spell(v, own) is None for _, v, f in near):
                continue
            change.append((at, w, x))
    for at, w, x in reversed(change):
        text = text[:at] + x + text[at + len(w) :]
    return text


def _plain_phonetic(text: str) -> str:
    """Phonetic letters among plain Latin ones as those they look like; words of phonetic writing keep theirs."""

    def one(m) -> str:  # noqa: ANN001
        w = m.group()
        odd = [c for c in w if ord(c) > 0x24F and c not in PHONETIC_TO_LATIN]
        plain = any("a" <= c.lower() <= "z" for c in w)
        return w.translate(_PLAIN_LETTERS) if plain and not odd else w

    return _TOKEN.sub(one, text)


_PLAIN_LETTERS = str.maketrans(PHONETIC_TO_LATIN)


def unify(text: str | None) -> str | None:
    """The one consistent form of a text; equal-looking texts give equal results."""
    if not text or text.isascii() and "\t" not in text or not suspicious(text):
        return text
    table = _table()
    t = _DROP.sub("", text)
    t = _SPACE.sub(" ", t)
    t = t.translate(table)
    if _PIECES.search(t):
        t = _PIECES.sub(lambda m: unicodedata.normalize("NFC", m.group()), t)
    if _PHONETIC.search(t):
        t = _plain_phonetic(t)
    if _ALIEN.search(t) and (_LATIN.search(t) or _GREEK.search(t) and _CYRILLIC.search(t)):
        t = _foreign(t)
    return t


@lru_cache(1)
def _table() -> dict[int, str]:
    return str.maketrans(forms())


def is_case(text: str | None) -> bool:
    """Whether at least one character or sequence should be another, ordinary one of the same look."""
    return bool(text) and unify(text) != text


def unified(df: DataFrame, text_col: str, out_col: str = "unified_text") -> DataFrame:
    """Add the consistent form of a text column; rows without any doubtful character stay in the JVM."""

    @F.pandas_udf("string")
    def run(s):  # noqa: ANN001, ANN202
        return s.map(lambda x: None if x is None else unify(x))

    doubt = F.when(~plain(F.col(text_col)), F.col(text_col))
    return df.withColumn(out_col, F.coalesce(run(doubt), F.col(text_col)))


def cases(df: DataFrame, id_col: str, text_col: str, src: str, model: mojibake.Model | None) -> DataFrame:
    """(src, row_id) of the rows that are cases, without rows holding a garbled passage when a model is given."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            hit = [i for i, t in enumerate(texts) if is_case(t)]
            if shared.value is not None and hit:
                garbled = {i for i, *_ in mojibake.decoder(shared.value).spans([texts[i] for i in hit])}
                hit = [i for n, i in enumerate(hit) if n not in garbled]
            yield pa.RecordBatch.from_arrays([pa.array([src] * len(hit), pa.string()), pa.array([ids[i] for i in hit], pa.int64())], names=["src", "row_id"])

    rows = df.select(F.col(id_col).cast("long").alias("row_id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull() & ~plain(F.col("text")))
    return rows.mapInArrow(run, "src string, row_id bigint")
