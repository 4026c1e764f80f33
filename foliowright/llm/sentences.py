"""Problem 4: sentence units for every document, whatever its language and script.

Everything is a chain of SQL expressions: terminators that end no sentence (in decimals, addresses,
initials, abbreviations, ordinals, quotations and parentheses) are masked with private-use
placeholders, the text is split with terminator patterns per script, and the placeholders are turned
back.  No Python runs on a row, and nothing leaves the row before the sentences are exploded.

Defined results: null and empty texts have no sentence; a line without a terminator is a sentence of
its own paragraph; private-use characters that the placeholders use are put aside where an input holds
them, and come back as they were.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliowright.functions.text import let

# Terminators and the placeholders that stand for them, in the same order.
TERMINATORS = ".!?…。！？।؟"
MASKS = "\ue001\ue002\ue003\ue004\ue005\ue006\ue007\ue008\ue009"
CUT = "\ue010"
# The placeholders' own characters in an input stand aside as those of the last plane while the text is cut.
_OWN = MASKS + CUT
_ASIDE = "".join(chr(0x10FF00 + i) for i in range(len(_OWN)))

# Abbreviations that never end a sentence, because a name or number follows them.
BEFORE_NAMES = (
    "Mr", "Mrs", "Ms", "Dr", "Dra", "St", "Ste", "Sr", "Sra", "Srta", "Prof", "Capt", "Sgt", "Lt", "Col", "Gen", "Gral", "Cdr", "Rev", "Hon",
    "No", "Nos", "fig", "figs", "vol", "vols", "p", "pp", "pág", "págs", "pag", "pagg", "art", "arts", "ch", "cap", "n", "núm", "nr", "nº", "v", "vs", "cf",
    "e.g", "i.e", "approx", "Hr", "Fr", "Frl", "Nr", "Str", "Abs", "z", "bzw", "dr", "MM", "Mgr", "sig", "sigg", "Sig", "dott", "Dott", "ing", "avv", "prof",
    "Av", "Avda", "Ud", "Uds", "Vd", "D", "ул", "пр", "г", "стр", "гл", "рис", "проф", "Проф", "др", "им", "акад", "см", "вул", "стор",
    "Dhr", "dhr", "Mevr", "mevr", "blz", "डॉ", "श्री", "सुश्री", "प्रो", "د", "أ", "م", "ص",
)

_IN = r"(?:[^{0}\n]++|\n(?![^\S\n]*\n))*+"  # up to a mark, but never over a blank line
_QUOTED = "|".join(
    a + _IN.format(stop) + b
    for a, stop, b in (
        ("“", "”“", "”"), ("„", "“”", "[“”]"), ("«", "»", "»"), ("「", "」", "」"), ("『", "』", "』"), ('"', '"', '"'), (r"\(", "()", r"\)"), ("（", "）", "）"), ("‘", "‘’", "’(?!\\p{{L}})"),
    )
).replace("{{", "{").replace("}}", "}")
_OPEN, _CLOSE = "“„«「『\"(（‘¿¡\\[", "”»」』\"'’)）\\]"
_PIECES = f'(?s)([\\x00-!#-\'\\x29-\\x7f]++|{_QUOTED}|[^“„«「『"(（‘]++|.)'  # plain runs first: the class is a table look-up


def masked(text: Column) -> Column:
    """The text with every terminator that ends nothing replaced by its placeholder; as long as before."""
    text = F.when(text.rlike(f"[{_OWN}]"), F.translate(text, _OWN, _ASIDE)).otherwise(text)
    for mark, mask in ((r"\.", MASKS[0]), (r"\?", MASKS[2]), ("!", MASKS[1])):  # addresses, decimals, letters run together
        text = F.regexp_replace(text, mark + r"(?=[\p{L}\p{N}/=&#_%])", mask)
    text = F.regexp_replace(text, r"\.(?<=\d\.)(?=\n\d)", MASKS[0])  # a decimal wrapped over a line
    text = F.regexp_replace(text, r"(?<![\p{L}\p{N}\p{M}])([\p{Lu}\p{Lo}&&[^぀-ヿ㐀-鿿]]\p{M}*)\.", "$1" + MASKS[0])  # initials
    names = "|".join(a.replace(".", "[." + MASKS[0] + "]") for a in sorted(BEFORE_NAMES, key=lambda a: (-len(a), a)))
    text = F.regexp_replace(text, rf"(?<![\p{{L}}\p{{N}}\p{{M}}])({names})\.", "$1" + MASKS[0])
    german = lambda x: x.rlike(r"\b(und|der|das|die|den|im)\b") & x.rlike("[äöüß„]")
    text = let(text, lambda x: F.when(german(x), F.regexp_replace(x, r"\.(?<=\d\.)(?=\s+\p{Lu})", MASKS[0])).otherwise(x))  # ordinals
    pieces = F.regexp_extract_all(text, F.lit(_PIECES), F.lit(1))
    inside = F.transform(pieces, lambda p: F.when((F.length(p) > 1) & p.rlike('^[“„«「『"(（‘]'), F.translate(p, TERMINATORS, MASKS)).otherwise(p))
    return F.array_join(inside, "")


def cut(text: Column) -> Column:
    """The masked text with a mark after every sentence."""
    t = masked(text)
    t = F.regexp_replace(t, r"\n[^\S\n]*\n\s*|\f", CUT)
    begins = rf"(?=\s+(?:[{_OPEN}]|\p{{Lu}}|\p{{Lt}}|[-–—]\s*\p{{Lu}}"
    t = F.regexp_replace(t, rf"(?=[.!?؟])(?<![.…])(\.|[!?؟]+\.*)([{_CLOSE}]*){begins}|[\p{{Lo}}&&[^\p{{IsDevanagari}}]]))", "$1$2" + CUT)
    t = F.regexp_replace(t, rf"([!?؟]+)([{_CLOSE}]*)(?=\s+\p{{IsDevanagari}})", "$1$2" + CUT)
    t = F.regexp_replace(t, rf"(?=[.!?؟])(?<=\p{{L}}{{4}})([.!?؟])([{_CLOSE}]*)(?=\s+\d)", "$1$2" + CUT)
    t = F.regexp_replace(t, rf"(\.{{2,}}|…+)([{_CLOSE}]*){begins}))", "$1$2" + CUT)
    t = F.regexp_replace(t, r"([。！？]+)([”」』’）)]*)", "$1$2" + CUT)
    t = F.regexp_replace(t, rf"([।॥]+)([{_CLOSE}]*)", "$1$2" + CUT)
    ended = MASKS.replace(MASKS[3], "")
    t = F.regexp_replace(t, rf"([{ended}][”“»\"’])(?=\s+[{_OPEN}]*\p{{Lu}})", "$1" + CUT)  # a quotation that stands alone
    t = F.regexp_replace(t, rf"([{ended}][”」』])(?=[“「『])", "$1" + CUT)
    return F.regexp_replace(t, r"(?=[  ])(?:(?<=[฀-๿])[  ]+(?=\S)|(?<=\S)[  ]+(?=[฀-๿]))", CUT)


_WIDE = rf"[\u3000-\u30ff\u3400-\u9fff\uff00-\uffef\u0e00-\u0e7f{MASKS[4:7]}]"


def sentence_array(text: Column) -> Column:
    """The sentences of a text in reading order, restored, line breaks as blanks (none in scripts without spaces)."""
    join = lambda t: F.when(t.rlike(_WIDE), F.regexp_replace(t, rf"(?<={_WIDE}\d{{0,9}})\s*\n\s*(?=[\d.,{MASKS[0]}]{{0,9}}{_WIDE})", "")).otherwise(t)
    t = F.regexp_replace(F.regexp_replace(let(cut(text), join), r"(?U)\s+", " "), f" ?{CUT} ?", CUT)
    own = lambda t: F.when(t.rlike(f"[{_ASIDE}]"), F.translate(t, _ASIDE, _OWN)).otherwise(t)
    parts = F.transform(F.split(F.translate(t, MASKS, TERMINATORS), CUT, -1), lambda p: F.trim(p))
    return F.transform(F.filter(parts, lambda p: F.length(p) > 0), own)


def end_array(text: Column) -> Column:
    """Where each sentence ends, in characters that are not white space."""
    sizes = F.transform(F.split(cut(text), CUT, -1), lambda p: F.length(F.regexp_replace(p, r"(?U)\s", "")).cast("long"))
    sizes = F.filter(sizes, lambda n: n > 0)
    start = F.struct(F.lit(0).cast("long").alias("n"), F.array().cast("array<bigint>").alias("ends"))
    step = lambda acc, n: F.struct((acc["n"] + n).alias("n"), F.array_append(acc["ends"], acc["n"] + n).alias("ends"))
    return F.aggregate(sizes, start, step, lambda acc: acc["ends"])


def ends(df: DataFrame, id_col: str = "render_id", text_col: str = "text") -> DataFrame:
    """(id, end_pos), one row per sentence; repeated rows count once."""
    return df.select(id_col, F.explode(end_array(F.col(text_col))).alias("end_pos")).distinct()


def sentences(df: DataFrame, id_col: str = "render_id", text_col: str = "text") -> DataFrame:
    """(id, sentence_no, sentence) in reading order, from 1."""
    once = df.select(id_col, text_col).dropDuplicates([id_col])
    at = once.select(id_col, F.posexplode(sentence_array(F.col(text_col))).alias("n", "sentence"))
    return at.select(id_col, (F.col("n") + 1).cast("long").alias("sentence_no"), "sentence")
