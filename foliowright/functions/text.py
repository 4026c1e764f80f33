"""Editorial rules as Column -> Column expressions; everything here stays inside the JVM.

Regular expressions carry the flags that give Unicode white space, digits and letter case.  Rules
that edit only some places use a private-use sentinel (U+E000) and undo it in the same rule.
Null texts stay null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SENTINEL = "\ue000"

# White space outside ASCII that counts as a plain blank.
SPACES = "\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000"
# Quotation marks folded to the straight one, glyphs scanners leave, ligatures.
DOUBLE_QUOTES = "\u201c\u201d\u201e\u201f\u275d\u275e\u301d\u301e\uff02\u00ab\u00bb"
SCANNER_GLYPHS = "\u25a0\u25a1\ufffd"
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
# Whole-word misreadings, split words and glued words with their repair.
MISREAD_WORDS = {
    "tbe": "the", "tiie": "the", "tlie": "the", "tihe": "the", "bis": "his", "liis": "his", "0f": "of", "0n": "on",
    "0ff": "off", "0nly": "only", "t0": "to", "0r": "or", "0ne": "one", "0ut": "out", "0wn": "own",
}
SPLIT_WORDS = (
    "i gnored", "r espectively", "c ontestants", "w ould", "c ould", "s hould", "i nto", "i ts", "i t", "i n", "i s", "o nly",
    "a bout", "a gain", "a fter", "a ll", "e very", "e ven", "a ny", "k now",
)
GLUED_WORDS = {"aspell": "a spell", "aline": "a line", "alot": "a lot", "afew": "a few", "alittle": "a little"}
# Characters taken for apostrophes and for long dashes.
APOSTROPHES = "['’‘ʼ´`]"
DASHES = "[–—―⸺]"
# Site markers, in the order they are looked for.
MARKERS = ("@@novelbin@@", "Free■ebnovel.c■m", "Free■ebn■vel.c■m", "All ■■■■■ full.com", "■■■■w■■■ov■■.co■")
# Patterns of markers and links.
AT_MARKER = r"@@[^@\n]{1,40}@@"
URL = r"(?iU)\bhttps?://\S+"
WWW = r"(?iU)\bwww\.[^\s,;)]+"
# Signals of a content network's error page, by name.
ERROR_SIGNALS = (
    ("ray-id", r"(?iU)cloudflare\s+ray\s+id"), ("security-footer", r"(?iU)performance\s*&\s*security\s+by"),
    ("error-url", r"(?i)developers\.cloudflare\.com|cloudflare-1xxx-errors"), ("rate-limited", r"(?iU)you\s+are\s+being\s+rate\s+limited"), ("error-code", r"(?iU)error\s+code[:\s]+10\d\d"),
)
# A promotional line, the start of a heading, and the least text of a readable file.
PROMO_LINE = r"(?iU)(read\s+(?:the\s+)?(?:latest|more|full)\s+chapter|visit\s+(?:us|our\s+site)|support\s+(?:the|us\s+on)|translator'?s?\s+note|donat|discord\.gg|ko-fi\.com|paypal\.me|\bAN:)"
HEADING_START = r"(?iU)^\s*Chapter\s+\d"
MIN_CHARS = 100


def strip(c: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]++|(?<![\s\x1c-\x1f])[\s\x1c-\x1f]++$", "")


def chain(c: Column, *steps: tuple[str, str]) -> Column:
    for pattern, by in steps:
        c = F.regexp_replace(c, pattern, by)
    return c


def by_line(c: Column, rule: Callable[[Column], Column]) -> Column:
    return F.array_join(F.transform(F.split(c, "\n", -1), rule), "\n")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def guarded(c: Column, test: str, rule: Callable[[Column], Column]) -> Column:
    """A rule of many passes, made only where its test finds work; the value is bound, so it is computed once."""
    return let(c, lambda x: F.when(x.rlike(test), rule(x)).otherwise(x))


# unicode


def drop_invisible(c: Column) -> Column:
    """Without control and format characters, other than line, page and tab breaks."""
    return F.regexp_replace(c, r"[\p{Cc}\p{Cf}&&[^\n\r\t\f]]", "")


def needs_composing(c: Column) -> Column:
    """Whether canonical composition could change a text: only then is it sent to Python."""
    return c.rlike(r"[^\x00-\u02ff\u0370-\u0482\u048a-\u058f\u2010-\u2027\u3001-\u3029\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fff\uff01-\uff5e\u0621-\u064a\u0e01-\u0e2e]")


@F.pandas_udf(StringType())
def _compose(s):  # noqa: ANN001, ANN202
    import unicodedata

    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


_compose = _compose.asNondeterministic()  # keeps the optimizer from copying it into later expressions


def compose(c: Column) -> Column:
    """Canonical composition (NFC): the one rule the JVM lacks; texts that cannot change are not sent."""
    return F.coalesce(_compose(F.when(needs_composing(c), c)), c)


def plain_spaces(c: Column) -> Column:
    return F.regexp_replace(c, f"[{SPACES}]", " ")


def normalize_unicode(c: Column) -> Column:
    return plain_spaces(compose(drop_invisible(c)))


def straight_quotes(c: Column) -> Column:
    return F.translate(c, DOUBLE_QUOTES, '"' * len(DOUBLE_QUOTES))


def drop_scanner_glyphs(c: Column) -> Column:
    return F.translate(c, SCANNER_GLYPHS, "")


def collapse_spaces(c: Column) -> Column:
    return chain(c, (r"[ \t]{2,}", " "), (r"(?<![ \t])[ \t]++\n", "\n"))


def expand_ligatures(c: Column) -> Column:
    for a, b in LIGATURES.items():
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


# lines and pages


def keep_headers(c: Column) -> Column:
    """Headers and footers are left alone: without page positions nothing tells them from text."""
    return c


def unglue_page_numbers(c: Column) -> Column:
    return F.regexp_replace(c, r"(?dmU)^\s*\d{1,4}(?=[A-Z][a-z])", "")


def join_wrapped(c: Column) -> Column:
    """Words cut at a line end, joined with their hyphen; the one pair known to be a single word without."""
    return chain(
        c,
        (r"(?<![A-Za-z])([A-Za-z]+)-\n([a-z][A-Za-z]*)", f"$1-{SENTINEL}$2"),
        (rf"(?i)(?<![A-Za-z])sur-{SENTINEL}face(?![A-Za-z])", "surface"),
        (SENTINEL, ""),
    )


def cut_repeated_heading(c: Column) -> Column:
    """A line is cut where the first chapter number that repeats on it comes again."""
    cut = r"(?iuUs)^(.*?Chapter\s+(\d+)(?!\d).*?)Chapter\s+\2(?!\d).*$"
    return by_line(c, lambda x: F.when(x.rlike(cut), F.regexp_replace(F.regexp_replace(x, cut, "$1"), r"(?U)\s+$", "")).otherwise(x))


def _is_chapter(x: Column) -> Column:
    return F.startswith(F.lower(strip(x)), F.lit("chapter "))


def drop_repeated_headings(c: Column) -> Column:
    """Of lines that say exactly the same heading, the first."""

    def keep(lines: Column) -> Column:
        plain = F.transform(lines, strip)
        first = F.filter(lines, lambda x, i: ~_is_chapter(x) | (F.array_position(plain, strip(x)) == i + 1))
        return F.array_join(first, "\n")

    return let(F.split(c, "\n", -1), keep)


def paragraphs(c: Column) -> Column:
    """Paragraphs from wrapped lines: a new one after a blank line, at a heading, and after a sentence's end unless a small letter follows."""
    ends = r"""[.!?…:]["'’”)\]]*$"""

    def build(lines: Column) -> Column:
        def piece(x: Column, i: Column) -> Column:
            prev = F.get(lines, i - 1)
            fresh = (i == 0) | (prev == "") | x.rlike(HEADING_START) | F.coalesce(prev.rlike(HEADING_START), F.lit(True)) | (prev.rlike(ends) & ~x.rlike(r"^\p{IsLowercase}"))
            return F.when(x == "", "").when(fresh, F.concat(F.lit("\n\n"), x)).otherwise(F.concat(F.lit(" "), x))

        return F.regexp_replace(F.array_join(F.transform(lines, piece), ""), r"^\n\n", "")

    return let(F.transform(F.split(c, "\n", -1), strip), build)


def page_breaks(c: Column) -> Column:
    """A form feed on its own line before every heading but the first."""

    def mark(lines: Column) -> Column:
        first = F.array_position(F.transform(lines, _is_chapter), F.lit(True))
        return F.array_join(F.transform(lines, lambda x, i: F.when(_is_chapter(x) & (i + 1 > first), F.concat(F.lit("\f\n"), x)).otherwise(x)), "\n")

    return let(F.split(c, "\n", -1), mark)


# headings

# The verbs that tell a body fused onto a heading, and the longest title.
_VERBS = "had|was|were|said|noticed|stood|gestured|thought|realized|found|saw|heard|felt|knew|told|asked|turned|looked|moved|began"
MAX_TITLE = 120


def _title_and_body(rest: Column) -> Column:
    """struct(title, body): body fused onto a heading is parted at "(Part N)", at "Name verb", or at a blank before MAX_TITLE."""
    part, fused = r"(?iuUd)^(.*?\s+\(Part\s+\d+\))\s+(.+)$", rf"(?Ud)^(.*?)\s+([A-Z][a-z]+\s+(?:{_VERBS})\s+)(.*)$"
    head = F.regexp_extract(F.substring(rest, 1, MAX_TITLE), r"(?d)^(.*) ", 1)
    pair = lambda a, b: F.struct(strip(a).alias("title"), strip(b).alias("body"))
    return (
        F.when(rest.rlike(part), pair(F.regexp_extract(rest, part, 1), F.regexp_extract(rest, part, 2)))
        .when(rest.rlike(fused), pair(F.regexp_extract(rest, fused, 1), F.concat(F.regexp_extract(rest, fused, 2), F.regexp_extract(rest, fused, 3))))
        .when((F.length(rest) > MAX_TITLE) & (F.length(head) > 20), pair(head, F.substr(rest, F.length(head) + 1)))
        .otherwise(F.struct(rest.alias("title"), F.lit("").alias("body")))
    )


def normalize_titles(c: Column) -> Column:
    """Heading lines as ``Chapter N: Title.`` and a blank line, then any body that was fused onto them."""
    rx = r"(?iuUd)^Chapter\s+(\d[\d,]*)\s*[:\-–—]?\s*(.*)$"

    def line(raw: Column) -> Column:
        def formed(x: Column) -> Column:
            number = F.regexp_extract(x, rx, 1)
            rest = F.regexp_replace(strip(F.regexp_extract(x, rx, 2)), r"(?U)^[:\-–—]+\s*", "")

            def titled(p: Column) -> Column:
                title = F.regexp_replace(p["title"], r"[ .]+$", "")
                end = F.when(title.rlike(r"[?!]$"), "").otherwise(".")
                return F.concat(F.lit("Chapter "), number, F.lit(": "), title, end, F.lit("\n"), F.when(p["body"] != "", F.concat(F.lit("\n"), p["body"])).otherwise(""))

            return F.when(~x.rlike(rx), raw).when(rest == "", F.concat(F.lit("Chapter "), number, F.lit("\n"))).otherwise(let(_title_and_body(rest), titled))

        return let(strip(raw), formed)

    return by_line(c, line)


HEADING_PARAGRAPH = r"(?iU)^Chapter\s+([\d,]+):"


def drop_repeated_titles(c: Column) -> Column:
    """Of heading paragraphs with the same number, commas aside, the first."""

    def keep(ps: Column) -> Column:
        number = lambda p: F.when(strip(p).rlike(HEADING_PARAGRAPH), F.replace(F.regexp_extract(strip(p), HEADING_PARAGRAPH, 1), F.lit(","), F.lit("")))
        numbers = F.transform(ps, number)
        return F.array_join(F.filter(ps, lambda p, i: number(p).isNull() | (F.array_position(numbers, number(p)) == i + 1)), "\n\n")

    return let(F.split(c, "\n\n", -1), keep)


def tidy(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def heading_violations(c: Column) -> Column:
    """Array of heading paragraphs, clipped, that are not in the normal form."""
    good = r"(?iuUd)^Chapter\s+[\d,]+:\s*.*?[.?!]\s*$"
    ps = F.transform(F.split(c, "\n\n", -1), strip)
    return F.transform(F.filter(ps, lambda p: F.startswith(F.lower(p), F.lit("chapter ")) & ~p.rlike(good)), lambda p: F.substring(p, 1, 120))


# words and punctuation


def undot_words(c: Column) -> Column:
    return F.regexp_replace(c, r"(?<=[A-Za-z])\.(?=[A-Za-z]\.[A-Za-z])|(?<=[A-Za-z]\.[A-Za-z])\.(?=[A-Za-z])", "")


def unpipe_words(c: Column) -> Column:
    return chain(c, (r"(?<=[a-zA-Z])\|(?=[a-zA-Z])", "l"), (r"(?<=[a-zA-Z])\\(?=[a-zA-Z])", "r"))


def zeros_in_words(c: Column) -> Column:
    return chain(c, (r"(?<=[a-zA-Z])0(?=[a-zA-Z'’])", "o"), (r"(?<=[a-zA-Z])00(?=[a-zA-Z])", "oo"))


def misread_words(c: Column) -> Column:
    return guarded(c, rf"(?U)\b(?:{'|'.join(MISREAD_WORDS)})\b", lambda x: chain(x, *[(rf"(?U)\b{bad}\b", good) for bad, good in MISREAD_WORDS.items()]))


def unglue_contractions(c: Column) -> Column:
    a = APOSTROPHES
    marked = [
        (rf"(?<![A-Za-z])([A-Za-z]++{a}s)([a-zA-Z]{{2,}})", "$1 $2"), (rf"(n{a}t)([a-zA-Z]{{2,}})", "$1 $2"),
        *[(rf"({a}{x})([a-zA-Z]{{2,}})", "$1 $2") for x in ("ll", "ve", "re")],
        (rf"(?U)\b([Ii]|[Ww]e|[Yy]ou|[Tt]hey|[Hh]e|[Ss]he|[Ii]t){a}(m|ve|re|ll|d)([a-zA-Z]{{2,}})\b", "$1'$2 $3"),
    ]
    c = guarded(c, rf"{a}[a-z]+[a-zA-Z]{{2}}", lambda x: chain(x, *marked))
    glued = [(rf"(?iuU)\b{bad}\b", good) for bad, good in GLUED_WORDS.items()]
    return guarded(c, rf"(?iuU)\b(?:{'|'.join(GLUED_WORDS)})\b", lambda x: chain(x, *glued))


def repair_ocr(c: Column) -> Column:
    for rule in (undot_words, unpipe_words, zeros_in_words, misread_words, unglue_contractions):
        c = rule(c)
    return c


def join_split_words(c: Column) -> Column:
    """Words an extraction split after one letter; a letter after the article "a" is left, and consumed, as it stands."""
    rejoin = r"(?U)(?<=\s)(?:(?<=a )([b-hj-z]\s[a-z])|([b-hj-z])\s([a-z]))"
    c = by_line(c, lambda x: F.regexp_replace(x, rejoin, "$1$2$3"))
    c = F.regexp_replace(c, r"(?U)\ba\s([bcdfghjklmnpqrstvwxyz])\1", "a$1$1")
    split = {w.replace(" ", r"\s+"): w.replace(" ", "") for w in SPLIT_WORDS}
    return guarded(c, rf"(?U)\b(?:{'|'.join(split)})\b", lambda x: chain(x, *[(rf"(?U)\b{bad}\b", good) for bad, good in split.items()]))


def ratios(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\b(\d+)\s*/\s*(\d+)\b", "$1 out of $2")


def spaced_dashes(c: Column) -> Column:
    """No long dash with blanks on both sides: a full stop before a capital, else a comma."""
    return guarded(c, DASHES, _spaced_dashes)


def _spaced_dashes(c: Column) -> Column:
    for _ in range(2):
        c = chain(c, (rf"(?U)(?<!\S)(\S++)\s++{DASHES}\s++(\S++)", f"$1{SENTINEL}$2"), (rf"{SENTINEL}(?=\p{{IsUppercase}})", ". "), (SENTINEL, ", "))
    nb = "\u00a0"
    for _ in range(4):
        for dash in (" — ", f"{nb}—{nb}", f"{nb}— ", f" —{nb}", " – ", f"{nb}–{nb}"):
            c = F.replace(c, F.lit(dash), F.lit(", "))
    return c


def repair_punctuation(c: Column) -> Column:
    return chain(
        c,
        (",,+", ","), (r"(?<!\.)\.\.(?!\.)", "."), (r"([?!])\.(?!\.)", "$1"), (",(?=[A-Za-z])", ", "),
        (r"(?<=[a-z])([.!?])(?=[A-Z])", "$1 "), (r"(?U)(?<!\s)\s++([,;:!?])", "$1"),
    )


def articles(c: Column) -> Column:
    return chain(c, (r"(?U)\b([Aa])\s+(?=(?!one\b|once\b|eu|ew)[aeio][a-z])", "$1n "), (r"(?U)\b([Aa])n\s+(?=[bcdfgjklmnpqrstvwxyz][a-z])", "$1 "))


# site junk


def drop_markers(c: Column) -> Column:
    for m in MARKERS:
        c = F.replace(c, F.lit(m), F.lit(""))
    return c


def drop_links(c: Column) -> Column:
    return chain(c, (AT_MARKER, ""), (URL, ""), (WWW, ""))


def _decoration(terms: tuple[str, ...]) -> tuple[str, str]:
    """Patterns of a standalone run that is no term, and of the run with the blank its removal closes."""
    shield = "".join(rf"(?!{_quote(t)}(?!\S))" for t in sorted(terms) if t and all(x in "~\\-=*# \t" for x in t))
    run = rf"(?<!\S){shield}[~\\\-=*#](?:[ \t]*[~\\\-=*#]){{2,}}(?!\S)"
    return run, rf"(?: (?>{run})(?=[.,;:!?])|(?<= )(?>{run}) |(?>{run}))"


def drop_decoration(c: Column, terms: tuple[str, ...] = ()) -> Column:
    """Without standalone runs of three or more decorative symbols; a line that held nothing else goes. Runs that are terms stay."""
    run, seam = _decoration(terms)
    lines = F.transform(F.split(c, "\n", -1), lambda x: F.when(x.rlike(run), F.nullif(strip(F.regexp_replace(x, seam, "")), F.lit(""))).otherwise(x))
    return F.array_join(F.filter(lines, lambda x: x.isNotNull()), "\n")


def decorations(c: Column, terms: tuple[str, ...] = ()) -> Column:
    """array<struct(run, line)>: the runs that ``drop_decoration`` removes, each with its line as it then is."""
    run, seam = _decoration(terms)

    def of_line(line: Column) -> Column:
        start = F.struct(line.alias("line"), F.array().cast("array<struct<run:string,line:string>>").alias("found"))

        def step(acc: Column, x: Column) -> Column:
            found = F.array_append(acc["found"], F.struct(x.alias("run"), acc["line"].alias("line")))
            return F.struct(strip(F.regexp_replace(acc["line"], rf"(?s)^(.*?){seam}", "$1")).alias("line"), found.alias("found"))

        return F.aggregate(F.regexp_extract_all(line, F.lit(run), F.lit(0)), start, step, lambda acc: acc["found"])

    return F.flatten(F.transform(F.filter(F.split(c, "\n", -1), lambda x: x.rlike(run)), of_line))


def _quote(s: str) -> str:
    return "".join("\\" + ch if ch in r"\^$.|?*+()[]{}-" else ch for ch in s)


def _promotional(x: Column, terms: tuple[str, ...]) -> Column:
    held = F.exists(F.array(*[F.lit(t.lower()) for t in terms]), lambda t: F.contains(F.lower(x), t)) if terms else F.lit(False)
    return x.rlike(PROMO_LINE) & ~held


def promo_lines(c: Column, terms: tuple[str, ...] = ()) -> Column:
    """The promotional lines that hold no protected term."""
    return F.filter(F.split(c, "\n", -1), lambda x: _promotional(x, terms))


def drop_promo_lines(c: Column, terms: tuple[str, ...] = ()) -> Column:
    """Without promotional lines, unless the line holds a protected term."""
    return F.array_join(F.filter(F.split(c, "\n", -1), lambda x: ~_promotional(x, terms)), "\n")


def error_page(c: Column) -> Column:
    """A reason where at least two signals of an error page agree, else null."""
    hits = F.filter(F.array(*[F.when(c.rlike(rx), F.lit(name)) for name, rx in ERROR_SIGNALS]), lambda x: x.isNotNull())
    return F.when(F.size(hits) >= 2, F.concat(F.lit("Cloudflare error page detected (signals: "), F.array_join(hits, ", "), F.lit(")")))


def low_confidence(c: Column) -> Column:
    return F.length(strip(F.coalesce(c, F.lit("")))) < MIN_CHARS


def snippet(c: Column, size: int = 160) -> Column:
    return F.substring(strip(F.regexp_replace(c, r"(?U)\s+", " ")), 1, size)


def escape_markup(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c
