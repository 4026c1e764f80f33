"""Single rules against pinned pairs, and against sequential restatements on generated text."""

import random
import re

import pytest
from pyspark.sql import functions as F

from foliowright.functions import text as T

CASES = [
    (T.straight_quotes, "“Hi” «you»", '"Hi" "you"'),
    (T.drop_scanner_glyphs, "a■b�c", "abc"),
    (T.collapse_spaces, "trail   \nnext", "trail\nnext"),
    (T.expand_ligatures, "oﬃce ﬁt ﬆ", "office fit st"),
    (T.normalize_unicode, "a​b c é", "ab c é"),
    (T.unglue_page_numbers, "one\n12Sunny went", "one\nSunny went"),
    (T.join_wrapped, "sur-\nface", "surface"),
    (T.join_wrapped, "well-\nknown", "well-known"),
    (T.join_wrapped, "North-\nGate", "North-\nGate"),
    (T.join_split_words, "He was d efending the w all", "He was defending the wall"),
    (T.join_split_words, "cast a spell", "cast a spell"),
    (T.repair_ocr, "tbe b0dy of h.i.p.s and V|adion", "the body of hips and Vladion"),
    (T.repair_ocr, "Lith’swill", "Lith’s will"),
    (T.normalize_titles, "CHAPTER 1,000 - The End", "Chapter 1,000: The End.\n"),
    (T.normalize_titles, "Chapter 12: The Gate Sunny stood before the gate.", "Chapter 12: The Gate.\n\nSunny stood before the gate."),
    (T.normalize_titles, "Chapter 649: Did Someone Say Cats?.", "Chapter 649: Did Someone Say Cats?\n"),
    (T.normalize_titles, "chapter 7", "Chapter 7\n"),
    (T.repair_punctuation, "Well.It was good ,really", "Well. It was good, really"),
    (T.repair_punctuation, "years, lifetimes?... spent", "years, lifetimes?... spent"),
    (T.repair_punctuation, "Cats?. yes.. no,, 1,000", "Cats? yes. no, 1,000"),
    (T.articles, "a explosion, an book, a euphoria, a university, an hour, a one", "an explosion, a book, a euphoria, a university, an hour, a one"),
    (T.spaced_dashes, "ran — and fell", "ran, and fell"),
    (T.spaced_dashes, "stopped — Then ran", "stopped. Then ran"),
    (T.spaced_dashes, "rip—off", "rip—off"),
    (T.ratios, "rank 6/7 and/or", "rank 6 out of 7 and/or"),
    (T.ratios, "1/2/3", "1 out of 2/3"),
    (T.drop_decoration, "before -=-=- after", "before after"),
    (T.drop_decoration, "** A second footnote line.", "** A second footnote line."),
    (T.drop_decoration, "one\n* * *\ntwo", "one\ntwo"),
    (T.drop_decoration, "one\n\ntwo", "one\n\ntwo"),
    (T.drop_links, "See https://x.example/a and @@m@@ at www.y.example, ok", "See  and  at , ok"),
    (T.drop_promo_lines, "a\nAN: join discord.gg/x\nb", "a\nb"),
    (T.cut_repeated_heading, "Chapter 9 nine Chapter 9 nine", "Chapter 9 nine"),
    (T.drop_repeated_headings, "Chapter 1\na\nChapter 1 \nb", "Chapter 1\na\nb"),
    (T.paragraphs, "Chapter 7 The Gate\nthe gate stood\nopen. Then\n\nNext.", "Chapter 7 The Gate\n\nthe gate stood open. Then\n\nNext."),
    (T.drop_repeated_titles, "Chapter 1,0: A.\n\nx\n\nChapter 10: A.\n\ny", "Chapter 1,0: A.\n\nx\n\ny"),
    (T.page_breaks, "chapter 1\na\nchapter 2\nb", "chapter 1\na\n\f\nchapter 2\nb"),
    (T.tidy, "\n a\n\n\n\nb ", "a\n\nb"),
    (T.escape_markup, "a<b>&c", "a&lt;b&gt;&amp;c"),
]


@pytest.mark.parametrize("n", range(len(CASES)))
def test_pinned(n, spark):
    rule, text, want = CASES[n]
    got = spark.createDataFrame([(text,)], "text string").select(rule(F.col("text"))).first()[0]
    assert got == want


def test_null_and_empty(spark):
    df = spark.createDataFrame([(None,), ("",)], "text string")
    for rule in {c[0] for c in CASES}:
        got = [r[0] for r in df.select(rule(F.col("text"))).collect()]
        assert got[0] is None and got[1] in ("", None)


PIECES = ["a ", "b", " c ", "d", " — ", "—", "–", "Then", "x", ".", "..", "...", ",", "?", "!", " ", "\n", "h.i.p", "U.S.A", "6/7", "/8", "Chapter 3", "Chapter 3 ", "* * *", "~~", "-", "---", "sur-\nface", "well-\nknown"]


def _texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randrange(1, 14))) for _ in range(n)]


def _same(spark, rule, plain, seed):
    ts = _texts(3000, seed)
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(ts)], "i int, t string").select("i", rule(F.col("t")).alias("o")).orderBy("i").select("o").collect()]
    assert [(t, g) for t, g in zip(ts, got) if g != plain(t)][:3] == []


def test_undot_sequential(spark):
    _same(spark, T.undot_words, lambda t: re.sub(r"(?:[A-Za-z]\.){2,}[A-Za-z]", lambda m: m.group().replace(".", ""), t), 1)


def test_wrapped_sequential(spark):
    def plain(t):
        return re.sub(r"(?<![A-Za-z])([A-Za-z]+)-\n([a-z][A-Za-z]*)", lambda m: "surface" if (m[1] + m[2]).lower() == "surface" and m[1].lower() == "sur" else f"{m[1]}-{m[2]}", t)

    _same(spark, T.join_wrapped, plain, 2)


def test_paragraphs_sequential(spark):
    def plain(t):
        out, cur = [], []
        for raw in t.split("\n"):
            line = raw.strip()
            head = re.match(r"\s*chapter\s+\d", line, re.I)
            if cur and (not line or head or re.search(r"""[.!?…:]["'’”)\]]*$""", cur[-1]) and not line[:1].islower()):
                out.append(" ".join(cur))
                cur = []
            if head:
                out.append(line)
            elif line:
                cur.append(line)
        return "\n\n".join(out + ([" ".join(cur)] if cur else []))

    _same(spark, T.paragraphs, plain, 3)


def test_error_page_needs_two_signals(spark):
    df = spark.createDataFrame([("You are being rate limited. Cloudflare Ray ID: 1",), ("Cloudflare Ray ID only",)], "t string")
    a, b = [r[0] for r in df.select(T.error_page(F.col("t"))).collect()]
    assert a == "Cloudflare error page detected (signals: ray-id, rate-limited)" and b is None
