"""The cleaning plan: one fixed, meaning-preserving order of rules over whole documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliowright.functions import text as T
from foliowright.operators import audit
from foliowright.operators.lexicon import Mask
from foliowright.operators.watermark import strip_watermarks


# Rule, category and note of the rows that sum up a profiled run.
QUOTES_NOTE = ("quote_normalize", "quote", "curly doubles -> straight")
RATIOS_NOTE = ("slash_replace", "slash", "numeric ratio -> out of")
DASHES_NOTE = ("em_dash", "dash", "spaced em/en dash -> , or .")


def _repairs(c: Column) -> Column:
    """Repairs that must not touch protected spans."""
    for rule in (T.repair_ocr, T.join_split_words, T.collapse_spaces, T.ratios, T.spaced_dashes):
        c = rule(c)
    return c


# Private-use characters that rules mark spans with stand aside, as those of the last plane, where an input holds them.
_OWN = "\ue000\ue001\ue002"
_ASIDE = "\U0010fe00\U0010fe01\U0010fe02"


def _swap(c: Column, a: str, b: str) -> Column:
    return T.let(c, lambda x: F.when(x.rlike(f"[{a}]"), F.translate(x, a, b)).otherwise(x))


def _removed_runs(before: Column, terms: tuple[str, ...]) -> Column:
    return F.transform(T.decorations(before, terms), lambda x: audit.entry(x["run"], F.lit(""), F.lit("junk_strip.decorative_run"), "fingerprint", x["line"]))


class Terms:
    """Protected terms of a run: the same for all rows, or by the profile that a column names.

    ``each`` gives an expression of the terms; by profile, one branch of a CASE for each, of which a row runs its own.
    """

    def __init__(self, terms: tuple[str, ...] | dict[str, tuple[str, ...]], profile_col: str | None):
        self.column = F.col(profile_col) if profile_col else None
        self.by = {p: (t, Mask(t)) for p, t in terms.items()} if isinstance(terms, dict) else {}
        common = () if self.by else tuple(terms)
        self.common = (common, Mask(common))

    def each(self, make: Callable[[tuple[str, ...], Mask], Column]) -> Column:
        out = make(*self.common)
        for p, own in self.by.items():
            out = F.when(self.column == p, make(*own)).otherwise(out)
        return out


def clean(df: DataFrame, text_col: str, terms: tuple[str, ...] | dict[str, tuple[str, ...]] = (), fixes: dict[str, str] | None = None, profiled: bool = False, tier2: bool = False, profile_col: str | None = None) -> DataFrame:
    """Add ``clean_text``, ``edits`` (array of entries), ``heading_violations``, ``error_reason`` and ``rule_error`` (a rule that failed).

    ``terms`` are protected: of all rows, or by the profile in ``profile_col``, all profiles in one pass.  ``fixes`` are
    forced; a profiled run also sums up quotes, dashes and ratios (with a profile column, in rows that have one).
    Null texts are cleaned as empty.  Columns of the input are kept.
    """
    own = Terms(terms, profile_col)
    summed = F.col(profile_col).isNotNull() if profile_col else F.lit(True)
    fixes = fixes or {}
    raw, t = F.col("_raw"), F.col("_t")
    d = df.withColumn("_raw", F.coalesce(F.col(text_col), F.lit(""))).withColumn("error_reason", T.error_page(raw))
    flag = audit.entry(F.col("error_reason"), F.lit("[FLAGGED: whole-file error page - re-scrape needed]"), F.lit("junk_strip.error_page_flag"), "integrity_flag", F.substring_index(raw, "\n", 1))
    d = d.withColumn("_e", audit.only(F.col("error_reason").isNotNull(), flag))
    d = d.withColumn("_t", T.expand_ligatures(T.straight_quotes(T.normalize_unicode(_swap(raw, _OWN, _ASIDE)))))
    # site junk, before the scanner's squares go, because markers are spelled with them
    d = d.withColumn("_e", F.concat("_e", audit.markers(t))).withColumn("_t", T.drop_markers(t))
    for pattern, rule in ((T.AT_MARKER, "junk_strip.at_marker"), (T.URL, "junk_strip.url"), (T.WWW, "junk_strip.url")):
        d = d.withColumn("_e", F.concat("_e", audit.removals(t, pattern, rule))).withColumn("_t", F.regexp_replace(t, pattern, ""))
    d = strip_watermarks(d, "_t", "_marks", "rule_error")
    d = d.withColumn("_e", F.concat("_e", F.transform("_marks", lambda x: audit.entry(x["original"], F.lit(""), x["rule"], "fingerprint", x["context"]))))
    d = d.withColumn("_e", F.concat("_e", own.each(lambda x, _: _removed_runs(t, x)))).withColumn("_t", own.each(lambda x, _: T.drop_decoration(t, x)))
    if tier2:
        gone = own.each(lambda x, _: T.promo_lines(t, x))
        d = d.withColumn("_e", F.concat("_e", F.transform(gone, lambda x: audit.entry(T.strip(x), F.lit(""), F.lit("junk_strip.tier2_line"), "fingerprint", x)))).withColumn("_t", own.each(lambda x, _: T.drop_promo_lines(t, x)))
    for rule in (T.drop_scanner_glyphs, T.keep_headers, T.cut_repeated_heading, T.drop_repeated_headings, T.unglue_page_numbers, T.join_wrapped):
        d = d.withColumn("_t", rule(t))
    d = d.withColumn("_dashes", F.regexp_count(t, F.lit(rf"(?U)(?<!\S)\S++\s++{T.DASHES}\s++\S++"))).withColumn("_t", T.paragraphs(t))
    d = d.withColumn("_slashes", _slashes(t)).withColumn("_t", own.each(lambda _, mask: mask.apply(t, _repairs))).withColumn("_slashes", F.col("_slashes") - _slashes(t))
    if profiled:
        quotes = F.regexp_count(raw, F.lit(f"[{T.DOUBLE_QUOTES}]"))
        d = d.withColumn("_e", F.concat("_e", audit.summary(F.when(summed, quotes), *QUOTES_NOTE)))
    for bad in sorted(fixes, key=lambda k: (-len(k), k)):
        d = _force(d, own, bad, fixes[bad])
    for rule in (T.normalize_titles, T.repair_punctuation, T.articles, T.spaced_dashes, T.drop_repeated_titles, T.tidy, T.page_breaks):
        d = d.withColumn("_t", rule(t))
    if profiled:
        d = d.withColumn("_e", F.concat("_e", audit.summary(F.when(summed, F.col("_slashes")), *RATIOS_NOTE), audit.summary(F.when(summed, F.col("_dashes")), *DASHES_NOTE)))
    d = d.withColumn("clean_text", _swap(t, _ASIDE, _OWN)).withColumn("edits", audit.effective(F.col("_e"))).withColumn("heading_violations", T.heading_violations(t))
    return d.drop("_raw", "_t", "_e", "_marks", "_dashes", "_slashes")


def _force(d: DataFrame, own: Terms, bad: str, good: str) -> DataFrame:
    """One forced fix in the gaps between protected spans, with its entry."""
    t = F.col("_t")
    hit = own.each(lambda _, mask: F.exists(mask.gaps(t), lambda g: F.contains(g, F.lit(bad))))
    e = audit.entry(F.lit(bad), F.lit(good), F.lit("special_fixes"), "forced_substitution", F.lit(bad))
    d = d.withColumn("_e", F.concat("_e", audit.only(hit, e)))
    return d.withColumn("_t", own.each(lambda _, mask: mask.apply(t, lambda g: F.replace(g, F.lit(bad), F.lit(good)))))


def _slashes(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit("/"), F.lit("")))
