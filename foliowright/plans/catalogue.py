"""The engine's own operators as named queries over whole tables; their SQL is in ``oracles``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliowright.functions import naming as N
from foliowright.functions import text as T
from foliowright.operators import audit, layout, lexicon, lines
from foliowright.operators.watermark import site_gate, strip_watermarks
from foliowright.plans import batch
from foliowright.plans.clean import clean
from foliowright.plans.oracles import CASES, DIRTY, FIXES, SIGNALS
from foliowright.plans.oracles import ORACLES as RULES
from foliowright.plans.pipeline_sql import PLANS
from foliowright.plans.run import Run
from foliowright.session import spread
from foliowright.sources import files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = RULES | PLANS


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def dirty(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with one of each artefact put before their text by a deterministic expression."""
    return table(spark, sf, "documents").select("doc_id", F.expr(DIRTY).alias("text"))


def _rule(name: str, rule: Callable[[Column], Column], source: str = "dirty") -> None:
    """A query that applies one rule to every text."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        if source == "dirty":
            return dirty(spark, sf).select("doc_id", rule(F.col("text")).alias("text"))
        return table(spark, sf, source).select(F.col("render_id"), rule(F.col("text")).alias("text"))

    run.__name__, run.__doc__ = name, rule.__doc__
    QUERIES[name] = run


for _name, _f in {
    "straight_quotes": T.straight_quotes, "scanner_glyphs": T.drop_scanner_glyphs, "collapse_spaces": T.collapse_spaces, "ligatures": T.expand_ligatures,
    "keep_headers": T.keep_headers, "page_numbers": T.unglue_page_numbers, "join_wrapped": T.join_wrapped, "undot_words": T.undot_words, "unpipe_words": T.unpipe_words,
    "zeros_in_words": T.zeros_in_words, "misread_words": T.misread_words, "unglue_contractions": T.unglue_contractions, "repair_ocr": T.repair_ocr, "join_split_words": T.join_split_words, "ratios": T.ratios, "spaced_dashes": T.spaced_dashes,
    "punctuation": T.repair_punctuation, "articles": T.articles, "tidy": T.tidy, "normalize_titles": T.normalize_titles, "drop_markers": T.drop_markers,
    "drop_links": T.drop_links, "decorative_runs": T.drop_decoration, "promo_lines": T.drop_promo_lines, "cut_repeated_heading": T.cut_repeated_heading,
    "drop_repeated_headings": T.drop_repeated_headings, "page_breaks": T.page_breaks, "paragraph_text": T.paragraphs, "escape_markup": T.escape_markup, "snippets": T.snippet,
}.items():
    _rule(_name, _f)
for _name, _f in {"normalize_unicode": T.normalize_unicode, "build_quotes": T.straight_quotes, "build_ratios": T.ratios, "build_tidy": T.tidy}.items():
    _rule(_name, _f, "build_pdf")


# lines, paragraphs, pages


@query
def reconstruct_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    return lines.paragraph_rows(dirty(spark, sf), "doc_id", "text")


@query
def paragraph_counts(spark: SparkSession, sf: str) -> DataFrame:
    return lines.paragraph_rows(dirty(spark, sf), "doc_id", "text").groupBy("doc_id").agg(F.count("*").alias("n_paragraphs"), F.max(F.length("paragraph")).cast("long").alias("longest"))


@query
def doubled_headings(spark: SparkSession, sf: str) -> DataFrame:
    return lines.doubled_headings(dirty(spark, sf), "doc_id", "text")


@query
def numbered_headings(spark: SparkSession, sf: str) -> DataFrame:
    return lines.numbered_headings(dirty(spark, sf), "doc_id", "text")


@query
def duplicate_titles(spark: SparkSession, sf: str) -> DataFrame:
    t = dirty(spark, sf).select("doc_id", T.normalize_titles(F.replace("text", F.lit("\n"), F.lit("\n\n"))).alias("text"))
    return lines.duplicate_titles(t, "doc_id", "text")


@query
def drop_repeated_titles(spark: SparkSession, sf: str) -> DataFrame:
    t = T.normalize_titles(F.replace("text", F.lit("\n"), F.lit("\n\n")))
    return dirty(spark, sf).select("doc_id", T.drop_repeated_titles(t).alias("text"))


@query
def page_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return lines.pages(dirty(spark, sf), "doc_id", "text")


@query
def heading_violations(spark: SparkSession, sf: str) -> DataFrame:
    d = dirty(spark, sf).select("doc_id", F.posexplode(T.heading_violations(F.replace("text", F.lit("\n"), F.lit("\n\n")))).alias("n", "heading"))
    return d.select("doc_id", (F.col("n") + 1).cast("long").alias("n"), "heading")


@query
def page_layout(spark: SparkSession, sf: str) -> DataFrame:
    t = dirty(spark, sf).select("doc_id", T.page_breaks(T.normalize_titles(T.paragraphs(F.col("text")))).alias("text"))
    return layout.layout(t, "doc_id", "text")


@query
def build_layout(spark: SparkSession, sf: str) -> DataFrame:
    return layout.layout(spread(table(spark, sf, "build_pdf").select("render_id", "text")), "render_id", "text")


@query
def heading_only_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Lone headings among the paragraphs of all chapters, each taken as a page."""
    t = table(spark, sf, "build_pdf").select("render_id", F.replace("text", F.lit("\n\n"), F.lit("\f")).alias("text"))
    return layout.heading_only_pages(t, "render_id", "text")


# detectors


@query
def error_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Error pages among snippets, chapters and documents with signals put behind their text."""
    parts = (("edits", "edit_id", F.col("context")), ("build_pdf", "render_id", F.col("text")), ("documents", "doc_id", F.expr(SIGNALS)))
    found = None
    for name, key, text in parts:
        part = table(spark, sf, name).select(F.lit(name).alias("src"), F.col(key).alias("id"), T.error_page(text).alias("reason"))
        found = part if found is None else found.unionByName(part)
    return found.where("reason is not null")


@query
def low_confidence(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "build_pdf").where(T.low_confidence(F.col("text"))).select("render_id", F.coalesce(F.length(T.strip(F.col("text"))), F.lit(0)).cast("long").alias("n_chars"))


@query
def near_site_names(spark: SparkSession, sf: str) -> DataFrame:
    """Dotted tokens of all texts whose name is near a known site's."""
    src = dirty(spark, sf).select("text").unionByName(table(spark, sf, "edits").select(F.col("original").alias("text")))
    tokens = src.select(F.explode(F.regexp_extract_all("text", F.lit(r"([A-Za-z0-9]+)\.(?:net|com)"), F.lit(1))).alias("name"))
    counted = tokens.groupBy("name").agg(F.count("*").alias("n"))
    return counted.select("name", "n", site_gate(F.col("name")).alias("junk"))


@query
def site_watermarks(spark: SparkSession, sf: str) -> DataFrame:
    t = strip_watermarks(dirty(spark, sf), "text")
    return t.select("doc_id", "text", F.size("watermark_edits").cast("long").alias("n_removed"))


@query
def junk_cases(spark: SparkSession, sf: str) -> DataFrame:
    """Every document behind one of the pinned watermark cases: what is left of both, and what was logged."""
    case = F.element_at(F.array(*[F.lit(c[1]) for c in CASES]), (F.pmod("doc_id", F.lit(len(CASES))) + 1).cast("int"))
    src = table(spark, sf, "documents").select("doc_id", F.concat(case, F.lit("\n\n"), F.coalesce("text", F.lit(""))).alias("text"))
    t = strip_watermarks(src, "text", "found")
    names = F.array(*[F.lit(c[0]) for c in CASES])
    return t.select("doc_id", F.element_at(names, (F.pmod("doc_id", F.lit(len(CASES))) + 1).cast("int")).alias("kind"), "text", F.array_join(F.transform("found", lambda e: F.concat(e["rule"], F.lit(": "), e["original"])), "|").alias("log"))


# protected terms and dispatch


@query
def lexicon_order(spark: SparkSession, sf: str) -> DataFrame:
    return lexicon.ordered(table(spark, sf, "lexicon_terms"))


@query
def lexicon_variants(spark: SparkSession, sf: str) -> DataFrame:
    return lexicon.variants(table(spark, sf, "lexicon_terms"))


@query
def floor_outside_index(spark: SparkSession, sf: str) -> DataFrame:
    """Floor terms an index file lacks."""
    t = table(spark, sf, "lexicon_terms")
    part = lambda origin: t.where(F.col("origin") == origin).select("profile", "term")
    return part("floor").distinct().join(part("index"), ["profile", "term"], "left_anti")


def _profiled(spark: SparkSession, sf: str) -> DataFrame:
    """Chapters of profiled novels with their profile."""
    d = batch.dispatch(spread(table(spark, sf, "build_pdf").select("render_id", "novel", "text")), "novel", batch.registry(table(spark, sf, "dispatch_cases")))
    return d.where("profile is not null").select("render_id", "profile", "text")


@query
def protected_terms(spark: SparkSession, sf: str) -> DataFrame:
    """How often each protected term of each profile stands in each chapter."""
    terms = lexicon.load_all(table(spark, sf, "lexicon_terms"))
    # a repeated row repeats its counts: those are shuffled, not the texts
    return lexicon.term_counts(spread(table(spark, sf, "build_pdf").select("render_id", "text")), "render_id", "text", terms).distinct()


@query
def terms_kept(spark: SparkSession, sf: str) -> DataFrame:
    """Protected spans of every chapter of a profiled novel before and after cleaning; none should be lost."""
    terms = lexicon.load_all(table(spark, sf, "lexicon_terms"))
    done = clean(_profiled(spark, sf), "text", terms, profiled=True, profile_col="profile")
    n = lexicon.span_counts(done, "render_id", "profile", "text", "clean_text", terms)
    return n.distinct().withColumn("kept", F.col("after") >= F.col("before"))


@query
def dispatch_novels(spark: SparkSession, sf: str) -> DataFrame:
    reg = batch.registry(table(spark, sf, "dispatch_cases"))
    d = batch.dispatch(table(spark, sf, "run_metadata").select("run_id", "selected"), "selected", reg)
    return d.select("run_id", "norm_key", "pipeline", "mode", "has_profile", "index_filename")


@query
def dispatch_agrees(spark: SparkSession, sf: str) -> DataFrame:
    """Recorded mode and pipeline of every run beside what dispatch gives for its selection and for its novel."""
    reg = batch.registry(table(spark, sf, "dispatch_cases"))
    m = table(spark, sf, "run_metadata").select("run_id", "selected", "novel", F.col("mode").alias("was_mode"), F.col("pipeline").alias("was_pipeline"))
    own = batch.dispatch(m, "selected", reg).select("run_id", "novel", "was_mode", "was_pipeline", "mode", "pipeline")
    again = batch.dispatch(own.select("run_id", "novel", "was_mode", "was_pipeline", F.col("mode").alias("own_mode"), F.col("pipeline").alias("own_pipeline")), "novel", reg)
    same = (F.col("own_mode") == F.col("was_mode")) & (F.col("own_pipeline") == F.col("was_pipeline"))
    return again.select("run_id", "was_mode", "own_mode", "was_pipeline", "own_pipeline", F.col("pipeline").alias("novel_pipeline"), same.alias("agrees"))


@query
def novel_roster(spark: SparkSession, sf: str) -> DataFrame:
    cases = table(spark, sf, "dispatch_cases")
    return files.roster(cases.select("index_filename"), batch.registry(cases)).select("group", "entry")


@query
def editing_notes(spark: SparkSession, sf: str) -> DataFrame:
    cases = table(spark, sf, "dispatch_cases")
    base = spark.createDataFrame([("Base rules.",)], "text string")
    layers = batch.registry(cases).select(N.markdown_filename(F.col("display_name")).alias("name"), F.concat(F.lit("Layer of "), "profile").alias("text"))
    return files.notes(base, layers, cases.select(F.col("input_name").alias("novel")))


# names and paths


@query
def name_forms(spark: SparkSession, sf: str) -> DataFrame:
    x = F.col("input_name")
    return table(spark, sf, "dispatch_cases").select(
        "input_name", N.norm_key(x).alias("norm_key"), N.kebab(x).alias("kebab"), N.index_filename(x).alias("index_name"), N.markdown_filename(x).alias("markdown_name"),
        N.display_name(F.coalesce("index_filename", F.lit(""))).alias("display_name"), N.sanitize(x).alias("safe_name"), N.clean_novel(F.concat(x, F.lit(N.NO_PROFILE))).alias("unmarked"),
    )


@query
def upload_scan(spark: SparkSession, sf: str) -> DataFrame:
    return files.scan_upload(table(spark, sf, "batch_inputs").select("run_id", "seq", "path"))


@query
def natural_order(spark: SparkSession, sf: str) -> DataFrame:
    return files.in_natural_order(table(spark, sf, "batch_inputs").select("path").distinct()).select("path", F.replace("natural_key", F.lit("\u0001"), F.lit("|")).alias("natural_key"))


@query
def missing_inputs(spark: SparkSession, sf: str) -> DataFrame:
    b = table(spark, sf, "batch_inputs").select(F.concat_ws("/", "run_id", "seq").alias("item"), "run_id", "seq", "path", "file_exists")
    there = b.where("file_exists").select(F.col("item").alias("path"))
    return files.missing(b.select("run_id", "seq", F.col("path").alias("file"), F.col("item").alias("path")), there).select("run_id", "seq", F.col("file").alias("path"))


@query
def output_names(spark: SparkSession, sf: str) -> DataFrame:
    """Every input's output path without a collision, in processing order."""
    b = table(spark, sf, "batch_inputs").select("run_id", "seq", "path").distinct()
    b = b.withColumn("folder", N.mirrored(F.col("path"), "in", F.lit("out"))).withColumn("name", N.basename(F.col("path")))
    named = N.unique_paths(b, "folder", "name", ["run_id", "seq", "path"], block=F.floor(F.col("run_id") / 64))
    return named.select("run_id", "seq", "path", "output_path", N.debug_path(F.col("output_path")).alias("debug_path"))


@query
def next_batch_number(spark: SparkSession, sf: str) -> DataFrame:
    runs = table(spark, sf, "summary").select(N.basename(F.col("output_dir")).alias("folder"))
    return N.next_numbers(runs, "folder")


# batches and audit


@query
def input_statuses(spark: SparkSession, sf: str) -> DataFrame:
    return batch.statuses(table(spark, sf, "batch_inputs")).select("run_id", "seq", "path", "status")


@query
def batch_summary(spark: SparkSession, sf: str) -> DataFrame:
    return batch.summaries(batch.statuses(table(spark, sf, "batch_inputs")))


@query
def run_reports(spark: SparkSession, sf: str) -> DataFrame:
    """Recorded summaries beside what their runs' inputs give."""
    ours = batch.summaries(batch.statuses(table(spark, sf, "batch_inputs")))
    theirs = table(spark, sf, "summary").select("run_id", F.col("total").alias("said_total"), F.size("outputs").cast("long").alias("n_outputs"), "profile_applied")
    return ours.join(theirs, "run_id")


@query
def logged_edits(spark: SparkSession, sf: str) -> DataFrame:
    """Log rows by rule and category that changed something, flags apart."""
    e = table(spark, sf, "edits").dropDuplicates(["edit_id"]).where("original <> replacement")
    return e.groupBy("rule", "category").agg(F.count("*").alias("n"), F.sum((F.col("category") != "integrity_flag").cast("long")).alias("n_edits"))


@query
def edit_counts(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "edits").dropDuplicates(["edit_id"])
    return e.where("original <> replacement and category <> 'integrity_flag'").groupBy("doc_id").agg(F.count("*").alias("n_edits"), F.max("seq").cast("long").alias("last_seq"))


@query
def log_snippets(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "edits").select("edit_id", T.snippet(F.coalesce("context", F.lit(""))).alias("snippet"))


@query
def link_entries(spark: SparkSession, sf: str) -> DataFrame:
    """The audit entries of markers and links, found on texts as they are."""
    t = F.col("text")
    found = F.concat(audit.removals(t, T.AT_MARKER, "junk_strip.at_marker"), audit.removals(t, T.URL, "junk_strip.url"), audit.removals(t, T.WWW, "junk_strip.url"), audit.markers(t))
    return dirty(spark, sf).select("doc_id", F.explode(found).alias("e")).select("doc_id", "e.original", "e.rule")


@query
def audit_rows(spark: SparkSession, sf: str) -> DataFrame:
    done = clean(spread(dirty(spark, sf)), "text")
    return audit.rows(done, "doc_id")


@query
def audit_jsonl(spark: SparkSession, sf: str) -> DataFrame:
    done = clean(spread(dirty(spark, sf)), "text")
    return audit.jsonl(done, "doc_id", F.struct(F.lit("run_metadata").alias("record"), F.lit("universal").alias("pipeline")))


@query
def clean_universal(spark: SparkSession, sf: str) -> DataFrame:
    """Every chapter through the universal plan."""
    done = clean(spread(table(spark, sf, "build_pdf").select("render_id", "text")), "text")
    return done.select("render_id", "clean_text", audit.edit_count(F.col("edits")).alias("n_edits"), "error_reason")


@query
def clean_profiled(spark: SparkSession, sf: str) -> DataFrame:
    """Chapters of profiled novels, each with the terms of its profile, all profiles in one pass."""
    own = clean(_profiled(spark, sf), "text", lexicon.load_all(table(spark, sf, "lexicon_terms")), profiled=True, profile_col="profile")
    return own.select("render_id", "profile", "clean_text", audit.edit_count(F.col("edits")).alias("n_edits"))


@query
def forced_fixes(spark: SparkSession, sf: str) -> DataFrame:
    """Documents cleaned with forced substitutions, which headings are spared."""
    done = clean(spread(dirty(spark, sf)), "text", fixes=FIXES)
    n = F.size(F.filter("edits", lambda e: e["rule"] == "special_fixes")).cast("long")
    return done.select("doc_id", "clean_text", n.alias("n_fixes"))


def _batch(spark: SparkSession, sf: str, dry_run: bool = False) -> Run:
    inputs = table(spark, sf, "batch_inputs").distinct()
    terms = lexicon.load_all(table(spark, sf, "lexicon_terms"))
    return Run(inputs, table(spark, sf, "run_metadata").select("run_id", "selected"), batch.registry(table(spark, sf, "dispatch_cases")), terms, "out", "in", dry_run)


@query
def batch_results(spark: SparkSession, sf: str) -> DataFrame:
    """Every input of every run: its fate, its output and its clean text."""
    return _batch(spark, sf).results()


@query
def batch_dry_run(spark: SparkSession, sf: str) -> DataFrame:
    """The same without outputs."""
    return _batch(spark, sf, dry_run=True).results().select("run_id", "seq", "path", "status", "n_edits", "output_path")


@query
def batch_log(spark: SparkSession, sf: str) -> DataFrame:
    """What each run says, in order."""
    return _batch(spark, sf).log()


@query
def batch_totals(spark: SparkSession, sf: str) -> DataFrame:
    return _batch(spark, sf).summary()


@query
def batch_entries(spark: SparkSession, sf: str) -> DataFrame:
    """The audit entries of all outputs, with page flags."""
    return _batch(spark, sf).entries().select("run_id", "seq", "n", "original", "replacement", "rule", "category", "context")


@query
def clean_dirty(spark: SparkSession, sf: str) -> DataFrame:
    done = clean(spread(dirty(spark, sf)), "text", tier2=True, profiled=True)
    return done.select("doc_id", "clean_text", audit.edit_count(F.col("edits")).alias("n_edits"), F.size("heading_violations").cast("long").alias("n_violations"))


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return clean_universal(spark, sf)
