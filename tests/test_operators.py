import pytest
from pyspark.sql import functions as F

from foliowright.functions import naming as N
from foliowright.functions import text as T
from foliowright.operators import audit, layout, lexicon, watermark
from foliowright.plans import batch
from foliowright.plans.clean import clean


def one(spark, text):
    return spark.createDataFrame([(1, text)], "id int, text string")


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Kelia stuttered noelfire.net, then smiled.", "Kelia stuttered, then smiled."),
        ("She hung the lantern on novelfirenet", "She hung the lantern"),
        ('Flint clicked his tongue. Official source s\nnovelfire.net\n"I did not!"', 'Flint clicked his tongue.\n"I did not!"'),
        ("she wrote the novel\nnovelfirenet\nand smiled.", "she wrote the novel\nand smiled."),
        ("She mentioned webnovel.com in passing.", "She mentioned webnovel.com in passing."),
        ("paragraph one.\n\nparagraph two.", "paragraph one.\n\nparagraph two."),
        ("ran f r e e w e b n o v e l. c o m now", "ran now"),
        ("end \U0001d41f\U0001d42b\U0001d41e\U0001d41e\U0001d430\U0001d41e\U0001d41b\U0001d427\U0001d428\U0001d42f\U0001d41e\U0001d425.\U0001d41c\U0001d428\U0001d426 here", "end here"),
        ("...novelfire.netShe smiled", "...She smiled"),
        ("hire.com and dell.com", "and"),
    ],
)
def test_watermarks(text, want):
    assert watermark.clean(text)[0] == want
    assert watermark.clean(want)[0] == want


def test_watermark_gate_column_equals_python(spark):
    names = ["novelfire", "nvlfire", "webnovel", "hire", "velfire", "tower", "N0velF1re", "libraed", "cell", "abc", "nicenovels", "today", "fir"]
    got = {r[0]: r[1] for r in spark.createDataFrame([(n,) for n in names], "n string").select("n", watermark.site_gate(F.col("n"))).collect()}
    assert got == {n: watermark.is_site(n) for n in names}


@pytest.mark.parametrize(
    ("line", "want"),
    [("word " * 12_800, None), ("x novelfire.netNovel " * 3_200, None), ("read latest chapters at novelfire.net " * 1_684, ""), ("novel" * 12_800, None), ("f " * 32_000, None), ("want to read " * 4_900, None), ("((((" * 16_000, None), ("ire.net." * 8_000, None)],
)
def test_watermark_long_line_is_fast(line, want):
    import time

    t = time.time()
    got = watermark.clean(line.strip())[0]
    assert time.time() - t < 5
    assert want is None or got == want
    assert watermark.clean(got)[0] == got


def test_watermark_spans_are_logged():
    text, edits = watermark.clean("He left. Check latest chapters at novelfire.net. She slept, novlfire.net, and read on nicenovel.com")
    assert text == "He left. She slept,, and"
    assert [(e["original"], e["rule"]) for e in edits] == [("Check latest chapters at novelfire.net.", "junk_strip.domain"), ("novlfire.net", "junk_strip.domain"), ("read on nicenovel.com", "junk_strip.domain")]


def test_watermark_lines_that_hold_none_stay_in_the_jvm(spark):
    lines = ["webnovel.com", "a tower.com", "x.net", "panda", "novel fire net", "visit hire.com", "n0velfire.net", "f r e e w e b n o v e l. c o m", "\U0001d427x"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in lines], "t string").select(watermark.holds(F.col("t"))).collect()]
    assert got == [False, False, False, False, False, True, True, True, True]


def test_prefilter_passes_every_recorded_spelling(spark):
    df = spark.createDataFrame([(r,) for r in watermark.RECORDED], "t string")
    assert df.where(~watermark.may_hold(F.col("t"))).count() == 0


def test_mask_shields_terms(spark):
    mask = lexicon.Mask(("Almanach", "V|adion Reach"))
    d = one(spark, "Chapter 3 b0dy\nAlmanach b0dy V|adion  Reach almanach’s b0dy")
    got = d.select(mask.apply(F.col("text"), T.repair_ocr)).first()[0]
    assert got == "Chapter 3 b0dy\nAlmanach body V|adion  Reach almanach’s body"


def test_lexicon_order_and_variants(spark):
    t = spark.createDataFrame([("p", "Sunny # comment"), ("p", "Bright Castle"), ("p", "Sunny"), ("p", " "), ("p", None), ("p", "X")], "profile string, term string")
    assert [r.term for r in lexicon.ordered(t).orderBy("rank").collect()] == ["Bright Castle", "Sunny", "X"]
    assert {r.term for r in lexicon.variants(t).collect()} == {"Bright Castle", "Sunny", "Sunny's", "Sunny’s", "Sunnys", "X"}


def test_lexicon_json(spark):
    d = spark.createDataFrame([("p", '["a","b"]'), ("p", '{"terms":["c"]}'), ("p", "broken")], "profile string, j string")
    assert sorted(r.term for r in lexicon.from_json(d, "j").collect()) == ["a", "b", "c"]


def test_layout(spark):
    text = 'Chapter 1: A.\n\nBody & more.\n\f\nChapter 2: The Gate "Run!" he said'
    rows = layout.layout(one(spark, text), "id", "text").orderBy("page_no", "para_no", "part_no").collect()
    assert [(r.page_no, r.para_no, r.part_no, r.kind, r.text) for r in rows] == [(1, 1, 1, "heading", "Chapter 1: A."), (1, 2, 1, "body", "Body & more."), (2, 1, 1, "heading", "Chapter 2: The Gate."), (2, 1, 2, "body", '"Run!" he said')]


@pytest.mark.parametrize("text", [None, "", " \n\f "])
def test_layout_of_nothing(spark, text):
    assert layout.layout(one(spark, text), "id", "text").first().text == layout.NOTHING


def test_heading_only_pages(spark):
    rows = layout.heading_only_pages(one(spark, "Chapter 1: A.\n\f\nChapter 2: B.\nbody"), "id", "text").collect()
    assert [r.page_no for r in rows] == [1]
    assert layout.heading_only_pages(one(spark, "Chapter 1: A."), "id", "text").count() == 0


def test_natural_order(spark):
    paths = ["in/b.pdf", "in/a.pdf", "in/10/x.pdf", "in/2/y.pdf", "in/1/z.pdf", "in/10.pdf", "in/1.pdf", "in/2.pdf"]
    got = [r[0] for r in spark.createDataFrame([(p,) for p in paths], "p string").orderBy(N.natural_key(F.col("p"))).collect()]
    assert got == ["in/1.pdf", "in/2.pdf", "in/10.pdf", "in/a.pdf", "in/b.pdf", "in/1/z.pdf", "in/2/y.pdf", "in/10/x.pdf"]


def test_names(spark):
    x = F.col("n")
    f = lambda n, e: spark.createDataFrame([(n,)], "n string").select(e).first()[0]
    assert f("Re:Monster!", N.kebab(x)) == "re-monster"
    assert f("lord-of-the-mills.txt", N.display_name(x)) == "Lord of the Mills"
    assert f("A  b_C", N.norm_key(x)) == "a b c"
    assert f("dir/a<b>.. ", N.sanitize(x)) == "a_b_"
    assert f("...", N.sanitize(x)) == "untitled"
    assert f("out/DEBUG_a.pdf", N.debug_path(x)) == "out/DEBUG_a.txt"
    assert f("in/sub/a.pdf", N.mirrored(x, "in", F.lit("out"))) == "out/in/sub"
    assert f("else/a.pdf", N.mirrored(x, "in", F.lit("out"))) == "out"


def test_unique_paths_take_first_free(spark):
    d = spark.createDataFrame([(1, "o", "C.pdf"), (2, "o", "C.pdf"), (3, "o", "C.pdf"), (4, "o", "C_2.pdf"), (5, "p", "C.pdf")], "seq int, folder string, name string")
    taken = spark.createDataFrame([("o/C_3.pdf",)], "output_path string")
    got = {r.seq: r.output_path for r in N.unique_paths(d, "folder", "name", ["seq"], taken).collect()}
    assert len(set(got.values())) == 5
    assert got == {1: "o/C.pdf", 2: "o/C_4.pdf", 3: "o/C_5.pdf", 4: "o/C_2.pdf", 5: "p/C.pdf"}


def test_next_number(spark):
    d = spark.createDataFrame([("x-1",), ("X-5",), ("x-a",), ("y-9",)], "n string")
    assert N.next_number(d, "n", "x").first()[0] == 6
    assert N.next_number(d.where("false"), "n", "x").first()[0] == 1


def test_statuses_partition_the_input(spark):
    rows = [(1, 1, "a.pdf", True, "x" * 100, None), (1, 2, "b.pdf", False, None, None), (1, 3, "c.pdf", True, "short", None), (1, 4, "d.pdf", True, "x" * 200, "MemoryError"), (1, 5, "e.pdf", None, None, None)]
    b = batch.statuses(spark.createDataFrame(rows, "run_id int, seq int, path string, file_exists boolean, text string, raises string"))
    assert batch.summaries(b).first().asDict() == {"run_id": 1, "total": 5, "succeeded": 1, "failed": 1, "skipped": 3}


def test_dispatch_never_fails(spark):
    cases = spark.createDataFrame([("The Tower", "p", True, None), ("Other", None, False, "other.txt")], "input_name string, profile string, has_profile boolean, index_filename string")
    novels = spark.createDataFrame([("the_TOWER",), ("unknown one",), (None,), ("  ",)], "novel string")
    got = {r.novel: (r.pipeline, r.display_name, r.index_filename) for r in batch.dispatch(novels, "novel", batch.registry(cases)).collect()}
    assert got["the_TOWER"] == ("p", "The Tower", "the-tower.txt")
    assert got["unknown one"] == ("universal", "unknown one", "unknown-one.txt")
    assert got[None] == ("universal", "Universal", "") and got["  "] == ("universal", "Universal", "")


TEXT = "chapter 1 - The Gate\nHe said “stop” and ran — and fell. He scored 6/7.\nSee https://x.example/a now.\nCheck latest chapters at novelfire.net\n* * *\nIt was a explosion of tbe b0dy ,really."


def test_clean_plan_and_audit(spark):
    done = clean(one(spark, TEXT), "text", profiled=True).first()
    assert done.clean_text == 'Chapter 1: The Gate.\n\nHe said "stop" and ran, and fell. He scored 6 out of 7.\n\nSee  now.\n\nIt was an explosion of the body, really.'.replace("See  now", "See now")
    assert [e.rule for e in done.edits] == ["junk_strip.url", "junk_strip.domain", "junk_strip.decorative_run", "quote_normalize", "slash_replace", "em_dash"]


def test_clean_is_idempotent_and_keeps_columns(spark):
    first = clean(one(spark, TEXT), "text").select("id", F.col("clean_text").alias("text"))
    again = clean(first, "text").first()
    assert again.clean_text == again.text
    assert {"id", "text", "clean_text", "edits"} <= set(clean(one(spark, TEXT), "text").columns)


@pytest.mark.parametrize("text", [None, "", "\n\n", "x" * 200_000])
def test_clean_edge_texts(spark, text):
    assert clean(one(spark, text), "text").first().clean_text == (text or "").strip()


def test_forced_fix_spares_terms(spark):
    done = clean(one(spark, "Almanach is protected, Lmanach is not."), "text", terms=("Almanach",), fixes={"manach": "MANACH"}).first()
    assert done.clean_text == "Almanach is protected, LMANACH is not."
    assert [e.rule for e in done.edits] == ["special_fixes"]


def test_error_page_is_flagged_and_cleaned(spark):
    done = clean(one(spark, "You are being rate limited\nCloudflare Ray ID: 5 https://x.example/a"), "text").first()
    assert done.error_reason and done.edits[0].category == "integrity_flag" and "https" not in done.clean_text


def test_audit_jsonl_has_header_first(spark):
    d = clean(one(spark, TEXT), "text")
    lines = [r.line for r in audit.jsonl(d, "id", F.struct(F.lit("run_metadata").alias("record"))).orderBy("line_no").collect()]
    assert lines[0] == '{"record":"run_metadata"}' and '"rule":"junk_strip.url"' in lines[1]


def test_terms_of_every_profile_are_counted(spark, sf):
    from foliowright.plans.catalogue import QUERIES

    got = {r.profile: r.k for r in QUERIES["protected_terms"](spark, sf).groupBy("profile").agg(F.count("*").alias("k")).collect()}
    profiles = {r.profile for r in spark.read.parquet(f"{sf}/lexicon_terms.parquet").select("profile").distinct().collect()}
    assert set(got) == profiles and len(profiles) > 1
    kept = QUERIES["terms_kept"](spark, sf)
    assert kept.columns == ["render_id", "profile", "before", "after", "kept"] and kept.where("not kept").count() == 0


@pytest.mark.parametrize(
    ("text", "want"),
    [("Sunny and sunny’s", ["sunny", "sunny’s"]), ("Bright\nCastle, brightcastle", ["bright castle"]), ("unsunny sunnyx", []), ("xBright Castlesunny", ["bright castle", "sunny"]), ("V|adion Reach V|adion", ["v|adion reach"]), ("", []), ("Chapter", [])],
)
def test_term_spans(spark, text, want):
    terms = ("Sunny", "Bright Castle", "V|adion Reach", "Chapter", "x")
    assert sorted(lexicon.Finder(terms).spans(text)) == want
    d = one(spark, text).select(lexicon.Mask(terms, headings=False).hits(F.col("text")).alias("h"))
    plain = [" ".join(h.translate({0xE001: None, 0xE002: None}).lower().split()) for h in d.first().h]
    assert sorted(plain) == want


def test_clean_by_profile_equals_clean_of_each(spark):
    texts = ["b0dy of Sunny b0dy — and B0dyguard 3/4", "Kai b0dy ~~~ “x”", None]
    rows = [(i, p, t) for i, (p, t) in enumerate((p, t) for p in ("a", "b", None) for t in texts)]
    d = spark.createDataFrame(rows, "id int, profile string, text string")
    terms = {"a": ("B0dyguard", "~~~"), "b": ("b0dy",)}
    got = {r.id: (r.clean_text, r.edits) for r in clean(d, "text", terms, profiled=True, profile_col="profile").collect()}
    want = {}
    for p in ("a", "b", None):
        part = d.where(F.col("profile").eqNullSafe(p))
        want |= {r.id: (r.clean_text, r.edits) for r in clean(part, "text", terms.get(p, ()), profiled=p is not None).collect()}
    assert got == want and got[0][0] == "body of Sunny body, and B0dyguard 3 out of 4" and got[1][0].startswith("Kai body ~~~")


def batch_of(spark, dry_run=False):
    from foliowright.plans.run import Run

    page = "Chapter 1: A.\n" + "word " * 30 + ".\nChapter 2: B\nChapter 3: C\nEnd."
    rows = [
        (1, 1, "in/a/x.pdf", True, page, None), (1, 2, "in/b/x.pdf", True, "short", None), (1, 3, "in/a/gone.pdf", False, None, None), (1, 4, "in/a/bad.pdf", True, None, "PDFSyntaxError: no"),
        (1, 5, "in/a/x.pdf", True, page + " b0dy of “Sunny” b0dy", None), (2, 1, "y.pdf", None, None, None),
    ]
    inputs = spark.createDataFrame(rows, "run_id long, seq int, path string, file_exists boolean, text string, raises string")
    cases = spark.createDataFrame([("My Novel", "p", True, None)], "input_name string, profile string, has_profile boolean, index_filename string")
    return Run(inputs, spark.createDataFrame([(1, "my-novel")], "run_id long, selected string"), batch.registry(cases), {"p": ("b0dy",)}, "out", "in", dry_run)


def test_batch_fates_and_outputs(spark):
    got = {(r.run_id, r.seq): r for r in batch_of(spark).results().collect()}
    assert [got[1, k].status for k in range(1, 6)] == ["succeeded", "skipped (image-only/empty)", "skipped (not found)", "failed", "succeeded"] and got[2, 1].status == "skipped (not found)"
    assert got[1, 1].output_path == "out/in/a/x.pdf" and got[1, 5].output_path == "out/in/a/x_2.pdf" and got[1, 4].output_path is None
    assert got[1, 5].clean_text.endswith('b0dy of "Sunny" b0dy') and got[1, 4].reason == "PDFSyntaxError: no" and got[1, 5].pipeline == "p"
    assert {(r.run_id, r.total, r.succeeded, r.failed, r.skipped, r.novel, r.profile_applied) for r in batch_of(spark).summary().collect()} == {(1, 5, 2, 1, 2, "My Novel", True), (2, 1, 0, 0, 1, "Universal", False)}


def test_batch_flags_lone_headings_and_logs(spark):
    run = batch_of(spark)
    flags = [(r.seq, r.original, r.context, r.category) for r in run.entries().where("rule = 'pdf.heading_only_page_flag'").orderBy("seq").collect()]
    assert flags == [(1, "heading-only page(s): 2", "x.pdf", "integrity_flag"), (5, "heading-only page(s): 2", "x_2.pdf", "integrity_flag")]
    log = [r.message for r in run.log().where("run_id = 1").orderBy("part", "seq", "n").collect()]
    assert log[:6] == ["Starting batch: 5 file(s).", "Output folder: out", "Selected novel: my-novel", "Loaded universal editor rules (UNIVERSAL.md).", "Applied novel-specific editing layer for My Novel (built-in profile).", "Loaded 1 protected term(s) for My Novel."]
    assert "[4/5] bad.pdf — FAILED (PDFSyntaxError: no)" in log and "[3/5] gone.pdf — skipped (not found)" in log
    assert any(m.startswith("        ⚠ heading-only page(s) 2 in x.pdf") for m in log) and "Batch complete: 2 done, 1 failed, 2 skipped of 5." in log
    assert log[-5:] == ["Failed:", "  - bad.pdf (PDFSyntaxError: no)", "Skipped:", "  - x.pdf (image-only/empty)", "  - gone.pdf (not found)"]


def test_batch_writes_tables_and_dry_run_none(spark, tmp_path):
    batch_of(spark).write(f"file://{tmp_path}/out")
    audit_lines = [(r.file, r.line) for r in spark.read.parquet(f"file://{tmp_path}/out/audit").orderBy("file", "line_no").collect()]
    assert {f for f, _ in audit_lines} == {"out/in/a/x_replacements.jsonl", "out/in/a/x_2_replacements.jsonl"} and '"record":"run_metadata"' in audit_lines[0][1]
    assert {r.file for r in spark.read.parquet(f"file://{tmp_path}/out/debug").collect()} == {"out/in/a/DEBUG_x.txt", "out/in/a/DEBUG_x_2.txt"}
    assert spark.read.parquet(f"file://{tmp_path}/out/layout").count() > 4
    batch_of(spark, dry_run=True).write(f"file://{tmp_path}/dry")
    assert sorted(p.name for p in (tmp_path / "dry").iterdir()) == ["files", "log", "summary"]
    assert spark.read.parquet(f"file://{tmp_path}/dry/log").where("message like '%(dry run, %'").count() == 2


def test_watermark_errors_are_a_column(spark):
    d = spark.createDataFrame([(1, "at novelfire.net now"), (2, None)], "id int, text string")
    r = watermark.strip_watermarks(d, "text", error_col="why").orderBy("id").collect()
    assert [(x.text, x.why) for x in r] == [("now", None), (None, None)]


def test_natural_order_of_long_numbers(spark):
    names = ["x9" + "0" * 24, "x1" + "0" * 24, "x" + "9" * 20, "x2", "x10", "x" + "0" * 30 + "3"]
    got = [r.n for r in spark.createDataFrame([(n,) for n in names], "n string").orderBy(N.natural_key(F.col("n"))).collect()]
    assert got == ["x2", "x" + "0" * 30 + "3", "x10", "x" + "9" * 20, "x1" + "0" * 24, "x9" + "0" * 24]


def test_ranks_by_block_equal_ranks(spark):
    rows = [(i, "out", "a.pdf" if i % 3 else "b.pdf") for i in range(40)] + [(100, "out", "a_5.pdf")]
    d = spark.createDataFrame(rows, "k int, folder string, name string")
    taken = spark.createDataFrame([("out/a_3.pdf",)], "output_path string")
    one = {(r.k, r.output_path) for r in N.unique_paths(d, "folder", "name", ["k"], taken).collect()}
    assert one == {(r.k, r.output_path) for r in N.unique_paths(d, "folder", "name", ["k"], taken, block=F.floor(F.col("k") / 7)).collect()}
    assert len({p for _, p in one}) == 41 and ("out/a_3.pdf" not in {p for _, p in one})


def test_private_use_characters_survive_cleaning(spark):
    text = "Go \ue000on\ue001 b0dy\ue002 of the sur-\nface."
    assert clean(one(spark, text), "text", terms=("Sunny",)).first().clean_text == "Go \ue000on\ue001 body\ue002 of the surface."
