"""Small tests of the training-data operators: pinned cases, brute force, round trips, held-out accuracy, edge tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliowright.llm import furniture, language, leakage, mixing, mojibake, queries, repeated_lines, residue, scans, sentences, textforms
from foliowright.llm.boosting import Booster

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def samples(spark):
    return spark.read.parquet(f"{DATA}/lang_samples.parquet")


@pytest.fixture(scope="session")
def garble(spark, samples):
    return mojibake.fit(samples.select("lang", "text"))


@pytest.fixture(scope="session")
def tongues(samples):
    return language.fit(samples)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(name, check):
    check(queries.QUERIES[name], queries.ORACLES[name])


# 1


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("ｔｈｅ bell", "the bell"), ("the be​ll", "the bell"), ("the bell", "the bell"), ("bеll", "bell"), ("café", "café"), ("ﬁre", "fire"), ("Kudro", "Kudro"),
        ("sold а charm", "sold a charm"), ("горcть пепла", "горсть пепла"), ("のボﾀﾝを", "のボタンを"), ("⼀把", "一把"), ("كلﻣة", "كلمة"), ("ギ", "ギ"),
    ],
)
def test_looks_alike_gets_one_form(text, want):
    assert textforms.unify(text) == want and textforms.is_case(text) and not textforms.is_case(want)


@pytest.mark.parametrize("text", [None, "", "plain", "“quoted” — yes…", "第１章".replace("１", "1") + "，好！", "น้ำแข็ง", "क़लम", "He read: На третий день а он ушёл.", "см. example.com", "nº 5, 2ª", "x" * 100_000])
def test_ordinary_spelling_is_no_case(text):
    assert not textforms.is_case(text) and textforms.unify(text) == text


def test_chapters_and_originals_are_unified(spark, sf):
    got = {(r.src, r.row_id): r.unified_text for r in queries.p1_unified(spark, sf).collect()}
    for src, key, col in (("build_pdf", "render_id", "text"), ("edits", "edit_id", "original")):
        rows = dict(spark.read.parquet(f"{sf}/{src}.parquet").select(key, col).collect())
        assert {i: t for (s, i), t in got.items() if s == src} == {i: t and textforms.unify(t) for i, t in rows.items()}


@pytest.mark.parametrize(
    ("text", "want"),
    [("ℌello", "Hello"), ("ℂ ℐ ℓ", "C I l"), ("㈱ ㎡ ㋀ ㍻", "(株) m2 1月 平成"), ("ʰello ᴬ", "hello A"), ("ɡɑme", "game"), ("Ꭺpple", "Apple"), ("ⅼine", "line"), ("ꓮsh аnd", "Ash and"), ("hοuse", "house")],
)
def test_letterlike_squared_raised_and_other_scripts(text, want):
    assert textforms.unify(text) == want and textforms.unify(want) == want


@pytest.mark.parametrize("text", ["™ ℃ № ª º ² ½", "[ˈfoʊɡɑː]", "ᏣᎳᎩ ᎦᏬᏂᎯᏍᏗ and Latin", "東京ラーメン", "서울 漢字", "Բարեւ and hello"])
def test_symbols_phonetics_and_other_writing_stay(text):
    assert textforms.unify(text) == text


def test_script_sets_are_intersected():
    assert textforms.resolved("東京ラーメン") == {"Japanese"} and textforms.resolved("bеll") == frozenset() and textforms.resolved("bell’s") == {"Latin"} and textforms.resolved("’") is None


# 2


@pytest.mark.parametrize(
    "text",
    ["{{ chapter_text | safe }}", "Chapter 5: Ash\n\n%chapter_body%", "Lorem ipsum dolor sit amet consectetur", "blah blah blah blah", "Chapter 2: X\n\nHe left.\n\n[INSERT content HERE]", "<CHAPTER_CONTENT>", "<story.text>", "undefined",
     "The courier repaired the governor's seal near the  #{chapter_text}", "Zandro carried a handful of cinders on the upper t {story.text}", "__story.text__"],
)
def test_slots_left_as_they_are(text):
    texts, slots, _ = residue.parts(text)
    assert slots and len(texts) <= residue.MAX_TRUE


@pytest.mark.parametrize("text", ["", " \n", "Chapter 5: Ash", "He wrote a script for the puppet play.", "The status window read [Skill: Step] {Rank: the old bell} and then went dark.", "Where the sign had said TITLE there was only a bowl, and beneath it [Brega was here]."])
def test_story_leaves_no_slot(text):
    assert not residue.parts(text)[1]


def _kept(df, name):
    return df.cache()


def test_page_templates_need_no_phrases(spark):
    """Error pages in a language of which the operator knows nothing, with slots; story that repeats a sentence; rare story."""
    rng = random.Random(5)
    say = lambda: " ".join(rng.choices("the old man crossed a bridge and sold his lamp near three towers under rain".split(), k=8)).capitalize() + "."
    pages = [f"Bu bölüm şu anda yüklenemiyor. Kod {rng.randrange(10**6)}" for _ in range(30)] + [f"{who} tekrar deneyin ve sayfayı yenileyin." for who in ("Lütfen daha sonra", "Birazdan") for _ in range(15)]
    rare = ["Yarın tekrar deneyin ve sayfayı yenileyin."]
    story = ["\n\n".join(["She waited by the gate."] + [say() for _ in range(8)]) for _ in range(60)]
    short = ["She waited by the gate."] * 30 + [say() for _ in range(50)]
    texts = pages + rare + story + short + [None, "", " "]
    d = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "render_id bigint, text string, src string")
    r = residue.Residue(residue.scan(d, "render_id", "text", "build_pdf"), _kept)
    assert {x.row_id for x in r.cases().collect()} == set(range(len(pages) + 1))
    slots = {(x.template, x.slot) for x in r.templates().collect()}
    assert ("* tekrar deneyin ve sayfayı yenileyin", "beginning") in slots


def test_residue_of_no_rows(spark):
    d = spark.createDataFrame([], "render_id bigint, text string")
    r = residue.Residue(residue.scan(d, "render_id", "text", "build_pdf"), _kept)
    assert r.cases().count() == 0 and r.templates().count() == 0


def test_skeleton_slots():
    assert residue.skeleton("Error 404 at a-b.example, id 9f3a516a8c45") == residue.skeleton("Error 503 at c.example, id 0011aabbcc99")
    assert residue.key(residue.words_of("The br https://a.example/c/1 idge.")) == residue.key(["the", "bridge"])


# 3


def test_wrong_encoding_round_trip(garble, samples):
    """Every pair restores what it garbled, and clean samples are left alone."""
    d = mojibake.Decoder(garble)
    clean = {r.lang: r.text for r in samples.orderBy("sample_id").collect()}
    assert [t for t in clean.values() if list(d.spans([t]))] == []
    for lang, k in (("fr", 1), ("ru", 3), ("zh", 0), ("de", 4), ("es", 7), ("ru", 24), ("ar", 34), ("pt", 2)):
        t = clean[lang] * 3
        g = mojibake.garble(t, k)
        spans = list(d.spans([g]))
        assert spans, (lang, mojibake.PAIRS[k])
        out = g
        for _, a, b, s, _ in sorted(spans, key=lambda x: -x[1]):
            out = out[:a] + (s if s is not None else out[a:b]) + out[b:]
        assert sum(x != y for x, y in zip(out, t)) <= 0.02 * len(t), (lang, mojibake.PAIRS[k])


def test_lost_bytes_are_found_not_restored(garble):
    spans = list(mojibake.Decoder(garble).spans(["Il dit � Fermez la porte ! � puis partit."]))
    assert spans and all(s[3] is None for s in spans)


def _many_samples(spark):
    """More samples than 5,000, those of the alphabetically last language behind them."""
    rows = [("en", f"The clerk wrote line {i} at the café.") for i in range(5100)] + [("uk", t) for t in ("Їжак пішов додому, бо їсти хотів.", "Ґанок старої хати стояв біля лісу, і є там вода.")]
    return spark.createDataFrame(rows, "lang string, text string")


def test_the_garble_model_counts_every_sample(spark):
    d = _many_samples(spark)
    m = mojibake.fit(d)
    assert {ord(c) for c in "їєґ"} <= set(m.chars) and m.uni["é"] == 5100 and m.bi["ї", "ж"] == 0 and m.bi["Ї", "ж"] == 1
    one, many = mojibake.fit(d.coalesce(1)), mojibake.fit(d.repartition(17))  # how the table is parted does not matter
    assert one.chars == many.chars and (one.emit == many.emit).all() and one.uni == many.uni and one.bi == many.bi


def test_lookalikes_are_judged_with_every_sample(spark, samples, tmp_path):
    """A garbled text in the language of the last samples is no case of look-alikes, though it holds other blanks."""
    text = samples.where("lang = 'ru'").orderBy("sample_id").first().text
    bad = "\n".join(filter(None, (mojibake.garble(w, mojibake.PAIRS.index(("cp866", "cp1251"))) for w in text.splitlines())))
    assert "\u00a0" in bad and textforms.is_case(bad)
    spark.createDataFrame([(1, bad), (2, "a\u200bb"), (3, text)], "render_id bigint, text string").write.parquet(f"{tmp_path}/build_pdf.parquet")
    spark.createDataFrame([(1, bad), (2, "a\u00a0b")], "edit_id bigint, original string").write.parquet(f"{tmp_path}/edits.parquet")
    d = _many_samples(spark).where("lang = 'en'").unionByName(samples.where("lang = 'ru'").select("lang", "text"))
    d.write.parquet(f"{tmp_path}/lang_samples.parquet")
    d.limit(0).write.parquet(f"{tmp_path}/eval_items.parquet")
    assert {tuple(r) for r in queries.p1_found(spark, str(tmp_path)).collect()} == {("build_pdf", 2), ("edits", 2)}


def test_counts_of_lines_are_those_of_the_whole(samples):
    """Counting the samples one by one gives what counting a language at once does, multibyte leftovers included."""
    for lang in ("fr", "ja", "ru"):
        texts = [r.text for r in samples.where(F.col("lang") == lang).orderBy("sample_id").limit(12).collect()]
        got, want = {}, {}
        for into, parts in ((want, [texts]), (got, [[t] for t in texts])):
            for part in parts:
                for key, kind, j, keys, n in mojibake.tally(lang, part):
                    for k, x in zip(keys.tolist(), n.tolist()):
                        if not (mojibake.UNI > kind >= len(mojibake.FORMS) and (j, k) == (0, 1)):  # this says only whether any line is changed
                            into[key, kind, j, k] = into.get((key, kind, j, k), 0) + x
        assert got == want


@pytest.mark.parametrize("text", ["AMANHÃ NÃO. CONTRA TODOS", "He carved the letters Ã and Â into it.", "Îles, Âge and ÜBER", "A fee of £6 or €6, 6 °C", "ПЕРЕВОД КОМАНДЫ", "她等了又等……然后", "uncoνered", "floor ﬂoor", ""])
def test_correct_accents_are_no_garble(garble, text):
    assert list(mojibake.Decoder(garble).spans([text])) == []


# 4


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Dr. A. Reed paid 7.5 crowns, e.g. for oil. He left.", ["Dr. A. Reed paid 7.5 crowns, e.g. for oil.", "He left."]),
        ('"Stop! Put it down!" he said. Then\nrain fell.', ['"Stop! Put it down!" he said.', "Then rain fell."]),
        ("Below lay ropes, lamps, etc. Orga left... and then came back.", ["Below lay ropes, lamps, etc.", "Orga left... and then came back."]),
        ("Am 3. Mai und der Abt. „Halt! Nein!“, rief er.", ["Am 3. Mai und der Abt.", "„Halt! Nein!“, rief er."]),
        ("“站住！放下。”他说。水位4.25尺！", ["“站住！放下。”他说。", "水位4.25尺！"]),
        ("「待て！」と言った。次。", ["「待て！」と言った。", "次。"]),
        ("กฎข้อ18.30ห้าม ตอนเช้า", ["กฎข้อ18.30ห้าม", "ตอนเช้า"]),
        ("डॉ. राम गया। वह रुकी... और चली।", ["डॉ. राम गया।", "वह रुकी... और चली।"]),
        ("«من؟» صاح. كتب د. علي رسالة.", ["«من؟» صاح.", "كتب د. علي رسالة."]),
        ("Chapter 1\n\nHe stopped (why? who knew) and sat.", ["Chapter 1", "He stopped (why? who knew) and sat."]),
        ("", []), (" \n\n ", []),
    ],
)
def test_sentences(spark, text, want):
    r = spark.createDataFrame([(text,)], "t string").select(sentences.sentence_array(F.col("t")).alias("s"), sentences.end_array(F.col("t")).alias("e")).first()
    assert r.s == want
    sizes = [len("".join(s.split())) for s in want]
    assert r.e == [sum(sizes[: i + 1]) for i in range(len(sizes))]


def test_sentences_of_null_and_long(spark):
    d = spark.createDataFrame([(1, None), (2, "A b. " * 5000), (2, "A b. " * 5000)], "render_id bigint, text string")
    assert sentences.ends(d).count() == 5000


def test_private_use_characters_of_the_input_come_back(spark):
    d = spark.createDataFrame([("One \ue001 two\ue010. Three 3.5!\n\n\ue004",)], "t string")
    assert d.select(sentences.sentence_array(F.col("t"))).first()[0] == ["One \ue001 two\ue010.", "Three 3.5!", "\ue004"]


# 5


def test_repeated_lines_match_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for i in range(300):
        site = rng.choice(["a", "a", "a", "b", None])
        text = rng.choice([None, "", "\n".join(rng.choice(["Share this!", " share  THIS! ", "12", f"story {i}", "Read on", "x"]) for _ in range(4))])
        rows.append((i, site, text))
    rows += rows[:40]
    d = spark.createDataFrame(rows, "render_id bigint, site string, text string").withColumn("rendered_at", F.current_timestamp())
    sites, seen = {}, {}
    norm = lambda x: " ".join(x.split()).lower()
    for i, s, t in set(rows):
        sites[s] = sites.get(s, 0) + 1
        for x in {norm(x) for x in (t or "").split("\n") if any(c.isalpha() for c in x)}:
            seen[s, x] = seen.get((s, x), 0) + 1
    want = {(i, n + 1) for i, s, t in rows for n, x in enumerate((t or "").split("\n")) if any(c.isalpha() for c in x) and seen[s, norm(x)] >= 5 and seen[s, norm(x)] >= 0.03 * sites[s]}
    got = [(r.render_id, r.line_no) for r in repeated_lines.excessive_lines(d).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_repeated_lines_of_nothing(spark):
    d = spark.createDataFrame([], "render_id bigint, site string, text string, rendered_at timestamp")
    assert repeated_lines.excessive_lines(d).count() == 0


def test_republished_articles_are_no_boilerplate(spark):
    import datetime as dt

    day = lambda n: dt.datetime(2024, 1, 1 + n)
    story = "The same chapter.\nIts second line."
    rows = [(i, "s", story, day(i % 3)) for i in range(20)] + [(100 + i, "s", f"Share this!\nLine {chr(97 + i)} {chr(98 + i)}.", day(i % 4)) for i in range(12)]
    rows += [(200 + i, "t", f"Today only!\nWord {chr(97 + i)}.", day(0)) for i in range(8)]
    d = spark.createDataFrame(rows, "render_id bigint, site string, text string, rendered_at timestamp")
    lines = lambda by: {(r.render_id, r.line_no) for r in repeated_lines.excessive_lines(d, by=by).collect()}
    assert lines("clusters") == {(100 + i, 1) for i in range(12)}
    assert lines("rows") == {(i, n) for i in range(20) for n in (1, 2)} | {(100 + i, 1) for i in range(12)} | {(200 + i, 1) for i in range(8)}


# 6


PAGE = "Chapter 7: The Gate / Oror\n\nThe quartermaster went home to-\ngether with the widow.\n- 12 -\n\f\nTHE HOLLOW TOWER    13\nShe slept.\n\n7\n"


@pytest.fixture(scope="session")
def furniture_model(spark, sf):
    clean = spark.read.parquet(f"{sf}/build_pdf.parquet").where("medium <> 'scan' and text is not null").select("novel", "text").distinct()
    return furniture.Furniture(scans._plain).fit(clean, scans._damage)


def test_page_furniture(furniture_model):
    (page,) = furniture_model.read([(PAGE, "The Hollow Tower")])
    assert [(i + 1, k) for i, k in enumerate(page.kind) if k in ("header", "page_number")] == [(5, "page_number"), (7, "header"), (10, "page_number")]


def test_furniture_of_held_out_pages(furniture_model, spark):
    """Made pages of other texts than those the classifier was fitted on."""
    rng, good, said, true = np.random.default_rng(99), 0, 0, 0
    rows = spark.read.parquet("/root/testdata/sf0.01/build_pdf.parquet").where("medium = 'web' and length(text) between 400 and 20000").select("novel", "text").distinct().orderBy("text").limit(200).collect()
    for novel, text in rows:
        made, kinds = furniture.make_page(text, novel, rng, scans._damage)
        (page,) = furniture_model.read([(made, novel)])
        got = {i: k for i, k in enumerate(page.kind) if k in ("header", "page_number")}
        good, said, true = good + len(got.items() & kinds.items()), said + len(got), true + len(kinds)
    assert good >= 0.95 * true and good >= 0.95 * said, (good, said, true)


@pytest.mark.parametrize("text", ["", "\f", "\f\n\f", "x", "\n\n12\n\f\n"])
def test_page_edge_texts(text, furniture_model):
    for page in furniture_model.read([(text, None), (text, "")]):
        scans._tokens(page)


@pytest.mark.parametrize(("printed", "read", "want"), [("the", "tbe", (1, 0)), ("evening", "everiing", (1, 0)), ("silver", "si1ver", (1, 0)), ("widow", "wiclow", (1, 0)), ("house", "mouse", (0, 1)), ("buried", "biiriecl", (2, 0))])
def test_confusions(printed, read, want):
    assert scans.edits(printed, read) == want


def test_language_of_a_scan_is_told_by_all_words():
    stops = scans.Stops({"en": frozenset(["the", "and"]), "fr": frozenset(["le", "et"])})
    assert stops.language(["le", "mot"] * 100 + ["the", "word"] * 150) == "en"
    assert stops.language(["mot"] * 200 + ["Le"]) == "fr" and stops.language(["word"] * 300) == ""


def test_fold_in_the_jvm_equals_python(spark):
    words = ["twiri", "deiix", "blind", "bl!nd", "rnade", "vvidow", "handclul", "ciiivre", "O1d"]
    got = {r[0]: r[1] for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", scans._grams(scans.fold(F.col("w")))).collect()}
    assert {w: frozenset(g) for w, g in got.items()} == {w: scans._shape(w) for w in words}


def test_no_confusion_changes_the_strokes(spark):
    pairs = [(f"{x}{a}{y}", f"{x}{b}{y}") for a, b in scans.CONFUSIONS for x in ("", "i", "r", "c") for y in ("", "i", "n", "l")]
    assert [p for p in pairs if scans._strokes(p[0]) != scans._strokes(p[1])] == []
    got = spark.createDataFrame(pairs, "a string, b string").select("a", scans.strokes(F.col("a")).alias("s")).collect()
    assert all(r.s == scans._strokes(r.a) for r in got)


def test_every_listed_confusion_is_a_candidate(spark):
    pairs = {"kriife": "knife", "ciiivre": "cuivre", "niiit": "nuit", "qiii": "qui", "tlie": "the", "aud": "and", "c4t": "cat", "ca7": "cat", "lcey": "key"} | {f"a{b}z": f"a{a}z" for a, b in scans.CONFUSIONS}
    rows = [("en", good, 100, 0, 0, 0) for good in set(pairs.values())] + [("en", bad, 0, 1, 0, 0) for bad in set(pairs) - set(pairs.values())]
    lex = spark.createDataFrame(rows, scans.LEXICON_SCHEMA)
    got = {(r.word, r.candidate) for r in scans.candidates(lex).collect()}
    assert {p for p in pairs.items() if p[0] not in pairs.values()} <= got


def test_candidates_equal_brute_force(spark):
    """All pairs that share enough q-grams of their shapes or have the same strokes, each once, and the ranker decides on them."""
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("abcehilnorstu1") for _ in range(rng.randint(2, 9))) for _ in range(150)} | {"house", "houfe", "candle", "cardle", "knife", "kriife", "the", "tlie", "minimum", "rninirnurn", "aaaa", "aaaaaaaa"})
    rows = [("en", w, *((20 + i, 0) if i % 2 else (0, 1 + i % 5)), 0, 0) for i, w in enumerate(words)] + [("fr", "houfe", 0, 1, 0, 0), ("fr", "house", 9, 0, 0, 0), ("de", "houfe", 0, 1, 0, 0)]
    share = lambda a, b: len(scans._shape(a) & scans._shape(b)) / len(scans._shape(a) | scans._shape(b))
    known = [(lang, w, clean + scan) for lang, w, clean, scan, *_ in rows if clean + scan >= scans.KNOWN and w.isalpha()]
    doubt = [(lang, w, scan) for lang, w, clean, scan, *_ in rows if scan and clean < scans.KNOWN and not w.isdigit()]
    want = [(lang, w, n, v, t, round(share(w, v), 9)) for lang, w, n in doubt for other, v, t in known if lang == other and w != v and t > n and (share(w, v) >= scans.SHARED or scans._strokes(w) == scans._strokes(v))]
    lex = spark.createDataFrame(rows, scans.LEXICON_SCHEMA)
    assert sorted((*r[:5], round(r.share, 9)) for r in scans.candidates(lex).collect()) == sorted(want)
    small = spark.createDataFrame([("en", "house", 100, 0, 0, 0), ("en", "houfe", 0, 1, 0, 0), ("en", "hcuse", 0, 1, 0, 0), ("en", "h0use", 0, 1, 0, 0)], scans.LEXICON_SCHEMA)
    x = np.zeros((400, 10))
    x[:, 6] = np.arange(400) / 400
    keen = Booster().fit(x, (x[:, 6] > 0.3).astype(float))  # goes by the q-grams only
    assert {r.word for r in scans.corrections(small, keen).collect()} == {"houfe", "hcuse", "h0use"}
    assert {r.word for r in scans.corrections(small, Booster()).collect()} == {"h0use"}  # one with nothing to learn from


def test_a_misread_word_is_no_reading(spark):
    import numpy as np

    x = np.zeros((800, 10))
    x[:, 0] = 1 + np.arange(800) % 2
    more = Booster().fit(x, ((x[:, 0] == 2) | (np.arange(800) % 8 > 1)).astype(float))  # surer of two confusions than of one
    lex = spark.createDataFrame([("en", "cold", 100, 0, 0, 0), ("en", "colcl", 0, 5, 0, 0), ("en", "c0ld", 0, 1, 0, 0)], scans.LEXICON_SCHEMA)
    assert {(r.word, r.good) for r in scans.corrections(lex, more).collect()} == {("colcl", "cold"), ("c0ld", "cold")}


def test_booster_learns():
    import numpy as np

    x = np.random.default_rng(1).normal(size=(600, 3))
    y = ((x[:, 0] > 0) & (x[:, 1] > 0)).astype(float)
    assert ((Booster().fit(x[:400], y[:400]).predict(x[400:]) > 0.5) == y[400:]).mean() > 0.95


def test_scan_repair_on_made_noise(spark, samples):
    """Held-out: of words damaged by known confusions, at least nine in ten are found, and no clean line is touched."""
    import numpy as np

    rng = np.random.default_rng(3)
    base = [r.text for r in samples.where("lang = 'en'").orderBy("sample_id").collect()]
    clean = [(i, "web", "N", "\n".join(base[i % 40 : i % 40 + 12])) for i in range(200)]
    scan, bad = [], set()
    for i in range(200, 240):
        lines = ["Chapter 1: A"]
        for n, s in enumerate(base[i % 40 : i % 40 + 10]):
            ws = s.split()
            if rng.random() < 0.4:
                j = max(range(len(ws)), key=lambda k: (len(ws[k]), k))
                new = scans._damage(ws[j], rng, 1)
                if new != ws[j]:
                    bad.add((i, n + 2))
                    ws[j] = new
            lines.append(" ".join(ws))
        scan.append((i, "scan", "N", "\n".join(lines)))
    d = spark.createDataFrame(clean + scan, "render_id bigint, medium string, novel string, text string")
    found = {(r.render_id, r.line_no) for r in scans.Analysis(spark, d, samples).found().where("kind = 'ocr'").collect()}
    assert len(found & bad) >= 0.9 * len(bad) and len(found - bad) <= 0.05 * len(bad)


# 7


def test_leaks_match_brute_force(spark):
    rng = random.Random(7)
    vocab = [f"w{i}" for i in range(30)] + ["STRASSE", "straße", "Ünder"]
    items = [(i, "en", " ".join(rng.choice(vocab) for _ in range(40))) for i in range(6)] + [(6, "zh", "".join(rng.choice("甲乙丙丁戊己庚辛壬癸") for _ in range(60))), (7, "en", None), (8, "en", "short")]
    docs = []
    for k in range(60):
        i = rng.randrange(7)
        unit = items[i][2].split() if i < 6 else list(items[i][2])
        n = rng.choice([14, 15, 16, 17, 23, 24, 25, 30])
        a = rng.randrange(len(unit) - n)
        piece = (", " if i < 6 else "").join(unit[a : a + n])
        docs.append((k, "x " + (piece.upper() if rng.random() < 0.3 else piece) + " y. " + " ".join(rng.choice(vocab) for _ in range(20))))
    docs += docs[:5] + [(90, None), (91, "")]
    want = set()
    for i, lang, t in items:
        chars, w = lang == "zh", 24 if lang == "zh" else 16
        ts = leakage.terms_of(t or "", chars)
        runs = {tuple(ts[a : a + w]) for a in range(len(ts) - w + 1)}
        for k, d in docs:
            ds = leakage.terms_of(d or "", chars)
            if any(tuple(ds[a : a + w]) in runs for a in range(len(ds) - w + 1)):
                want.add((k, i))
    got = [(r.doc_id, r.item_id) for r in leakage.matches(spark, spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, lang string, text string")).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want


def test_proximity_matches_brute_force(spark):
    """Words changed, put in and left out: all passages whose words keep within three places are found, and none that looser counting would not."""
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(200)]
    items = [(i, "en", " ".join(rng.choice(vocab) for _ in range(40))) for i in range(5)]
    docs = []
    for k in range(120):
        unit = items[k % 5][2].split()
        a = rng.randrange(24)
        piece = unit[a : a + 16]
        for _ in range(rng.randrange(6)):
            j = rng.randrange(len(piece))
            piece[j : j + 1] = (["other"], [piece[j], "more"], [])[k % 3]
        docs.append((k, " ".join([rng.choice(vocab) for _ in range(k % 4)] + piece + [rng.choice(vocab) for _ in range(5)])))
    strict, loose = set(), set()
    for i, _, t in items:
        ts = t.split()
        for k, d in docs:
            at: dict[str, list[int]] = {}
            for n, w in enumerate(d.split()):
                at.setdefault(w, []).append(n)
            for base in {n - j for j, x in enumerate(ts) for n in at.get(x, ())}:
                for low, out in ((0, strict), (-3, loose)):
                    hit = [any(base + j + low <= n <= base + j + 3 for n in at.get(x, ())) for j, x in enumerate(ts)]
                    if any(sum(hit[j : j + 16]) >= 13 for j in range(len(ts) - 15)):
                        out.add((k, i))
    got = {(r.doc_id, r.item_id) for r in leakage.near_matches(spark, spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, lang string, text string")).collect()}
    assert strict <= got <= loose and len(strict) > 20


def test_an_index_serves_any_items(spark, monkeypatch):
    """Other items need no other pass over the texts, large sets are searched in blocks, and items without letters of unspaced scripts are found too."""
    rng = random.Random(1)
    vocab = [f"t{i}" for i in range(50)]
    docs = [(k, " ".join(rng.choice(vocab) for _ in range(60))) for k in range(20)] + [(50, "x" * 3 + "abcdefghijklmnopqrstuvwx" + "!"), (51, "甲乙" * 20)]
    find = leakage.Searcher(spark, spark.createDataFrame(docs, "doc_id bigint, text string"))
    sets = [[(n, "en", " ".join(docs[n][1].split()[5:25]))] for n in (0, 7, 11)]
    for rows in sets:
        got = find.matches(spark.createDataFrame(rows, "item_id bigint, lang string, text string")).collect()
        assert [(r.doc_id, r.item_id) for r in got] == [(rows[0][0], rows[0][0])]
    assert list(find.index) == ["unspaced"]
    monkeypatch.setattr(leakage, "MAX_QUERY_CHARS", 30)
    every = spark.createDataFrame([r for rows in sets for r in rows] + [(60, "ja", "abcdefghijklmnopqrstuvwx"), (61, "zh", "甲乙" * 12)], "item_id bigint, lang string, text string")
    assert sorted((r.doc_id, r.item_id) for r in find.matches(every).collect()) == [(0, 0), (7, 7), (11, 11), (50, 60), (51, 61)]


def test_word_hashes_ignore_case_and_place():
    assert leakage.terms_of("The  Großer-BELL 7", False) == leakage.terms_of("x. the GROSSER bell, 7!", False)[1:]


def test_postings_round_trip():
    v = np.array([0, 5, 70_000, 65_535, 65_536, 1], np.int64)
    assert (leakage._unpack(leakage._pack(v)) == v).all() and len(leakage._unpack(leakage._pack(v[:0]))) == 0


# 8


def test_mix_plan():
    t, want = mixing.plan({"a": 1000, "b": 100, "c": 50}, {"a": 0.5, "b": 0.5, "gone": 0.2}, {"a": None, "b": 2, "gone": 1})
    assert t == 1.0 and want == {"a": 200.0, "b": 200.0}
    t, want = mixing.plan({"a": 1000, "b": 100}, {"a": 0.5, "b": 0.5}, {"a": 1, "b": 1}, budget=600)
    assert 0 < t < 1 and abs(sum(want.values()) - 600) < 1e-6 and want["b"] <= 100 + 1e-6
    assert mixing.plan({}, {"a": 1.0}, {"a": None}) == (1.0, {})


def test_temperature_reaches_an_entropy():
    import numpy as np

    p = np.array([0.7, 0.2, 0.1])
    q = p ** mixing.temperature(p, 1.0)
    assert abs(mixing.entropy(q / q.sum()) - 1.0) < 1e-6


def test_temperature_gives_way_to_repetition_limits():
    tokens, goal = {"a": 1000, "b": 100, "c": 10}, {"a": 0.4, "b": 0.3, "c": 0.3}
    t, free = mixing.flatten(tokens, goal, dict.fromkeys(tokens))
    p = np.array([free[s] for s in "abc"]) / sum(free.values())
    assert 0 < t < 1 and abs(mixing.entropy(p) - mixing.entropy(np.array([0.4, 0.3, 0.3]))) < 1e-6
    u, held = mixing.flatten(tokens, goal, {"a": None, "b": None, "c": 3})
    assert t < u < 1 and abs(held["c"] - 30) < 1e-3 and abs(sum(held.values()) - 1110) < 1e-6
    assert mixing.flatten({}, goal, dict.fromkeys(tokens)) == (1.0, {})
    none = mixing.flatten(tokens, goal, {"a": 1, "b": 1, "c": 0}, budget=500)[1]
    assert "c" not in none and abs(sum(none.values()) - 500) < 1e-6


def test_mix_reaches_targets_within_caps(spark):
    docs = spark.createDataFrame([(i, "A " if i % 3 else "b", "some words here " * (1 + i % 5)) for i in range(600)] + [(900, None, "x"), (901, "a", None), (902, "a", "")], "doc_id bigint, source string, text string")
    targets = spark.createDataFrame([("m", "a", 0.25, 2), ("m", "B", 0.75, 3), ("m", "none", 0.1, None)], "mix_name string, source string, target_share double, max_repeats int")
    mix = mixing.Mix(spark, docs, targets)
    r = {x.source: x for x in mix.report().collect()}
    assert abs(r["a"].reached_share - 0.25) < 0.01 and abs(r["b"].reached_share - 0.75) < 0.01 and r["none"].tokens == 0
    assert r["a"].most_takes <= 2 and r["b"].most_takes <= 3


# 9


def test_language_held_out(tongues):
    assert tongues.accuracy >= 0.97


def test_languages_of_segments(spark, tongues):
    en, fr, ja = "The old ferryman returned the iron key before the rain eased that evening.", "Le gardien des clés rapporta la lanterne de cuivre sous le pont du nord.", "何も言わずに、使者は北の橋の下で鉄の鍵を運んだ。弟は地図の束を見つけた。"
    rows = [(1, en, "en"), (2, en, "fr"), (3, f"{en}\n\n{fr}", "en"), (4, ja, None), (5, en, "EN-gb"), (6, fr, "French"), (7, "12 34", "en"), (8, None, None), (9, en, "??"), (9, en, "??")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = sorted((r.doc_id, r.lang) for r in language.mislabelled(language.documents(d, tongues)).distinct().collect())
    assert got == [(2, "en"), (3, "en"), (3, "fr"), (4, "ja"), (9, "en")]
    assert all(0 < r.confidence <= 1 for r in language.segments(d, tongues).collect())


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_every_query_runs(name, spark, sf):
    assert queries.QUERIES[name](spark, sf).count() > 0


def test_empty_tables(spark, garble, tongues, samples):
    build = spark.createDataFrame([], "render_id bigint, medium string, novel string, site string, text string, rendered_at timestamp")
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string")
    items = spark.createDataFrame([], "item_id bigint, lang string, text string")
    targets = spark.createDataFrame([("m", "a", 1.0, None)], "mix_name string, source string, target_share double, max_repeats int")
    assert textforms.cases(build, "render_id", "text", "build_pdf", garble).count() == 0
    assert residue.Residue(residue.scan(build, "render_id", "text", "build_pdf"), _kept).cases().count() == 0
    assert mojibake.garbled_rows(build, garble).count() == 0 and mojibake.restore(build, garble).count() == 0
    assert sentences.ends(build).count() == 0
    assert scans.Analysis(spark, build, samples).found().count() == 0
    assert leakage.matches(spark, docs, items).count() == 0
    assert mixing.Mix(spark, docs, targets).draws().count() == 0
    assert language.documents(docs, tongues).count() == 0


# what the second queries give, measured on made cases


def test_restored_texts_equal_their_originals(garble, samples, spark):
    """Of texts garbled whole and in part, at least nine in ten come back letter by letter; clean ones are not touched."""
    rows, truth = [], {}
    for n, r in enumerate(samples.where("lang in ('fr', 'de', 'es', 'ru', 'pt')").orderBy("lang", "sample_id").collect()):
        k = n % 8
        bad = mojibake.garble(r.text * 2, k)
        if bad is None or bad == r.text * 2 or mojibake.ungarble(bad, k) is None or mojibake.ungarble(bad, k)[0] != r.text * 2:
            continue
        head = "" if n % 2 else "The old ferryman crossed the river before dawn and said nothing.\n\n"
        truth[n] = head + r.text * 2
        rows.append((n, head + bad))
    rows += [(1000 + i, r.text) for i, r in enumerate(samples.orderBy("sample_id").collect())]
    got = {r.row_id: r for r in mojibake.restore(spark.createDataFrame(rows, "render_id bigint, text string"), garble).collect()}
    assert not [i for i in got if i >= 1000]
    right = sum(i in got and got[i][1] == t for i, t in truth.items())
    assert len(truth) > 20 and right >= 0.9 * len(truth), (right, len(truth))


def test_twins_become_equal(samples):
    """Texts spelled with other characters of the same look give the text they were made from."""
    rng, n, same = random.Random(3), 0, 0
    back: dict[str, list[str]] = {}
    for c, plain in textforms.forms().items():
        if len(plain) == 1 and plain.isascii() and plain.isalpha():
            back.setdefault(plain, []).append(c)
    for c, plain in textforms.TO_LATIN.items():
        back.setdefault(plain, []).append(c)
    for r in samples.where("lang in ('en', 'de', 'nl')").orderBy("sample_id").collect():
        out = []
        for w in r.text.split(" "):
            i = rng.randrange(len(w)) if w else 0
            if len(w) > 3 and rng.random() < 0.4 and w[i] in back:
                w = w[:i] + rng.choice(back[w[i]]) + w[i + 1 :]
            out.append(w + ("\u200b" if rng.random() < 0.05 else ""))
        n, same = n + 1, same + (textforms.unify("\u00a0".join(out)) == textforms.unify(r.text))
    assert same >= 0.98 * n and n > 50, (same, n)


def test_segments_of_made_documents(tongues, samples, spark):
    """Paragraphs of held-in samples in documents of one to three languages: nearly all get their own language."""
    own = {}
    for r in samples.orderBy("sample_id").collect():
        own.setdefault(r.lang, []).append(r.text)
    rng, docs, truth = random.Random(8), [], {}
    for i in range(120):
        langs = [rng.choice(sorted(own)) for _ in range(rng.randrange(1, 4))]
        docs.append((i, "\n\n".join(rng.choice(own[x]) for x in langs)))
        truth |= {(i, n + 1): x for n, x in enumerate(langs)}
    got = language.segments(spark.createDataFrame(docs + [(999, None), (998, "1 2 3")], "doc_id bigint, text string"), tongues).collect()
    assert len(got) == len(truth) and sum(truth[r.doc_id, r.para_no] == r.lang for r in got) >= 0.97 * len(truth)
    assert all(isinstance(r.rejected, bool) and 0 < r.confidence <= 1 for r in got)


def test_repaired_scans_read_like_their_originals(spark, samples):
    """Pages cut, numbered and misread: at least 97 of 100 words of the repaired text are those printed, and no furniture is left."""
    rng = np.random.default_rng(21)
    base = [r.text for r in samples.where("lang = 'en'").orderBy("sample_id").collect()]
    clean = [(i, "web", "The Hollow Tower", "\n".join(base[i % 40 : i % 40 + 12])) for i in range(200)]
    scan, truth = [], {}
    for i in range(200, 230):
        printed = " ".join(base[(i * 3) % 30 : (i * 3) % 30 + 8])
        read = " ".join(scans._damage(w, rng, 1) if len(w) > 5 and w.isalpha() and rng.random() < 0.08 else w for w in printed.split())
        made, _ = furniture.make_page("Chapter 3: A Gate\n\n" + read, "The Hollow Tower", rng, lambda s, *_: s)
        scan.append((i, "scan", "The Hollow Tower", made))
        truth[i] = printed.split()
    d = spark.createDataFrame(clean + scan, "render_id bigint, medium string, novel string, text string")
    got = {r.render_id: r.clean_text.split() for r in scans.Analysis(spark, d, samples).repaired().collect()}
    import difflib

    good = total = 0
    for i, words in truth.items():
        m = difflib.SequenceMatcher(None, words, got[i], autojunk=False)
        good += sum(b.size for b in m.get_matching_blocks())
        total += len(words)
        assert "THE HOLLOW TOWER" not in " ".join(got[i])
    assert good >= 0.97 * total, (good, total)
