"""SQL for DuckDB, equal to the queries of the catalogue.

RE2 has no lookaround and only ASCII white space, so patterns capture their neighbours and name the
white space; a rule whose matches may share a neighbour is applied twice.
"""

from __future__ import annotations

from foliowright.functions import text as T
from foliowright.functions.naming import ILLEGAL, MAX_STEM, NO_PROFILE, SMALL_WORDS, UNIVERSAL
from foliowright.operators.watermark import ORDINARY, STEMS

WS = r"\t\n\x{0b}\f\r \x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
NW = r"[^\p{L}\p{N}\p{M}_]"  # no part of a word

_GAPS = rf"[{WS}_\-]+"
_STEM = (("^.*/", ""), (r"(.)[.][^.]*$", r"\1"))  # a file name without its folder and ending

DIRTY = """concat('chapter ', cast(doc_id % 5 + 1 as varchar(10)), ' - The Gate', chr(10),
 case doc_id % 8 when 0 then 'He said “stop” and left.' when 1 then 'The oﬁce was ■closed�.' when 2 then 'He scored 6/7  today.' when 3 then 'He ran — and fell. It stopped — Then ran.' when 4 then 'Well.It was good ,really,, yes..' when 5 then 'It was a explosion in an book.' when 6 then 'See https://x.example/a and @@mark@@ here.' else 'tbe b0dy of V|adion in h.i.p.s shape' end, chr(10),
 case doc_id % 6 when 0 then '* * *' when 1 then 'The sur-' when 2 then 'A well-' when 3 then '12Sunny went on.' when 4 then '' else 'chapter 9 nine chapter 9 nine' end, chr(10),
 case doc_id % 6 when 1 then 'face was calm.' when 2 then 'known fact.' else 'Nobody moved.' end, chr(10),
 case when doc_id % 7 = 0 then concat('Check latest chapters at novelfire.net', chr(10)) when doc_id % 7 = 1 then concat('AN: join discord.gg/abc', chr(10)) else '' end,
 coalesce(text, ''),
 case when doc_id % 4 = 0 then concat(chr(10), 'chapter ', cast(doc_id % 5 + 1 as varchar(10)), ' - The Gate', chr(10), 'Again.') else '' end)"""

# Forced fixes of the query that shows them: in prose, in headings (where they are not made) and across a longer one.
FIXES = {"Nobody": "No one", "Nobody moved": "None stirred", "Gate": "Wall", "went on": "walked on"}

# Signals of error pages behind the text of some documents.
SIGNALS = """concat(coalesce(text, ''), case doc_id % 7 when 0 then ' You are being rate limited. Cloudflare Ray ID: 7a1' when 1 then ' Error code: 1015' when 2 then concat(chr(10), 'Performance & security by X, error code 1020, developers.cloudflare.com') when 3 then ' the ray id of a rate limited cloud' else '' end)"""

_MATH = "".join(chr(0x1D41A + ord(c) - 97) if c.isalpha() else c for c in "freewebnovel.com")  # bold mathematical letters
# Watermark cases: kind, text, what is left, what is logged.
CASES = (
    ("exact", "Kelia stuttered noelfire.net, then smiled.", "Kelia stuttered, then smiled.", "junk_strip.domain: noelfire.net"),
    ("template", "She hung the lantern on novelfirenet", "She hung the lantern", "junk_strip.domain: on novelfirenet"),
    ("cross-line", 'Flint clicked his tongue. Official source s\nnovelfire.net\n"I did not!"', 'Flint clicked his tongue.\n"I did not!"', "junk_strip.domain: novelfire.net|junk_strip.domain: Official source s"),
    ("cross-line guard", "she wrote the novel\nnovelfirenet\nand smiled.", "she wrote the novel\nand smiled.", "junk_strip.domain: novelfirenet"),
    ("survivor", "She mentioned webnovel.com in passing.", "She mentioned webnovel.com in passing.", ""),
    ("spaced", "ran f r e e w e b n o v e l. c o m now", "ran now", "junk_strip.spaced_domain: f r e e w e b n o v e l. c o m"),
    ("promo", "He left. Do you want to read more chapters? Come to p a n d a - n o v e l . c o m Then she slept.", "He left. Then she slept.", "junk_strip.promo: Do you want to read more chapters? Come to p a n d a - n o v e l . c o m"),
    ("homoglyph", f"end {_MATH} here", "end here", f"junk_strip.homoglyph_domain: {_MATH}"),
    ("fuzzy", "hire.com and dell.com", "and", "junk_strip.domain: hire.com|junk_strip.domain: dell.com"),
    ("glued", "...novelfire.netShe smiled", "...She smiled", "junk_strip.domain: novelfire.net"),
    ("seam", "She left novelfire.net ; and slept", "She left; and slept", "junk_strip.domain: novelfire.net"),
    ("full stop", "He slept. Check latest chapters at novelfire.net. Then", "He slept. Then", "junk_strip.domain: Check latest chapters at novelfire.net."),
    ("misspelled", "He slept. Orginally published at n0velfire.net", "He slept.", "junk_strip.domain: Orginally published at n0velfire.net"),
    ("two", "A visit novelfire.net B nicenovel.com C", "A B C", "junk_strip.domain: visit novelfire.net|junk_strip.domain: nicenovel.com"),
    ("twelve words", "x " + "read " * 13 + "novelfire.net", "x read", "junk_strip.domain: " + "read " * 12 + "novelfire.net"),
    ("comma", "He slept. Chaptrs, at novelfire.net now", "He slept. now", "junk_strip.domain: Chaptrs, at novelfire.net"),
    ("mark in a word", "he said.Read at novelfire.net", "he said.", "junk_strip.domain: Read at novelfire.net"),
)

SRC = f"(SELECT doc_id, {DIRTY} AS text FROM documents) AS d"


def q(s: str) -> str:
    """A SQL string literal."""
    parts = [f"'{p.replace(chr(39), chr(39) * 2)}'" for p in s.split("\n")]
    return "(" + " || chr(10) || ".join(parts) + ")" if len(parts) > 1 else parts[0]


def rr(x: str, *steps: tuple[str, str]) -> str:
    for p, r in steps:
        x = f"regexp_replace({x}, {q(p)}, {q(r)}, 'g')"
    return x


def strip(x: str) -> str:
    return rr(x, (f"^[{WS}]+|[{WS}]+$", ""))


def on_dirty(x: str) -> str:
    return f"SELECT doc_id, {x} AS text FROM {SRC}"


def on_build(x: str) -> str:
    return f"SELECT render_id, {x} AS text FROM build_pdf"


def swap(x: str, pairs: dict[str, str]) -> str:
    for a, b in pairs.items():
        x = f"replace({x}, {q(a)}, {q(b)})"
    return x


def words(x: str, pairs: dict[str, str], flags: str = "") -> str:
    for bad, good in pairs.items():
        step = (f"{flags}(^|{NW}){bad}({NW}|$)", rf"\1{good}\2")
        x = rr(x, step, step)
    return x


_case = lambda k: "[" + ", ".join(q(c[k]) for c in CASES) + f"][doc_id % {len(CASES)} + 1]"
_text, _context = "coalesce(text, '')", "coalesce(context, '')"
_quotes = f"translate(text, {q('“”„‟❝❞〝〞＂«»')}, {q(chr(34) * 11)})"
_A = T.APOSTROPHES
_E = ""
_zeros = [(r"([a-zA-Z])0([a-zA-Z'’])", r"\1o\2")] * 2 + [(r"([a-zA-Z])00([a-zA-Z])", r"\1oo\2")] * 2
_pipes = [(r"([a-zA-Z])\|([a-zA-Z])", r"\1l\2")] * 2 + [(r"([a-zA-Z])\\([a-zA-Z])", r"\1r\2")] * 2
_contractions = (
    [(rf"([A-Za-z]+{_A}s)([a-zA-Z]{{2,}})", r"\1 \2"), (rf"(n{_A}t)([a-zA-Z]{{2,}})", r"\1 \2")]
    + [(rf"({_A}{x})([a-zA-Z]{{2,}})", r"\1 \2") for x in ("ll", "ve", "re")]
    + [(rf"(^|{NW})([Ii]|[Ww]e|[Yy]ou|[Tt]hey|[Hh]e|[Ss]he|[Ii]t){_A}(m|ve|re|ll|d)([a-zA-Z]{{2,}})({NW}|$)", r"\1\2'\3 \4\5")] * 2
)


def _dashes(x: str) -> str:
    for _ in range(2):
        x = rr(x, (rf"([^{WS}]+)[{WS}]+{T.DASHES}[{WS}]+([^{WS}]+)", rf"\1{_E}\2"), (rf"{_E}(\p{{Lu}})", r". \1"), (_E, ", "))
    nb = " "
    for _ in range(4):
        x = swap(x, {" — ": ", ", f"{nb}—{nb}": ", ", f"{nb}— ": ", ", f" —{nb}": ", ", " – ": ", ", f"{nb}–{nb}": ", "})
    return x


_punctuation = rr(
    "text", (",,+", ","), (r"(^|[^.])\.\.([^.]|$)", r"\1.\2"), (r"(^|[^.])\.\.([^.]|$)", r"\1.\2"), (r"([?!])\.([^.]|$)", r"\1\2"), (",([A-Za-z])", r", \1"), (r"([a-z])([.!?])([A-Z])", r"\1\2 \3"), (rf"[{WS}]+([,;:!?])", r"\1")
)
_hold = [(rf"(^|{NW})([Aa])([{WS}]+)(one|once)({NW}|$)", rf"\1\2{_E}\3\4\5"), (rf"(^|{NW})([Aa])([{WS}]+)(eu|ew)", rf"\1\2{_E}\3\4")]
_articles = rr("text", *_hold, *[(rf"(^|{NW})([Aa])[{WS}]+([aeio][a-z])", r"\1\2n \3")] * 2, *[(rf"(^|{NW})([Aa])n[{WS}]+([bcdfgjklmnpqrstvwxyz][a-z])", r"\1\2 \3")] * 2, (_E, ""))
_wrapped = rr("text", *[(rf"(^|[^A-Za-z])([A-Za-z]+)-\n([a-z][A-Za-z]*)", rf"\1\2-{_E}\3")] * 2, (rf"(?i)(^|[^A-Za-z])sur-{_E}face([^A-Za-z]|$)", r"\1surface\2"), (_E, ""))
_links = rr("text", (r"@@[^@\n]{1,40}@@", ""), (rf"(?i)(^|{NW})https?://[^{WS}]+", r"\1"), (rf"(?i)(^|{NW})www\.[^{WS},;)]+", r"\1"))
_markers = swap("text", dict.fromkeys(T.MARKERS, ""))
_lines = "string_split(text, chr(10))"
_promo = T.PROMO_LINE.replace("(?iU)", "(?i)").replace(r"\s", f"[{WS}]")
_is_chapter = lambda x: f"starts_with(lower({strip(x)}), 'chapter ')"
_CONTROL = r"[\x00-\x08\x0b\x0e-\x1f\x7f-\x{9f}\p{Cf}]"
_unicode = rr(f"nfc_normalize({rr('text', (_CONTROL, ''))})", (r"[\x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]", " "))

_SMALL = r"^[\p{Ll}ªº]"
_ends = r"""[.!?…:]["'’”)\]]*$"""
_head = rf"(?i)^[{WS}]*Chapter[{WS}]+\d"
_para_rows = f"""
WITH l AS (SELECT doc_id, {strip('line')} AS line, n FROM (SELECT doc_id, unnest({_lines}) AS line, generate_subscripts({_lines}, 1) AS n FROM {SRC})),
p AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY n) AS prev FROM l),
b AS (SELECT *, CASE WHEN line <> '' AND (prev IS NULL OR prev = '' OR regexp_matches(line, {q(_head)}) OR regexp_matches(prev, {q(_head)})
        OR (regexp_matches(prev, {q(_ends)}) AND NOT regexp_matches(line, {q(_SMALL)}))) THEN 1 ELSE 0 END AS fresh FROM p),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY n) AS para_no FROM b),
rows_ AS (SELECT doc_id, CAST(para_no AS BIGINT) AS para_no, string_agg(line, ' ' ORDER BY n) AS paragraph FROM s WHERE line <> '' GROUP BY doc_id, para_no)"""

# headings, line by line
_VERB = T._VERBS


def _titles(line: str) -> str:
    """The normal form of one line, as an expression."""
    rx = rf"(?i)^Chapter[{WS}]+(\d[\d,]*)[{WS}]*[:\-–—]?[{WS}]*(.*)$"
    x = strip(line)
    number = f"regexp_extract({x}, {q(rx)}, 1)"
    rest = rr(strip(f"regexp_extract({x}, {q(rx)}, 2)"), (rf"^[:\-–—]+[{WS}]*", ""))
    part = rf"(?i)^(.*?[{WS}]+\(Part[{WS}]+\d+\))[{WS}]+(.+)$"
    fused = rf"^(.*?)[{WS}]+([A-Z][a-z]+[{WS}]+(?:{_VERB})[{WS}]+)(.*)$"
    head = f"regexp_extract(substring({rest}, 1, 120), '^(.*) ', 1)"
    title = f"""CASE WHEN regexp_matches({rest}, {q(part)}) THEN {strip(f'regexp_extract({rest}, {q(part)}, 1)')} WHEN regexp_matches({rest}, {q(fused)}) THEN {strip(f'regexp_extract({rest}, {q(fused)}, 1)')}
      WHEN length({rest}) > 120 AND length({head}) > 20 THEN {strip(head)} ELSE {rest} END"""
    body = f"""CASE WHEN regexp_matches({rest}, {q(part)}) THEN {strip(f'regexp_extract({rest}, {q(part)}, 2)')} WHEN regexp_matches({rest}, {q(fused)}) THEN {strip(f'regexp_extract({rest}, {q(fused)}, 2) || regexp_extract({rest}, {q(fused)}, 3)')}
      WHEN length({rest}) > 120 AND length({head}) > 20 THEN {strip(f'substring({rest}, length({head}) + 1)')} ELSE '' END"""
    bare = rr(title, ("[ .]+$", ""))
    end = f"CASE WHEN regexp_matches({bare}, '[?!]$') THEN '' ELSE '.' END"
    full = f"'Chapter ' || {number} || ': ' || {bare} || {end} || chr(10) || CASE WHEN {body} <> '' THEN chr(10) || {body} ELSE '' END"
    return f"CASE WHEN NOT regexp_matches({x}, {q(rx)}) THEN {line} WHEN {rest} = '' THEN 'Chapter ' || {number} || chr(10) ELSE {full} END"


_titled = f"(SELECT doc_id, string_agg({_titles('line')}, chr(10) ORDER BY n) AS text FROM (SELECT doc_id, unnest({_lines}) AS line, generate_subscripts({_lines}, 1) AS n FROM {SRC}) GROUP BY doc_id) AS d"

_layout = rf"""
WITH src AS (SELECT row_number() OVER () AS k, render_id, text FROM SOURCE_ROWS),
sheet AS (SELECT k, render_id, list_filter(string_split(coalesce(text, ''), chr(12)), lambda x: {strip('x')} <> '') AS s FROM src),
page AS (SELECT k, render_id, unnest(CASE WHEN len(s) = 0 THEN [NULL] ELSE s END) AS sheet, generate_subscripts(CASE WHEN len(s) = 0 THEN [NULL] ELSE s END, 1) AS page_no FROM sheet),
para0 AS (SELECT k, render_id, page_no, list_filter(string_split(sheet, chr(10) || chr(10)), lambda x: {strip('x')} <> '') AS p FROM page),
para AS (SELECT k, render_id, page_no, unnest(CASE WHEN p IS NULL OR len(p) = 0 THEN [NULL] ELSE p END) AS raw, generate_subscripts(CASE WHEN p IS NULL OR len(p) = 0 THEN [NULL] ELSE p END, 1) AS para_no FROM para0),
flat AS (SELECT *, {strip(rr('raw', (f'[{WS}]+', ' ')))} AS t FROM para),
cut AS (SELECT *, length(t) <= 500 AND regexp_matches(t, {q(rf'(?i)^Chapter[{WS}]+\d[\d,]*:[{WS}]*.*?[.?!][{WS}]*$')}) AS heading,
   CASE WHEN regexp_matches(t, {q(rf'''(?i)^(Chapter[{WS}]+\d+:[{WS}]*[^"'“‘\n]+)[{WS}]+(["'“‘].*)''')}) THEN 1 WHEN regexp_matches(t, {q(rf'(?i)^(Chapter[{WS}]+\d+:[{WS}]*.+?)[{WS}]+([A-Z][^.]+\.[{WS}]+.*)')}) THEN 2 ELSE 0 END AS way FROM flat),
two AS (SELECT *, CASE way WHEN 1 THEN regexp_extract(t, {q(rf'''(?i)^(Chapter[{WS}]+\d+:[{WS}]*[^"'“‘\n]+)[{WS}]+(["'“‘].*)''')}, 1) WHEN 2 THEN regexp_extract(t, {q(rf'(?i)^(Chapter[{WS}]+\d+:[{WS}]*.+?)[{WS}]+([A-Z][^.]+\.[{WS}]+.*)')}, 1) END AS h,
   CASE way WHEN 1 THEN regexp_extract(t, {q(rf'''(?i)^(Chapter[{WS}]+\d+:[{WS}]*[^"'“‘\n]+)[{WS}]+(["'“‘].*)''')}, 2) WHEN 2 THEN regexp_extract(t, {q(rf'(?i)^(Chapter[{WS}]+\d+:[{WS}]*.+?)[{WS}]+([A-Z][^.]+\.[{WS}]+.*)')}, 2) END AS b FROM cut),
parts AS (SELECT render_id, page_no, para_no, CASE WHEN raw IS NULL THEN [{{'kind': 'body', 'text': '(no extractable text)'}}] WHEN heading THEN [{{'kind': 'heading', 'text': t}}]
   WHEN way > 0 AND length(h) < 500 THEN [{{'kind': 'heading', 'text': CASE WHEN regexp_matches({rr('h', (f'[{WS}]+$', ''))}, '[.?!]$') THEN {rr('h', (f'[{WS}]+$', ''))} ELSE {rr('h', (f'[{WS}]+$', ''))} || '.' END}}, {{'kind': 'body', 'text': {strip('b')}}}]
   ELSE [{{'kind': 'body', 'text': t}}] END AS x FROM two)
SELECT render_id, CAST(page_no AS BIGINT) AS page_no, CAST(para_no AS BIGINT) AS para_no, CAST(part_no AS BIGINT) AS part_no, y.kind AS kind, y.text AS text
FROM (SELECT render_id, page_no, para_no, unnest(x) AS y, generate_subscripts(x, 1) AS part_no FROM parts)"""

_dots = [(r"([A-Za-z])\.([A-Za-z])\.([A-Za-z])", rf"\1{_E}\2{_E}\3")] + [(rf"{_E}([A-Za-z])\.([A-Za-z])", rf"{_E}\1{_E}\2")] * 6 + [(_E, "")]
_run = r"[~\\\-=*#](?:[ \t]*[~\\\-=*#]){2,}"
_bare = strip(rr("x", *[(rf"(^|[{WS}]){_run}([{WS}]|$)", r"\1")] * 2))
_decoration = f"""coalesce(list_aggregate(list_filter(list_transform({_lines}, lambda x: CASE WHEN NOT regexp_matches(x, {q(rf'(^|[{WS}]){_run}([{WS}]|$)')}) THEN x WHEN {_bare} = '' THEN NULL ELSE {_bare} END), lambda x: x IS NOT NULL), 'string_agg', chr(10)), '')"""
_paged = "replace(text, chr(10) || chr(10), chr(12))"
_loose = rf"(?i)^Chapter[{WS}]+\d[\d,]*:[{WS}]*.*?[.?!]?[{WS}]*$"

_rows_text = f"({_para_rows} SELECT doc_id, string_agg(paragraph, chr(10) || chr(10) ORDER BY para_no) AS text FROM rows_ GROUP BY doc_id)"
_rows_titled = f"(SELECT doc_id, string_agg({_titles('line')}, chr(10) ORDER BY n) AS text FROM (SELECT doc_id, unnest({_lines}) AS line, generate_subscripts({_lines}, 1) AS n FROM {_rows_text}) GROUP BY doc_id)"
_breaks = f"list_aggregate(list_transform({_lines}, lambda x, i: CASE WHEN {_is_chapter('x')} AND i > list_position(list_transform({_lines}, lambda y: {_is_chapter('y')}), true) THEN chr(12) || chr(10) || x ELSE x END), 'string_agg', chr(10))"
_numbers = q(rf"(?i)chapter[{WS}]+(\d+)")
_cut = f"""(SELECT doc_id, string_agg(CASE WHEN j IS NULL THEN line ELSE {rr("coalesce(list_aggregate(list_transform(range(1, j), lambda k: parts[k] || found[k]), 'string_agg', ''), '') || parts[j]", (f'[{WS}]+$', ''))} END, chr(10) ORDER BY n) AS text FROM (
  SELECT *, CASE WHEN i > 0 THEN i + list_position(nums[i + 1:], nums[i]) END AS j FROM (
  SELECT *, list_position(list_transform(nums, lambda x, k: list_contains(nums[k + 1:], x)), true) AS i FROM (
  SELECT doc_id, n, line, regexp_extract_all(line, {_numbers}, 1) AS nums, regexp_extract_all(line, {_numbers}) AS found, string_split_regex(line, {_numbers}) AS parts
  FROM (SELECT doc_id, unnest({_lines}) AS line, generate_subscripts({_lines}, 1) AS n FROM {SRC})))) GROUP BY doc_id)"""
_sold = "'Check latest chapters at novelfire.net'"

_norm = lambda x: f"lower({strip(rr(x, (_GAPS, ' ')))})"
_registry = f"""(SELECT norm_key, profile, max(display_name) AS display_name FROM (SELECT {_norm('input_name')} AS norm_key, profile, {strip('input_name')} AS display_name FROM dispatch_cases WHERE has_profile AND profile IS NOT NULL) GROUP BY norm_key, profile)"""
_index = lambda x: f"CASE WHEN {_norm(x)} = '' THEN '' ELSE replace({_norm(x)}, ' ', '-') || '.txt' END"
_signals = [(n, p.replace("(?iU)", "(?i)").replace(r"[:\s]", f"[:{WS}]").replace(r"\s", f"[{WS}]")) for n, p in T.ERROR_SIGNALS]
_status = f"""CASE WHEN NOT coalesce(file_exists, false) THEN 'skipped (not found)' WHEN raises IS NOT NULL THEN 'failed' WHEN length({strip("coalesce(text, '')")}) < 100 THEN 'skipped (image-only/empty)' ELSE 'succeeded' END"""
_terms = rf"""(SELECT DISTINCT profile, {strip(rr('term', ('(?s)#.*$', '')))} AS term FROM lexicon_terms WHERE {strip(rr('term', ('(?s)#.*$', '')))} <> '')"""
_tails = sorted({s[i:] for s in STEMS for i in range(1, len(s) - 2)})
_gate = (
    "(f <> '' AND ("
    + " OR ".join(f"(length(f) >= {len(s) - 2} AND levenshtein(f, '{s}') <= {2 if len(s) >= 9 else 1})" for s in STEMS)
    + f" OR (length(f) >= 3 AND f NOT IN ({', '.join(q(w) for w in sorted(ORDINARY))}) AND ("
    + " OR ".join(f"levenshtein(f, '{t}') <= 1" for t in _tails)
    + "))))"
)
_words_of = lambda x: f"list_filter(string_split_regex({x}, {q(_GAPS)}), lambda w: w <> '')"
_once = "(SELECT DISTINCT * FROM edits)"
_safe = lambda x: f"""CASE WHEN {rr(f"substring({rr(rr(x, ('^.*/', '')), (ILLEGAL, '_'), ('^[ .]+|[ .]+$', ''))}, 1, {MAX_STEM})", ('[ .]+$', ''))} = '' THEN 'untitled' ELSE {rr(f"substring({rr(rr(x, ('^.*/', '')), (ILLEGAL, '_'), ('^[ .]+|[ .]+$', ''))}, 1, {MAX_STEM})", ('[ .]+$', ''))} END"""
_natural = r"""list_transform(string_split(path, '/'), lambda x, i: CASE WHEN i = len(string_split(path, '/')) THEN '0' ELSE '1' END
 || list_aggregate(list_transform(regexp_extract_all(lower(x), '\d+|\D+'), lambda r: CASE WHEN regexp_matches(r, '^\d') THEN CASE WHEN length(regexp_replace(r, '^0+(\d)', '\1')) <= 20 THEN lpad(regexp_replace(r, '^0+(\d)', '\1'), 20, '0') ELSE ':' || lpad(CAST(length(regexp_replace(r, '^0+(\d)', '\1')) AS VARCHAR), 9, '0') || regexp_replace(r, '^0+(\d)', '\1') END ELSE r END), 'string_agg', ''))"""

_SPACED = f"(SELECT doc_id, replace(text, chr(10), chr(10) || chr(10)) AS text FROM {SRC}) AS d"
_NUMBERED = rf"(?i)^Chapter[{WS}]+([\d,]+):"
_numbered = lambda p: f"CASE WHEN regexp_matches({strip(p)}, {q(_NUMBERED)}) THEN replace(regexp_extract({strip(p)}, {q(_NUMBERED)}, 1), ',', '') END"
_paras = "string_split(text, chr(10) || chr(10))"
_once_titled = f"list_aggregate(list_filter({_paras}, lambda p, i: {_numbered('p')} IS NULL OR list_position(list_transform({_paras}, lambda y: {_numbered('y')}), {_numbered('p')}) = i), 'string_agg', chr(10) || chr(10))"

ORACLES: dict[str, str] = {
    "straight_quotes": on_dirty(_quotes),
    "build_quotes": on_build(_quotes),
    "scanner_glyphs": on_dirty(f"translate(text, {q('■□' + chr(0xFFFD))}, '')"),
    "collapse_spaces": on_dirty(rr("text", ("[ \\t]{2,}", " "), ("[ \\t]+\\n", "\n"))),
    "ligatures": on_dirty(swap("text", T.LIGATURES)),
    "keep_headers": on_dirty("text"),
    "page_numbers": on_dirty(rr("text", (rf"(?m)^[{WS}]*\d{{1,4}}([A-Z][a-z])", r"\1"))),
    "join_wrapped": on_dirty(_wrapped),
    "undot_words": on_dirty(rr("text", *_dots)),
    "repair_ocr": on_dirty(words(rr(words(rr("text", *_dots, *_pipes, *_zeros), T.MISREAD_WORDS), *_contractions), T.GLUED_WORDS, "(?i)")),
    "decorative_runs": on_dirty(_decoration),
    "heading_only_pages": f"""SELECT render_id, CAST(n AS BIGINT) AS page_no FROM (SELECT render_id, len(s) AS pages, unnest(s) AS sheet, generate_subscripts(s, 1) AS n FROM (SELECT render_id, list_filter(string_split({_paged}, chr(12)), lambda x: {strip('x')} <> '') AS s FROM build_pdf WHERE text IS NOT NULL))
      WHERE pages >= 2 AND len(list_filter(string_split(sheet, chr(10)), lambda x: {strip('x')} <> '')) = 1 AND regexp_matches({strip('sheet')}, {q(_loose)})""",
    "output_names": f"""WITH b AS (SELECT DISTINCT run_id, seq, path FROM batch_inputs), f AS (SELECT *, regexp_replace(path, '/?[^/]*$', '') AS dir, regexp_replace({_safe('path')}, '(?i)\\.pdf$', '') AS stem FROM b),
      o AS (SELECT *, CASE WHEN dir = 'in' OR starts_with(dir, 'in/') THEN 'out/in' || substring(dir, 3) ELSE 'out' END AS folder FROM f),
      r AS (SELECT *, row_number() OVER (PARTITION BY folder, stem ORDER BY run_id, seq, path) AS n FROM o),
      u AS (SELECT *, stem || CASE WHEN n > 1 THEN '_' || n ELSE '' END AS name FROM r)
      SELECT run_id, seq, path, folder || '/' || name || '.pdf' AS output_path, folder || '/' || CASE WHEN starts_with(name, 'DEBUG_') THEN name ELSE 'DEBUG_' || name END || '.txt' AS debug_path FROM u""",
    "unpipe_words": on_dirty(rr("text", *_pipes)),
    "zeros_in_words": on_dirty(rr("text", *_zeros)),
    "misread_words": on_dirty(words("text", T.MISREAD_WORDS)),
    "unglue_contractions": on_dirty(words(rr("text", *_contractions), T.GLUED_WORDS, "(?i)")),
    "ratios": on_dirty(rr("text", (rf"\b(\d+)[{WS}]*/[{WS}]*(\d+)\b", r"\1 out of \2"))),
    "build_ratios": on_build(rr("text", (rf"\b(\d+)[{WS}]*/[{WS}]*(\d+)\b", r"\1 out of \2"))),
    "spaced_dashes": on_dirty(_dashes("text")),
    "punctuation": on_dirty(_punctuation),
    "articles": on_dirty(_articles),
    "tidy": on_dirty(strip(rr("text", ("\\n{3,}", "\n\n")))),
    "build_tidy": on_build(strip(rr("text", ("\\n{3,}", "\n\n")))),
    "normalize_titles": f"SELECT doc_id, text FROM {_titled}",
    "drop_markers": on_dirty(_markers),
    "drop_links": on_dirty(_links),
    "promo_lines": on_dirty(f"coalesce(list_aggregate(list_filter({_lines}, lambda x: NOT regexp_matches(x, {q(_promo)})), 'string_agg', chr(10)), '')"),
    "drop_repeated_headings": on_dirty(f"list_aggregate(list_filter({_lines}, lambda x, i: NOT {_is_chapter('x')} OR list_position(list_transform({_lines}, lambda y: {strip('y')}), {strip('x')}) = i), 'string_agg', chr(10))"),
    "page_breaks": on_dirty(f"list_aggregate(list_transform({_lines}, lambda x, i: CASE WHEN {_is_chapter('x')} AND i > list_position(list_transform({_lines}, lambda y: {_is_chapter('y')}), true) THEN chr(12) || chr(10) || x ELSE x END), 'string_agg', chr(10))"),
    "paragraph_text": f"{_para_rows} SELECT doc_id, string_agg(paragraph, chr(10) || chr(10) ORDER BY para_no) AS text FROM rows_ GROUP BY doc_id",
    "escape_markup": on_dirty(swap("text", {"&": "&amp;", "<": "&lt;", ">": "&gt;"})),
    "snippets": on_dirty(f"substring({strip(rr('text', (f'[{WS}]+', ' ')))}, 1, 160)"),
    "normalize_unicode": on_build(_unicode),
    "reconstruct_paragraphs": f"{_para_rows} SELECT doc_id, para_no, paragraph FROM rows_",
    "paragraph_counts": f"{_para_rows} SELECT doc_id, count(*) AS n_paragraphs, CAST(max(length(paragraph)) AS BIGINT) AS longest FROM rows_ GROUP BY doc_id",
    "doubled_headings": f"""SELECT doc_id, line_no, line FROM (SELECT doc_id, CAST(n AS BIGINT) AS line_no, {strip('line')} AS line, row_number() OVER (PARTITION BY doc_id, {strip('line')} ORDER BY n) AS r
      FROM (SELECT doc_id, unnest({_lines}) AS line, generate_subscripts({_lines}, 1) AS n FROM {SRC}) WHERE {_is_chapter('line')}) WHERE r > 1""",
    "numbered_headings": f"""SELECT doc_id, CAST(n AS BIGINT) AS line_no, line, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS heading_no
      FROM (SELECT doc_id, unnest({_lines}) AS line, generate_subscripts({_lines}, 1) AS n FROM {SRC}) WHERE regexp_matches(line, {q(_head)})""",
    "duplicate_titles": rf"""WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10) || chr(10))) AS p, generate_subscripts(string_split(text, chr(10) || chr(10)), 1) AS n FROM {_titled}),
      h AS (SELECT doc_id, n, replace(regexp_extract({strip('p')}, {q(rf'(?i)^Chapter[{WS}]+([\d,]+):')}, 1), ',', '') AS chapter FROM p WHERE regexp_matches({strip('p')}, {q(rf'(?i)^Chapter[{WS}]+([\d,]+):')}))
      SELECT doc_id, CAST(n AS BIGINT) AS para_no, chapter FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, chapter ORDER BY n) AS r FROM h) WHERE r > 1""".replace(SRC, _SPACED),
    "drop_repeated_titles": f"SELECT doc_id, {_once_titled} AS text FROM {_titled}".replace(SRC, _SPACED),
    "page_sizes": f"""SELECT doc_id, page_no, count(*) AS n_lines FROM (SELECT doc_id, CAST(greatest(sum(CASE WHEN {_is_chapter('line')} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n), 1) AS BIGINT) AS page_no
      FROM (SELECT doc_id, unnest({_lines}) AS line, generate_subscripts({_lines}, 1) AS n FROM {SRC})) GROUP BY doc_id, page_no""",
    "heading_violations": rf"""WITH p AS (SELECT doc_id, list_filter(list_transform(string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10)), lambda x: {strip('x')}),
      lambda x: starts_with(lower(x), 'chapter ') AND NOT regexp_matches(x, {q(rf'(?i)^Chapter[{WS}]+[\d,]+:[{WS}]*.*?[.?!][{WS}]*$')})) AS v FROM {SRC})
      SELECT doc_id, CAST(n AS BIGINT) AS n, substring(h, 1, 120) AS heading FROM (SELECT doc_id, unnest(v) AS h, generate_subscripts(v, 1) AS n FROM p)""",
    "build_layout": _layout.replace("SOURCE_ROWS", "build_pdf"),
    "page_layout": _layout.replace("SOURCE_ROWS", f"(SELECT doc_id AS render_id, {_breaks} AS text FROM {_rows_titled})").replace("SELECT render_id, CAST(page_no", "SELECT render_id AS doc_id, CAST(page_no"),
    "cut_repeated_heading": f"SELECT doc_id, text FROM {_cut}",
    "site_watermarks": f"SELECT doc_id, list_aggregate(list_filter({_lines}, lambda x: x <> {_sold}), 'string_agg', chr(10)) AS text, CAST(len(list_filter({_lines}, lambda x: x = {_sold})) AS BIGINT) AS n_removed FROM {SRC}",
    "error_pages": "SELECT src, id, reason FROM (SELECT src, id, CASE WHEN len(h) >= 2 THEN 'Cloudflare error page detected (signals: ' || list_aggregate(h, 'string_agg', ', ') || ')' END AS reason FROM (SELECT src, id, list_filter(["
    + ", ".join(f"CASE WHEN regexp_matches(text, {q(p)}) THEN {q(n)} END" for n, p in _signals)
    + f"], lambda x: x IS NOT NULL) AS h FROM (SELECT 'edits' AS src, edit_id AS id, context AS text FROM edits UNION ALL SELECT 'build_pdf', render_id, text FROM build_pdf UNION ALL SELECT 'documents', doc_id, {SIGNALS} FROM documents))) WHERE reason IS NOT NULL",
    "junk_cases": f"SELECT doc_id, {_case(0)} AS kind, {_case(2)} || chr(10) || chr(10) || coalesce(text, '') AS text, {_case(3)} AS log FROM documents",
    "low_confidence": f"SELECT render_id, CAST(coalesce(length({strip('text')}), 0) AS BIGINT) AS n_chars FROM build_pdf WHERE length({strip(_text)}) < 100",
    "near_site_names": f"""WITH t AS (SELECT unnest(regexp_extract_all(text, '([A-Za-z0-9]+)\\.(?:net|com)', 1)) AS name FROM (SELECT text FROM {SRC} UNION ALL SELECT original FROM edits)),
      c AS (SELECT name, count(*) AS n, lower(translate(name, '013I()[]-', 'olel')) AS f FROM t GROUP BY name) SELECT name, n, {_gate} AS junk FROM c""",
    "lexicon_order": f"SELECT profile, term, row_number() OVER (PARTITION BY profile ORDER BY CASE WHEN contains(term, ' ') THEN 0 ELSE 1 END, length(term) DESC, term) AS rank FROM {_terms}",
    "lexicon_variants": f"SELECT profile, term FROM {_terms} UNION SELECT profile, term || v FROM {_terms} CROSS JOIN (SELECT unnest(['''s', '’s', 's']) AS v) WHERE NOT contains(term, ' ') AND length(term) >= 2",
    "floor_outside_index": "SELECT DISTINCT f.profile, f.term FROM lexicon_terms f WHERE origin = 'floor' AND NOT EXISTS (SELECT 1 FROM lexicon_terms i WHERE i.origin = 'index' AND i.profile = f.profile AND i.term = f.term)",
    "dispatch_novels": f"""SELECT run_id, {_norm("coalesce(selected, '')")} AS norm_key, coalesce(r.profile, 'universal') AS pipeline, CASE WHEN r.profile IS NULL THEN 'universal-only' ELSE 'novel-profile' END AS mode, r.profile IS NOT NULL AS has_profile,
      CASE WHEN r.profile IS NULL THEN {_index("coalesce(selected, '')")} ELSE {_index('r.display_name')} END AS index_filename FROM run_metadata LEFT JOIN {_registry} r ON r.norm_key = {_norm("coalesce(selected, '')")}""",
    "dispatch_agrees": f"""SELECT run_id, was_mode, own_mode, was_pipeline, own_pipeline, novel_pipeline, own_mode = was_mode AND own_pipeline = was_pipeline AS agrees FROM (SELECT run_id, m.mode AS was_mode, CASE WHEN r.profile IS NULL THEN 'universal-only' ELSE 'novel-profile' END AS own_mode, m.pipeline AS was_pipeline, coalesce(r.profile, 'universal') AS own_pipeline, coalesce(n.profile, 'universal') AS novel_pipeline
      FROM run_metadata m LEFT JOIN {_registry} r ON r.norm_key = {_norm("coalesce(selected, '')")} LEFT JOIN {_registry} n ON n.norm_key = {_norm("coalesce(novel, '')")})""",
    "novel_roster": rf"""WITH n AS (SELECT DISTINCT list_aggregate(list_transform({_words_of(rr('index_filename', *_STEM))}, lambda w, i: CASE WHEN i > 1 AND lower(w) IN ({', '.join(q(w) for w in SMALL_WORDS)}) THEN lower(w) ELSE upper(substring(lower(w), 1, 1)) || substring(lower(w), 2) END), 'string_agg', ' ') AS name
        FROM dispatch_cases WHERE index_filename IS NOT NULL AND ends_with(lower(index_filename), '.txt'))
      SELECT CAST(0 AS INTEGER) AS "group", {q(UNIVERSAL)} AS entry UNION ALL SELECT CAST(1 AS INTEGER), CASE WHEN r.profile IS NULL THEN name || {q(NO_PROFILE)} ELSE name END FROM n LEFT JOIN {_registry} r ON r.norm_key = {_norm('name')}""",
    "editing_notes": f"SELECT input_name AS novel, CASE WHEN r.profile IS NULL THEN 'Base rules.' ELSE 'Base rules.' || chr(10) || chr(10) || 'Layer of ' || r.profile END AS combined, r.profile IS NULL AS universal_only FROM dispatch_cases LEFT JOIN {_registry} r ON r.norm_key = {_norm('input_name')}",
    "name_forms": f"""SELECT input_name, {_norm('input_name')} AS norm_key, coalesce(list_aggregate(regexp_extract_all(lower(input_name), '[a-z0-9]+'), 'string_agg', '-'), '') AS kebab, {_index('input_name')} AS index_name,
      coalesce(list_aggregate(list_transform({_words_of(strip('input_name'))}, lambda w: upper(substring(w, 1, 1)) || substring(w, 2)), 'string_agg', '-'), '') || '.md' AS markdown_name,
      coalesce(list_aggregate(list_transform({_words_of(rr("coalesce(index_filename, '')", *_STEM))}, lambda w, i: CASE WHEN i > 1 AND lower(w) IN ({', '.join(q(w) for w in SMALL_WORDS)}) THEN lower(w) ELSE upper(substring(lower(w), 1, 1)) || substring(lower(w), 2) END), 'string_agg', ' '), '') AS display_name,
      {_safe('input_name')} AS safe_name, input_name AS unmarked FROM dispatch_cases""",
    "upload_scan": "SELECT run_id, seq, path FROM batch_inputs WHERE ends_with(lower(path), '.pdf')",
    "natural_order": f"SELECT path, list_aggregate({_natural}, 'string_agg', '|') AS natural_key FROM (SELECT DISTINCT path FROM batch_inputs)",
    "missing_inputs": "SELECT run_id, seq, path FROM batch_inputs b WHERE NOT EXISTS (SELECT 1 FROM batch_inputs o WHERE o.file_exists AND o.run_id = b.run_id AND o.seq = b.seq)",
    "next_batch_number": r"SELECT regexp_replace(folder, '-\d{1,18}$', '') AS base, coalesce(max(CAST(nullif(regexp_extract(folder, '-(\d{1,18})$', 1), '') AS BIGINT)), 0) + 1 AS next_number FROM (SELECT regexp_replace(output_dir, '^.*/', '') AS folder FROM summary) GROUP BY 1",
    "input_statuses": f"SELECT run_id, seq, path, {_status} AS status FROM batch_inputs",
    "batch_summary": f"SELECT run_id, count(*) AS total, CAST(count(*) FILTER (status = 'succeeded') AS BIGINT) AS succeeded, CAST(count(*) FILTER (status = 'failed') AS BIGINT) AS failed, CAST(count(*) FILTER (starts_with(status, 'skipped')) AS BIGINT) AS skipped FROM (SELECT run_id, {_status} AS status FROM batch_inputs) GROUP BY run_id",
    "run_reports": f"""SELECT b.*, s.total AS said_total, CAST(len(s.outputs) AS BIGINT) AS n_outputs, s.profile_applied FROM (SELECT run_id, count(*) AS total, CAST(count(*) FILTER (status = 'succeeded') AS BIGINT) AS succeeded, CAST(count(*) FILTER (status = 'failed') AS BIGINT) AS failed,
      CAST(count(*) FILTER (starts_with(status, 'skipped')) AS BIGINT) AS skipped FROM (SELECT run_id, {_status} AS status FROM batch_inputs) GROUP BY run_id) b JOIN summary s USING (run_id)""",
    "logged_edits": f"SELECT rule, category, count(*) AS n, CAST(sum(CASE WHEN category <> 'integrity_flag' THEN 1 ELSE 0 END) AS BIGINT) AS n_edits FROM {_once} WHERE original <> replacement GROUP BY rule, category",
    "edit_counts": f"SELECT doc_id, count(*) AS n_edits, CAST(max(seq) AS BIGINT) AS last_seq FROM {_once} WHERE original <> replacement AND category <> 'integrity_flag' GROUP BY doc_id",
    "link_entries": " UNION ALL ".join(
        f"SELECT doc_id, unnest(regexp_extract_all(text, {q(p)})) AS original, {q(r)} AS rule FROM {SRC}" for p, r in ((r"@@[^@\n]{1,40}@@", "junk_strip.at_marker"), (rf"(?i)\bhttps?://[^{WS}]+", "junk_strip.url"), (rf"(?i)\bwww\.[^{WS},;)]+", "junk_strip.url"))
    )
    + " UNION ALL "
    + " UNION ALL ".join(f"SELECT doc_id, {q(m)} AS original, 'junk_strip.marker' AS rule FROM {SRC} WHERE contains(text, {q(m)})" for m in T.MARKERS),
    "log_snippets": f"SELECT edit_id, substring({strip(rr(_context, (f'[{WS}]+', ' ')))}, 1, 160) AS snippet FROM edits",
}
