"""SQL of the cleaning plan: the SQL of its rules, chained in the plan's order over numbered rows.

Each step is a common table expression (doc_id, text); what a step logs is kept beside it as a list.
Masked repairs run over the gaps between heading lines.  Watermarks are the one line that the inputs hold.
"""

from __future__ import annotations

from foliowright.functions import text as T
from foliowright.plans import oracles as O

WS, NW, q, rr = O.WS, O.NW, O.q, O.rr
_lines = O._lines
_ENTRY = "{{'original': {0}, 'replacement': {1}, 'rule': {2}, 'category': {3}, 'context': {4}}}"
_NO_ENTRY = "CAST([] AS STRUCT(original VARCHAR, replacement VARCHAR, rule VARCHAR, category VARCHAR, context VARCHAR)[])"


def _snippet(x: str) -> str:
    return f"substring({O.strip(rr(x, (f'[{WS}]+', ' ')))}, 1, 160)"


def _entry(original: str, rule: str, context: str, category: str = "fingerprint", replacement: str = "''") -> str:
    return _ENTRY.format(original, replacement, q(rule), q(category), _snippet(context))


def _removed(pattern: str, rule: str) -> str:
    return f"list_transform(list_filter(regexp_extract_all(text, {q(pattern)}), lambda x: {O.strip('x')} <> ''), lambda x: {_entry('x', rule, 'x')})"


def _split_words(x: str) -> str:
    """Words parted after one letter, joined again."""
    rejoin = (rf"(a )([b-hj-z][{WS}][a-z])|([{WS}])([b-hj-z])[{WS}]([a-z])", r"\1\2\3\4\5")
    x = f"list_aggregate(list_transform(string_split({x}, chr(10)), lambda l: {rr('l', rejoin)}), 'string_agg', chr(10))"
    x = rr(x, *[(rf"(^|{NW})a[{WS}]{c}{c}", rf"\1a{c}{c}") for c in "bcdfghjklmnpqrstvwxyz"])
    return O.words(x, {w.replace(" ", f"[{WS}]+"): w.replace(" ", "") for w in T.SPLIT_WORDS})


def _repairs(x: str) -> str:
    ocr = O.words(rr(O.words(rr(x, *O._dots, *O._pipes, *O._zeros), T.MISREAD_WORDS), *O._contractions), T.GLUED_WORDS, "(?i)")
    x = rr(_split_words(ocr), ("[ \\t]{2,}", " "), ("[ \\t]+\\n", "\n"))
    return O._dashes(rr(x, (rf"\b(\d+)[{WS}]*/[{WS}]*(\d+)\b", r"\1 out of \2")))


_HEADING = rf"(?im)^[{WS.replace(chr(92) + 'n', '')}]*(?:Chapter)[{WS}]+\d[^\n]*"
_URL, _WWW = rf"(?i)\bhttps?://[^{WS}]+", rf"(?i)\bwww\.[^{WS},;)]+"
_DASHED = rf"[^{WS}]+[{WS}]+{T.DASHES}[{WS}]+[^{WS}]+"
_RUN_LINE = rf"(^|[{WS}])({O._run})([{WS}]|$)"
_QUOTES = "“”„‟❝❞〝〞＂«»"
_slashes = "(length(text) - length(replace(text, '/', '')))"
_repeated_titles = rf"""list_aggregate(list_filter(string_split(text, chr(10) || chr(10)), lambda p, i: NOT regexp_matches({O.strip('p')}, {q(rf'(?i)^Chapter[{WS}]+([\d,]+):')})
  OR list_position(list_transform(string_split(text, chr(10) || chr(10)), lambda y: CASE WHEN regexp_matches({O.strip('y')}, {q(rf'(?i)^Chapter[{WS}]+([\d,]+):')}) THEN replace(regexp_extract({O.strip('y')}, {q(rf'(?i)^Chapter[{WS}]+([\d,]+):')}, 1), ',', '') END), replace(regexp_extract({O.strip('p')}, {q(rf'(?i)^Chapter[{WS}]+([\d,]+):')}, 1), ',', '')) = i), 'string_agg', chr(10) || chr(10))"""
_violations = rf"list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda x: {O.strip('x')}), lambda x: starts_with(lower(x), 'chapter ') AND NOT regexp_matches(x, {q(rf'(?i)^Chapter[{WS}]+[\d,]+:[{WS}]*.*?[.?!][{WS}]*$')}))"


# Protected terms: patterns of a profile's phrases and words as columns p and w, letters taken once and every other character twice.
_OPEN, _CLOSE = "\ue001", "\ue002"
_NEVER = r"[^\s\S]"
_USABLE = f"(SELECT profile, term FROM {O._terms} WHERE length(term) >= 2 AND term <> 'Chapter')"
_TWICE = r"(\\[^A-Za-z0-9]|[^\\A-Za-z])"
_PATTERNS = f"""(SELECT profile, coalesce(string_agg(p, '|' ORDER BY length(v) DESC, v), {q(_NEVER)}) AS p, coalesce(string_agg(w, '|' ORDER BY length(v) DESC, v), {q(_NEVER)}) AS w FROM (
  SELECT profile, term AS v, replace(regexp_escape(term), {q(chr(92) + ' ')}, {q(f'[{WS}]+')}) AS p, NULL AS w FROM {_USABLE} WHERE contains(term, ' ')
  UNION ALL SELECT profile, v, NULL, {rr('regexp_escape(v)', (_TWICE, r'\1\1'))} FROM (SELECT DISTINCT profile, term || x AS v FROM {_USABLE}, (SELECT unnest(['', '''s', '’s', 's']) AS x) WHERE NOT contains(term, ' ')))
  GROUP BY profile)"""


def _marked(text: str, p: str, w: str, whole: str = "") -> str:
    """A text with marks around its protected spans: headings (``whole``) and phrases first, then words with no letter beside them."""
    x = f"regexp_replace({text}, {q('(?i)(' + whole)} || {p} || ')', {q(rf'{_OPEN}\1{_CLOSE}')}, 'g')"
    x = rr(x, (f"([^A-Za-z{_OPEN}{_CLOSE}])", r"\1\1"))
    x = f"regexp_replace({x}, {q(f'(?i)({_OPEN}[^{_CLOSE}]*{_CLOSE})|(^|[^A-Za-z])(')} || {w} || {q(')([^A-Za-z]|$)')}, {q(rf'\1\2{_OPEN}\3{_CLOSE}\4')}, 'g')"
    return rr(x, (f"([^A-Za-z{_OPEN}{_CLOSE}])(?s:.)", r"\1"))


_SPAN = f"{_OPEN}[^{_CLOSE}]*{_CLOSE}"
_spans_of = lambda x: f"list_filter(list_transform(regexp_extract_all({x}, {q(_SPAN)}), lambda h: lower({rr('h', (f'[{_OPEN}{_CLOSE}]', ''), (f'[{WS}]+', ' '))})), lambda h: h <> '')"


def plan(source: str, tier2: bool = False, profiled: bool = False, terms: bool = False, summed: str = "true", fixes: dict[str, str] | None = None) -> str:
    """CTEs ending in ``done``: (doc_id, id, text, entries, reason, n_violations) of the plan over ``source`` (id, text).

    With ``terms``, the source also has the patterns p and w of its row's profile; rows that are ``summed`` get the rows of a profiled run.
    """
    steps: list[str] = []
    name = "s0"

    def step(expr: str, entries: str | None = None, more: str = "") -> None:
        nonlocal name
        new = f"s{len(steps) + 1}"
        log = f"list_concat(e, {entries})" if entries else "e"
        steps.append(f"{new} AS MATERIALIZED (SELECT doc_id, {expr} AS text, {log} AS e, n_dash, n_slash{more} FROM {name})")
        name = new

    def whole(query: str) -> None:
        """A step that aggregates: rows that it drops have no text left."""
        nonlocal name
        new = f"s{len(steps) + 1}"
        steps.append(f"{new}q AS MATERIALIZED (SELECT * FROM ({query.replace(O.SRC, name)}))")
        steps.append(f"{new} AS MATERIALIZED (SELECT o.doc_id, coalesce(w.text, '') AS text, o.e, o.n_dash, o.n_slash FROM {name} o LEFT JOIN {new}q w ON w.doc_id = o.doc_id)")
        name = new

    step(O._unicode)
    step(O._quotes)
    step(O.swap("text", T.LIGATURES))
    markers = "list_filter([" + ", ".join(f"CASE WHEN contains(text, {q(m)}) THEN {_entry(q(m), 'junk_strip.marker', q(m))} END" for m in T.MARKERS) + "], lambda x: x IS NOT NULL)"
    step(O._markers, markers)
    step(rr("text", (r"@@[^@\n]{1,40}@@", "")), _removed(r"@@[^@\n]{1,40}@@", "junk_strip.at_marker"))
    step(rr("text", (rf"(?i)(^|{NW})https?://[^{WS}]+", r"\1")), _removed(_URL, "junk_strip.url"))
    step(rr("text", (rf"(?i)(^|{NW})www\.[^{WS},;)]+", r"\1")), _removed(_WWW, "junk_strip.url"))
    sold = O._sold
    step(f"list_aggregate(list_filter({_lines}, lambda x: x <> {sold}), 'string_agg', chr(10))", f"list_transform(list_filter({_lines}, lambda x: x = {sold}), lambda x: {_entry('x', 'junk_strip.domain', 'x')})")
    step(O._decoration, f"list_transform(list_filter({_lines}, lambda x: regexp_matches(x, {q(_RUN_LINE)})), lambda x: {_entry(f'regexp_extract(x, {q(_RUN_LINE)}, 2)', 'junk_strip.decorative_run', 'x')})")
    if tier2:
        promo = f"regexp_matches(x, {q(O._promo)})"
        step(f"coalesce(list_aggregate(list_filter({_lines}, lambda x: NOT {promo}), 'string_agg', chr(10)), '')", f"list_transform(list_filter({_lines}, lambda x: {promo}), lambda x: {_entry(O.strip('x'), 'junk_strip.tier2_line', 'x')})")
    step(f"translate(text, {q('■□' + chr(0xFFFD))}, '')")
    whole("SELECT doc_id, text FROM " + O._cut)
    step(f"list_aggregate(list_filter({_lines}, lambda x, i: NOT {O._is_chapter('x')} OR list_position(list_transform({_lines}, lambda y: {O.strip('y')}), {O.strip('x')}) = i), 'string_agg', chr(10))")
    step(rr("text", (rf"(?m)^[{WS}]*\d{{1,4}}([A-Z][a-z])", r"\1")))
    step(O._wrapped)
    new = f"s{len(steps) + 1}"
    steps.append(f"{new} AS MATERIALIZED (SELECT doc_id, text, e, len(regexp_extract_all(text, {q(_DASHED)})) AS n_dash, n_slash FROM {name})")
    name = new
    whole(f"{O._para_rows} SELECT doc_id, string_agg(paragraph, chr(10) || chr(10) ORDER BY para_no) AS text FROM rows_ GROUP BY doc_id")
    new = f"s{len(steps) + 1}"
    if terms:
        marked = _marked("o.text", "p", "w", _HEADING.replace("(?im)", "(?m:") + ")|")
        steps.append(f"{new}t AS MATERIALIZED (SELECT o.doc_id, {marked} AS text, e, n_dash FROM {name} o JOIN numbered n ON n.doc_id = o.doc_id)")
        name, cut = f"{new}t", _SPAN
    else:
        cut = _HEADING
    gaps = f"list_transform(string_split_regex(text, {q(cut)}), lambda g: {_repairs('g')})"
    joined = f"list_aggregate(list_transform({gaps}, lambda g, i: g || coalesce(regexp_extract_all(text, {q(cut)})[i], '')), 'string_agg', '')"
    bare = f"translate({joined}, {q(_OPEN + _CLOSE)}, '')" if terms else joined
    steps.append(f"{new}m AS MATERIALIZED (SELECT doc_id, translate(text, {q(_OPEN + _CLOSE)}, '') AS before, {bare} AS text, e, n_dash FROM {name})")
    steps.append(f"{new} AS MATERIALIZED (SELECT doc_id, text, e, n_dash, {_slashes.replace('text', 'before')} - {_slashes} AS n_slash FROM {new}m)")
    name = new
    for bad in sorted(fixes or {}, key=lambda k: (-len(k), k)):
        new = f"s{len(steps) + 1}"
        parts = f"string_split_regex(text, {q(_HEADING)})"
        put = f"list_aggregate(list_transform({parts}, lambda g, i: replace(g, {q(bad)}, {q(fixes[bad])}) || coalesce(regexp_extract_all(text, {q(_HEADING)})[i], '')), 'string_agg', '')"
        log = f"CASE WHEN len(list_filter({parts}, lambda g: contains(g, {q(bad)}))) > 0 THEN [{_entry(q(bad), 'special_fixes', q(bad), 'forced_substitution', q(fixes[bad]))}] ELSE {_NO_ENTRY} END"
        steps.append(f"{new} AS MATERIALIZED (SELECT doc_id, {put} AS text, list_concat(e, {log}) AS e, n_dash, n_slash FROM {name})")
        name = new
    whole(f"SELECT doc_id, string_agg({O._titles('line')}, chr(10) ORDER BY n) AS text FROM (SELECT doc_id, unnest({_lines}) AS line, generate_subscripts({_lines}, 1) AS n FROM {O.SRC}) GROUP BY doc_id")
    step(O._punctuation)
    step(O._articles)
    step(O._dashes("text"))
    step(_repeated_titles)
    step(O.strip(rr("text", ("\\n{3,}", "\n\n"))))
    step(O._breaks)
    first = f"s0 AS MATERIALIZED (SELECT doc_id, raw AS text, CASE WHEN reason IS NULL THEN {_NO_ENTRY} ELSE [{_entry('reason', 'junk_strip.error_page_flag', 'string_split(raw, chr(10))[1]', 'integrity_flag', q('[FLAGGED: whole-file error page - re-scrape needed]'))}] END AS e, 0 AS n_dash, 0 AS n_slash FROM flagged)"
    hits = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(raw, {q(p)}) THEN {q(n)} END" for n, p in O._signals) + "], lambda x: x IS NOT NULL)"
    flagged = f"""numbered AS MATERIALIZED (SELECT row_number() OVER () AS doc_id, *, coalesce(text, '') AS raw FROM {source}),
flagged AS MATERIALIZED (SELECT * EXCLUDE (text), CASE WHEN len({hits}) >= 2 THEN 'Cloudflare error page detected (signals: ' || list_aggregate({hits}, 'string_agg', ', ') || ')' END AS reason FROM numbered)"""
    entries = f"{name}.e"
    if profiled:
        count = f"(length(raw) - length(translate(raw, {q(_QUOTES)}, '')))"
        for n, (rule, category, note) in ((count, ("quote_normalize", "quote", "curly doubles -> straight")), (f"{name}.n_slash", ("slash_replace", "slash", "numeric ratio -> out of")), (f"{name}.n_dash", ("em_dash", "dash", "spaced em/en dash -> , or ."))):
            note_entry = _ENTRY.format(f"CAST({n} AS VARCHAR) || ' occurrence(s)'", q(note), q(rule), q(category), q(note))
            entries = f"list_concat({entries}, CASE WHEN {n} > 0 AND {summed} THEN [{note_entry}] ELSE {_NO_ENTRY} END)"
    done = f"done AS (SELECT flagged.doc_id, flagged.id, {name}.text AS text, list_filter({entries}, lambda x: x.original <> x.replacement) AS entries, reason, list_transform({_violations.replace('text', name + '.text')}, lambda x: substring(x, 1, 120)) AS violations, len(violations) AS n_violations FROM {name} JOIN flagged ON flagged.doc_id = {name}.doc_id)"
    return "WITH " + ",\n".join([flagged, first, *steps, done])


_n_edits = "CAST(len(list_filter(entries, lambda x: x.category <> 'integrity_flag')) AS BIGINT) AS n_edits"
_DIRTY_ROWS = f"(SELECT doc_id AS id, {O.DIRTY} AS text FROM documents)"
_BUILD_ROWS = "(SELECT render_id AS id, text FROM build_pdf)"
_unnested = "(SELECT id, unnest(entries) AS x, generate_subscripts(entries, 1) AS n FROM done)"

_EMPTY = q("")
_PROFILED = f"(SELECT b.render_id AS id, r.profile AS profile, b.text AS text, coalesce(t.p, {q(_NEVER)}) AS p, coalesce(t.w, {q(_NEVER)}) AS w FROM build_pdf b JOIN {O._registry} r ON r.norm_key = {O._norm(f'coalesce(b.novel, {_EMPTY})')} LEFT JOIN {_PATTERNS} t ON t.profile = r.profile)"
_profiled_plan = plan(_PROFILED, profiled=True, terms=True)

_RUNS = f"(SELECT m.run_id, r.profile, r.display_name, m.selected FROM (SELECT run_id, max(selected) AS selected FROM run_metadata GROUP BY run_id) m LEFT JOIN {O._registry} r ON r.norm_key = {O._norm(f'coalesce(m.selected, {_EMPTY})')})"
_INPUTS = f"""(SELECT 0 AS id, b.run_id, seq, path, raises, status, m.profile AS profile, CASE WHEN status = 'succeeded' THEN text END AS text, coalesce(t.p, {q(_NEVER)}) AS p, coalesce(t.w, {q(_NEVER)}) AS w
  FROM (SELECT DISTINCT run_id, seq, path, raises, text, {O._status} AS status FROM batch_inputs) b LEFT JOIN {_RUNS} m ON m.run_id = b.run_id LEFT JOIN {_PATTERNS} t ON t.profile = m.profile)"""
_batch = plan(_INPUTS, profiled=True, terms=True, summed="profile IS NOT NULL")
_NAMES = f"""named AS (SELECT run_id, seq, path, folder || '/' || stem || CASE WHEN n > 1 THEN '_' || n ELSE '' END || '.pdf' AS output_path FROM (SELECT *, row_number() OVER (PARTITION BY run_id, folder, stem ORDER BY seq, path) AS n FROM (
  SELECT run_id, seq, path, regexp_replace({O._safe('path')}, '(?i)\\.pdf$', '') AS stem, CASE WHEN d = 'in' OR starts_with(d, 'in/') THEN 'out/in' || substring(d, 3) ELSE 'out' END AS folder FROM (SELECT *, regexp_replace(path, '/?[^/]*$', '') AS d FROM numbered WHERE status = 'succeeded'))))"""
_done = f"(SELECT n.*, d.text AS clean_text, d.entries AS entries FROM numbered n JOIN done d ON d.doc_id = n.doc_id)"
_edits = f"CASE WHEN status = 'succeeded' THEN {_n_edits.removesuffix(' AS n_edits')} ELSE 0 END AS n_edits"

_TOTALS = f"""SELECT b.*, 'out' AS output_dir, CASE WHEN m.profile IS NOT NULL THEN m.display_name ELSE coalesce(nullif({O.strip('m.selected')}, ''), {q(O.UNIVERSAL)}) END AS novel, m.profile IS NOT NULL AS profile_applied FROM ({O.ORACLES['batch_summary']}) b LEFT JOIN {_RUNS} m ON m.run_id = b.run_id"""


def _log() -> str:
    """What each run says: head, inputs, end, and the failed and skipped by name."""
    line = lambda n, level, text: f"{{'n': {n}, 'level': {level}, 'message': {text}}}"
    label = f"coalesce(nullif(selected, ''), '(none — universal-only)')"
    layer = f"""CASE WHEN profile_applied THEN 'Applied novel-specific editing layer for ' || novel || ' (built-in profile).' WHEN lower(trim(coalesce(selected, ''))) = 'universal'
      THEN 'Universal editing selected — applying the standard universal-only editing (no novel-specific layer).' ELSE 'No novel-specific profile for ''' || {label} || ''' — universal-only editing.' END"""
    head = ", ".join(line(n, q(level), text) for n, (level, text) in enumerate((
        ("accent", "'Starting batch: ' || total || ' file(s).'"), ("muted", "'Output folder: ' || output_dir"), ("accent", f"'Selected novel: ' || {label}"), ("muted", q("Loaded universal editor rules (UNIVERSAL.md).")), ("muted", layer),
        ("muted", "'Loaded ' || n_terms || ' protected term(s) for ' || novel || '.'"),
    )))
    edits = f"len(list_filter(entries, lambda x: x.category <> 'integrity_flag'))"
    state = f"""'[' || i || '/' || total || '] ' || regexp_replace(path, '^.*/', '') || ' — ' || CASE WHEN starts_with(status, 'skipped') THEN status WHEN status = 'failed' THEN 'FAILED (' || raises || ')' ELSE 'done (' || {edits} || CASE WHEN {edits} = 1 THEN ' edit)' ELSE ' edits)' END END"""
    level = "CASE WHEN starts_with(status, 'skipped') THEN 'warn' WHEN status = 'failed' THEN 'error' ELSE 'success' END"
    listed = "CASE WHEN status = 'failed' THEN {0} ELSE {1} END"
    part, loud = listed.format(3, 5), listed.format("'error'", "'warn'")
    return f"""{_batch}, f AS (SELECT n.*, d.entries, d.reason AS page_reason, d.violations, row_number() OVER (PARTITION BY n.run_id ORDER BY seq, path) AS i FROM numbered n JOIN done d ON d.doc_id = n.doc_id),
t AS ({_TOTALS}), k AS (SELECT profile, count(*) AS c FROM {O._terms} GROUP BY profile),
r AS (SELECT t.*, m.selected, coalesce(k.c, 0) AS n_terms FROM t LEFT JOIN {_RUNS} m ON m.run_id = t.run_id LEFT JOIN k ON k.profile = m.profile),
g AS (SELECT f.*, t.total FROM f JOIN t ON t.run_id = f.run_id),
said AS (SELECT run_id, 0 AS part, 0 AS seq, unnest([{head}]) AS m FROM r
  UNION ALL SELECT run_id, 1, i, {line(0, "'warn'", "'  ⚠ ' || page_reason || ' — chapter text missing; file needs re-scrape'")} FROM g WHERE status = 'succeeded' AND page_reason IS NOT NULL
  UNION ALL SELECT run_id, 1, i, unnest(list_transform(violations, lambda h: {line(1, "'warn'", "'  ⚠ Non-normalized chapter line: ' || h || '...'")})) FROM g WHERE status = 'succeeded'
  UNION ALL SELECT run_id, 1, i, {line(2, level, state)} FROM g
  UNION ALL SELECT run_id, 2, 0, {line(0, "CASE WHEN failed = 0 THEN 'success' ELSE 'warn' END", "'Batch complete: ' || succeeded || ' done, ' || failed || ' failed, ' || skipped || ' skipped of ' || total || '.'")} FROM r
  UNION ALL SELECT DISTINCT run_id, {part}, 0, {line(-1, loud, listed.format("'Failed:'", "'Skipped:'"))} FROM (SELECT run_id, CASE WHEN status = 'failed' THEN status ELSE 'skipped' END AS status FROM g WHERE status <> 'succeeded')
  UNION ALL SELECT run_id, {part}, i, {line(0, loud, "'  - ' || regexp_replace(path, '^.*/', '') || ' (' || " + listed.format("raises", r"regexp_extract(status, '\((.*)\)$', 1)") + " || ')'")} FROM g WHERE status <> 'succeeded')
SELECT run_id, CAST(part AS INTEGER) AS part, CAST(seq AS BIGINT) AS seq, CAST(m.n AS INTEGER) AS n, m.level AS level, m.message AS message FROM said"""


PLANS: dict[str, str] = {
    "batch_results": f"{_batch}, {_NAMES} SELECT f.run_id, f.seq, f.path, status, raises AS reason, coalesce(profile, 'universal') AS pipeline, output_path, {_edits}, CASE WHEN status = 'succeeded' THEN clean_text END AS clean_text FROM {_done} f LEFT JOIN named o ON o.run_id = f.run_id AND o.seq = f.seq AND o.path = f.path",
    "batch_dry_run": f"{_batch} SELECT run_id, seq, path, status, {_edits}, CAST(NULL AS VARCHAR) AS output_path FROM {_done}",
    "batch_entries": f"{_batch} SELECT run_id, seq, CAST(n - 1 AS INTEGER) AS n, x.original AS original, x.replacement AS replacement, x.rule AS rule, x.category AS category, x.context AS context FROM (SELECT run_id, seq, unnest(entries) AS x, generate_subscripts(entries, 1) AS n FROM {_done} WHERE status = 'succeeded')",
    "batch_totals": _TOTALS,
    "batch_log": _log(),
    "clean_profiled": f"{_profiled_plan} SELECT done.id AS render_id, profile, done.text AS clean_text, {_n_edits} FROM done JOIN numbered ON numbered.doc_id = done.doc_id",
    "terms_kept": f"""{_profiled_plan} SELECT DISTINCT render_id, profile, before, after, after >= before AS kept FROM (SELECT numbered.id AS render_id, profile, CAST(len({_spans_of(_marked('numbered.raw', 'p', 'w'))}) AS BIGINT) AS before, CAST(len({_spans_of(_marked('done.text', 'p', 'w'))}) AS BIGINT) AS after
      FROM done JOIN numbered ON numbered.doc_id = done.doc_id)""",
    "protected_terms": f"""SELECT render_id, profile, term, count(*) AS n FROM (SELECT render_id, profile, unnest({_spans_of(_marked('text', 'p', 'w'))}) AS term FROM (SELECT DISTINCT render_id, text FROM build_pdf WHERE text IS NOT NULL), {_PATTERNS})
      GROUP BY render_id, profile, term""",
    "clean_universal": f"{plan(_BUILD_ROWS)} SELECT id AS render_id, text AS clean_text, {_n_edits}, reason AS error_reason FROM done",
    "clean_dirty": f"{plan(_DIRTY_ROWS, tier2=True, profiled=True)} SELECT id AS doc_id, text AS clean_text, {_n_edits}, n_violations FROM done",
    "join_split_words": O.on_dirty(_split_words("text")),
    "audit_jsonl": f"""{plan(_DIRTY_ROWS)} SELECT id AS doc_id, CAST(0 AS BIGINT) AS line_no, '{{"record":"run_metadata","pipeline":"universal"}}' AS line FROM done
      UNION ALL SELECT id, CAST(n AS BIGINT), CAST(to_json(x) AS VARCHAR) FROM {_unnested}""",
    "forced_fixes": f"{plan(_DIRTY_ROWS, fixes=O.FIXES)} SELECT id AS doc_id, text AS clean_text, CAST(len(list_filter(entries, lambda x: x.rule = 'special_fixes')) AS BIGINT) AS n_fixes FROM done",
    "audit_rows": f"{plan(_DIRTY_ROWS)} SELECT id AS doc_id, CAST(n - 1 AS INTEGER) AS seq, x.original AS original, x.replacement AS replacement, x.rule AS rule, x.category AS category, x.context AS context FROM {_unnested}",
}
