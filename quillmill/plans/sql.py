"""DuckDB SQL for the queries' common tables, written apart from the Spark code it is held against."""

from __future__ import annotations

from quillmill.functions import chunks, classify, spans, targets
from quillmill.functions.caselaw import CITATION, COURT, YEAR
from quillmill.plans.corpus import CORPUS, cleaned_sql


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _fires(pattern: str) -> str:
    return f"regexp_matches(substr(raw, 1, {classify.SAMPLE}), {q('(?im)' + pattern)})"


_SCORES = ", ".join(
    "0.0::DOUBLE + " + " + ".join(f"CASE WHEN {_fires(p)} THEN {w}::DOUBLE ELSE 0.0::DOUBLE END" for p, w in signals) + f" AS s_{kind}"
    for kind, signals in classify.SIGNALS.items()
)
SCORED = f"scored AS (SELECT *, {_SCORES} FROM cleaned)"
CLASSIFIED = """totalled AS (SELECT *, 0.0::DOUBLE + s_caselaw + s_published + s_private AS s_total FROM scored),
shared AS (SELECT *, s_caselaw / s_total AS p1, s_published / s_total AS p2, s_private / s_total AS p3 FROM totalled),
classified AS (SELECT *, CASE WHEN ext IN ('.eml', '.msg') THEN 'private' WHEN ext = '.pptx' THEN 'published' WHEN s_total = 0 OR greatest(p1, p2, p3) < 0.6 THEN 'uncertain'
 WHEN p1 = greatest(p1, p2, p3) THEN 'caselaw' WHEN p2 = greatest(p1, p2, p3) THEN 'published' ELSE 'private' END AS doc_type,
 CASE WHEN ext IN ('.eml', '.msg') THEN 0.99::DOUBLE WHEN ext = '.pptx' THEN 0.9::DOUBLE WHEN s_total = 0 THEN 0.0::DOUBLE ELSE greatest(p1, p2, p3) END AS confidence FROM shared)"""


def _spans(kind: str) -> str:
    score = f"{spans.RECOGNIZERS[kind][1]}::DOUBLE"
    if kind in spans.NEAR:
        score = f"CASE WHEN regexp_matches(clean, {q(spans.NEAR[kind][0])}) THEN least({score} + {spans.NEAR[kind][1]}::DOUBLE, 1.0::DOUBLE) ELSE {score} END"
    cut = f"string_split(regexp_replace(clean, {q(spans.marked(kind)[0])}, '\\1' || chr(1) || '\\2' || chr(1), 'g'), chr(1))"
    return (
        f"list_transform([{cut}], lambda c: list_transform(range(2, len(c), 2), lambda i: {{'entity_type': {q(kind)}, "
        f"'start': CAST(coalesce(list_sum(list_transform(c[1:i-1], lambda p: len(p))), 0) AS INT), "
        f"'end': CAST(coalesce(list_sum(list_transform(c[1:i], lambda p: len(p))), 0) AS INT), 'score': {score}, 'text': c[i]}}))[1]"
    )


_FOUND = " || ".join(map(_spans, spans.RECOGNIZERS))
DETECTED = f"detected AS (SELECT *, CASE WHEN doc_type IN ('private', 'uncertain') THEN {_FOUND} ELSE [] END AS spans FROM classified)"
KEPT = """ordered AS (SELECT *, list_filter(spans, lambda e: e.score >= 0.85) || list_filter(spans, lambda e: e.score >= 0.5 AND e.score < 0.85) AS usable FROM detected),
sorted_spans AS (SELECT *, list_transform(list_sort(list_transform(usable, lambda e: {'s': e.start, 'l': e.start - e.end, 'e': e})), lambda x: [x.e]) AS singles FROM ordered),
kept AS (SELECT *, CASE WHEN len(singles) = 0 THEN [] ELSE list_reduce(singles, lambda a, x: CASE WHEN x[1].start >= a[-1].end THEN a || x ELSE a END) END AS kept_spans FROM sorted_spans)"""
BASE = f"WITH {CORPUS},\n{cleaned_sql()},\n{SCORED},\n{CLASSIFIED}"
SPANS = f"{BASE},\n{DETECTED}"
FULL = f"{SPANS},\n{KEPT}"
CORPUS_ONLY = f"WITH {CORPUS}"
CLEANED = f"WITH {CORPUS},\n{cleaned_sql()}"

STEM = "regexp_replace(filename, '^(.+)\\.[^.]+$', '\\1')"


def canonical_stem(x: str) -> str:
    for end in (".ocr", "-ocr", "_ocr", "-ocr.pdf", " searchable copy"):
        x = f"(CASE WHEN ends_with(lower({x}), {q(end)}) THEN left({x}, len({x}) - {len(end)}) ELSE {x} END)"
    return f"trim(lower({x}))"


SLUG = f"regexp_replace(regexp_replace(lower({STEM}), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"
ANON = "'anon_' || left(sha256(filename), 16)"
VERSIONS = f"""firsts AS (SELECT *, first_value(path) OVER (PARTITION BY sha256 ORDER BY string_split(path, '/')) AS first_path FROM corpus),
kept_files AS (SELECT *, {canonical_stem(STEM)} AS stem FROM firsts WHERE path = first_path),
best AS (SELECT *, first_value(path) OVER (PARTITION BY stem ORDER BY CASE ext WHEN '.txt' THEN 0 WHEN '.pdf' THEN 1 WHEN '.docx' THEN 2 WHEN '.pptx' THEN 3 WHEN '.eml' THEN 4 WHEN '.msg' THEN 5 ELSE 99 END,
 CASE WHEN regexp_matches(lower({STEM}), '(\\.ocr|-ocr|_ocr|-ocr\\.pdf| searchable copy)$') THEN 0 ELSE 1 END, len(path), string_split(path, '/')) AS best_path FROM kept_files)"""
META = (
    f"nullif(regexp_replace(regexp_extract(left(clean, 2000), {q(CITATION)}, 1), '^\\s+|\\s+$', '', 'g'), '') AS citation, "
    f"CAST(nullif(regexp_extract(left(clean, 2000), {q(YEAR)}, 1), '') AS INT) AS year, nullif(regexp_extract(left(clean, 2000), {q(COURT)}, 1), '') AS court"
)
#: The digits of a SHA-256 taken modulo 551 one by one.
OFFSET = "180 + list_reduce([0] || list_transform(range(1, 65), lambda i: CAST(instr('0123456789abcdef', sha256(left(clean, 4096))[i]) - 1 AS INT)), lambda a, d: (a * 16 + d) % 551)"

_TOKENS = " ".join(f"WHEN {q(k)} THEN {q(t)}" for k, t in targets.TOKEN_OF.items())
TOKEN_FOR = f"CASE trim(lower(kind)) {_TOKENS} ELSE '[REDACTED]' END"

_COUNT = r"len(regexp_extract_all({}, '[\p{{L}}\p{{M}}\p{{N}}\p{{Pc}}]+|[^\p{{L}}\p{{M}}\p{{N}}\p{{Pc}}\s]'))".format
_LIST = lambda xs: "[" + ", ".join("'" + x.replace("\n", "'||chr(10)||'") + "'" for x in xs) + "]"


def chunks_sql(source: str) -> str:
    """CTEs up to ``chunks (doc_id, doc_type, index, total, token_count, text)`` of ``source (doc_id, doc_type, text)``; the query is a recursive one.

    A node is a text to be cut; its large pieces are nodes with the separators behind; its runs of small pieces are
    joined by a fold that keeps the first piece of the chunk at hand and the ranges of the chunks before it.
    """
    small = ", ".join(q(k) for k, v in chunks.CONFIG.items() if v == chunks.CONFIG["caselaw"])
    (s1, o1), (s2, o2) = chunks.CONFIG["caselaw"], chunks.CONFIG["private"]
    cut = (
        "SELECT *, CASE WHEN seps[use] = '' THEN string_split(text, '') ELSE list_filter([string_split(text, seps[use])[1]] || list_transform(string_split(text, seps[use])[2:], lambda x: seps[use] || x), lambda x: x <> '') END AS pieces"
        " FROM (SELECT *, list_filter(range(level + 1, len(seps) + 1), lambda k: seps[k] = '' OR contains(text, seps[k]))[1] AS use FROM nodes) WHERE use IS NOT NULL"
    )
    each = f"SELECT doc_id, size, overlap, seps, path, use, unnest(pieces) AS piece, unnest(range(1, len(pieces) + 1)) AS i FROM ({cut})"
    before = "(cum[x.i - 1] - coalesce(cum[{0} - 1], 0))".format
    fit = f"coalesce(list_filter(range(s.a, x.i), lambda j: {before('j')} <= overlap AND {before('j')} + ns[x.i] <= size)[1], x.i)"
    full = f"s.a < x.i AND {before('s.a')} + ns[x.i] > size"
    state = "{{'i': CAST({} AS BIGINT), 'a': CAST({} AS BIGINT), 'out': {}}}".format
    step = state("x.i", f"CASE WHEN {full} THEN {fit} ELSE s.a END", f"CASE WHEN {full} THEN s.out || [{{'a': s.a, 'b': x.i - 1}}] ELSE s.out END")
    none = "CAST([] AS STRUCT(a BIGINT, b BIGINT)[])"
    return f"""texts AS (SELECT doc_id, doc_type, text, CASE WHEN doc_type IN ({small}) THEN {s1} ELSE {s2} END AS size, CASE WHEN doc_type IN ({small}) THEN {o1} ELSE {o2} END AS overlap,
 CASE WHEN doc_type = 'caselaw' THEN {_LIST(chunks.LEGAL_SEPARATORS)} ELSE {_LIST(chunks.COMMON_SEPARATORS)} END AS seps FROM {source}),
nodes AS (SELECT doc_id, size, overlap, seps, CAST([] AS BIGINT[]) AS path, text, CAST(0 AS BIGINT) AS level FROM texts UNION ALL
 SELECT doc_id, size, overlap, seps, list_append(path, i), piece, use FROM ({each}) WHERE {_COUNT('piece')} >= size),
pieces AS (SELECT *, {_COUNT('piece')} AS n FROM ({each})),
marked AS (SELECT *, count(*) FILTER (n >= size) OVER (PARTITION BY doc_id, path ORDER BY i) AS run FROM pieces),
summed AS (SELECT *, sum(n) OVER (PARTITION BY doc_id, path, run ORDER BY i) AS cum FROM marked WHERE n < size),
runs AS (SELECT doc_id, size, overlap, path, min(i) AS lead_i, list(piece ORDER BY i) AS ps, list(n ORDER BY i) AS ns, list(CAST(cum AS BIGINT) ORDER BY i) AS cum FROM summed GROUP BY doc_id, size, overlap, path, run),
folded AS (SELECT *, list_reduce(list_transform(range(1, len(ps) + 1), lambda k: {state('k', '1', none)}), lambda s, x: {step}) AS f FROM runs),
ranges AS (SELECT doc_id, list_append(path, lead_i) AS place, ps, unnest(f.out || [{{'a': f.a, 'b': len(ps)}}]) AS r FROM folded),
stripped AS (SELECT doc_id, place, r.a AS a, regexp_replace(array_to_string(ps[r.a:r.b], ''), '^\\s+|\\s+$', '', 'g') AS text FROM ranges),
all_chunks AS (SELECT * FROM stripped WHERE text <> '' UNION ALL SELECT doc_id, [], 0, text FROM texts WHERE doc_id NOT IN (SELECT doc_id FROM stripped WHERE text <> '')),
chunks AS (SELECT s.doc_id, t.doc_type, CAST(row_number() OVER (PARTITION BY s.doc_id ORDER BY place, a) - 1 AS INT) AS index, CAST(count(*) OVER (PARTITION BY s.doc_id) AS INT) AS total, CAST({_COUNT('s.text')} AS INT) AS token_count, s.text FROM all_chunks s JOIN texts t USING (doc_id)),
chunk_sums AS (SELECT doc_id, count(*) AS chunk_count, CAST(sum(token_count) AS BIGINT) AS token_count FROM chunks GROUP BY doc_id)"""
