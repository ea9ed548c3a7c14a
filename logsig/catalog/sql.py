"""SQL building blocks of the oracles: the line semantics as list folds."""

from __future__ import annotations

from ..functions.text import WHITESPACE

WS = "'" + WHITESPACE + "'"
SPACES = (
    r"\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
WORD = r"a-zA-Z0-9_\p{L}\p{N}"

DOC_LINES = f"""doc_lines AS MATERIALIZED (
  SELECT doc_id * 4294967296 + n - 1 AS pos, doc_id, source, lang,
         CAST(substr(source, 4) AS INTEGER) AS cluster, trim(line, {WS}) AS raw_log
  FROM (SELECT doc_id, source, lang, unnest(string_split(text, chr(10))) AS line,
               generate_subscripts(string_split(text, chr(10)), 1) AS n
        FROM documents)
  WHERE trim(line, {WS}) <> '')"""

EVENT_LINES = """event_lines AS MATERIALIZED (
  SELECT event_id AS pos, event_type,
         '[' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '] ' || event_type || ': user=' || user_id
         || ' value=' || CAST(round(value * 100) AS BIGINT) || ' ' || props AS raw_log
  FROM events)"""

PAGE_LINES = f"""page_lines AS MATERIALIZED (
  SELECT page_id * 4294967296 + n - 1 AS pos, page_id, trim(line, {WS}) AS raw_log
  FROM (SELECT page_id, unnest(string_split(html, '</p>')) AS line,
               generate_subscripts(string_split(html, '</p>'), 1) AS n
        FROM pages)
  WHERE trim(line, {WS}) <> '')"""

_FLUSH = (
    "CASE WHEN s.run = '...' THEN '... ' ELSE regexp_replace(s.run, '(.)', '\\1 ', 'g') END"
)


def skeleton(line: str) -> str:
    return f"regexp_replace({line}, '[{WORD}{SPACES}]+', '', 'g')"


def signature(line: str) -> str:
    """The signature of a line as a fold over its symbols with a stack."""
    top = "right(s.stk, 1)"
    wanted = f"translate({top}, '\"[{{<', '\"]}}>')"
    step = f"""CASE
      WHEN s.stk <> '' AND c = {wanted} THEN {{'stk': s.stk[:-2], 'run': '',
        'out': CASE WHEN length(s.stk) = 1 THEN s.out || {top} || 'X' || c || ' ' ELSE s.out END}}
      WHEN c IN ('"', '[', '{{', '<') THEN {{'stk': s.stk || c, 'run': '',
        'out': CASE WHEN s.stk = '' AND s.run <> '' THEN s.out || {_FLUSH} ELSE s.out END}}
      WHEN s.stk <> '' OR c IN (']', '}}', '>') THEN s
      ELSE {{'stk': s.stk, 'run': s.run || c, 'out': s.out}} END"""
    folded = (
        f"list_reduce(string_split({skeleton(line)}, ''), lambda s, c: {step}, "
        "{'stk': '', 'run': '', 'out': ''})"
    )
    final = f"CASE WHEN s.stk = '' AND s.run <> '' THEN s.out || {_FLUSH} ELSE s.out END"
    return f"""CASE WHEN {skeleton(line)} = '' THEN ''
      ELSE list_transform([{folded}], lambda s: rtrim({final}, ' '))[1] END"""


def signed(table: str, name: str = "signed") -> str:
    return (
        f"{name} AS MATERIALIZED (SELECT *, {signature('raw_log')} AS pattern FROM {table})"
    )


def _phases(pattern: str) -> str:
    """Search steps of a generated pattern: before, at and between its tokens."""
    token = f"string_split({pattern}, ' ')"
    needle = "left(t, 1)"
    closer = "CASE WHEN contains(t, 'X') THEN right(t, 1) ELSE '' END"
    return f"""list_concat(
      [{{'kind': 'before', 'needle': left({pattern}, 1), 'closer': '', 'token': ''}}],
      flatten(list_transform({token}, lambda t, i: list_concat(
        [{{'kind': 'at', 'needle': {needle}, 'closer': {closer}, 'token': t}}],
        CASE WHEN i < len({token})
             THEN [{{'kind': 'between', 'needle': left({token}[i + 1], 1), 'closer': '',
                     'token': ''}}]
             ELSE [] END))))"""


def _hit() -> str:
    return "strpos(substr(line, s.at), p.needle)"


def fields(line: str, pattern: str) -> str:
    """All fields of a line as ``{enclosed, text}``, for generated patterns."""
    start = "(s.at + hit - 1)"
    text = f"trim(substr(line, s.at, (CASE WHEN hit > 0 THEN hit - 1 ELSE length(line) END)), {WS})"
    close = f"strpos(substr(line, {start} + 1), p.closer)"
    step = f"""list_transform([{_hit()}], lambda hit: CASE
      WHEN p.kind = 'before' THEN {{
        'at': greatest(hit, 1),
        'out': CASE WHEN hit > 1 AND {text} <> '' THEN
               list_append(s.out, {{'enclosed': false, 'text': {text}}}) ELSE s.out END}}
      WHEN p.kind = 'between' THEN
        CASE WHEN regexp_full_match({text}, '[{WORD}{SPACES}.]+') THEN {{
          'at': CASE WHEN hit > 0 THEN {start} ELSE length(line) + 1 END,
          'out': list_append(s.out, {{'enclosed': false, 'text': {text}}})}} ELSE s END
      WHEN hit = 0 THEN s
      WHEN p.closer = '' THEN {{'at': {start} + 1, 'out': s.out}}
      WHEN {close} > 0 THEN {{
        'at': {start} + {close} + 1,
        'out': list_append(s.out, {{'enclosed': true,
                 'text': substr(line, {start} + 1, {close} - 1)}})}}
      ELSE s END)[1]"""
    empty = "CAST([] AS STRUCT(enclosed BOOLEAN, \"text\" VARCHAR)[])"
    folded = (
        f"list_reduce({_phases('pat')}, lambda s, p: {step}, "
        f"{{'at': CAST(1 AS BIGINT), 'out': {empty}}})"
    )
    tail = f"trim(substr(line, s.at), {WS})"
    finish = f"""CASE WHEN {tail} <> ''
      THEN list_append(s.out, {{'enclosed': false, 'text': {tail}}}) ELSE s.out END"""
    body = f"list_transform([{folded}], lambda s: {finish})[1]"
    return f"""CASE WHEN {line} = '' OR {pattern} = '' THEN {empty} ELSE
      list_transform([{{'l': {line}, 'p': {pattern}}}], lambda row:
        {body.replace('line', 'row.l').replace('pat,', 'row.p,').replace("(pat)", "(row.p)")})[1] END"""


def reconstruction(line: str, pattern: str) -> str:
    """The shallow text of a line, for generated patterns."""
    start = "(s.at + hit - 1)"
    text = f"trim(substr(line, s.at, (CASE WHEN hit > 0 THEN hit - 1 ELSE length(line) END)), {WS})"
    close = f"strpos(substr(line, {start} + 1), p.closer)"
    step = f"""list_transform([{_hit()}], lambda hit: CASE
      WHEN p.kind = 'before' THEN {{
        'at': greatest(hit, 1),
        'out': CASE WHEN hit > 1 AND {text} <> '' THEN {text} || ' ' ELSE '' END}}
      WHEN p.kind = 'between' THEN {{
        'at': CASE WHEN hit > 0 THEN {start} ELSE length(line) + 1 END,
        'out': CASE WHEN {text} <> '' THEN s.out || {text} || ' ' ELSE s.out END}}
      WHEN hit = 0 THEN {{'at': s.at, 'out': s.out || p.token || ' '}}
      WHEN p.closer = '' THEN {{'at': {start} + 1, 'out': s.out || p.token || ' '}}
      ELSE {{
        'at': CASE WHEN {close} > 0 THEN {start} + {close} + 1 ELSE length(line) + 1 END,
        'out': s.out || p.token || ' '}} END)[1]"""
    folded = (
        f"list_reduce({_phases('pat')}, lambda s, p: {step}, "
        "{'at': CAST(1 AS BIGINT), 'out': ''})"
    )
    body = (
        f"list_transform([{folded}], lambda s: rtrim(s.out || trim(substr(line, s.at), {WS}), ' '))[1]"
    )
    return f"""CASE WHEN {line} = '' OR {pattern} = '' THEN '' ELSE
      list_transform([{{'l': {line}, 'p': {pattern}}}], lambda row:
        {body.replace('line', 'row.l').replace('pat,', 'row.p,').replace("(pat)", "(row.p)")})[1] END"""


def texts(walked: str, enclosed: bool | None = None) -> str:
    """Field texts of a walk as one string, optionally of one kind."""
    kept = walked
    if enclosed is not None:
        kept = f"list_filter({walked}, lambda f: f.enclosed = {str(enclosed).lower()})"
    return f"coalesce(array_to_string(list_transform({kept}, lambda f: f.text), '|'), '')"


def default_vector(pattern: str, size: int = 256) -> str:
    """The default features of a pattern: unit frequencies of its terms' buckets."""
    words = f"CASE WHEN {pattern} = '' THEN [] ELSE string_split({pattern}, ' ') END"
    return f"""list_transform([{words}], lambda w: list_transform([list_transform(
        list_concat(w, list_transform(w[2:], lambda x, i: w[i] || ' ' || x)),
        lambda t: CAST('0x' || left(md5(t), 8) AS BIGINT) % {size})],
      lambda b: list_transform([list_transform(range({size}),
          lambda n: CAST(len(list_filter(b, lambda x: x = n)) AS DOUBLE))],
        lambda c: list_transform(c, lambda x: x / greatest(sqrt(list_dot_product(c, c)), 1e-9)))[1]
      )[1])[1]"""


def matched(fresh: str, centers: str, samples: str, limits) -> str:
    """CTEs that end in ``matched(pattern, lines, stable_id, match_kind)``: nearest center, and
    between the two distances the vote of the nearest samples.

    ``fresh`` has ``(pattern, lines, vec)``, ``centers`` ``(stable_id, center)`` and ``samples``
    ``(stable_id, idx, vec)``.
    """
    apart = """CASE WHEN list_dot_product(f.vec, f.vec) = 0 OR list_dot_product(r.vec, r.vec) = 0
      THEN 1 ELSE 1 - list_cosine_similarity(f.vec, r.vec) END"""
    return f"""near_center AS MATERIALIZED (SELECT f.pattern, lines, f.vec, stable_id AS candidate,
      {apart} AS distance FROM {fresh} f CROSS JOIN (SELECT stable_id, center AS vec FROM {centers}) r
    QUALIFY row_number() OVER (PARTITION BY f.pattern ORDER BY round({apart}, 9), stable_id) = 1),
  band AS (SELECT * FROM near_center WHERE distance >= {limits.primary_distance}
    AND distance < {limits.secondary_distance}),
  asked AS (SELECT f.pattern, candidate, stable_id FROM band f CROSS JOIN {samples} r
    QUALIFY row_number() OVER (
      PARTITION BY f.pattern ORDER BY round({apart}, 9), stable_id, idx) <= {limits.knn_k}),
  voted AS (SELECT pattern, CASE WHEN count(*) >= {limits.knn_k} THEN
      count(*) FILTER (stable_id = candidate) / {limits.knn_k} ELSE 0 END AS vote
    FROM asked GROUP BY pattern),
  kinds AS (SELECT pattern, lines, candidate, CASE
      WHEN distance < {limits.primary_distance} THEN 'direct'
      WHEN distance < {limits.secondary_distance} AND vote >= {limits.knn_confidence} THEN 'knn'
      ELSE 'outlier' END AS match_kind FROM near_center LEFT JOIN voted USING (pattern)),
  matched AS (SELECT pattern, lines, match_kind, CAST(CASE WHEN match_kind = 'outlier' THEN -1
    ELSE candidate END AS BIGINT) AS stable_id FROM kinds)"""
