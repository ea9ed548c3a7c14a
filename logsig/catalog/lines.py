"""Signatures, fields, filters: per-line operators over whole corpora."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import (
    categorize_fields,
    extract_fields,
    is_blank,
    join_fields,
    keyword_flags,
    select_fields_dual,
    select_fields_unified,
    shallow_reconstruct,
    signature_hash,
    split_symbols,
    strip,
    symbol_skeleton,
    text_preview,
    token_kinds,
)
from ..functions.fields import locate_any
from ..operators.clusters import pattern_counts, topk_patterns
from ..operators.features import term_frequencies
from ..operators.runlog import PROGRESS_WORDS
from ..sources import annotate, signature_batch
from . import sql
from .corpora import doc_lines, event_lines, page_lines, table
from .registry import query


def _raw():
    return F.col("raw_log")


def _pattern():
    return F.col("pattern")


_DOC = f"WITH {sql.DOC_LINES}, {sql.signed('doc_lines')}"
_EVENT = f"WITH {sql.EVENT_LINES}, {sql.signed('event_lines')}"
_PAGE = f"WITH {sql.PAGE_LINES}, {sql.signed('page_lines')}"


def _joined(array):
    return F.array_join(array, "|")


@query("pattern_signature", f"{_DOC} SELECT pos, pattern FROM signed")
def pattern_signature_docs(spark, folder):
    return annotate(doc_lines(spark, folder)).select("pos", "pattern")


@query("pattern_signature_pages", f"{_PAGE} SELECT pos, pattern FROM signed")
def pattern_signature_pages(spark, folder):
    return annotate(page_lines(spark, folder)).select("pos", "pattern")


@query("pattern_signature_events", f"{_EVENT} SELECT pos, pattern FROM signed")
def pattern_signature_events(spark, folder):
    return annotate(event_lines(spark, folder)).select("pos", "pattern")


@query(
    "signature_counts",
    f"""{_DOC} SELECT pattern, count(*) AS lines, min(pos) AS first_pos
    FROM signed GROUP BY pattern""",
)
def signature_counts(spark, folder):
    return (
        annotate(doc_lines(spark, folder))
        .groupBy("pattern")
        .agg(F.count(F.lit(1)).alias("lines"), F.min("pos").alias("first_pos"))
    )


@query(
    "split_symbols",
    f"""WITH {sql.DOC_LINES}, s AS (SELECT pos, {sql.skeleton('raw_log')} AS symbols FROM doc_lines)
    SELECT pos, CASE WHEN symbols = '...' THEN symbols
      ELSE rtrim(regexp_replace(symbols, '(.)', '\\1 ', 'g'), ' ') END AS tokens FROM s""",
)
def split_symbols_docs(spark, folder):
    symbols = symbol_skeleton(_raw())
    return doc_lines(spark, folder).select(
        "pos", F.array_join(split_symbols(symbols), " ").alias("tokens")
    )


@query(
    "signature_batch",
    f"""WITH raw AS (
      SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line FROM conversations),
    lines AS (SELECT conv_id, turn, trim(line, {sql.WS}) AS raw_log FROM raw
              WHERE trim(line, {sql.WS}) <> ''), {sql.signed('lines')}
    SELECT conv_id, turn, pattern, count(*) AS lines FROM signed GROUP BY ALL""",
)
def signature_batch_conversations(spark, folder):
    lines = table(spark, folder, "conversations").select(
        "conv_id", "turn", F.explode(F.split("text", "\n")).alias("raw_log")
    )
    return (
        signature_batch(lines)
        .groupBy("conv_id", "turn", "pattern")
        .agg(F.count(F.lit(1)).alias("lines"))
    )


@query(
    "extract_fields",
    f"""{_DOC}, walked AS (SELECT pos, {sql.fields('raw_log', 'pattern')} AS w FROM signed)
    SELECT pos, CAST(len(w) AS BIGINT) AS n_fields, {sql.texts('w')} AS fields FROM walked""",
)
def extract_fields_docs(spark, folder):
    walked = annotate(doc_lines(spark, folder)).select(
        "pos", extract_fields(_raw(), _pattern()).alias("fields")
    )
    return walked.select(
        "pos",
        F.size("fields").cast("bigint").alias("n_fields"),
        _joined("fields").alias("fields"),
    )


@query(
    "extract_fields_events",
    f"""{_EVENT}, walked AS (SELECT pos, {sql.fields('raw_log', 'pattern')} AS w FROM signed)
    SELECT pos, CAST(len(w) AS BIGINT) AS n_fields, {sql.texts('w')} AS fields FROM walked""",
)
def extract_fields_events(spark, folder):
    walked = annotate(event_lines(spark, folder)).select(
        "pos", extract_fields(_raw(), _pattern()).alias("fields")
    )
    return walked.select(
        "pos",
        F.size("fields").cast("bigint").alias("n_fields"),
        _joined("fields").alias("fields"),
    )


@query(
    "categorize_fields",
    f"""{_PAGE}, walked AS (SELECT pos, {sql.fields('raw_log', 'pattern')} AS w FROM signed)
    SELECT pos, {sql.texts('w', False)} AS whitespace_fields, {sql.texts('w', True)} AS x_fields
    FROM walked""",
)
def categorize_fields_pages(spark, folder):
    split = annotate(page_lines(spark, folder)).select(
        "pos", categorize_fields(_raw(), _pattern()).alias("c")
    )
    return split.select(
        "pos",
        _joined("c.whitespace_fields").alias("whitespace_fields"),
        _joined("c.x_fields").alias("x_fields"),
    )


@query(
    "select_fields_dual",
    f"""{_EVENT}, walked AS (SELECT pos, {sql.fields('raw_log', 'pattern')} AS w FROM signed),
    two AS (SELECT pos, list_filter(w, lambda f: NOT f.enclosed) AS g,
                   list_filter(w, lambda f: f.enclosed) AS x FROM walked)
    SELECT pos, array_to_string([g[3].text, g[1].text], '|') AS whitespace_fields,
           x[2].text AS x_fields FROM two""",
)
def select_fields_dual_events(spark, folder):
    split = annotate(event_lines(spark, folder)).select(
        "pos", categorize_fields(_raw(), _pattern()).alias("c")
    )
    chosen = select_fields_dual(
        F.col("c.whitespace_fields"), F.col("c.x_fields"), [2, 0, 99], [1]
    )
    return split.select("pos", chosen.alias("s")).select(
        "pos",
        _joined("s.whitespace_fields").alias("whitespace_fields"),
        _joined("s.x_fields").alias("x_fields"),
    )


_PICK = "[w[3].text, w[1].text, w[1].text, w[41].text]"


@query(
    "select_fields_unified",
    f"""{_DOC}, walked AS (SELECT pos, {sql.fields('raw_log', 'pattern')} AS w FROM signed)
    SELECT pos, coalesce(array_to_string(list_filter({_PICK}, lambda t: t IS NOT NULL), '|'), '')
      AS fields FROM walked""",
)
def select_fields_unified_docs(spark, folder):
    fields = extract_fields(_raw(), _pattern())
    return annotate(doc_lines(spark, folder)).select(
        "pos", _joined(select_fields_unified(fields, [2, 0, 0, 40])).alias("fields")
    )


@query(
    "token_kinds",
    f"""{_PAGE}, tokens AS (
      SELECT unnest(string_split(pattern, ' ')) AS token FROM signed WHERE pattern <> '')
    SELECT CASE WHEN contains(token, 'X') THEN 'enclosed_content' ELSE 'symbol' END AS kind,
           token, count(*) AS n FROM tokens GROUP BY ALL""",
)
def token_kinds_pages(spark, folder):
    kinds = annotate(page_lines(spark, folder)).select(
        F.explode(token_kinds(_pattern())).alias("t")
    )
    return kinds.groupBy("t.kind", "t.token").agg(F.count(F.lit(1)).alias("n"))


@query(
    "field_locators",
    f"""{_DOC}, first AS (
      SELECT pos, raw_log, pattern, strpos(raw_log, left(pattern, 1)) AS spot FROM signed)
    SELECT pos, CASE WHEN pattern = '' THEN 0 ELSE spot END AS first_symbol,
           CASE WHEN pattern = '' OR spot < 2 THEN ''
                ELSE trim(substr(raw_log, 1, spot - 1), {sql.WS}) END AS before FROM first""",
)
def field_locators(spark, folder):
    kinds = token_kinds(_pattern())
    needles = F.when(F.size(kinds) > 0, kinds[0]["needles"])
    located = annotate(doc_lines(spark, folder)).select(
        "pos",
        "raw_log",
        F.coalesce(locate_any(needles, _raw(), F.lit(1)), F.lit(0))
        .cast("bigint")
        .alias("first_symbol"),
    )
    before = strip(F.substring(_raw(), F.lit(1), F.greatest(F.col("first_symbol") - 1, F.lit(0)).cast("int")))
    return located.select("pos", "first_symbol", before.alias("before"))


@query(
    "shallow_reconstruct",
    f"{_DOC} SELECT pos, {sql.reconstruction('raw_log', 'pattern')} AS shallow FROM signed",
)
def shallow_reconstruct_docs(spark, folder):
    return annotate(doc_lines(spark, folder)).select(
        "pos", shallow_reconstruct(_raw(), _pattern()).alias("shallow")
    )


@query(
    "shallow_reconstruct_pages",
    f"{_PAGE} SELECT pos, {sql.reconstruction('raw_log', 'pattern')} AS shallow FROM signed",
)
def shallow_reconstruct_pages(spark, folder):
    return annotate(page_lines(spark, folder)).select(
        "pos", shallow_reconstruct(_raw(), _pattern()).alias("shallow")
    )


@query(
    "text_preview",
    """SELECT doc_id,
      CASE WHEN length(text) > 150 THEN left(text, 150) || '...' ELSE text END AS preview,
      CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS summary
    FROM documents""",
)
def text_previews(spark, folder):
    text = F.col("text")
    return table(spark, folder, "documents").select(
        "doc_id",
        text_preview(text, 150).alias("preview"),
        text_preview(text, 200).alias("summary"),
    )


@query(
    "signature_hash",
    f"""{_DOC}, counts AS (SELECT cluster, pattern, count(*) AS n, min(pos) AS first
      FROM signed GROUP BY ALL),
    top AS (SELECT * FROM counts QUALIFY row_number() OVER (
      PARTITION BY cluster ORDER BY n DESC, first) <= 3)
    SELECT cluster, left(md5(string_agg(pattern, '|' ORDER BY pattern)), 12) AS signature_hash
    FROM top GROUP BY cluster""",
)
def signature_hashes(spark, folder):
    """The hash of each source's three most frequent patterns, over all lines."""
    counts = pattern_counts(annotate(doc_lines(spark, folder)), "cluster")
    return (
        topk_patterns(counts, 3, "cluster")
        .groupBy("cluster")
        .agg(F.collect_list("pattern").alias("patterns"))
        .select("cluster", signature_hash(F.col("patterns")).alias("signature_hash"))
    )


# Written out, not taken from the library, so that the comparison can fail.
_FLAGS = """contains(lower(text), 'cluster') AS cluster,
  (contains(lower(text), 'insight') OR contains(lower(text), 'pattern')
    OR contains(lower(text), 'discovered') OR contains(lower(text), 'found')
    OR contains(lower(text), 'entity') OR contains(lower(text), 'relation')) AS insight,
  contains(lower(text), 'create_entities') AS entities,
  contains(lower(text), 'create_relations') AS relations"""


@query("keyword_flags", f"SELECT conv_id, turn, {_FLAGS} FROM conversations")
def keyword_flags_conversations(spark, folder):
    flags = keyword_flags(F.col("text"), PROGRESS_WORDS)
    return table(spark, folder, "conversations").select("conv_id", "turn", *flags)


@query(
    "join_text",
    f"""{_EVENT}, walked AS (SELECT pos, {sql.fields('raw_log', 'pattern')} AS w FROM signed)
    SELECT pos, array_to_string(list_transform(w, lambda f: f.text), chr(9)) AS line
    FROM walked""",
)
def join_text_events(spark, folder):
    return annotate(event_lines(spark, folder)).select(
        "pos", join_fields(extract_fields(_raw(), _pattern())).alias("line")
    )


@query(
    "filter_nonblank",
    f"""SELECT doc_id, count(*) AS lines FROM (
      SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
    WHERE trim(line, {sql.WS}) <> '' GROUP BY doc_id""",
)
def filter_nonblank_docs(spark, folder):
    lines = table(spark, folder, "documents").select(
        "doc_id", F.explode(F.split("text", "\n")).alias("line")
    )
    return (
        lines.filter(~is_blank(F.col("line")))
        .groupBy("doc_id")
        .agg(F.count(F.lit(1)).alias("lines"))
    )


_WORDS = "string_split(pattern, ' ')"


@query(
    "features",
    f"""{_DOC}, p AS (SELECT DISTINCT pattern FROM signed WHERE pattern <> ''),
    terms AS (
      SELECT pattern, unnest(list_concat({_WORDS}, list_transform(
        {_WORDS}[2:], lambda w, i: {_WORDS}[i] || ' ' || w))) AS term FROM p)
    SELECT pattern, term, count(*) AS tf FROM terms GROUP BY ALL""",
)
def features_docs(spark, folder):
    return term_frequencies(annotate(doc_lines(spark, folder)))


