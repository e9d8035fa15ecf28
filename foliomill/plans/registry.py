"""The registry of queries, and SQL fragments that their counterparts share."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foliomill.functions import fixed as X
from foliomill.sources.tables import HIRAGANA_FROM, HIRAGANA_TO, KATAKANA_FROM, KATAKANA_TO, PATHS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with its SQL counterpart where there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def re2(pattern: str) -> str:
    """A pattern with its code points written the way RE2 reads them."""
    return re.sub(r"\\u([0-9a-fA-F]{4})", r"\\x{\1}", pattern)


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


WS = re2(X.WS)


def norm(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(coalesce({x}, ''), '[{re2(X.CONTROL)}]', '', 'g'), '[{WS}]+', ' ', 'g'))"


def bare(x: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), '[{WS}]+', '', 'g')"


def hash24(x: str) -> str:
    return f"substr(sha256({norm(x)}), 1, 24)"


def kana(x: str) -> str:
    return f"translate({x}, '{HIRAGANA_FROM}', '{HIRAGANA_TO}')"


def kata(x: str) -> str:
    return f"translate({x}, '{KATAKANA_FROM}', '{KATAKANA_TO}')"


def page_number(x: str) -> str:
    return f"regexp_matches(trim({x}), '{X.PAGE_NUMBER}')"


def matter(path: str, title: str) -> str:
    cases = [f"WHEN {path} <> '' AND regexp_matches({path}, {quoted('(?i)' + p)}) THEN '{k}'" for k, p in X.MATTER_PATHS]
    cases += [f"WHEN trim({title}) <> '' AND regexp_matches(trim({title}), {quoted('(?i)' + p)}) THEN '{k}'" for k, p in X.MATTER_TITLES]
    return "CASE " + " ".join(cases) + " ELSE 'main' END"


_paths = ", ".join(quoted(p) for p in PATHS)

#: Blocks of documents; the same arithmetic as foliomill.sources.tables.blocks.
BLOCK = f"""
WITH lines AS (SELECT doc_id, lang, source, string_split(text, chr(10)) AS ls FROM documents),
raw AS (
  SELECT doc_id, lang, source, CAST(generate_subscripts(ls, 1) AS INTEGER) AS ord, unnest(ls) AS text,
         list_position(list_transform(ls, lambda l: trim(l) <> ''), true) AS head
  FROM lines
), typed AS (
  SELECT *, printf('b%06d', ord) AS block_id, [{_paths}][(doc_id % 12) + 1] AS path_hint,
    CASE WHEN trim(text) = '' THEN 'paragraph' WHEN ord = head OR ord % 12 = 1 THEN 'heading' WHEN ord % 17 = 0 THEN 'image'
         WHEN ord % 19 = 0 THEN 'table' ELSE 'paragraph' END AS type
  FROM raw
), block AS (
  SELECT *, CASE WHEN type = 'heading' THEN CASE WHEN ord = head OR ord % 24 = 1 THEN 1 ELSE 2 END END AS level,
    {matter("path_hint", "''")} AS matter,
    CASE WHEN type = 'table' THEN [string_split(text, ' ')[1:2], string_split(text, ' ')[3:4]] END AS rows
  FROM typed
), flagged AS (
  SELECT *, CASE WHEN type = 'table' THEN len(list_filter(flatten(rows), lambda c: trim(c) <> '')) > 0
                 ELSE type IN ('heading', 'paragraph') AND trim(text) <> '' END AS translatable
  FROM block
)
"""

SEGMENT = BLOCK + f""", segment AS (
  SELECT doc_id || ':' || block_id AS seg_id, doc_id, block_id, ord, type, text, lang AS source_lang, {hash24("text")} AS text_hash
  FROM block WHERE type IN ('heading', 'paragraph') AND trim(text) <> ''
)
"""

PAIR = f"""
WITH turns AS (SELECT *, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS answer FROM conversations),
pair AS (
  SELECT conv_id || ':' || turn AS seg_id, conv_id, turn, {kana("text")} AS source,
    coalesce(CASE turn % 8 WHEN 0 THEN {kana("text")} WHEN 1 THEN {kana("answer")} WHEN 2 THEN {kata("answer")}
             WHEN 3 THEN '們這說 ' || answer WHEN 4 THEN substr(answer, 1, 3) ELSE answer END, '') AS target,
    CASE WHEN turn % 3 = 0 THEN 'pending' ELSE 'done' END AS status
  FROM turns
)
"""

PAGE_ROW = """
WITH d AS (SELECT doc_id, source, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, source, generate_subscripts(ls, 1) - 1 AS pos, unnest(ls) AS text FROM d),
body AS (
  SELECT doc_id, CAST(pos // 40 AS INTEGER) AS page, CAST(pos % 40 + 1 AS INTEGER) AS row, text,
    CASE WHEN pos % 5 = 0 THEN 14.0::DOUBLE ELSE 0.0::DOUBLE END AS off, (700.0 - (pos % 40) * 12)::DOUBLE AS y, 60.0::DOUBLE AS x,
    (10.0 + pos % 3)::DOUBLE AS h, source
  FROM l
), page_row AS (
  SELECT * FROM body
  UNION ALL SELECT doc_id, page, 0, 'Head ' || source, 0.0::DOUBLE, 760.0::DOUBLE, 60.0::DOUBLE, 10.0::DOUBLE, source FROM body WHERE row = 1
  UNION ALL SELECT doc_id, page, 99, CAST(page + 1 AS VARCHAR), 0.0::DOUBLE, 42.0::DOUBLE, 300.0::DOUBLE, 10.0::DOUBLE, source FROM body WHERE row = 1
), pages AS (SELECT doc_id, count(DISTINCT page) AS pages FROM page_row GROUP BY doc_id)
"""

JOB = """
WITH job AS (
  SELECT user_id AS job_id, event_id AS seq, ts, event_type AS status, CAST(floor((value - floor(value)) * 10) / 10.0 AS DOUBLE) AS progress, user_id % 17 AS pid FROM events
)
"""
