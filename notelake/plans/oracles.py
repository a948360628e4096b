"""Checking SQL for the query suite (plain SQL over the test tables).

The derived tables are common table expressions; every statement reads the whole
tables.  White space in the derived notes is ASCII, listing order is by bytes and
lambdas are avoided.
"""

from __future__ import annotations

from ..schema import ROLES
from .derived import property_form

# The patterns of links, hashtags and tasks, as the checking engine writes them.
LINK_PATTERN = r"\[\[([^\]|#]+)(?:[|#][^\]]+)?\]\]"
HASHTAG_PATTERN = r"(?m)(?:^|\s)#([\w/-]+)"
TASK_PATTERN = r"(?m)^\s*-\s*\[([ xX])\]\s+(.+)$"

NOTES_CTE = rf"""
raw_notes AS (
  SELECT source AS vault,
         lang || '/' || lpad(cast(doc_id AS varchar), 6, '0') || '.md' AS path,
         concat('---', chr(10), {property_form(0)}, '---', chr(10), text, chr(10), '#', lang, '/', source, ' #q', cast(doc_id % 10 AS varchar), chr(10),
                'See [[', lpad(cast(doc_id + 20 AS varchar), 6, '0'), '|next]] and [[',
                lang, '/', lpad(cast(doc_id AS varchar), 6, '0'), '.md#top]]', chr(10)) AS content
  FROM documents
  UNION ALL
  SELECT k.source, r.rpath,
         CASE WHEN r.idx = 6 THEN concat('- [ ] ', replace(k.text, chr(10), concat(chr(10), '- [x] ')))
              WHEN r.idx IN (4, 10, 11) THEN concat('# Log', chr(10), '## ', replace(k.text, chr(10), concat(chr(10), '## ')))
              ELSE k.text END
  FROM (SELECT source, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS k FROM documents) k
  JOIN roles r ON k.k = r.idx % 10
  WHERE (cast(substring(k.source, 4) AS int) + r.idx) % 5 <> 4
  UNION ALL
  SELECT concat('src', cast(user_id % 20 AS varchar)),
         concat('Daily/', cast(cast(ts AS date) AS varchar), '.md'),
         string_agg(concat('- ', event_type, ' ', cast(event_id AS varchar), chr(10)), '' ORDER BY event_id)
  FROM events GROUP BY 1, 2
),
notes AS (SELECT *, sha256(content) AS content_hash FROM raw_notes)
"""

_ROLE_ROWS = ", ".join(f"({i}, '{role}', '{path}')" for i, (role, path) in enumerate(ROLES))
ROLES_CTE = f"roles(idx, role, rpath) AS (VALUES {_ROLE_ROWS})"

VAULTS_CTE = """
vaults AS (
  SELECT source AS name, concat('/vaults/', source) AS path,
         cast(substring(source, 4) AS int) % 5 = 0 AS read_only,
         CASE WHEN cast(substring(source, 4) AS int) % 2 = 0 THEN 'Daily' ELSE 'Journal/' END AS directory,
         CASE WHEN cast(substring(source, 4) AS int) % 3 = 0 THEN 'YYYY/MM/DD' ELSE 'YYYY-MM-DD' END AS date_format
  FROM (SELECT DISTINCT source FROM documents)
)
"""

COMMANDS_CTE = """
commands AS (
  SELECT event_id AS seq, concat('src', cast(user_id % 20 AS varchar)) AS vault,
         CASE event_type WHEN 'signup' THEN 'create' WHEN 'click' THEN 'append' WHEN 'purchase' THEN 'update'
                         WHEN 'error' THEN 'delete' ELSE 'append_daily' END AS op,
         CASE WHEN event_type = 'view' THEN concat('Daily/', cast(cast(ts AS date) AS varchar), '.md')
              ELSE concat('Log/n', cast(event_id % 25 AS varchar), '.md') END AS path,
         concat(event_type, ' ', cast(event_id AS varchar), chr(10)) AS body,
         event_id % 7 = 0 AS overwrite, event_id % 5 = 0 AS stale,
         cast(ts AS date) AS day
  FROM events
)
"""

# Property blocks stand in the document notes alone, whose names end in the document's id.
PROPERTIES_CTE = rf"""
properties AS (
  SELECT *, CASE WHEN block = '' THEN '{{}}' ELSE
           concat('{{"tags":', tags, ',"status":"', CASE WHEN doc_id % 3 = 0 THEN 'done' ELSE 'open' END, '"', others, '}}') END AS properties
  FROM (SELECT *, {property_form(1)} AS tags, {property_form(2)} AS others
        FROM (SELECT *, vault AS source, split_part(path, '/', 1) AS lang,
                     CASE WHEN block <> '' THEN regexp_extract(path, '(\d+)\.md$', 1)::BIGINT END AS doc_id
              FROM (SELECT *, CASE WHEN starts_with(content, '---' || chr(10))
                                   THEN regexp_extract(content, '^---\n((?s:.*?\n))---\n', 1) ELSE '' END AS block
                    FROM notes)))
)
"""

TAGS_CTE = rf"""
tags AS (
  SELECT vault, path, unnest([lang, source]) AS tag, 'frontmatter' AS origin
  FROM properties WHERE block <> ''
  UNION ALL
  SELECT vault, path, unnest(regexp_extract_all(content, '{HASHTAG_PATTERN}', 1)), 'hashtag'
  FROM notes
)
"""

LINKS_CTE = rf"""
links AS (
  SELECT DISTINCT vault, path AS src, regexp_replace(replace(raw, '\', '/'), '(?i)\.md$', '') AS link
  FROM (SELECT vault, path,
               unnest(regexp_extract_all(content, '{LINK_PATTERN}', 1)) AS raw
        FROM notes)
),
targets AS (SELECT vault, path, regexp_replace(path, '(?i)\.md$', '') AS name FROM notes),
-- names by what follows their last slash: links that match share it
meets AS (
  SELECT DISTINCT t.vault, t.path, l.src, l.link
  FROM links l JOIN targets t
    ON l.vault = t.vault
   AND list_extract(string_split(l.link, '/'), -1) = list_extract(string_split(t.name, '/'), -1)
   AND (l.link = t.name OR ends_with(l.link, '/' || t.name) OR ends_with(t.name, '/' || l.link))
)
"""


def _trim(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


TASKS_CTE = rf"""
task_items AS (
  SELECT vault, path AS source,
         generate_subscripts(marks, 1) - 1 AS spot, unnest(marks) AS mark, unnest(texts) AS item
  FROM (SELECT vault, path,
               regexp_extract_all(content, '{TASK_PATTERN}', 1) AS marks,
               regexp_extract_all(content, '{TASK_PATTERN}', 2) AS texts
        FROM notes WHERE path = '06 - Tasks.md')
),
tasks AS (
  SELECT vault, source, cast(row_number() OVER (PARTITION BY vault ORDER BY spot) - 1 AS int) AS pos,
         lower(mark) = 'x' AS completed, {_trim('item')} AS text
  FROM task_items WHERE {_trim('item')} <> ''
)
"""

SECTIONS_CTE = rf"""
section_items AS (
  SELECT vault, path AS source, generate_subscripts(parts, 1) - 1 AS spot, unnest(parts) AS part
  FROM (SELECT vault, path,
               string_split(regexp_replace(content, '\n(##\s)', chr(1) || '\1', 'g'), chr(1)) AS parts
        FROM notes WHERE path IN ('04 - Decisions.md', '10 - Risks & Issues.md', '11 - Changelog.md'))
),
sections AS (
  SELECT vault, CASE source WHEN '04 - Decisions.md' THEN 'decisions' WHEN '11 - Changelog.md' THEN 'changelog'
                            ELSE 'risks' END AS kind,
         source, cast(row_number() OVER (PARTITION BY vault, source ORDER BY spot) - 1 AS int) AS pos,
         {_trim('part')} AS content
  FROM section_items WHERE {_trim('part')} <> ''
)
"""

DAILY_CTE = """
daily AS (
  SELECT vault, cast(rank AS int) AS rank, path,
         CASE WHEN length(content) > {chars} THEN concat(substring(content, 1, {chars}), chr(10), '[content truncated]')
              ELSE content END AS content,
         length(content) > {chars} AS truncated
  FROM (SELECT *, row_number() OVER (PARTITION BY vault ORDER BY path DESC) AS rank
        FROM notes WHERE starts_with(path, 'Daily/'))
  WHERE rank <= {limit}
)
"""

_BASE = {
    "roles": (ROLES_CTE, ()),
    "notes": (NOTES_CTE, ("roles",)),
    "vaults": (VAULTS_CTE, ()),
    "commands": (COMMANDS_CTE, ()),
    "properties": (PROPERTIES_CTE, ("notes",)),
    "tags": (TAGS_CTE, ("properties",)),
    "links": (LINKS_CTE, ("notes",)),
    "tasks": (TASKS_CTE, ("notes",)),
    "sections": (SECTIONS_CTE, ("notes",)),
}


def sql(body: str, *tables: str, extra: str = "") -> str:
    """``body`` below the named derived tables and any extra ones."""
    ordered: list[str] = []

    def need(name: str) -> None:
        for other in _BASE[name][1]:
            need(other)
        if name not in ordered:
            ordered.append(name)

    for table in tables:
        need(table)
    parts = [_BASE[name][0].strip() for name in ordered] + ([extra.strip()] if extra else [])
    return f"WITH {', '.join(parts)}\n{body.strip()}"


# One judged command stream per key: existence first, then the text since the
# last command that set it.  Expected hashes of the derived commands are stale ones.
REPLAY_CTE = """
accepted AS (
  SELECT c.seq, c.vault, c.path, c.op, c.body, c.overwrite, c.stale FROM commands c JOIN vaults v ON v.name = c.vault
  WHERE NOT v.read_only
),
marked AS (
  SELECT a.*, n.content AS base,
         max(CASE WHEN op IN ('create', 'append_daily') THEN seq * 2 + 1 WHEN op = 'delete' THEN seq * 2 END)
           OVER (PARTITION BY a.vault, a.path ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mark
  FROM accepted a LEFT JOIN notes n ON n.vault = a.vault AND n.path = a.path
),
existed AS (
  SELECT *, CASE WHEN mark IS NULL THEN base IS NOT NULL ELSE mark % 2 = 1 END AS was FROM marked
),
judged AS (
  SELECT *, CASE WHEN op = 'create' AND was AND NOT overwrite THEN 'EXISTS'
                 WHEN op = 'update' AND was AND stale THEN 'HASH_MISMATCH'
                 WHEN op IN ('create', 'append_daily') OR was THEN 'OK' ELSE 'NOT_FOUND' END AS status
  FROM existed
),
placed AS (
  SELECT *, max(CASE WHEN status = 'OK' AND (op IN ('create', 'update') OR (op = 'append_daily' AND NOT was))
                     THEN seq END)
              OVER (PARTITION BY vault, path ORDER BY seq) AS start
  FROM judged
),
texts AS (
  SELECT *, concat(CASE WHEN start IS NULL THEN coalesce(base, '') ELSE '' END,
                   string_agg(CASE WHEN status = 'OK' AND op <> 'delete' THEN body ELSE '' END, '')
                     OVER (PARTITION BY vault, path, start ORDER BY seq)) AS text
  FROM placed
)
"""
