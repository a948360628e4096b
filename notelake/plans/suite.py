"""The query suite: each operator over the derived tables, and its checking SQL.

``SUITE`` maps a name to ``(query, sql)``; ``sql`` is ``None`` where plain SQL
over the test tables cannot say the same.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import frontmatter as fm, paths, text
from ..operators import commands as cmd, corpus, graph, project, properties, registry, tags
from ..operators.checkpoints import checkpoint, scratch
from ..operators.common import numbered
from ..sources.files import scan_notes as read_folders, scan_trash as read_trash
from ..sources.registry_file import load_vaults as read_registry, save_vaults
from ..sources.tables import NoteStore, save_notes as write_snapshot
from ..streaming import streams
from . import derived
from .oracles import DAILY_CTE, LINK_PATTERN, REPLAY_CTE, sql

Query = Callable[[SparkSession, str], DataFrame]
SUITE: dict[str, tuple[Query, str | None]] = {}


def _query(name: str, checking: str | None):
    def register(run: Query) -> Query:
        SUITE[name] = (run, checking)
        return run

    return register


# -- text expressions -----------------------------------------------------------

_query("content_hash", sql("SELECT vault, path, content_hash FROM notes", "notes"))(
    lambda spark, sf: derived.notes(spark, sf).select("vault", "path", "content_hash")
)

_query(
    "relative_path",
    sql("SELECT vault, path AS rel FROM notes", "notes"),
)(
    lambda spark, sf: derived.notes(spark, sf).select(
        "vault",
        paths.relative_path(
            F.concat(F.lit("/vaults/"), "vault"), F.concat(F.lit("/vaults/"), "vault", F.lit("/"), "path")
        ).alias("rel"),
    )
)


@_query(
    "frontmatter",
    sql(
        """SELECT vault, path, tags,
                  CASE WHEN block <> '' THEN CASE WHEN doc_id % 3 = 0 THEN 'done' ELSE 'open' END END AS status,
                  CASE WHEN others LIKE ',"by"%' THEN 'Ann' END AS first_name
           FROM properties""",
        "properties",
    ),
)
def frontmatter(spark, sf):
    """Values read back out of the dynamic properties, a nested one too."""
    rows = derived.notes(spark, sf).select("vault", "path", fm.frontmatter("content").alias("v"))
    return rows.select(
        "vault", "path",
        F.to_json(F.variant_get("v", "$.tags", "variant")).alias("tags"),
        F.variant_get("v", "$.status", "string").alias("status"),
        F.variant_get("v", "$.by[0].name", "string").alias("first_name"),
    )


_query(
    "frontmatter_text",
    sql("SELECT vault, path, properties AS frontmatter_text FROM properties", "properties"),
)(
    lambda spark, sf: derived.notes(spark, sf).select(
        "vault", "path", fm.frontmatter_text("content").alias("frontmatter_text")
    )
)

_query(
    "frontmatter_body",
    sql(
        """SELECT vault, path,
                  sha256(CASE WHEN block = '' THEN content ELSE substring(content, length(block) + 9) END) AS body_hash
           FROM properties""",
        "properties",
    ),
)(
    lambda spark, sf: derived.notes(spark, sf).select(
        "vault", "path", text.content_hash(fm.frontmatter_body("content")).alias("body_hash")
    )
)

_query(
    "flatten_tags",
    sql("SELECT vault, path, tag, count(*) AS n FROM tags WHERE origin = 'frontmatter' GROUP BY ALL", "tags"),
)(
    lambda spark, sf: derived.notes(spark, sf)
    .select("vault", "path", F.explode(fm.frontmatter_tags("content")).alias("tag"))
    .groupBy("vault", "path", "tag")
    .agg(F.count("*").alias("n"))
)

_query(
    "hashtags",
    sql("SELECT vault, path, tag, count(*) AS n FROM tags WHERE origin = 'hashtag' GROUP BY ALL", "tags"),
)(
    lambda spark, sf: derived.notes(spark, sf)
    .select("vault", "path", F.explode(text.hashtags(F.col("content"))).alias("tag"))
    .groupBy("vault", "path", "tag")
    .agg(F.count("*").alias("n"))
)

_query(
    "wikilinks",
    sql(
        rf"""SELECT vault, path, unnest(regexp_extract_all(content, '{LINK_PATTERN}', 1)) AS link
            FROM notes""",
        "notes",
    ),
)(
    lambda spark, sf: derived.notes(spark, sf).select(
        "vault", "path", F.explode(text.wikilinks(F.col("content"))).alias("link")
    )
)

_query("normalize_link", sql("SELECT vault, src, link FROM links", "links"))(
    lambda spark, sf: graph.links(derived.notes(spark, sf))
)

_query("tasks", sql("SELECT vault, source, pos, completed, text FROM tasks", "tasks"))(
    lambda spark, sf: project.note_tasks(derived.notes(spark, sf))
)

_query("sections", sql("SELECT vault, kind, source, pos, content FROM sections", "sections"))(
    lambda spark, sf: project.note_sections(derived.notes(spark, sf))
)

_EXCERPT = r"""
flat AS (SELECT *, regexp_replace(regexp_replace(content, '\s+', ' ', 'g'), '^ | $', '', 'g') AS body FROM notes),
spots AS (SELECT *, instr(lower(body), '{q}') AS i FROM flat),
excerpts AS (
  SELECT *, CASE WHEN i = 0 THEN substring(body, 1, 180)
                 ELSE substring(body, greatest(1, i - 70), i + {n} + 110 - greatest(1, i - 70)) END AS excerpt
  FROM spots
)
"""

_query(
    "excerpt",
    sql(
        "SELECT vault, path, excerpt FROM excerpts", "notes",
        extra=_EXCERPT.format(q="status", n=len("status")),
    ),
)(
    lambda spark, sf: derived.notes(spark, sf).select(
        "vault", "path", text.excerpt(F.col("content"), "status").alias("excerpt")
    )
)

_query(
    "truncate_content",
    sql(
        """SELECT vault, path, length(content) > 200 AS truncated,
                  CASE WHEN length(content) > 200
                       THEN concat(substring(content, 1, 200), chr(10), '[content truncated]') ELSE content END AS content
           FROM notes""",
        "notes",
    ),
)(
    lambda spark, sf: derived.notes(spark, sf)
    .select("vault", "path", text.truncate_content(F.col("content"), 200).alias("t"))
    .select("vault", "path", "t.truncated", "t.content")
)

_DAILY_PATH = """
concat(rtrim(directory, '/'), '/',
       replace(replace(replace(date_format, 'YYYY', lpad(cast(year({day}) AS varchar), 4, '0')),
                       'MM', lpad(cast(month({day}) AS varchar), 2, '0')),
               'DD', lpad(cast(day({day}) AS varchar), 2, '0')), '.md')
"""


@_query(
    "daily_path",
    sql(
        f"""SELECT DISTINCT vault, {_DAILY_PATH.format(day='day')} AS path
            FROM (SELECT concat('src', cast(user_id % 20 AS varchar)) AS vault, cast(ts AS date) AS day FROM events) e
            JOIN vaults ON name = vault""",
        "vaults",
    ),
)
def daily_path(spark, sf):
    return cmd.daily_commands(derived.vaults(spark, sf), _entries(spark, sf)).filter(
        "path IS NOT NULL"
    ).select("vault", "path").distinct()


def _entries(spark, sf):
    return derived.table(spark, sf, "events").select(
        F.col("event_id").alias("seq"),
        derived.event_vault().alias("vault"),
        derived.event_day().alias("day"),
        derived.event_line().alias("body"),
    )


@_query(
    "normalize_vault_name",
    "SELECT DISTINCT trim(replace(name, '#', '/')) AS name, NOT contains(name, '#') AS valid "
    "FROM (SELECT concat('  ', p_name, ' ') AS name FROM part UNION ALL SELECT concat(source, '#', lang) FROM documents)",
)
def normalize_vault_name(spark, sf):
    """Part names padded with blanks, and document groups with a path in the name."""
    part = derived.table(spark, sf, "part")
    documents = derived.table(spark, sf, "documents")
    names = part.select(F.concat(F.lit("  "), "p_name", F.lit(" ")).alias("name")).unionByName(
        documents.select(F.concat("source", F.lit("/"), "lang").alias("name"))
    )
    return registry.normalize_vault_names(names).distinct()


# -- filters, listing, search -----------------------------------------------------


@_query("vaults_in_root", sql("SELECT name, path FROM vaults WHERE name = 'src1'", "vaults"))
def vaults_in_root(spark, sf):
    return registry.vaults_in_root(derived.vaults(spark, sf), "/vaults/src1").select("name", "path")


@_query(
    "load_vaults",
    sql("SELECT name, path, read_only, directory, date_format FROM vaults", "vaults"),
)
def load_vaults(spark, sf):
    """The registry written as JSON and read back inside the root."""
    place = scratch(spark, "vaults")
    save_vaults(derived.vaults(spark, sf), place)
    return read_registry(spark, place, "/vaults", lines=True).select(
        "name", "path", "read_only", "daily_notes.directory", "daily_notes.date_format"
    )


def _with_hidden(spark, sf):
    """The corpus with some folders hidden and some names not Markdown."""
    n = derived.notes(spark, sf)
    return n.withColumn(
        "path",
        F.when(F.startswith("path", F.lit("en/")), F.concat(F.lit(".hidden/"), "path"))
        .when(F.startswith("path", F.lit("fr/")), F.concat(F.lit("a/node_modules/"), "path"))
        .when(F.startswith("path", F.lit("de/")), F.concat(F.lit("."), F.replace("path", F.lit("/"), F.lit("-"))))
        .when(F.startswith("path", F.lit("Daily/")), F.replace("path", F.lit(".md"), F.lit(".txt")))
        .otherwise(F.col("path")),
    )


_HIDDEN = """
renamed AS (
  SELECT vault, CASE WHEN starts_with(path, 'en/') THEN concat('.hidden/', path)
                     WHEN starts_with(path, 'fr/') THEN concat('a/node_modules/', path)
                     WHEN starts_with(path, 'de/') THEN concat('.', replace(path, '/', '-'))
                     WHEN starts_with(path, 'Daily/') THEN replace(path, '.md', '.txt') ELSE path END AS path
  FROM notes
)
"""

_query(
    "visible_notes",
    sql(
        "SELECT vault, path FROM renamed WHERE NOT starts_with(path, '.hidden/') AND NOT starts_with(path, 'a/node_modules/')",
        "notes", extra=_HIDDEN,
    ),
)(lambda spark, sf: corpus.visible_notes(_with_hidden(spark, sf)).select("vault", "path"))

_query(
    "markdown_only",
    sql("SELECT vault, path FROM renamed WHERE lower(path) LIKE '%.md'", "notes", extra=_HIDDEN),
)(lambda spark, sf: corpus.markdown_only(_with_hidden(spark, sf)).select("vault", "path"))

_query(
    "in_directory",
    sql("SELECT vault, path, content_hash FROM notes WHERE path LIKE 'Daily/%'", "notes"),
)(
    lambda spark, sf: corpus.in_directory(derived.notes(spark, sf), "Daily").select(
        "vault", "path", "content_hash"
    )
)


@_query(
    "directory_status",
    sql(
        """SELECT name AS vault, CASE WHEN name IN (SELECT vault FROM notes WHERE path LIKE 'es/%')
                                      THEN 'OK' ELSE 'NOT_FOUND' END AS status FROM vaults""",
        "notes", "vaults",
    ),
)
def directory_status(spark, sf):
    return corpus.directory_status(derived.notes(spark, sf), derived.vaults(spark, sf), "es")


@_query(
    "path_status",
    """SELECT url AS path, k AS kind,
              CASE WHEN k = 'note' AND NOT regexp_matches(url, '(?i)\\.md[/\\\\]*$') THEN 'MARKDOWN_REQUIRED'
                   WHEN regexp_matches(url, '(?i)(^|[/\\\\])node_modules([/\\\\]|$)') THEN 'EXCLUDED_PATH'
                   WHEN k = 'note' AND regexp_matches(url, '(^|[/\\\\])\\.[^/\\\\]*[/\\\\]+[^/\\\\]') THEN 'EXCLUDED_PATH'
                   WHEN k = 'directory' AND regexp_matches(url, '(^|[/\\\\])\\.') THEN 'EXCLUDED_PATH'
                   ELSE 'OK' END AS status
       FROM (SELECT url AS raw, CASE page_id % 6 WHEN 0 THEN concat('/', url) WHEN 1 THEN concat('../', url)
                    WHEN 2 THEN concat('.x/', url, '.md') WHEN 3 THEN concat(url, '.md')
                    WHEN 4 THEN concat('Node_Modules/', url, '.md') ELSE url END AS url FROM pages) p,
            (VALUES ('note'), ('directory')) kinds(k)
       WHERE NOT starts_with(url, '/') AND NOT starts_with(url, '../')
       UNION ALL
       SELECT NULL, k, 'TRAVERSAL' FROM pages, (VALUES ('note'), ('directory')) kinds(k)
       UNION ALL
       SELECT concat('/', url), k, 'ABSOLUTE_PATH' FROM pages, (VALUES ('note'), ('directory')) kinds(k) WHERE page_id % 6 = 0
       UNION ALL
       SELECT concat('../', url), k, 'TRAVERSAL' FROM pages, (VALUES ('note'), ('directory')) kinds(k) WHERE page_id % 6 = 1""",
)
def path_status(spark, sf):
    """Page addresses made into good and bad paths of every kind."""
    url, way = F.col("url"), F.col("page_id") % 6
    path = (
        F.when(way == 0, F.concat(F.lit("/"), url))
        .when(way == 1, F.concat(F.lit("../"), url))
        .when(way == 2, F.concat(F.lit(".x/"), url, F.lit(".md")))
        .when(way == 3, F.concat(url, F.lit(".md")))
        .when(way == 4, F.concat(F.lit("Node_Modules/"), url, F.lit(".md")))
        .otherwise(url)
    )
    pages = derived.table(spark, sf, "pages")
    kinds = F.explode(F.array(F.lit("note"), F.lit("directory")))
    named = pages.select(path.alias("path"), kinds.alias("kind"))
    return corpus.path_status(named.unionByName(named.withColumn("path", F.lit(None).cast("string"))))


_QUERY_TEXT = "The"


def _matches(q: str) -> str:
    return f"""
hits AS (
  SELECT vault, path, content, contains(lower(path), '{q}') AS f, contains(lower(content), '{q}') AS c,
         contains(lower(properties), '{q}') AS p
  FROM properties
),
matched AS (SELECT * FROM hits WHERE f OR c OR p)
"""


_query(
    "match_notes",
    sql("SELECT vault, path FROM matched", "properties", extra=_matches("open")),
)(
    lambda spark, sf: corpus.match_notes(derived.notes(spark, sf), " OPEN ").select("vault", "path")
)

_query(
    "match_kinds",
    sql(
        """SELECT vault, path, concat_ws(',', CASE WHEN f THEN 'filename' END, CASE WHEN c THEN 'content' END,
                                         CASE WHEN p THEN 'frontmatter' END) AS kinds FROM hits""",
        "properties", extra=_matches("daily"),
    ),
)(
    lambda spark, sf: derived.notes(spark, sf).select(
        "vault", "path", F.concat_ws(",", corpus.match_kinds("daily")).alias("kinds")
    )
)

_query(
    "search_notes",
    sql(
        """SELECT vault, cast(rank AS int) AS rank, path, excerpt, kinds FROM (
             SELECT e.vault, e.path, e.excerpt,
                    concat_ws(',', CASE WHEN f THEN 'filename' END, CASE WHEN c THEN 'content' END,
                              CASE WHEN p THEN 'frontmatter' END) AS kinds,
                    row_number() OVER (PARTITION BY e.vault ORDER BY e.path) AS rank
             FROM matched m JOIN excerpts e ON e.vault = m.vault AND e.path = m.path)
           WHERE rank <= 20""",
        "properties",
        extra=_matches("the").strip() + "," + _EXCERPT.format(q="the", n=3),
    ),
)(
    lambda spark, sf: corpus.search_notes(derived.notes(spark, sf), _QUERY_TEXT, collation=None).select(
        "vault", "rank", "path", "excerpt", F.concat_ws(",", "matches").alias("kinds")
    )
)

_query(
    "list_notes",
    sql(
        "SELECT vault, path, content_hash, row_number() OVER (ORDER BY vault, path) - 1 AS pos FROM notes", "notes"
    ),
)(lambda spark, sf: numbered(corpus.list_notes(derived.notes(spark, sf), collation=None), "pos"))

_query(
    "list_directory",
    sql(
        """SELECT DISTINCT vault, split_part(path, '/', 1) AS path,
                  CASE WHEN contains(path, '/') THEN 'directory' ELSE 'file' END AS type FROM notes""",
        "notes",
    ),
)(lambda spark, sf: corpus.list_directory(derived.notes(spark, sf)))


@_query(
    "read_notes",
    sql(
        """SELECT seq, r.vault AS vault, path,
                  CASE WHEN status = 'OK' THEN content_hash END AS content_hash, status
           FROM (SELECT c.seq, c.vault, c.path, n.content_hash,
                        CASE WHEN v.name IS NULL THEN 'NOT_REGISTERED' WHEN n.path IS NULL THEN 'NOT_FOUND' ELSE 'OK' END AS status
                 FROM commands c LEFT JOIN vaults v ON v.name = c.vault
                 LEFT JOIN notes n ON n.vault = c.vault AND n.path = c.path) r""",
        "notes", "vaults", "commands",
    ),
)
def read_notes(spark, sf):
    requests = derived.commands(spark, sf).select("seq", "vault", "path")
    return corpus.read_notes(derived.notes(spark, sf), derived.vaults(spark, sf), requests).select(
        "seq", "vault", "path", "content_hash", "status"
    )


# -- registry ------------------------------------------------------------------------


def _asked_names(spark, sf):
    """Vault names that users ask for: some registered, some not."""
    events = derived.table(spark, sf, "events")
    return events.select(F.concat(F.lit("src"), (F.col("user_id") % 30).cast("string")).alias("name")).distinct()


_ASKED = "asked AS (SELECT DISTINCT concat('src', cast(user_id % 30 AS varchar)) AS name FROM events)"


@_query(
    "get_vaults",
    sql(
        """SELECT a.name AS name, v.path AS path, v.read_only AS read_only,
                  CASE WHEN v.name IS NULL THEN 'NOT_REGISTERED' ELSE 'OK' END AS status
           FROM asked a LEFT JOIN vaults v ON v.name = a.name""",
        "vaults", extra=_ASKED,
    ),
)
def get_vaults(spark, sf):
    found = registry.get_vaults(derived.vaults(spark, sf), _asked_names(spark, sf))
    return found.select("name", "path", "read_only", "status")


@_query(
    "register_vaults",
    sql(
        """SELECT name, path, read_only, directory, date_format FROM vaults
           UNION ALL
           SELECT name, concat('/vaults/', name), false, 'Daily', 'YYYY-MM-DD'
           FROM asked WHERE name NOT IN (SELECT name FROM vaults)""",
        "vaults", extra=_ASKED,
    ),
)
def register_vaults(spark, sf):
    events = derived.table(spark, sf, "events")
    new = events.select(
        F.col("event_id").alias("seq"),
        F.concat(F.lit(" src"), (F.col("user_id") % 30).cast("string"), F.lit(" ")).alias("name"),
        F.lit(None).cast("string").alias("path"),
        F.lit(None).cast("boolean").alias("read_only"),
        F.lit(" ").alias("directory"),
        F.lit(None).cast("string").alias("date_format"),
    )
    after, _ = registry.register_vaults(derived.vaults(spark, sf), new, root="/vaults")
    return after.select(
        "name", "path", "read_only", "daily_notes.directory", "daily_notes.date_format"
    )


@_query(
    "unregister_vaults",
    sql(
        """SELECT name, 'kept' AS status FROM vaults WHERE name NOT IN (SELECT name FROM asked)
           UNION ALL
           SELECT name, CASE WHEN name IN (SELECT name FROM vaults) THEN 'OK' ELSE 'NOT_REGISTERED' END FROM asked""",
        "vaults", extra=_ASKED.replace("user_id % 30", "user_id % 30 + 10"),
    ),
)
def unregister_vaults(spark, sf):
    events = derived.table(spark, sf, "events")
    names = events.select(
        F.concat(F.lit("src"), (F.col("user_id") % 30 + 10).cast("string")).alias("name")
    ).distinct()
    after, results = registry.unregister_vaults(derived.vaults(spark, sf), names)
    return after.select("name", F.lit("kept").alias("status")).unionByName(results)


# -- tags and links --------------------------------------------------------------------

_query("tag_counts", sql("SELECT vault, tag, count(*) AS count FROM tags GROUP BY vault, tag", "tags"))(
    lambda spark, sf: tags.tag_counts(derived.notes(spark, sf))
)
_query(
    "list_tags",
    sql(
        """SELECT vault, tag, count(*) AS count, row_number() OVER (ORDER BY vault, tag) - 1 AS pos
           FROM tags GROUP BY vault, tag""",
        "tags",
    ),
)(lambda spark, sf: numbered(tags.list_tags(derived.notes(spark, sf), collation=None), "pos"))
_query("note_tags", sql("SELECT vault, path, tag, origin FROM tags", "tags"))(
    lambda spark, sf: tags.note_tags(derived.notes(spark, sf))
)
_query(
    "backlinks_of",
    sql(
        r"""SELECT DISTINCT vault, src AS path FROM links
            WHERE link = 'en/000100' OR ends_with(link, '/en/000100') OR ends_with('en/000100', '/' || link)""",
        "links",
    ),
)(lambda spark, sf: graph.backlinks_of(derived.notes(spark, sf), "en\\000100.md"))
_query("backlinks", sql("SELECT DISTINCT vault, path, src FROM meets", "links"))(
    lambda spark, sf: graph.backlinks(derived.notes(spark, sf))
)
_query("link_targets", sql("SELECT DISTINCT vault, link, path FROM meets", "links"))(
    lambda spark, sf: graph.link_targets(derived.notes(spark, sf))
)
_query(
    "backlink_counts",
    sql("SELECT vault, count(DISTINCT (path, src)) AS n FROM meets GROUP BY vault", "links"),
)(lambda spark, sf: graph.backlink_counts(derived.notes(spark, sf)))
_query(
    "dangling_links",
    sql(
        """SELECT l.vault AS vault, l.src AS src, l.link AS link
           FROM links l LEFT JOIN meets m ON m.vault = l.vault AND m.src = l.src AND m.link = l.link
           WHERE m.src IS NULL""",
        "links",
    ),
)(lambda spark, sf: graph.dangling_links(derived.notes(spark, sf)))


# -- project views -----------------------------------------------------------------------

_CONTEXT = """
placed AS (
  SELECT v.name AS vault, r.idx, r.role, r.rpath AS path, n.path IS NOT NULL AS "exists", n.content, n.content_hash,
         coalesce(sum(length(n.content)) OVER (PARTITION BY v.name ORDER BY r.idx
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used
  FROM vaults v CROSS JOIN roles r LEFT JOIN notes n ON n.vault = v.name AND n.path = r.rpath
),
context AS (
  SELECT vault, idx, role, path, "exists", content_hash, length(content) > greatest(0, 5000 - used) AS truncated,
         CASE WHEN length(content) > greatest(0, 5000 - used)
              THEN concat(substring(content, 1, cast(greatest(0, 5000 - used) AS bigint)), chr(10), '[content truncated]')
              ELSE content END AS content
  FROM placed
)
"""

_query(
    "project_context",
    sql(
        'SELECT vault, idx, role, path, "exists", content, content_hash, truncated FROM context',
        "notes", "vaults", extra=_CONTEXT,
    ),
)(
    lambda spark, sf: project.project_context(
        derived.notes(spark, sf), derived.vaults(spark, sf), 5000
    )
)


@_query(
    "context_budget",
    sql(
        'SELECT vault, idx, role, path, "exists", content, content_hash, truncated FROM context WHERE "exists"',
        "notes", "vaults", extra=_CONTEXT,
    ),
)
def context_budget(spark, sf):
    notes = derived.notes(spark, sf)
    role = F.filter(project.roles(), lambda r: r["path"] == F.col("path")).getItem(0)
    placed = project.role_notes(notes).select(
        "vault", role["idx"].alias("idx"), role["role"].alias("role"), "path", "content", "content_hash"
    )
    return project.context_budget(placed, 5000)


@_query(
    "missing_notes",
    sql(
        'SELECT vault, path AS missing, cast(row_number() OVER (PARTITION BY vault ORDER BY idx) - 1 AS int) AS pos '
        'FROM context WHERE NOT "exists"',
        "notes", "vaults", extra=_CONTEXT,
    ),
)
def missing_notes(spark, sf):
    return project.missing_notes(derived.notes(spark, sf), derived.vaults(spark, sf)).select(
        "vault", F.posexplode("missing").alias("pos", "missing")
    )


_query(
    "recent_daily_notes",
    sql(
        "SELECT vault, rank, path, content, truncated FROM daily", "notes",
        extra=DAILY_CTE.format(chars=100, limit=10),
    ),
)(
    lambda spark, sf: project.recent_daily_notes(
        derived.notes(spark, sf), max_chars=100, collation=None
    )
)

_query(
    "project_activity",
    sql(
        """SELECT vault, 'tasks' AS kind, source, pos, completed, text AS content FROM tasks
           UNION ALL SELECT vault, kind, source, pos, NULL, content FROM sections
           UNION ALL SELECT vault, 'dailyNotes', path, rank - 1, NULL, content FROM daily""",
        "tasks", "sections", extra=DAILY_CTE.format(chars=20000, limit=10),
    ),
)(lambda spark, sf: project.project_activity(derived.notes(spark, sf), collation=None))


_LISTS = ("tasks", "decisions", "risks", "changelog", "dailyNotes")


@_query(
    "project_activity_nested",
    sql(
        """SELECT vault, 'tasks' AS list, pos, source, text AS content, completed FROM tasks
           UNION ALL SELECT vault, kind, pos, source, content, NULL FROM sections
           UNION ALL SELECT vault, 'dailyNotes', rank - 1, path, content, NULL FROM daily
           UNION ALL
           SELECT v.name, l.list, -1, NULL, NULL, NULL
           FROM vaults v CROSS JOIN (VALUES ('tasks'), ('decisions'), ('risks'), ('changelog'), ('dailyNotes')) l(list)
           WHERE NOT EXISTS (SELECT 1 FROM (SELECT vault, 'tasks' AS list FROM tasks UNION ALL SELECT vault, kind FROM sections
                                            UNION ALL SELECT vault, 'dailyNotes' FROM daily) h
                             WHERE h.vault = v.name AND h.list = l.list)""",
        "tasks", "sections", "vaults", extra=DAILY_CTE.format(chars=20000, limit=10),
    ),
)
def project_activity_nested(spark, sf):
    """The five lists of every vault, entry by entry; an empty list is one row at -1."""
    nested = project.project_activity_nested(
        project.project_activity(derived.notes(spark, sf), collation=None), derived.vaults(spark, sf)
    )

    def entries(name):
        task = name == "tasks"
        return F.transform(
            name,
            lambda e: F.struct(
                e["source"].alias("source"),
                e["text" if task else "content"].alias("content"),
                (e["completed"] if task else F.lit(None).cast("boolean")).alias("completed"),
            ),
        )

    lists = F.explode(F.array(*[F.struct(F.lit(n).alias("list"), entries(n).alias("entries")) for n in _LISTS]))
    rows = nested.select("vault", lists.alias("l")).select("vault", "l.list", F.posexplode_outer("l.entries").alias("pos", "e"))
    return rows.select(
        "vault", "list", F.coalesce("pos", F.lit(-1)).alias("pos"), "e.source", "e.content", "e.completed"
    )


_query(
    "vault_counts",
    sql(
        f"""SELECT vault, count(*) AS notes, count(*) FILTER (WHERE path LIKE 'Daily/%') AS daily_notes,
                  coalesce((SELECT count(*) FROM tasks t WHERE t.vault = n.vault), 0) AS tasks,
                  (SELECT count(*) FROM tags t WHERE t.vault = n.vault) AS tag_occurrences,
                  cast(sum(len(regexp_extract_all(content, '{LINK_PATTERN}', 1))) AS bigint) AS link_occurrences
           FROM notes n GROUP BY vault""",
        "tags", "tasks",
    ),
)(lambda spark, sf: project.vault_counts(derived.notes(spark, sf)))


_query(
    "vault_summary",
    sql(
        """SELECT vault, 'tags' AS measure, count(DISTINCT tag) AS n FROM tags GROUP BY vault
           UNION ALL
           SELECT vault, 'backlinks', count(DISTINCT (path, src)) FROM meets GROUP BY vault
           UNION ALL
           SELECT vault, 'directory_entries', count(DISTINCT split_part(path, '/', 1)) FROM notes GROUP BY vault""",
        "tags", "links",
    ),
)(lambda spark, sf: project.vault_summary(derived.notes(spark, sf)))


# -- change commands -----------------------------------------------------------------------


def _tables(spark, sf):
    return derived.notes(spark, sf), derived.vaults(spark, sf), derived.commands(spark, sf)


@_query(
    "writable_commands",
    sql(
        """SELECT c.seq AS seq, c.vault AS vault, c.path AS path,
                  CASE WHEN v.name IS NULL THEN 'NOT_REGISTERED' WHEN v.read_only THEN 'READ_ONLY' ELSE 'OK' END AS status
           FROM commands c LEFT JOIN vaults v ON v.name = c.vault""",
        "commands", "vaults",
    ),
)
def writable_commands(spark, sf):
    _, vaults, commands = _tables(spark, sf)
    return cmd.writable_commands(commands, vaults).select("seq", "vault", "path", "status")


_RESULT = """
SELECT seq, vault, path, status,
       CASE WHEN status = 'OK' AND op <> 'delete' THEN sha256(text) END AS content_hash
FROM texts
UNION ALL
SELECT c.seq, c.vault, c.path, CASE WHEN v.name IS NULL THEN 'NOT_REGISTERED' ELSE 'READ_ONLY' END, NULL
FROM commands c LEFT JOIN vaults v ON v.name = c.vault WHERE v.name IS NULL OR v.read_only
"""


@_query("apply_commands", sql(_RESULT, "notes", "vaults", "commands", extra=REPLAY_CTE))
def apply_commands(spark, sf):
    """Result of every command; deletes report the note they removed."""
    notes, vaults, commands = _tables(spark, sf)
    applied = cmd.apply_commands(notes, None, vaults, commands)
    asked = commands.select("seq", F.col("path").alias("asked"))
    return (
        applied.results.join(asked, "seq")
        .select("seq", "vault", F.col("asked").alias("path"), "status", "content_hash")
    )


_HOT_SQL = (
    sql(_RESULT, "notes", "vaults", "commands", extra=REPLAY_CTE)
    .replace("event_id AS seq, concat('src', cast(user_id % 20 AS varchar)) AS vault", "event_id * 1000003 AS seq, 'src1' AS vault")
    .replace("CASE WHEN event_type = 'view' THEN concat('Daily/', cast(cast(ts AS date) AS varchar), '.md')\n              ELSE concat('Log/n', cast(event_id % 25 AS varchar), '.md') END AS path",
             "concat('Log/n', cast(event_id % 3 AS varchar), '.md') AS path")
)


@_query("apply_commands_hot", _HOT_SQL)
def apply_commands_hot(spark, sf):
    """All commands on three notes of one vault, with numbers far apart."""
    notes, vaults, commands = _tables(spark, sf)
    hot = commands.withColumns(
        {
            "path": F.concat(F.lit("Log/n"), (F.col("seq") % 3).cast("string"), F.lit(".md")),
            "vault": F.lit("src1"),
            "seq": F.col("seq") * 1000003,
        }
    )
    return _results_of(cmd.apply_commands(notes, None, vaults, hot), hot)


_FINAL = """
, last AS (
  SELECT vault, path, arg_max(text, seq) AS text, arg_max(op, seq) AS op FROM texts WHERE status = 'OK' GROUP BY vault, path
)
SELECT n.vault AS vault, n.path AS path, n.content_hash AS content_hash
FROM notes n LEFT JOIN last l ON l.vault = n.vault AND l.path = n.path WHERE l.path IS NULL
UNION ALL
SELECT vault, path, sha256(text) FROM last WHERE op <> 'delete'
"""


@_query("next_notes", sql(_FINAL, "notes", "vaults", "commands", extra=REPLAY_CTE))
def next_notes(spark, sf):
    notes, vaults, commands = _tables(spark, sf)
    return cmd.apply_commands(notes, None, vaults, commands).notes.select(
        "vault", "path", "content_hash"
    )


_TRASH = """
SELECT vault, path AS deleted_from, sha256(text) AS content_hash,
       row_number() OVER (PARTITION BY vault, regexp_extract(path, '[^/]+$') ORDER BY seq) = 1 AS keeps_name
FROM texts WHERE op = 'delete' AND status = 'OK'
"""


@_query("trash", sql(_TRASH, "notes", "vaults", "commands", extra=REPLAY_CTE))
def trash(spark, sf):
    notes, vaults, commands = _tables(spark, sf)
    binned = cmd.apply_commands(notes, None, vaults, commands).trashed
    return binned.select(
        "vault", "deleted_from", "content_hash",
        (F.col("path") == F.concat(F.lit(".trash/"), paths.base_name(F.col("deleted_from")))).alias("keeps_name"),
    )


def _only_sql(op: str, final: str = _RESULT) -> str:
    """The replay with every derived command turned into one operation."""
    replay = REPLAY_CTE.replace("c.op,", f"'{op}' AS op,")
    return sql(final, "notes", "vaults", "commands", extra=replay)


def _results_of(applied, commands):
    asked = commands.select("seq", F.col("path").alias("asked"))
    return applied.results.join(asked, "seq").select(
        "seq", "vault", F.col("asked").alias("path"), "status", "content_hash"
    )


@_query("create_notes", _only_sql("create"))
def create_notes(spark, sf):
    notes, vaults, commands = _tables(spark, sf)
    return _results_of(cmd.create_notes(notes, vaults, commands), commands)


@_query("update_notes", _only_sql("update"))
def update_notes(spark, sf):
    notes, vaults, commands = _tables(spark, sf)
    return _results_of(cmd.update_notes(notes, vaults, commands), commands)


@_query("append_notes", _only_sql("append"))
def append_notes(spark, sf):
    notes, vaults, commands = _tables(spark, sf)
    return _results_of(cmd.append_notes(notes, vaults, commands), commands)


@_query("delete_notes", _only_sql("delete"))
def delete_notes(spark, sf):
    notes, vaults, commands = _tables(spark, sf)
    return _results_of(cmd.delete_notes(notes, None, vaults, commands), commands)


_DAILY_ENTRIES = f"""
placed AS (
  SELECT e.event_id AS seq, v.name AS vault, v.read_only, {_DAILY_PATH.format(day='cast(e.ts AS date)')} AS path,
         concat('- ', e.event_type, ' ', cast(e.event_id AS varchar), chr(10)) AS body
  FROM events e JOIN vaults v ON v.name = concat('src', cast(e.user_id % 20 AS varchar))
),
grown AS (
  SELECT p.vault AS vault, p.path AS path,
         concat(coalesce(any_value(n.content), ''), string_agg(p.body, '' ORDER BY p.seq)) AS content
  FROM placed p LEFT JOIN notes n ON n.vault = p.vault AND n.path = p.path
  WHERE NOT p.read_only GROUP BY p.vault, p.path
)
"""


@_query(
    "append_daily_notes",
    sql("SELECT vault, path, sha256(content) AS content_hash FROM grown", "notes", "vaults", extra=_DAILY_ENTRIES),
)
def append_daily_notes(spark, sf):
    notes, vaults, _ = _tables(spark, sf)
    changed = cmd.append_daily_notes(notes, vaults, _entries(spark, sf)).changes
    return changed.select("vault", "path", "content_hash")


@_query(
    "daily_notes_from_events",
    sql(
        "SELECT vault, path, string_agg(body, '' ORDER BY seq) AS content FROM placed GROUP BY vault, path",
        "notes", "vaults", extra=_DAILY_ENTRIES,
    ),
)
def daily_notes_from_events(spark, sf):
    built = cmd.daily_notes_from_events(_entries(spark, sf), derived.vaults(spark, sf))
    return built.select("vault", "path", "content")


@_query(
    "first_writer_wins",
    sql(
        """SELECT seq, vault, path,
                  CASE WHEN now IS NULL THEN 'NOT_FOUND'
                       WHEN free OR seq = min(CASE WHEN free OR expected = now THEN seq END) OVER (PARTITION BY vault, path)
                       THEN 'OK' ELSE 'HASH_MISMATCH' END AS status
           FROM (SELECT r.*, n.content_hash AS now, coalesce(expected, '') = '' AS free
                 FROM racing r LEFT JOIN notes n ON n.vault = r.vault AND n.path = r.path)""",
        "notes", "commands",
        extra="""racing AS (
                   SELECT c.seq, c.vault, concat('Daily/', CASE WHEN c.seq % 11 = 0 THEN 'no-' ELSE '' END, cast(c.day AS varchar), '.md') AS path,
                          CASE WHEN c.seq % 7 = 0 THEN 'stale' WHEN c.seq % 13 = 0 THEN ' ' WHEN c.seq % 17 = 0 THEN NULL
                               ELSE m.content_hash END AS expected
                   FROM commands c JOIN notes m ON m.vault = c.vault AND m.path = concat('Daily/', cast(c.day AS varchar), '.md'))""",
    ),
)
def first_writer_wins(spark, sf):
    """All of a day's events race to replace that day's note, some without a hash, some at a missing note."""
    notes, _, _ = _tables(spark, sf)
    day, seq = derived.event_day().cast("string"), F.col("seq")
    racers = derived.table(spark, sf, "events").select(
        F.col("event_id").alias("seq"),
        derived.event_vault().alias("vault"),
        F.concat(F.lit("Daily/"), day, F.lit(".md")).alias("path"),
        F.concat(F.lit("Daily/no-"), day, F.lit(".md")).alias("missing"),
    )
    seen = notes.select("vault", "path", "content_hash")
    updates = racers.join(seen, ["vault", "path"]).select(
        "seq",
        "vault",
        F.when(seq % 11 == 0, F.col("missing")).otherwise(F.col("path")).alias("path"),
        F.when(seq % 7 == 0, "stale")
        .when(seq % 13 == 0, " ")
        .when(seq % 17 == 0, F.lit(None).cast("string"))
        .otherwise(F.col("content_hash"))
        .alias("expected_hash"),
    )
    return cmd.first_writer_wins(notes, updates)


@_query(
    "move_notes",
    sql(
        """SELECT n.vault AS vault,
                  CASE WHEN moves THEN concat('Archive/', n.path) ELSE n.path END AS path, n.content_hash AS content_hash
           FROM (SELECT n.*, coalesce(NOT read_only, false) AS moves
                 FROM notes n LEFT JOIN vaults v ON v.name = n.vault) n""",
        "notes", "vaults",
    ),
)
def move_notes(spark, sf):
    """Every note is moved to an archive folder."""
    notes, vaults, _ = _tables(spark, sf)
    moves = notes.select("vault", "path", F.concat(F.lit("Archive/"), "path").alias("dest"))
    moves = numbered(moves, "seq")
    return cmd.move_notes(notes, vaults, moves).notes.select("vault", "path", "content_hash")


_CHAINS = """
ranked AS (
  SELECT n.*, coalesce(NOT read_only, false) AS writable, row_number() OVER (PARTITION BY n.vault ORDER BY n.path) - 1 AS k
  FROM notes n LEFT JOIN vaults v ON v.name = n.vault
),
fours AS (
  SELECT *, k % 4 AS place, count(*) OVER (PARTITION BY vault, k // 4) = 4 AS whole,
         lead(content_hash) OVER (PARTITION BY vault ORDER BY path) AS following
  FROM ranked
)
"""


def _chain_moves(notes: DataFrame) -> DataFrame:
    """Six moves in each four notes of a vault that follow each other: a chain over names that get free,
    one onto a taken name, one that replaces another note."""
    order = Window.partitionBy("vault").orderBy("path")
    ranked = notes.select("vault", "path", (F.row_number().over(order) - 1).alias("k"))
    names = F.array_sort(F.collect_list("path")).alias("n")
    fours = numbered(ranked.groupBy("vault", F.floor(F.col("k") / 4).alias("g")).agg(names).filter(F.size("n") == 4), "four")
    aside = F.concat(F.lit("Aside/"), F.col("g").cast("string"), F.lit(".md"))
    n = [F.get("n", F.lit(i)) for i in range(4)]
    steps = [(n[0], aside, False), (n[1], n[0], False), (n[2], n[0], False), (n[2], n[1], False), (n[3], aside, True), (aside, n[3], False)]
    moves = F.array(
        *[F.struct(F.lit(i).alias("i"), a.alias("path"), b.alias("dest"), F.lit(o).alias("overwrite")) for i, (a, b, o) in enumerate(steps)]
    )
    return fours.select("vault", "four", F.inline(moves)).select(
        "vault", (F.col("four") * 6 + F.col("i")).alias("seq"), "path", "dest", "overwrite"
    )


@_query(
    "move_chains",
    sql(
        """SELECT vault, path, CASE WHEN writable AND whole AND place < 2 THEN following ELSE content_hash END AS content_hash
           FROM fours WHERE NOT (writable AND whole AND place = 2)""",
        "notes", "vaults", extra=_CHAINS,
    ),
)
def move_chains(spark, sf):
    """What chains of moves, some refused and some replacing, leave behind."""
    notes, vaults, _ = _tables(spark, sf)
    return cmd.move_notes(notes, vaults, _chain_moves(notes)).notes.select("vault", "path", "content_hash")


@_query(
    "move_chain_results",
    sql(
        """SELECT vault, status, path, content_hash, count(*) AS n FROM (
             SELECT f.vault AS vault, CASE WHEN NOT writable THEN 'READ_ONLY' WHEN i = 2 THEN 'EXISTS' ELSE 'OK' END AS status,
                    CASE WHEN NOT writable THEN [n[1], n[2], n[3], n[3], n[4], aside][i + 1]
                         ELSE [aside, n[1], n[3], n[2], aside, n[4]][i + 1] END AS path,
                    CASE WHEN writable AND i <> 2 THEN [h[1], h[2], NULL, h[3], h[4], h[4]][i + 1] END AS content_hash
             FROM (SELECT vault, any_value(writable) AS writable, list(path ORDER BY path) AS n, list(content_hash ORDER BY path) AS h,
                          concat('Aside/', cast(k // 4 AS varchar), '.md') AS aside
                   FROM fours WHERE whole GROUP BY vault, k // 4) f, range(0, 6) r(i)) GROUP BY ALL""",
        "notes", "vaults", extra=_CHAINS,
    ),
)
def move_chain_results(spark, sf):
    """The status of each of those moves, and the hash of what it moved."""
    notes, vaults, _ = _tables(spark, sf)
    results = cmd.move_notes(notes, vaults, _chain_moves(notes)).results
    return results.groupBy("vault", "status", "path", "content_hash").agg(F.count("*").alias("n"))


@_query(
    "update_frontmatter",
    sql(
        r"""SELECT p.vault AS vault, p.path AS path,
                   concat('{', CASE WHEN block <> '' THEN concat('"tags":', tags, ',') ELSE '' END,
                          '"status":"seen"', others, ',"events":', cast(e.n AS varchar), ',"last":"', e.last, '"}') AS properties,
                   sha256(CASE WHEN block = '' THEN content ELSE substring(content, length(block) + 9) END) AS body_hash
            FROM properties p
            JOIN (SELECT concat('src', cast(user_id % 20 AS varchar)) AS vault, count(*) AS n,
                         arg_max(event_type, event_id) AS last FROM events GROUP BY 1) e ON e.vault = p.vault
            JOIN vaults v ON v.name = p.vault AND NOT v.read_only""",
        "properties", "vaults",
    ),
)
def update_frontmatter(spark, sf):
    """Every note gets its vault's event count and last event type."""
    notes, vaults, _ = _tables(spark, sf)
    seen = (
        derived.table(spark, sf, "events")
        .groupBy(derived.event_vault().alias("vault"))
        .agg(F.count("*").alias("n"), F.max_by("event_type", "event_id").alias("last"))
    )

    def pair(k, v):
        return F.struct(F.lit(k).alias("k"), v.alias("v"))

    updates = notes.select("vault", "path").join(seen, "vault").select(
        "vault",
        "path",
        F.array(
            pair("status", F.lit('"seen"')),
            pair("events", F.col("n").cast("string")),
            pair("last", fm.json_string(F.col("last"))),
        ).alias("properties"),
    )
    updates = numbered(updates, "seq")
    changed = properties.update_frontmatter(notes, vaults, updates).changes
    content = F.col("content")
    return changed.select(
        "vault",
        "path",
        fm.frontmatter_text("content").alias("properties"),
        text.content_hash(fm.frontmatter_body("content")).alias("body_hash"),
    )


# -- stored tables and streams ---------------------------------------------------------------


@_query("save_notes", sql("SELECT vault, path, content_hash FROM notes", "notes"))
def save_notes(spark, sf):
    """The corpus written as a snapshot and read back."""
    place = scratch(spark, "snapshot")
    write_snapshot(derived.notes(spark, sf), place)
    return NoteStore(spark, place).notes().select("vault", "path", "content_hash")


def _as_files(notes: DataFrame, place: str) -> DataFrame:
    """Write notes as files below ``place``, which all tasks must reach; gives the vaults."""
    folder = place.removeprefix("file://").removeprefix("file:")

    def put(batches):
        for batch in batches:
            for vault, path, content in zip(batch["vault"], batch["path"], batch["content"], strict=True):
                target = os.path.join(folder, vault, path)
                os.makedirs(os.path.dirname(target), exist_ok=True)
                with open(target, "w", encoding="utf-8", newline="") as f:
                    f.write(content)
            yield batch[["vault"]].drop_duplicates()

    written = notes.select("vault", "path", "content").mapInPandas(put, "vault string")
    names = checkpoint(written.distinct())
    return names.select(F.col("vault").alias("name"), F.concat(F.lit(f"{folder}/"), "vault").alias("path"))


@_query("scan_notes", sql("SELECT vault, path, content_hash FROM notes", "notes"))
def scan_notes(spark, sf):
    """The corpus written as files and read back from the folders."""
    vaults = _as_files(derived.notes(spark, sf), scratch(spark, "folders"))
    return read_folders(spark, vaults).select("vault", "path", "content_hash")


@_query(
    "scan_trash",
    sql("SELECT vault, concat('.trash/', replace(path, '/', '_')) AS path, content_hash FROM notes", "notes"),
)
def scan_trash(spark, sf):
    """The corpus written into the trash folders and read back."""
    notes = derived.notes(spark, sf)
    binned = notes.withColumn("path", F.concat(F.lit(".trash/"), F.replace("path", F.lit("/"), F.lit("_"))))
    vaults = _as_files(binned, scratch(spark, "folders"))
    return read_trash(spark, vaults).select("vault", "path", "content_hash")


def _run_stream(writer, place: str) -> None:
    """Take in all there is, then stop."""
    query = (
        writer.option("checkpointLocation", f"{place}/progress").trigger(availableNow=True).start()
    )
    query.awaitTermination()


@_query("stream_commands", sql(_RESULT, "notes", "vaults", "commands", extra=REPLAY_CTE))
def stream_commands(spark, sf):
    """The commands as a stream over the stored corpus; results from the files it appends to."""
    place = scratch(spark, "stream-commands")
    write_snapshot(derived.notes(spark, sf), f"{place}/store", 0)
    start = NoteStore(spark, f"{place}/store").notes()
    outcome = streams.stream_commands(derived.commands(spark, sf, streaming=True), start, derived.vaults(spark, sf))
    _run_stream(outcome.writeStream.format("parquet").option("path", f"{place}/outcome"), place)
    results = spark.read.schema(streams.OUTCOME).parquet(f"{place}/outcome").filter("kind = 'result'")
    asked = derived.commands(spark, sf).select("seq", F.col("path").alias("asked"))
    return results.join(asked, "seq").select("seq", "vault", F.col("asked").alias("path"), "status", "content_hash")


@_query(
    "stream_daily_notes",
    sql(
        "SELECT vault, path, sha256(string_agg(body, '' ORDER BY seq)) AS content_hash "
        "FROM placed WHERE NOT read_only GROUP BY vault, path",
        "notes", "vaults", extra=_DAILY_ENTRIES,
    ),
)
def stream_daily_notes(spark, sf):
    """All events as entries of daily notes, those of every fifth event a batch later than the others."""
    place = scratch(spark, "stream-daily")
    entries = derived.table(spark, sf, "events").select(
        F.col("event_id").alias("seq"),
        derived.event_vault().alias("vault"),
        derived.event_day().alias("day"),
        derived.event_line().alias("body"),
    )
    # All entries of a batch arrive together, in as many files as there are; the stream goes on when the late ones are there.
    for late in (False, True):
        entries.filter((F.col("seq") % 5 == 0) == late).write.mode("append").parquet(f"{place}/entries")
        arriving = spark.readStream.schema(entries.schema).parquet(f"{place}/entries")
        days = streams.stream_daily_notes(arriving, derived.vaults(spark, sf)).select("vault", "path", "content_hash", "version")
        _run_stream(days.writeStream.format("parquet").option("path", f"{place}/days"), place)
    saved = spark.read.schema(days.schema).parquet(f"{place}/days")
    return saved.groupBy("vault", "path").agg(F.max_by("content_hash", "version").alias("content_hash"))


@_query(
    "windowed_daily_notes",
    sql(
        f"""SELECT name AS vault, {_DAILY_PATH.format(day='day')} AS path, sha256(content) AS content_hash
            FROM (SELECT concat('src', cast(user_id % 20 AS varchar)) AS vault, cast(ts AS date) AS day,
                         string_agg(concat('- ', event_type, ' ', cast(event_id AS varchar), chr(10)), ''
                                    ORDER BY event_id) AS content
                  FROM events GROUP BY 1, 2) d JOIN vaults ON name = d.vault
            WHERE cast(day AS timestamp) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY""",
        "vaults",
    ),
)
def windowed_daily_notes(spark, sf):
    """Days closed by the watermark, from a stream with bounded state."""
    place = scratch(spark, "windowed-days")
    entries = derived.table(spark, sf, "events", streaming=True).select(
        F.col("event_id").alias("seq"),
        derived.event_vault().alias("vault"),
        F.col("ts").cast("timestamp").alias("ts"),
        derived.event_line().alias("body"),
    )
    closed = streams.windowed_daily_notes(entries, derived.vaults(spark, sf)).select(
        "vault", "path", "content_hash"
    )
    writer = closed.writeStream.format("parquet").option("path", f"{place}/days")
    _run_stream(writer.outputMode("append"), place)
    return spark.read.schema(closed.schema).parquet(f"{place}/days")


@_query(
    "stream_tag_counts",
    sql("SELECT vault, tag, count(*) AS count FROM tags WHERE vault <> 'src3' GROUP BY vault, tag", "tags"),
)
def stream_tag_counts(spark, sf):
    """Tag counts kept by a stream of notes that come as drafts, are edited, and in one vault deleted again."""
    place = scratch(spark, "stream-tags")
    notes = derived.notes(spark, sf).select("vault", "path", "content")
    draft = F.concat("content", F.lit("\n#draft #q1\n"))
    gone = F.when(F.col("vault") != "src3", F.col("content"))

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place}/counts/batch={batch_id}")

    # All files of a version arrive together; the stream goes on from its state when the next version is there.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for text_ in (draft, F.col("content"), gone):
        notes.withColumn("content", text_).repartition(parts, "vault", "path").write.mode("append").parquet(f"{place}/notes")
        counts = streams.stream_tag_counts(spark.readStream.schema(notes.schema).parquet(f"{place}/notes"))
        _run_stream(counts.writeStream.outputMode("complete").foreachBatch(keep), place)
    saved = spark.read.schema(f"{_ddl(counts)}, batch bigint").parquet(f"{place}/counts")
    latest = saved.agg(F.max("batch").alias("batch"))
    return saved.join(F.broadcast(latest), "batch").drop("batch").filter("count <> 0")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)
