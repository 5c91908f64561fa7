"""Input views derived from the driver's ``documents``, ``labels`` and ``pages``.

The test tables hold no drive links, so each operator works on views that turn
every document into a file with metadata, text, links and a place in an
inventory. The SQL runs unchanged in Spark and DuckDB, so that both sides of a
check start from the same rows.
"""

from pyspark.sql import DataFrame, SparkSession

from linkloom.operators.storage import RunFolder
from linkloom.sources.snapshots import scan_presence, text_presence

_ID = "'doc' || lpad(CAST({0} AS STRING), 22, '0')"


def _doc_id(expr: str) -> str:
    return _ID.format(expr)


# Names are the whole first line of a text.
FILES = f"""
SELECT {_doc_id('doc_id')} AS file_id,
 CASE WHEN split_part(text, chr(10), 1) = '' THEN 'Doc ' || CAST(doc_id AS STRING)
      ELSE split_part(text, chr(10), 1) END AS name,
 CASE doc_id % 10 WHEN 0 THEN 'application/vnd.google-apps.spreadsheet' WHEN 1 THEN 'video/mp4'
  WHEN 2 THEN 'application/pdf' WHEN 3 THEN 'application/octet-stream'
  ELSE 'application/vnd.google-apps.document' END AS mime_type,
 'fld' || lang || source AS parent_id,
 '2024-01-' || lpad(CAST(doc_id % 28 + 1 AS STRING), 2, '0') || 'T10:30:00.000Z' AS modified_time,
 doc_id % 31 = 7 AS trashed,
 CASE WHEN doc_id % 17 = 5 THEN 404 WHEN doc_id % 19 = 5 THEN 403
      WHEN doc_id % 23 = 5 THEN 400 WHEN doc_id % 29 = 5 THEN 500 ELSE 200 END AS http_status
FROM documents
UNION ALL
SELECT DISTINCT 'fld' || lang || source AS file_id, source AS name,
 'application/vnd.google-apps.folder' AS mime_type, 'fld' || lang AS parent_id,
 '2024-02-01T00:00:00.000Z' AS modified_time, source LIKE '%9' AS trashed,
 CASE WHEN source LIKE '%7' THEN 403 ELSE 200 END AS http_status
FROM documents
UNION ALL
SELECT DISTINCT 'fld' || lang AS file_id, lang AS name,
 'application/vnd.google-apps.folder' AS mime_type, 'fldroot' AS parent_id,
 '2024-02-01T00:00:00.000Z' AS modified_time, FALSE AS trashed, 200 AS http_status
FROM documents
UNION ALL
SELECT DISTINCT 'fldroot' AS file_id, 'root' AS name,
 'application/vnd.google-apps.folder' AS mime_type, 'fldroot' AS parent_id,
 '2024-02-01T00:00:00.000Z' AS modified_time, FALSE AS trashed, 200 AS http_status
FROM documents
"""

# Some documents lie in the folder of their language as well, and some folders in
# that of the first language.
PARENTS = f"""
SELECT file_id AS child, parent_id AS parent FROM ({FILES}) files
UNION ALL
SELECT {_doc_id('doc_id')} AS child, 'fld' || lang AS parent FROM documents WHERE doc_id % 9 = 4
UNION ALL
SELECT DISTINCT 'fld' || lang || source AS child, 'fld' || (SELECT min(lang) FROM documents) AS parent
FROM documents WHERE source LIKE '%3' OR source LIKE '%9'
"""

# Every document links to two others, one in each URL form, to a document that
# does not exist, to itself, and to the folder it lies in. In some documents a
# line break and Markdown escapes run through the links.
CONTENTS = f"""
SELECT d.doc_id, {_doc_id('d.doc_id')} AS file_id,
 d.text || chr(10)
 || '[next](https://docs.google.com/document/d/'
 || CASE WHEN d.doc_id % 11 = 0 THEN 'doc' || chr(10) || substr({_doc_id('(d.doc_id * 7 + 1) % (SELECT max(doc_id) + 1 FROM documents)')}, 4)
    ELSE {_doc_id('(d.doc_id * 7 + 1) % (SELECT max(doc_id) + 1 FROM documents)')} END
 || '/edit) and [other](https://drive.google.com/file/d/'
 || {_doc_id('(d.doc_id * 13 + 2) % (SELECT max(doc_id) + 1 FROM documents)')}
 || '/view?a' || CASE WHEN d.doc_id % 11 = 0 THEN chr(92) || '_b=1' ELSE '=1' END
 || ') or [gone](https://docs.google.com/document/d/absent' || CAST(d.doc_id AS STRING)
 || '/edit), [self](https://docs.google.com/document/d/' || {_doc_id('d.doc_id')}
 || '/edit#top) in ' || CASE WHEN d.doc_id % 6 = 0 THEN '<' ELSE '' END
 || 'https://drive.google.com/drive/folders/fld' || d.lang || d.source
 || CASE WHEN d.doc_id % 6 = 0 THEN '>' ELSE '' END || ' .' AS markdown
FROM documents d
"""

# Seeds: every labelled document, every folder of a language,
# and every web page, which is not in the drive at all.
SEEDS = f"""
SELECT doc_id AS seed_pos, 'https://docs.google.com/document/d/' || {_doc_id('doc_id')} || '/edit' AS url
FROM labels
UNION ALL
SELECT (SELECT max(doc_id) + 1 FROM documents) + min(doc_id) AS seed_pos,
 'https://drive.google.com/drive/folders/fld' || lang AS url
FROM documents GROUP BY lang
UNION ALL
SELECT (SELECT 2 * max(doc_id) + 2 FROM documents) + page_id AS seed_pos, url
FROM pages
"""

# Inventory: every document under its editing URL, and every labelled one once
# more under the other URL form with another title and place. A few links name
# spreadsheets, forms, or nothing in the drive.
INVENTORY = f"""
SELECT doc_id AS rec_pos,
 CASE WHEN doc_id % 37 = 3 THEN 'https://docs.google.com/forms/d/e/' || {_doc_id('doc_id')} || '/viewform'
      WHEN doc_id % 41 = 3 THEN 'https://docs.google.com/spreadsheets/d/' || {_doc_id('doc_id')} || '/edit'
      WHEN doc_id % 43 = 3 THEN 'https://example.org/' || CAST(doc_id AS STRING)
      ELSE 'https://docs.google.com/document/d/' || {_doc_id('doc_id')} || '/edit' END AS link,
 CASE WHEN split_part(text, chr(10), 1) = '' THEN 'Doc ' || CAST(doc_id AS STRING)
      ELSE split_part(text, chr(10), 1) END AS title,
 lang || '; ' || source || CASE WHEN doc_id % 4 = 0 THEN ';;' ELSE '' END AS tags,
 lang AS frag1, source AS frag2,
 CASE WHEN doc_id % 3 = 0 THEN 'Deep  Dive: ' || lang ELSE '' END AS frag3,
 '' AS frag4, CASE WHEN doc_id % 5 = 0 THEN '..' ELSE '' END AS frag5
FROM documents
UNION ALL
SELECT (SELECT max(doc_id) + 1 FROM documents) + l.doc_id AS rec_pos,
 'https://drive.google.com/file/d/' || {_doc_id('l.doc_id')} || '/view' AS link,
 'Quality ' || CAST(l.quality AS STRING) || ' v1.' || CAST(l.toxic AS STRING) AS title,
 CASE WHEN l.toxic = 1 THEN 'toxic' ELSE '' END AS tags,
 'labelled' AS frag1, '' AS frag2, d.lang AS frag3, '' AS frag4, '' AS frag5
FROM labels l JOIN documents d ON d.doc_id = l.doc_id
"""

# A published tree: one Markdown file per document. Some revisions differ from
# the current one, some front matters are stubs, unclosed, missing or lack a
# field, and some name a file that cannot be found.
MD_FILES = f"""
SELECT 'wiki/' || lang || '/' || CAST(doc_id AS STRING) || '.md' AS path,
 CASE WHEN doc_id % 47 = 1 THEN text
      WHEN doc_id % 53 = 1 THEN '---' || chr(10) || 'title: open' || chr(10) || text
      ELSE '---' || chr(10)
       || 'description: "Doc: ' || CAST(doc_id AS STRING) || '"' || chr(10)
       || 'editor: markdown' || chr(10) || 'no colon here' || chr(10)
       || CASE WHEN doc_id % 59 = 1 THEN '' ELSE
           'gdrive-link: "' || CASE WHEN doc_id % 61 = 1 THEN 'https://example.org/x'
            ELSE 'https://docs.google.com/document/d/' || {_doc_id('doc_id')} || '/edit' END || '"' || chr(10) END
       || CASE WHEN doc_id % 67 = 1 THEN '' WHEN doc_id % 7 = 1 THEN 'hash-gdrive: stub' || chr(10) ELSE
           'hash-gdrive: "2024-01-' || lpad(CAST((doc_id + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END) % 28 + 1 AS STRING), 2, '0')
           || 'T10:30:00.000Z"' || chr(10) END
       || 'hash-content: old' || chr(10) || 'published: true' || chr(10)
       || 'title:   first ' || chr(10) || 'extra: lost' || chr(10)
       || 'tags: ' || lang || ', ' || source || chr(10)
       || 'title: - ' || lang || ' ''' || source || ''' ' || chr(10)
       || '---' || chr(10) || chr(10) || '> Link: x' || chr(10) || chr(10) || text END AS content
FROM documents
"""

VIEWS = {
    "fx_files": FILES,
    "fx_parents": PARENTS,
    "fx_contents": CONTENTS,
    "fx_seeds": SEEDS,
    "fx_inventory": INVENTORY,
    "fx_md_files": MD_FILES,
}
_TABLES = ("documents", "labels", "pages")


class Fixtures:
    """The derived views over one directory of test tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.kept: dict[str, DataFrame] = {}
        self.tables = {
            name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in _TABLES
        }

    def kept_as_tables(self, folder: str, partitions: int) -> "Fixtures":
        """The same views written as tables, the way a corpus is usually stored."""
        for name in VIEWS:
            path = f"{folder}/{name}"
            self._view(name).repartition(partitions).write.parquet(path)
            self.kept[name] = self.spark.read.parquet(path)
        path = f"{folder}/presence"
        text_presence(self.contents).write.parquet(path)
        self.kept["presence"] = scan_presence(self.spark, path)
        return self

    def _view(self, name: str) -> DataFrame:
        if name in self.kept:
            return self.kept[name]
        sql = VIEWS[name]
        for table in _TABLES:
            sql = sql.replace(f"FROM {table}", f"FROM {{{table}}}")
            sql = sql.replace(f"JOIN {table}", f"JOIN {{{table}}}")
        used = {t: df for t, df in self.tables.items() if f"{{{t}}}" in sql}
        return self.spark.sql(sql, **used)

    @property
    def documents(self) -> DataFrame:
        return self.tables["documents"]

    @property
    def files(self) -> DataFrame:
        return self._view("fx_files")

    @property
    def parents(self) -> DataFrame:
        return self._view("fx_parents")

    @property
    def contents(self) -> DataFrame:
        return self._view("fx_contents")

    @property
    def presence(self) -> DataFrame:
        """The table that landing the texts leaves beside them."""
        if "presence" not in self.kept:
            run = RunFolder(self.spark, "landed")
            self.kept["presence"] = run.keep(text_presence(self.contents), "presence")
        return self.kept["presence"]

    @property
    def seeds(self) -> DataFrame:
        return self._view("fx_seeds")

    @property
    def inventory(self) -> DataFrame:
        return self._view("fx_inventory")

    @property
    def md_files(self) -> DataFrame:
        return self._view("fx_md_files")
