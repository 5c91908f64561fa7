"""The same queries in SQL, as a check that shares nothing but the input views.

Written for an engine with list functions and linear-time regular expressions.
Each query is a ``SELECT`` over named steps; only the steps it needs are put in
front of it.
"""

import re

from linkloom.fixtures import VIEWS
from linkloom.functions import fixed_values

_H = fixed_values.URL_HEAD
_MD_LINK = rf"\[([^\]]+)\]\(({_H}[^\)]+)\)"
_WORKSPACE, _DOCX = fixed_values.WORKSPACE_PREFIX, fixed_values.DOCX
_PPTX, _XLSX = [mime for mime in fixed_values.MIME_KINDS if "openxmlformats" in mime]


def _file_id(url: str) -> str:
    path = rf"regexp_extract({url}, '//[^/?#]*([^?#]*)', 1)"
    query = rf"regexp_extract({url}, '^[^?#]*\?([^#]*)', 1)"
    return (
        rf"CASE WHEN regexp_matches({url}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*(?:drive|docs)\.google\.com')"
        rf" THEN coalesce(CASE WHEN regexp_matches({path}, '/(?:d/e|d|folders)/')"
        rf" THEN regexp_extract({path}, '/(?:d/e|d|folders)/([^/]*)', 1) END,"
        rf" nullif(regexp_extract({query}, '(?:^|&)id=([^&;]*)', 1), ''),"
        rf" nullif(regexp_extract({url}, '[-\w]{{25,}}'), '')) END"
    )


def _safe(name: str) -> str:
    unsafe = r"""[<>:"/\\|?*\x00-\x1f]"""
    clean = rf"regexp_replace({name}, '{unsafe}', '_', 'g')"
    clean = rf"regexp_replace(regexp_replace({clean}, '\s+', ' ', 'g'), '\.+', '.', 'g')"
    # Segments of the fixtures are ASCII, so 255 characters are 255 bytes.
    return f"left(coalesce(nullif(trim({clean}, ' ._'), ''), 'untitled'), 255)"


def _file_name(title: str) -> str:
    stem = rf"lower(regexp_replace({title}, '\.[^.]*$', ''))"
    stem = f"regexp_replace(replace({stem}, ' ', '-'), '[^a-z0-9-]', '', 'g')"
    stem = f"trim(regexp_replace({stem}, '-+', '-', 'g'), '-')"
    return f"left(coalesce(nullif({stem}, ''), 'unnamed'), 255) || '.md'"


def _quoted(value: str) -> str:
    special = r"""[:#@&*!|>''"%\[\]{}]|^-"""
    return (
        f"CASE WHEN regexp_matches({value}, '{special}')"
        f" THEN '\"' || replace({value}, '\"', '\\\"') || '\"' ELSE {value} END"
    )


def _shared(level: int = 1) -> str:
    deeper = f" + {_shared(level + 1)}" if level < 5 else ""
    return f"(CASE WHEN s.dirs[{level}] = t.dirs[{level}] THEN 1{deeper} ELSE 0 END)"


def _relative(source: str, target: str, file_name: str) -> str:
    shared = _shared().replace("s.dirs", source).replace("t.dirs", target)
    return (
        f"array_to_string(list_concat(list_transform(range(len({source}) - {shared}), lambda i: '..'),"
        f" {target}[{shared} + 1:], [{file_name}]), '/')"
    )


def _unescape(url: str) -> str:
    for char in "_*-[]":
        url = f"replace({url}, chr(92) || '{char}', '{char}')"
    return url


def _rewritten(links: str, sources: str) -> str:
    """Text of each source with its links replaced, from links with ``relative_path``."""
    return f"""
 SELECT s.row_id, array_to_string(list_transform(list_zip(
   string_split_regex(r.text, '{_MD_LINK}'), regexp_extract_all(r.text, '{_MD_LINK}', 0),
   coalesce(w.paths, [])), lambda x: x[1] || CASE WHEN x[2] IS NULL THEN '' WHEN x[3] IS NULL THEN x[2]
     ELSE regexp_extract(x[2], '^(\\[[^\\]]+\\])', 1) || '(' || x[3] || ')' END), '') AS text
 FROM {sources} s JOIN repaired r USING (file_id)
 LEFT JOIN (SELECT row_id, list(relative_path ORDER BY pos) AS paths FROM {links} GROUP BY row_id) w USING (row_id)
"""


_KEYS = fixed_values.FRONT_MATTER_KEYS


def _closure_levels(depth: int) -> dict[str, str]:
    """Breadth-first levels, one step each, from ``level_0`` to ``level_<depth>``."""
    steps = {
        "level_0": f"""
 SELECT file_id, url AS link, 0 AS depth, seed_pos, CAST([] AS INTEGER[]) AS trail
 FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY seed_pos) AS n FROM seed_refs WHERE file_id IS NOT NULL)
 WHERE n = 1"""
    }
    for level in range(1, depth + 1):
        seen = " UNION ALL ".join(f"SELECT file_id FROM level_{i}" for i in range(level))
        steps[f"level_{level}"] = f"""
 SELECT dst AS file_id, url AS link, {level} AS depth, seed_pos, list_append(before, pos) AS trail FROM (
  SELECT e.dst, e.url, e.pos, f.seed_pos, f.trail AS before,
   row_number() OVER (PARTITION BY e.dst ORDER BY f.seed_pos, f.trail, e.src, e.pos) AS n
  FROM edges e JOIN level_{level - 1} f ON e.src = f.file_id
  WHERE e.dst NOT IN ({seen})) WHERE n = 1"""
    return steps


_STEPS = dict(VIEWS)
_STEPS["seed_refs"] = f"SELECT *, {_file_id('url')} AS file_id FROM fx_seeds"
_STEPS["joined_lines"] = rf"""
 SELECT file_id, regexp_replace(markdown,
  '({_H}[^\s\n*_]+)[\*_]*\s*\n\s*[\*_]*([^\s\n*_]+)[\*_]*', '\1\2', 'g') AS text FROM fx_contents"""
_STEPS["repaired"] = rf"""
 SELECT file_id, array_to_string(list_transform(list_zip(
  string_split_regex(text, '{_H}[^\s\n]*'), regexp_extract_all(text, '{_H}[^\s\n]*')),
  lambda x: x[1] || coalesce({_unescape('x[2]')}, '')), '') AS text FROM joined_lines"""
_STEPS["all_links"] = rf"""
 SELECT src, pos, url, dst FROM (SELECT src, pos, url, {_file_id('url')} AS dst FROM (
  SELECT file_id AS src, unnest(urls) AS url, CAST(generate_subscripts(urls, 1) - 1 AS INTEGER) AS pos
  FROM (SELECT file_id, regexp_extract_all(text, '{_H}[^\s\)]+') AS urls FROM repaired)))
 WHERE dst IS NOT NULL AND dst <> src"""
_STEPS["edges"] = f"""
 SELECT l.* FROM all_links l JOIN fx_files f ON f.file_id = l.src
 WHERE f.http_status = 200 AND (f.mime_type IN ('application/pdf', '{_DOCX}')
  OR (starts_with(f.mime_type, '{_WORKSPACE}') AND f.mime_type <> '{_WORKSPACE}folder'))"""
_STEPS["records"] = f"""
 SELECT *, {_file_id('link')} AS record_id, {_file_name('title')} AS file_name,
  list_transform(list_filter([frag1, frag2, frag3, frag4, frag5], lambda f: f <> ''), lambda f: {_safe('f')}) AS dirs
 FROM fx_inventory"""
_STEPS["keyed"] = """
 SELECT link AS key, * FROM records
 UNION ALL SELECT record_id AS key, * FROM records WHERE record_id IS NOT NULL"""
_STEPS["index_rows"] = """
 SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY rec_pos DESC) AS n FROM keyed)
 WHERE n = 1"""
_STEPS["md_links"] = rf"""
 SELECT file_id, pos, url, {_file_id('url')} AS dst FROM (
  SELECT file_id, unnest(urls) AS url, CAST(generate_subscripts(urls, 1) - 1 AS INTEGER) AS pos
  FROM (SELECT file_id, regexp_extract_all(text, '{_MD_LINK}', 2) AS urls FROM repaired))"""
_STEPS["resolved"] = """
 SELECT l.*, coalesce(u.rec_pos, i.rec_pos) AS rec_pos,
  CASE WHEN u.key IS NOT NULL THEN u.dirs ELSE i.dirs END AS target_dirs,
  coalesce(u.file_name, i.file_name) AS target_file
 FROM md_links l LEFT JOIN index_rows u ON u.key = l.url LEFT JOIN index_rows i ON i.key = l.dst"""
_STEPS["facts"] = """
 SELECT f.file_id, f.mime_type, f.modified_time, f.http_status, c.file_id IS NOT NULL AS has_content
 FROM fx_files f LEFT JOIN fx_contents c ON c.file_id = f.file_id"""
_STEPS["routed_by_type"] = f"""
 SELECT r.*, f.mime_type, f.modified_time, coalesce(f.has_content, FALSE) AS has_content,
  CASE WHEN r.record_id IS NULL THEN 'error'
   WHEN contains(r.link, 'docs.google.com/forms') OR contains(r.link, 'docs.google.com/spreadsheets')
     OR contains(r.link, 'docs.google.com/presentation') THEN 'stub_url'
   WHEN f.http_status IS DISTINCT FROM 200 THEN 'error'
   WHEN regexp_matches(f.mime_type, '^(video|audio|image)/') OR f.mime_type IN ('{_WORKSPACE}presentation',
     '{_WORKSPACE}spreadsheet', '{_PPTX}', '{_XLSX}') THEN 'stub_mime'
   WHEN starts_with(f.mime_type, '{_WORKSPACE}') THEN 'export'
   WHEN f.mime_type IN ('application/pdf', '{_DOCX}') THEN 'convert' ELSE 'error' END AS route_by_type,
  CASE WHEN r.record_id IS NULL THEN 'failed to extract file ID from ' || r.link
   WHEN f.http_status IS DISTINCT FROM 200 THEN 'failed to get metadata for ' || r.record_id
   ELSE 'unsupported file type ' || f.mime_type || ' for ' || r.title END AS reason
 FROM records r LEFT JOIN facts f ON f.file_id = r.record_id"""
_STEPS["routed"] = """
 SELECT * EXCLUDE (route_by_type, reason),
  CASE WHEN route_by_type IN ('export', 'convert') AND NOT has_content THEN 'error' ELSE route_by_type END AS route,
  CASE WHEN route_by_type = 'error' THEN reason
   WHEN route_by_type = 'export' AND NOT has_content THEN 'failed to export ' || title || ' as markdown'
   WHEN route_by_type = 'convert' AND NOT has_content THEN 'failed to convert PDF ' || title END AS error
 FROM routed_by_type"""
_STEPS["kinds"] = f"""
 SELECT *, CASE WHEN route = 'stub_url' THEN CASE WHEN contains(link, 'docs.google.com/forms') THEN 'Google Form'
   WHEN contains(link, 'docs.google.com/spreadsheets') THEN 'Google Sheet' ELSE 'Google Presentation' END
  WHEN route = 'stub_mime' THEN CASE WHEN starts_with(mime_type, 'video/') THEN 'video file'
   WHEN starts_with(mime_type, 'audio/') THEN 'audio file' WHEN starts_with(mime_type, 'image/') THEN 'image file'
   WHEN mime_type = '{_WORKSPACE}presentation' THEN 'Google Presentation'
   WHEN mime_type = '{_WORKSPACE}spreadsheet' THEN 'Google Sheet'
   WHEN mime_type = '{_PPTX}' THEN 'PowerPoint presentation' ELSE 'Excel spreadsheet' END END AS kind
 FROM routed"""
_STEPS["planned"] = """
 SELECT *, array_to_string(list_concat(['wiki'], dirs, [file_name]), '/') AS plain_path FROM records"""
_SUFFIXED = """CASE WHEN n = 1 THEN plain_path ELSE left(plain_path, length(plain_path) - 3) || '_' || CAST(n - 1 AS VARCHAR) || '.md' END"""
_STEPS["placed"] = f"""
 SELECT *, {_SUFFIXED} AS path FROM (
  SELECT k.*, p.plain_path, row_number() OVER (PARTITION BY p.plain_path ORDER BY k.rec_pos) AS n
  FROM kinds k JOIN planned p USING (rec_pos) WHERE k.route <> 'error')
 UNION ALL SELECT *, NULL AS plain_path, NULL AS n, NULL AS path FROM kinds WHERE route = 'error'"""
_STEPS["text_sources"] = """
 SELECT rec_pos AS row_id, record_id AS file_id, dirs FROM placed WHERE route IN ('export', 'convert')"""
_STEPS["text_links"] = f"""
 SELECT s.row_id, l.pos, CASE WHEN l.rec_pos IS NOT NULL
  THEN {_relative('s.dirs', 'l.target_dirs', 'l.target_file')} END AS relative_path
 FROM text_sources s JOIN resolved l USING (file_id)"""
_STEPS["texts"] = _rewritten("text_links", "text_sources")
_STEPS["bodies"] = """
 SELECT p.*, '> Link: ' || p.link || chr(10) || chr(10) || CASE p.route
  WHEN 'stub_url' THEN '*This is a ' || p.kind || '. This document type cannot be exported to markdown format.*'
  WHEN 'stub_mime' THEN '*This is a ' || p.kind || ' (' || p.mime_type || '). Media files cannot be exported to markdown format.*'
  ELSE t.text END AS body,
  CASE WHEN p.route IN ('stub_url', 'stub_mime') THEN 'stub' ELSE p.modified_time END AS revision,
  array_to_string(list_filter(list_transform(string_split(p.tags, ';'), lambda t: trim(t)), lambda t: t <> ''), ', ') AS tag_line
 FROM placed p LEFT JOIN texts t ON t.row_id = p.rec_pos"""
_STEPS["published"] = f"""
 SELECT rec_pos, route, error, path, '---' || chr(10)
  || 'description: ' || {_quoted('title')} || chr(10) || 'editor: markdown' || chr(10)
  || 'gdrive-link: ' || {_quoted('link')} || chr(10) || 'hash-gdrive: ' || {_quoted('revision')} || chr(10)
  || 'hash-content: ' || sha256(body) || chr(10) || 'published: true' || chr(10)
  || CASE WHEN tag_line = '' THEN '' ELSE 'tags: ' || tag_line || chr(10) END
  || 'title: ' || {_quoted('title')} || chr(10) || '---' || chr(10) || chr(10) || body AS content
 FROM bodies"""
_STEPS["folder_rows"] = f"""
 SELECT file_id, parent_id FROM fx_files
 WHERE NOT trashed AND http_status = 200 AND mime_type = '{_WORKSPACE}folder'"""
_STEPS["file_rows"] = f"""
 SELECT * FROM fx_files WHERE NOT trashed AND mime_type <> '{_WORKSPACE}folder'"""


def _descendants(roots: str) -> str:
    """Least place of the roots over every file below them."""
    return f"""
 WITH RECURSIVE down(root, folder) AS (
  SELECT file_id, file_id FROM {roots}
  UNION SELECT d.root, f.file_id FROM down d JOIN folder_rows f ON f.parent_id = d.folder)
 SELECT file_id, name, mime_type, depth, seed_pos, trail FROM (
  SELECT c.file_id, c.name, c.mime_type, r.depth, r.seed_pos, r.trail,
   row_number() OVER (PARTITION BY c.file_id ORDER BY r.depth, r.seed_pos, r.trail) AS n
  FROM down d JOIN {roots} r ON r.file_id = d.root JOIN file_rows c ON c.parent_id = d.folder) WHERE n = 1"""


_STEPS.update(_closure_levels(5))
_STEPS["reached"] = " UNION ALL ".join(f"SELECT * FROM level_{i}" for i in range(6))
_STEPS["seed_folders"] = f"""
 SELECT l.* FROM level_0 l JOIN fx_files f USING (file_id)
 WHERE f.http_status = 200 AND f.mime_type = '{_WORKSPACE}folder'"""
_STEPS["reached_folders"] = _STEPS["seed_folders"].replace("level_0", "reached")
_STEPS["below_seeds"] = _descendants("seed_folders")
_STEPS["below_reached"] = _descendants("reached_folders")
_STATUS = """CASE f.http_status WHEN 200 THEN 'available' WHEN 403 THEN 'permission_denied'
   WHEN 400 THEN 'invalid' WHEN 404 THEN 'deleted' ELSE CASE WHEN f.file_id IS NULL THEN 'deleted' ELSE 'error' END END"""


def _canonical(file_id: str, mime: str) -> str:
    return f"""CASE {mime} WHEN '{_WORKSPACE}document' THEN 'https://docs.google.com/document/d/' || {file_id} || '/edit'
  WHEN '{_WORKSPACE}spreadsheet' THEN 'https://docs.google.com/spreadsheets/d/' || {file_id} || '/edit'
  WHEN '{_WORKSPACE}presentation' THEN 'https://docs.google.com/presentation/d/' || {file_id} || '/edit'
  WHEN '{_WORKSPACE}form' THEN 'https://docs.google.com/forms/d/e/' || {file_id} || '/viewform'
  WHEN '{_WORKSPACE}drawing' THEN 'https://docs.google.com/drawings/d/' || {file_id} || '/edit'
  WHEN '{_WORKSPACE}folder' THEN 'https://drive.google.com/drive/folders/' || {file_id}
  ELSE 'https://drive.google.com/file/d/' || {file_id} || '/view' END"""


_LESSER = """CASE WHEN (b.depth, b.seed_pos, b.trail) < (r.depth, r.seed_pos, r.trail) THEN b.{0} ELSE r.{0} END AS {0}"""
_STEPS["found"] = f"""
 SELECT r.file_id, r.link, CASE WHEN f.http_status = 200 THEN f.name ELSE r.file_id END AS title,
  {_STATUS} AS status, {_LESSER.format('depth')}, {_LESSER.format('seed_pos')}, {_LESSER.format('trail')}
 FROM reached r LEFT JOIN fx_files f USING (file_id) LEFT JOIN below_reached b ON b.file_id = r.file_id
 WHERE NOT (f.file_id IS NOT NULL AND f.http_status = 200 AND f.mime_type = '{_WORKSPACE}folder')
 UNION ALL
 SELECT file_id, {_canonical('file_id', 'mime_type')}, name, 'available', depth, seed_pos, trail
 FROM below_reached WHERE file_id NOT IN (SELECT file_id FROM reached)
 UNION ALL
 SELECT NULL, url, 'INVALID_URL', 'invalid', 0, seed_pos, [] FROM seed_refs WHERE file_id IS NULL"""
_STEPS["md_parts"] = r"""
 SELECT path, content, CASE WHEN NOT starts_with(content, '---' || chr(10))
   THEN 'failed to parse frontmatter: no frontmatter found'
  WHEN strpos(substr(content, 5), chr(10) || '---' || chr(10)) = 0
   THEN 'failed to parse frontmatter: frontmatter not closed' END AS parse_error,
  strpos(substr(content, 5), chr(10) || '---' || chr(10)) AS stop
 FROM fx_md_files"""
_STEPS["md_lines"] = r"""
 SELECT path, n, trim(line[:strpos(line, ':') - 1]) AS key, trim(trim(line[strpos(line, ':') + 1:]), '"') AS value
 FROM (SELECT path, unnest(lines) AS line, generate_subscripts(lines, 1) AS n
  FROM (SELECT path, string_split(substr(content, 5, stop - 1), chr(10)) AS lines
   FROM md_parts WHERE parse_error IS NULL)) WHERE contains(line, ':')"""
_STEPS["md_values"] = """
 SELECT path, key, value FROM (
  SELECT *, row_number() OVER (PARTITION BY path, key ORDER BY n DESC) AS r FROM md_lines) WHERE r = 1"""
_STEPS["md_headers"] = (
    "SELECT p.path, p.parse_error, "
    + ", ".join(
        f"max(v.value) FILTER (v.key = '{key}') AS \"{key}\"" for key in _KEYS
    )
    + " FROM md_parts p LEFT JOIN md_values v USING (path) GROUP BY ALL"
)
_STEPS["judged"] = f"""
 SELECT *, CASE WHEN parse_error IS NOT NULL THEN 'error' WHEN "hash-gdrive" IS NULL THEN 'skipped'
   WHEN "hash-gdrive" = 'stub' THEN 'skipped' WHEN "gdrive-link" IS NULL THEN 'skipped'
   WHEN file_id IS NULL THEN 'error' WHEN http_status IS DISTINCT FROM 200 THEN 'error'
   WHEN "hash-gdrive" = modified_time THEN 'unchanged'
   WHEN NOT starts_with(mime_type, '{_WORKSPACE}') OR NOT has_content OR rec_pos IS NULL THEN 'error'
   ELSE 'updated' END AS status,
  CASE WHEN parse_error IS NOT NULL THEN parse_error
   WHEN "hash-gdrive" IS NULL THEN 'no hash-gdrive field found' WHEN "hash-gdrive" = 'stub' THEN NULL
   WHEN "gdrive-link" IS NULL THEN 'no gdrive-link field found'
   WHEN file_id IS NULL THEN 'failed to extract file ID'
   WHEN http_status IS DISTINCT FROM 200 THEN 'failed to get file metadata'
   WHEN "hash-gdrive" = modified_time THEN NULL
   WHEN NOT starts_with(mime_type, '{_WORKSPACE}') THEN 'failed to export document: unsupported MIME type: ' || mime_type
   WHEN NOT has_content THEN 'failed to export document'
   WHEN rec_pos IS NULL THEN 'record not found in link map' END AS error
 FROM (SELECT h.*, f.mime_type, f.modified_time, f.http_status, f.has_content, i.rec_pos, i.dirs
  FROM (SELECT *, {_file_id('"gdrive-link"')} AS file_id FROM md_headers) h
  LEFT JOIN facts f ON f.file_id = h.file_id LEFT JOIN index_rows i ON i.key = h.file_id)"""
_STEPS["sync_sources"] = """
 SELECT path AS row_id, file_id, dirs FROM judged WHERE status = 'updated'"""
_STEPS["sync_links"] = _STEPS["text_links"].replace("text_sources", "sync_sources")
_STEPS["sync_texts"] = _rewritten("sync_links", "sync_sources")
_STEPS["sync_bodies"] = """
 SELECT j.*, '> Link: ' || j."gdrive-link" || chr(10) || chr(10) || t.text AS body
 FROM judged j JOIN sync_texts t ON t.row_id = j.path"""
_REBUILT = " || ".join(
    "CASE WHEN {0} IS NULL THEN '' ELSE '{1}: ' || {2} || chr(10) END".format(
        value, key, _quoted(value)
    )
    for key, value in (
        (
            key,
            {"hash-gdrive": "modified_time", "hash-content": "sha256(body)"}.get(
                key, f'"{key}"'
            ),
        )
        for key in _KEYS
    )
)
_STEPS["sync_docs"] = f"""
 SELECT path, '---' || chr(10) || {_REBUILT} || '---' || chr(10) || chr(10) || body AS content FROM sync_bodies"""
_STEPS["sync_rows"] = """
 SELECT j.path AS file_path, j.status, j.error,
  CASE WHEN j."gdrive-link" IS NULL OR j."hash-gdrive" IS NULL OR j."hash-gdrive" = 'stub' THEN '' ELSE j."hash-gdrive" END AS old_hash,
  CASE WHEN j."hash-gdrive" IS NULL OR j."hash-gdrive" = 'stub' OR j.http_status IS DISTINCT FROM 200 THEN '' ELSE j.modified_time END AS new_hash,
  CAST(coalesce(strlen(d.content), 0) AS BIGINT) AS content_length
 FROM judged j LEFT JOIN sync_docs d ON d.path = j.path"""

_RESULTS = {
    "seed_ids": f"""
 SELECT seed_pos, url, {_file_id('url')} AS file_id FROM (
  SELECT seed_pos, url FROM fx_seeds UNION ALL SELECT rec_pos, link FROM fx_inventory)""",
    "canonical_links": f"""
 SELECT file_id, mime_type, {_canonical('file_id', 'mime_type')} AS link FROM fx_files""",
    "repaired_text": "SELECT file_id, text FROM repaired",
    "link_edges": "SELECT src, pos, url, dst FROM edges",
    "link_counts": """
 SELECT dst, count(*) AS links, min(pos) AS first_pos FROM edges GROUP BY dst ORDER BY links DESC, dst""",
    "access_status": f"""
 SELECT r.file_id, r.link, CASE WHEN r.file_id IS NULL THEN 'INVALID_URL'
   WHEN f.http_status = 200 THEN f.name ELSE r.file_id END AS title,
  CASE WHEN r.file_id IS NULL THEN 'invalid' ELSE {_STATUS} END AS status
 FROM (SELECT file_id, url AS link FROM seed_refs UNION ALL SELECT dst, url FROM all_links) r
 LEFT JOIN fx_files f ON f.file_id = r.file_id""",
    "document_routes": "SELECT rec_pos, route, kind, error FROM kinds",
    "tag_counts": """
 SELECT tag, count(*) AS records FROM (SELECT trim(unnest(string_split(tags, ';'))) AS tag FROM fx_inventory)
 WHERE tag <> '' GROUP BY tag""",
    "output_paths": "SELECT rec_pos, plain_path AS path FROM planned",
    "unique_paths": f"""
 SELECT rec_pos, {_SUFFIXED} AS path FROM (
  SELECT *, row_number() OVER (PARTITION BY plain_path ORDER BY rec_pos) AS n FROM planned)""",
    "link_index": "SELECT key, rec_pos, link, title, record_id FROM index_rows",
    "resolved_links": "SELECT file_id, pos, url, dst, rec_pos FROM resolved",
    "relative_paths": f"""
 SELECT l.file_id, l.pos, {_relative('s.dirs', 'l.target_dirs', 'l.target_file')} AS relative_path
 FROM resolved l JOIN index_rows s ON s.key = l.file_id WHERE l.rec_pos IS NOT NULL""",
    "rewritten_docs": "SELECT row_id AS file_id, text FROM all_texts",
    "conversion_plan": "SELECT rec_pos, route, error, path FROM placed",
    "published_docs": "SELECT rec_pos, route, error, path, content FROM published",
    "convert_summary": """
 SELECT count(*) AS records, count(error) AS errors, count(error) > 0 AS failed FROM published""",
    "folder_closure": "SELECT file_id, name, depth, seed_pos FROM below_seeds",
    "link_closure": "SELECT file_id, link, depth, seed_pos, array_to_string(trail, '.') AS trail FROM reached",
    "discovered": """
 SELECT file_id, link, title, status, depth, seed_pos,
  row_number() OVER (ORDER BY seed_pos, depth, trail, file_id NULLS FIRST, link) - 1 AS position FROM found""",
    "status_counts": "SELECT status, count(*) AS files FROM found GROUP BY status",
    "front_matter": """
 SELECT p.path, p.parse_error, CASE WHEN p.parse_error IS NULL THEN sha256(substr(p.content, p.stop + 9)) END AS body_hash,
  v.key, v.value FROM md_parts p LEFT JOIN md_values v USING (path)""",
    "sync_results": "SELECT * FROM sync_rows",
    "sync_rewritten": "SELECT path AS file_path, content FROM sync_docs",
    "published_tree": r"""
 SELECT path, content FROM published WHERE content IS NOT NULL AND strlen(regexp_extract(path, '[^/]*$')) <= 255""",
    "synced_tree": """
 SELECT m.path, coalesce(d.content, m.content) AS content FROM fx_md_files m LEFT JOIN sync_docs d USING (path)""",
    "plain_tree": "SELECT path, content FROM fx_md_files",
    "reported": """
 SELECT row_number() OVER (ORDER BY seed_pos, depth, trail, file_id NULLS FIRST, link) - 1 AS seed_pos, link AS url
 FROM found""",
    "listed_inventory": """
 SELECT rec_pos, link, trim(title) AS title, trim(tags) AS tags, trim(frag1) AS frag1, trim(frag2) AS frag2,
  trim(frag3) AS frag3, '' AS frag4, trim(frag5) AS frag5 FROM (
  SELECT * REPLACE (row_number() OVER (ORDER BY late, rec_pos) - 1 AS rec_pos,
    CASE WHEN late THEN '' ELSE frag2 END AS frag2, CASE WHEN late THEN '' ELSE frag5 END AS frag5)
  FROM (SELECT *, contains(tags, 'toxic') OR frag1 = 'labelled' AS late FROM fx_inventory))""",
    "ordered_sync": """
 SELECT file_path, status, row_number() OVER (ORDER BY file_path) - 1 AS position FROM sync_rows""",
    "sync_summary": """
 SELECT count(*) FILTER (status = 'updated') AS updated, count(*) FILTER (status = 'unchanged') AS unchanged,
  count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status = 'error') AS errors,
  count(*) FILTER (status = 'error') > 0 AS failed FROM sync_rows""",
}
_STEPS["index_sources"] = "SELECT key AS row_id, key AS file_id, dirs FROM index_rows"
_STEPS["index_links"] = _STEPS["text_links"].replace("text_sources", "index_sources")
_STEPS["all_texts"] = _rewritten("index_links", "index_sources")


def _levels_through_folders(depth: int) -> dict[str, str]:
    """As ``_closure_levels``, where files below a level's folders are sources too."""
    steps = _closure_levels(depth)
    for level in range(depth):
        def earlier(name: str) -> str:
            ids = " UNION ALL ".join(f"SELECT file_id FROM {name}_{i}" for i in range(level))
            return f"file_id NOT IN ({ids})" if level else "TRUE"

        steps[f"folders_{level}"] = _STEPS["seed_folders"].replace("level_0", f"level_{level}")
        steps[f"below_{level}"] = _descendants(f"folders_{level}")
        steps[f"sources_{level}"] = f"""
 SELECT file_id, seed_pos, trail FROM (
  SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY seed_pos, trail) AS n FROM (
   SELECT file_id, seed_pos, trail FROM level_{level}
   UNION ALL SELECT file_id, seed_pos, trail FROM below_{level} WHERE {earlier('below')})
  WHERE {earlier('sources')}) WHERE n = 1"""
        steps[f"level_{level + 1}"] = steps[f"level_{level + 1}"].replace(
            f"JOIN level_{level} f", f"JOIN sources_{level} f"
        )
    return steps


#: Steps where a file may lie in several folders.
_SHARED = {
    "folder_rows": _STEPS["folder_rows"].replace("parent_id FROM fx_files", "parent AS parent_id FROM fx_files JOIN fx_parents ON child = file_id"),
    "file_rows": _STEPS["file_rows"].replace("* FROM fx_files", "f.* REPLACE (p.parent AS parent_id) FROM fx_files f JOIN fx_parents p ON p.child = f.file_id"),
}
#: Queries that are another one with some steps replaced.
_VARIANTS = {
    "published_unrepaired": (
        "published_docs", {"repaired": "SELECT file_id, markdown AS text FROM fx_contents"}
    ),
    "published_unique_links": ("published_docs", {"keyed": """
 SELECT n.link AS key, n.* FROM unique_names n
 UNION ALL SELECT n.record_id AS key, n.* FROM unique_names n WHERE n.record_id IS NOT NULL"""}),
    "discovered_seeds_only": ("discovered", {"reached": "SELECT * FROM level_0"}),
    "discovered_through_folders": ("discovered", _levels_through_folders(5)),
    "folder_closure_shared": ("folder_closure", _SHARED),
    "discovered_shared": ("discovered", _SHARED),
    "discovered_again": ("discovered", {}),
}
_STEPS["unique_names"] = """
 SELECT r.* REPLACE (coalesce(regexp_extract(p.path, '[^/]*$'), r.file_name) AS file_name)
 FROM records r JOIN placed p USING (rec_pos)"""


def _needed(sql: str, steps: dict[str, str]) -> list[str]:
    """Steps used by a query, each after the ones it uses itself."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in steps:
            if name not in order and re.search(rf"(?:FROM|JOIN) {name}\b", text):
                visit(steps[name])
                order.append(name)

    visit(sql)
    return order


def _with_steps(sql: str, steps: dict[str, str]) -> str:
    listed = ",\n".join(f"{step} AS ({steps[step]})" for step in _needed(sql, steps))
    return f"WITH {listed}\n{sql.strip()}"


def all_oracles() -> dict[str, str]:
    queries = {name: _with_steps(sql, _STEPS) for name, sql in _RESULTS.items()}
    for name, (base, replaced) in _VARIANTS.items():
        queries[name] = _with_steps(_RESULTS[base], _STEPS | replaced)
    return queries
