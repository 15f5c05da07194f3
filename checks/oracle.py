"""The registered queries as plain SQL over the test tables."""

from __future__ import annotations

CONTENT = """
content AS (
  SELECT 1000000000 + doc_id AS id,
         '/share/corpus/documents/' || source || '/' || lang || '/doc_' || doc_id || '.txt' AS path,
         CASE WHEN doc_id % 97 = 13 THEN '' ELSE text END AS content, 'documents' AS tag
  FROM documents
  UNION ALL
  SELECT 2000000000 + page_id,
         '/share/corpus/pages/' || regexp_extract(url, '^https?://([^/]+)', 1) || '/p_' || page_id || '.html',
         html, 'pages'
  FROM pages
  UNION ALL
  SELECT 3000000000 + conv_id * 1000 + turn,
         '/share/corpus/conversations/' || conv_id || '/' || turn || '_' || role || '.msg', text, 'conversations'
  FROM conversations
  UNION ALL
  SELECT 4000000000 + item_id, '/share/corpus/benchmark/item_' || item_id || '.TXT', text, 'benchmark'
  FROM benchmark
)"""


def described(source: str) -> str:
    """Columns that follow from the path."""
    return f"""
  SELECT *, regexp_replace(path, '/[^/]*$', '') AS dir_path,
         regexp_extract(path, '([^/]*)$', 1) AS filename,
         regexp_extract(regexp_extract(path, '([^/]*)$', 1), '(\\.[^.]*)$', 1) AS file_ext,
         coalesce(string_split(trim(path, '/'), '/')[5], string_split(trim(path, '/'), '/')[-1]) AS top_folder
  FROM {source}"""


FILES = f"""{CONTENT},
plain AS (
  SELECT id, path, tag, CAST(strlen(content) AS BIGINT) AS size, md5(content) AS content_md5,
         TIMESTAMP '2024-01-01 00:00:00' + to_seconds(id % 86400) AS mtime
  FROM content
),
files AS ({described('plain')})"""

HASHED = f"""{FILES},
shared AS (SELECT size, count(*) AS file_count FROM files WHERE size > 0 GROUP BY size HAVING count(*) > 1),
hashed AS (
  SELECT f.*, CASE WHEN s.size IS NOT NULL THEN content_md5 END AS hash_value
  FROM files f LEFT JOIN shared s ON f.size = s.size
),
groups AS (
  SELECT hash_value, count(*) AS file_count, CAST(sum(size) AS BIGINT) AS total_size, min(mtime) AS first_seen
  FROM hashed WHERE hash_value IS NOT NULL GROUP BY hash_value HAVING count(*) > 1
),
sized AS (
  SELECT hash_value, size, count(*) AS file_count, size * count(*) AS total_size
  FROM hashed WHERE hash_value IS NOT NULL GROUP BY hash_value, size HAVING count(*) > 1
),
large AS (SELECT * FROM sized WHERE size >= 1024)"""


def folders_from(files: str) -> str:
    """All ancestors from three components down."""
    return f"""
  SELECT path, min(tag) AS tag, max(mtime) AS mtime,
         CAST('0x' || substr(md5(path), 1, 15) AS BIGINT) AS id,
         regexp_extract(path, '([^/]*)$', 1) AS name,
         CASE WHEN len(string_split(path, '/')) > 4 THEN regexp_replace(path, '/[^/]*$', '') END AS parent_path
  FROM (
    SELECT tag, mtime,
           array_to_string(list_slice(string_split(dir_path, '/'), 1, n), '/') AS path
    FROM {files}, range(4, 20) AS r(n)
    WHERE n <= len(string_split(dir_path, '/'))
  ) GROUP BY path"""


FOLDERS = f"""{FILES},
folders AS ({folders_from('files')})"""

HASHED_FOLDERS = f"""{HASHED},
folders AS ({folders_from('files')})"""

ROLLED = """
rolled AS (
  SELECT d.path, d.name, d.tag, d.mtime,
         (SELECT coalesce(CAST(sum(size) AS BIGINT), 0) FROM files f WHERE f.dir_path = d.path) AS size,
         (SELECT count(*) FROM files f WHERE f.dir_path = d.path) AS number_files,
         (SELECT coalesce(CAST(sum(size) AS BIGINT), 0) FROM files f WHERE starts_with(f.path, d.path || '/')) AS subtree_size,
         (SELECT count(*) FROM files f WHERE starts_with(f.path, d.path || '/')) AS subtree_files
  FROM folders d
)"""

SECOND = f"""
rescanned AS (
  SELECT id, path, size + 1 AS size, mtime + INTERVAL 1 DAY AS mtime, 'rescan' AS tag
  FROM files WHERE tag IN ('documents', 'pages')
  UNION ALL
  SELECT 5000000000 + c_custkey, '/share/corpus/extra/' || lower(c_mktsegment) || '/c_' || c_custkey || '.rec',
         CAST(strlen(c_name) AS BIGINT), TIMESTAMP '2024-01-02 00:00:00', 'extra'
  FROM customer
),
second AS ({described('rescanned')})"""

UNITS = ["KB", "MB", "GB", "TB", "PB", "EB"]


def bytes_text(size: str) -> str:
    cases = " ".join(
        f"WHEN {size} >= {1024 ** (i + 1)} THEN printf('%.1f', {size} / {float(1024 ** (i + 1))}) || ' {unit}'"
        for i, unit in reversed(list(enumerate(UNITS)))
    )
    return f"(CASE {cases} ELSE {size} || ' B' END)"


def cut(value: str, limit: int) -> str:
    longest = f"list_max(list_filter(range(0, {limit - 2}), lambda k: strlen(left({value}, k)) <= {limit - 3}))"
    return f"CASE WHEN strlen({value}) > {limit} THEN left({value}, {longest}) || '...' ELSE {value} END"


def escaped(value: str, quote: str = "&quot;", plus: bool = False) -> str:
    pairs = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', quote), ("''", "&#39;")]
    if plus:
        pairs.append(("+", "&#43;"))
    for old, new in pairs:
        value = f"replace({value}, '{old}', '{new}')"
    return value


def templated(value: str) -> str:
    return escaped(value, "&#34;", True)


def stamp(value: str) -> str:
    return f"strftime({value}, '%Y-%m-%d %H:%M:%S')"


def rfc(value: str) -> str:
    return f"strftime({value}, '%Y-%m-%dT%H:%M:%SZ')"


def with_(ctes: str, select: str) -> str:
    return f"WITH {ctes} {select}"


TOP_ALL = "row_number() OVER (ORDER BY size DESC, path) AS rank"
MEMBERS = "hashed h JOIN groups g ON h.hash_value = g.hash_value"
LARGE_MEMBERS = "hashed h JOIN large g ON h.hash_value = g.hash_value AND h.size = g.size"

SUMMARY = """
summary AS (
  SELECT count(*) AS total_files, coalesce(CAST(sum(size) AS BIGINT), 0) AS total_size,
         count(DISTINCT hash_value) AS unique_files,
         (SELECT coalesce(CAST(sum((file_count - 1) * size) AS BIGINT), 0) FROM sized) AS wasted_space,
         (SELECT coalesce(CAST(sum(file_count - 1) AS BIGINT), 0) FROM sized) AS redundant_copies,
         count(*) - count(DISTINCT hash_value) AS duplicate_files_ref,
         coalesce(CAST(sum(size) AS BIGINT) // nullif(count(*), 0), 0) AS average_file_size
  FROM hashed
)"""

TOPS = f"""
top_all AS (SELECT * FROM (SELECT *, {TOP_ALL} FROM hashed) WHERE rank <= 100),
top AS (SELECT * FROM (SELECT *, {TOP_ALL} FROM hashed WHERE size > 0) WHERE rank <= 100)"""


def line(section: int, part: int, text: str, source: str, place="0", hash_value="''", size_rank="0", path="''"):
    return (
        f"SELECT {section} AS section, CAST({place} AS BIGINT) AS place, {hash_value} AS hash_value, {part} AS part, "
        f"CAST({size_rank} AS BIGINT) AS size_rank, {path} AS path, {text} AS line {source}"
    )


def nested(page_size: int) -> str:
    return with_(HASHED, f"""
SELECT hash_value, file_count, total_size, page, string_agg(path, '; ' ORDER BY path) AS paths
FROM (
  SELECT g.hash_value, g.file_count, g.total_size, h.path,
         (row_number() OVER (PARTITION BY g.hash_value ORDER BY h.path) - 1) // {page_size} + 1 AS page
  FROM {MEMBERS}
) GROUP BY ALL""")


TAGGED_OLD = """
old_groups AS (
  SELECT hash_value, count(*) AS file_count, CAST(sum(size) AS BIGINT) AS total_size,
         min(mtime) + INTERVAL 1 DAY AS first_seen
  FROM hashed WHERE hash_value IS NOT NULL AND tag = 'documents' GROUP BY hash_value HAVING count(*) > 1
)"""


def group_upsert(first_seen: str) -> str:
    return with_(HASHED + "," + TAGGED_OLD, f"""
SELECT coalesce(n.hash_value, o.hash_value) AS hash_value, coalesce(n.file_count, o.file_count) AS file_count,
       coalesce(n.total_size, o.total_size) AS total_size, {first_seen} AS first_seen,
       CASE WHEN n.hash_value IS NULL THEN TIMESTAMP '2024-05-01 00:00:00'
            ELSE TIMESTAMP '2024-06-01 12:00:00' END AS last_updated
FROM groups n FULL JOIN old_groups o ON n.hash_value = o.hash_value""")


SCOPE = "'/share/corpus/documents/src1'"
IN_SCOPE = f"(path = {SCOPE} OR starts_with(path, {SCOPE} || '/'))"
IN_FILTER = "(starts_with(path, '/share/corpus/') AND lower(file_ext) IN ('.txt', '.msg'))"

SPELLINGS = [
    ("%Y-%m-%dT%H:%M:%S.000000123Z", 0),
    ("%Y-%m-%dT%H:%M:%S+07:00", -7 * 3600),
    ("%Y-%m-%d %H:%M:%S.0-03:30", 3 * 3600 + 1800),
    ("%Y-%m-%d %H:%M:%SZ", 0),
    ("%Y-%m-%d %H:%M:%S.000", 0),
    (" %Y-%m-%d %H:%M:%S ", 0),
    ("%Y-%m-%dT%H:%M:%S", None),
    ("%Y-%m-%d", None),
    (" ", None),
    ("bad", None),
]


def spelled(index: int, form: str, shift: int | None) -> str:
    micros = "NULL" if shift is None else f"epoch_us(mtime) + ({shift * 1000000})"
    return (
        f"SELECT id, {index} AS form, strftime(mtime, '{form}') AS value, CAST({micros} AS BIGINT) AS micros, "
        f"coalesce({micros}, epoch_us(TIMESTAMP '2024-06-01 12:00:00')) AS first_seen FROM files"
    )


def browse(shelf: str, source: str, key: str, orders: dict[str, str]) -> list[str]:
    return [
        f"SELECT '{shelf}' AS shelf, '{name}' AS browse, rank, entry FROM (SELECT {key} AS entry, "
        f"row_number() OVER (ORDER BY {order}, {key}) AS rank FROM {source}) WHERE rank <= 100"
        for name, order in orders.items()
    ]


BROWSES = [
    *browse("files", "files", "path", {
        "by_mtime": "mtime DESC",
        "by_folder_size": "dir_path, size DESC",
        "by_folder_tag_size": "dir_path, tag, size DESC",
        "by_size_mtime": "size DESC, mtime DESC",
        "by_tag": "tag",
        "by_extension": "file_ext",
    }),
    *browse("folders", "rolled", "path", {
        "by_size": "size DESC",
        "by_number_files": "number_files DESC",
        "by_subtree_size": "subtree_size DESC",
        "by_subtree_files": "subtree_files DESC",
        "by_mtime": "mtime DESC",
        "by_tag": "tag",
    }),
    *browse("groups", "groups", "hash_value", {
        "by_total_size": "total_size DESC",
        "by_file_count": "file_count DESC",
    }),
    *browse("runs", "latest", "CAST(id AS VARCHAR)", {
        "by_status": "status",
        "by_started_at": "id DESC",
    }),
]

MARKUP = "('<a href=\"' || path || '\">&''+</a>')"

CONSOLE = [
    line(0, 0, "'=== FILESYSTEM ANALYSIS REPORT ==='", ""),
    line(0, 1, "'Generated: 2024-06-01 12:00:00'", ""),
    line(1, 0, "'SUMMARY:'", ""),
    line(1, 1, "'  Total Files:     ' || total_files", "FROM summary"),
    line(1, 2, f"'  Total Size:      ' || {bytes_text('total_size')}", "FROM summary"),
    line(1, 3, "'  Unique Files:    ' || unique_files", "FROM summary"),
    line(1, 4, "'  Duplicate Files: ' || duplicate_files_ref", "FROM summary"),
    line(1, 5, f"'  Wasted Space:    ' || {bytes_text('wasted_space')}", "FROM summary"),
    line(2, 0, "'TOP ' || count(*) || ' LARGEST FILES:'", "FROM top"),
    line(2, 1, f"printf('%2d. %-50s %s', rank, {cut('path', 50)}, {bytes_text('size')})",
         "FROM top", "rank"),
    line(3, 0, "'DUPLICATE FILES (' || count(*) || ' groups):'", "FROM large"),
    line(4, 0, "printf('%2d. Hash: %s...', number, substr(hash_value, 1, 12))", "FROM numbered", "number", "hash_value"),
    line(4, 1, f"'    Size: ' || {bytes_text('size')} || ', Count: ' || file_count || ', Total: ' || {bytes_text('total_size')}",
         "FROM numbered", "number", "hash_value"),
    line(4, 2, "'    Files:'", "FROM numbered", "number", "hash_value"),
    line(4, 3, f"'      - ' || {cut('path', 46)}",
         "FROM hashed h JOIN numbered n ON h.hash_value = n.hash_value AND h.size = n.size",
         "number", "h.hash_value", "0", "path"),
]

NUMBERED = "numbered AS (SELECT *, row_number() OVER (ORDER BY size DESC, hash_value) AS number FROM large)"


def html_row(*cells: str) -> str:
    return "'<tr>' || " + " || ".join(f"'<td>' || {c} || '</td>'" for c in cells) + " || '</tr>'"


SUMMARY_ROWS = """
shown AS (
  SELECT 1 AS position, 'Total Files' AS "Metric", CAST(total_files AS VARCHAR) AS "Value" FROM summary
  UNION ALL SELECT 2, 'Total Size', {total_size} FROM summary
  UNION ALL SELECT 3, 'Unique Files', CAST(unique_files AS VARCHAR) FROM summary
  UNION ALL SELECT 4, 'Duplicate Files', CAST(duplicate_files_ref AS VARCHAR) FROM summary
  UNION ALL SELECT 5, 'Wasted Space', {wasted_space} FROM summary
  UNION ALL SELECT 6, 'Average File Size', {average_file_size} FROM summary
)""".format(**{c: bytes_text(c) for c in ("total_size", "wasted_space", "average_file_size")})

def page(title: str) -> str:
    return (f"'<!DOCTYPE html><html><head><meta charset=\"UTF-8\"><title>{title}</title></head>"
            f"<body><h1>{title}</h1>'")


def table(before: str, *headings: str) -> str:
    return "'" + before + "<table><tr>" + "".join(f"<th>{h}</th>" for h in headings) + "</tr>'"


HTML = [
    line(0, 0, page("Filesystem Analysis Report"), ""),
    line(0, 1, "'<p>Generated: 2024-06-01 12:00:00</p>'", ""),
    line(1, 0, "'<h2>Summary</h2>'", ""),
    line(2, 0, "'<div class=\"metric\">' || \"Metric\" || ': ' || \"Value\" || '</div>'",
         "FROM shown WHERE position < 6", "position"),
    line(3, 0, table("<h2>Top Largest Files</h2>", "Path", "Size", "Modified"), ""),
    line(4, 0, html_row(templated("path"), bytes_text("size"), stamp("mtime")), "FROM top", "rank"),
    line(5, 0, "'</table><h2>Duplicate Files</h2>'", ""),
    line(6, 0, f"'<h3>Hash: ' || hash_value || ' (' || file_count || ' files, ' || {bytes_text('total_size')} || ' total)</h3>' || "
               + table("", "Path", "Size", "Modified"),
         "FROM numbered", "number", "hash_value"),
    line(6, 1, html_row(templated("path"), bytes_text("h.size"), stamp("mtime")),
         "FROM hashed h JOIN numbered n ON h.hash_value = n.hash_value AND h.size = n.size",
         "number", "h.hash_value", "0", "path"),
    line(6, 2, "'</table>'", "FROM numbered", "number", "hash_value"),
    line(7, 0, "'</body></html>'", ""),
]

BASIC_CONSOLE = [
    line(1, 0, "'--- Top Largest Files ---'", ""),
    line(1, 1, "rank || '. Size: ' || printf('%-10d', size) || ' Path: ' || path", "FROM top_all", "rank"),
    line(2, 0, "'--- Duplicate Files ---'", ""),
    line(3, 0, "'Hash: ' || hash_value || ' (Count: ' || file_count || ')'", "FROM groups", "0", "hash_value"),
    line(3, 1, "'  - Size: ' || printf('%-10d', size) || ' Path: ' || path", f"FROM {MEMBERS}",
         "0", "h.hash_value", "-size", "path"),
]

BASIC_HTML = [
    line(0, 0, page("File Scan Report"), ""),
    line(0, 1, "'<p>Generated on: 2024-06-01 12:00:00</p>'", ""),
    line(1, 0, table("<h2>Top 100 Largest Files</h2>", "Rank", "Size (Bytes)", "Path", "Filename",
                     "Modified Time", "Hash Value", "Type"), ""),
    line(2, 0, html_row("rank", "size", escaped("path"), escaped("filename"), rfc("mtime"),
                        "coalesce(hash_value, '')", escaped("tag")), "FROM top_all", "rank"),
    line(3, 0, table("</table><h2>Duplicate Files</h2>", "Hash Value", "Count", "File Path", "Filename",
                     "Size (Bytes)", "Modified Time", "Type"), ""),
    line(4, 0, "'<tr class=\"hash-group\"><td colspan=\"7\">Hash: ' || hash_value || ' (Count: ' || file_count || ')</td></tr>'",
         "FROM groups", "0", "hash_value"),
    line(4, 1, html_row("''", "''", escaped("path"), escaped("filename"), "size", rfc("mtime"), escaped("tag")),
         f"FROM {MEMBERS}", "0", "h.hash_value", "-size", "path"),
    line(5, 0, "'</table></body></html>'", ""),
]

MIXED = """
mixed AS (
  SELECT id, path, size, tag, CASE WHEN id % 7 <> 0 AND id % 11 <> 0 THEN hash_value END AS hash_value,
         CASE WHEN id % 7 = 0 THEN 'cannot read ' || id % 3 END AS hash_error
  FROM hashed WHERE hash_value IS NOT NULL
)"""

FAILED = """
failed AS (
  SELECT path, tag || '-' || CASE WHEN id % 2 = 0 THEN 0 ELSE 1 END AS tag,
         CASE id % 13 WHEN 0 THEN 'stat' ELSE 'list' END AS stage,
         'gone through root ' || CASE WHEN id % 2 = 0 THEN 0 ELSE 1 END AS message
  FROM files WHERE id % 13 < 2
  UNION ALL
  SELECT path, tag, 'hash', hash_error FROM mixed WHERE hash_error IS NOT NULL
)"""

LEDGER = """
run_groups AS (
  SELECT 1 AS id, * FROM groups
  UNION ALL SELECT 2, * FROM groups WHERE hash_value > '8'
  UNION ALL
  SELECT 3, hash_value, count(*), CAST(sum(size) AS BIGINT), min(mtime)
  FROM hashed WHERE hash_value IS NOT NULL AND tag = 'documents' GROUP BY hash_value HAVING count(*) > 1
),
latest AS (
  SELECT CAST(r.id AS BIGINT) AS id, 'done' AS status, TRUE AS finished, count(hash_value) AS total_groups,
         count(hash_value) AS processed_groups, coalesce(CAST(sum(file_count) AS BIGINT), 0) AS processed_files,
         coalesce(CAST(sum(total_size) AS BIGINT), 0) AS processed_size, max(hash_value) AS last_hash_value
  FROM (SELECT unnest([1, 2, 3]) AS id) r LEFT JOIN run_groups g ON g.id = r.id GROUP BY r.id
)"""
CANDIDATES = "SELECT id, path, size FROM hashed WHERE hash_value IS NOT NULL"
HASHES = "SELECT id, path, size, hash_value, CAST(NULL AS VARCHAR) AS hash_error FROM hashed WHERE hash_value IS NOT NULL"

MEMBER_ROWS = f"""SELECT g.hash_value, g.file_count, h.id, h.path, h.filename, h.size, h.mtime, h.tag FROM {MEMBERS}"""

ORACLE = {
    "inventory_files": with_(FILES, "SELECT id, path, dir_path, filename, file_ext, size, mtime, tag, top_folder FROM files"),
    "files_by_tag": with_(FILES, "SELECT tag, count(*) AS file_count, CAST(sum(size) AS BIGINT) AS total_size FROM files GROUP BY tag"),
    "snapshot_roundtrip": with_(FILES, f"SELECT id, path, dir_path, filename, file_ext, size, {stamp('mtime')} AS mtime, FALSE AS is_duplicate, tag, top_folder FROM files"),
    "root_specs": with_(FILES, """
SELECT DISTINCT dir_path || ' : ' || tag AS spec, dir_path AS root, tag FROM files
UNION ALL
SELECT DISTINCT dir_path, dir_path, regexp_extract(dir_path, '([^/]*)$', 1) FROM files"""),
    "exclude_dirs": with_(FILES, """
SELECT id, path FROM files
WHERE NOT list_has_any(list_slice(string_split(dir_path, '/'), 5, 100), ['fr', 'src1', 'documents'])"""),
    "schema_upgrade_defaults": with_(FOLDERS + "," + ROLLED, """
SELECT path, name, tag, CASE WHEN length(path) % 2 = 0 THEN size ELSE 0 END AS size, number_files,
       CAST(0 AS BIGINT) AS subtree_size, CAST(0 AS BIGINT) AS subtree_files FROM rolled"""),
    "colliding_ids": with_(FILES, """
SELECT CAST('0x' || substr(md5(path), 1, 4) AS BIGINT) AS id, count(*) AS paths
FROM files GROUP BY 1 HAVING count(*) > 1"""),
    "lookup_by_ids": with_(FILES, "SELECT id, path FROM files WHERE id IN (SELECT doc_id + 1000000000 FROM labels)"),
    "parse_times": with_(FILES, " UNION ALL ".join(spelled(i, f, s) for i, (f, s) in enumerate(SPELLINGS))),
    "candidate_sizes": with_(HASHED, "SELECT size, file_count FROM shared"),
    "candidate_files": with_(HASHED, CANDIDATES),
    "candidate_files_salted": with_(HASHED, CANDIDATES),
    "candidate_count": with_(HASHED, "SELECT count(*) AS candidates FROM hashed WHERE hash_value IS NOT NULL"),
    "candidates_incremental": with_(HASHED + "," + SECOND, """
, merged AS (
  SELECT coalesce(o.path, n.path) AS path, coalesce(n.size, o.size) AS size, o.hash_value
  FROM hashed o FULL JOIN second n ON o.path = n.path
)
SELECT path, size FROM merged
WHERE size > 0 AND hash_value IS NULL
  AND size IN (SELECT size FROM merged WHERE size > 0 GROUP BY size HAVING count(*) > 1)"""),
    "hashed_files": with_(HASHED, HASHES),
    "hashed_files_listed": with_(HASHED, HASHES),
    "hashed_files_unbounded": with_(HASHED, HASHES),
    "hash_write_back": with_(HASHED, "SELECT id, path, size, hash_value FROM hashed"),
    "hash_outcomes": with_(HASHED + "," + MIXED, """
SELECT count(*) AS processed, count(hash_value) AS success, count(*) - count(hash_value) AS errors,
       coalesce(CAST(sum(size) AS BIGINT), 0) AS bytes,
       CASE WHEN count(*) > 0 THEN round(100.0::DOUBLE * count(hash_value) / count(*), 2) ELSE 0.0::DOUBLE END AS success_percent
FROM mixed"""),
    "scan_errors": with_(HASHED + "," + MIXED + "," + FAILED, "SELECT * FROM failed"),
    "scan_error_counts": with_(HASHED + "," + MIXED + "," + FAILED, """
SELECT tag, stage, count(*) AS errors, min(path) AS first_path FROM failed GROUP BY tag, stage"""),
    "hash_bin_loads": with_(HASHED + """, loads AS (SELECT path, id, size + 65536 AS load FROM hashed WHERE hash_value IS NOT NULL),
placed AS (
  SELECT load, row_number() OVER w - 1 AS place,
         coalesce(sum(CASE WHEN load < 524288 THEN load END) OVER w, 0) - load AS before
  FROM loads WINDOW w AS (ORDER BY load DESC, path, id ROWS UNBOUNDED PRECEDING)
)""", """
SELECT CAST(CASE WHEN load >= 524288 THEN place
                 ELSE (SELECT count(*) FROM loads WHERE load >= 524288) + before // 524288 END AS INTEGER) AS bin,
       count(*) AS files, CAST(sum(load) AS BIGINT) AS load, max(load) AS largest
FROM placed GROUP BY 1"""),
    "duplicate_groups": with_(HASHED, "SELECT * FROM groups"),
    "duplicate_totals": with_(HASHED, """
SELECT count(*) AS groups, coalesce(CAST(sum(file_count) AS BIGINT), 0) AS files,
       coalesce(CAST(sum(total_size) AS BIGINT), 0) AS total_size,
       round(CAST(sum(total_size) AS DOUBLE) / 1048576, 4) AS size_mb,
       round(CAST(sum(total_size) AS DOUBLE) / 1073741824, 6) AS size_gb
FROM groups"""),
    "duplicate_groups_after": with_(HASHED, "SELECT * FROM groups WHERE hash_value > '8'"),
    "duplicate_group_count_after": with_(HASHED, "SELECT count(*) AS groups FROM groups WHERE hash_value > '8'"),
    "duplicate_groups_min_size": with_(HASHED, "SELECT * FROM large"),
    "duplicate_group_ids": with_(HASHED, f"""
SELECT g.hash_value, g.size, g.file_count, g.total_size, CAST(1 AS BIGINT) AS page,
       string_agg(CAST(h.id AS VARCHAR), ',' ORDER BY h.id) AS ids
FROM {LARGE_MEMBERS} GROUP BY ALL"""),
    "duplicate_members": with_(HASHED, MEMBER_ROWS),
    "duplicate_members_salted": with_(HASHED, MEMBER_ROWS),
    "duplicate_members_nested": nested(1000),
    "duplicate_members_paged": nested(2),
    "flagged_files": with_(HASHED, "SELECT id, path, coalesce(hash_value IN (SELECT hash_value FROM groups), FALSE) AS is_duplicate FROM hashed"),
    "flagged_files_after": with_(HASHED, "SELECT id, path, coalesce(hash_value IN (SELECT hash_value FROM groups WHERE hash_value > '8'), FALSE) AS is_duplicate FROM hashed"),
    "reset_flags": with_(FILES, "SELECT id, path, FALSE AS is_duplicate FROM files"),
    "upsert_groups_scan": group_upsert("coalesce(o.first_seen, n.first_seen)"),
    "upsert_groups_rebuild": group_upsert("coalesce(n.first_seen, o.first_seen)"),
    "rebuild_ranges": with_(HASHED, """
SELECT CAST(n AS INTEGER) AS range, count(hash_value) AS groups, coalesce(CAST(sum(file_count) AS BIGINT), 0) AS files,
       coalesce(CAST(sum(total_size) AS BIGINT), 0) AS size, max(hash_value) AS last_hash_value
FROM range(16) AS r(n) LEFT JOIN (SELECT * FROM groups WHERE hash_value > '8') g
  ON substr(hash_value, 1, 1) = printf('%x', n) GROUP BY n"""),
    "run_ledger_latest": with_(HASHED + "," + LEDGER, "SELECT * FROM latest"),
    "upsert_files": with_(HASHED + "," + SECOND, """
SELECT coalesce(o.id, n.id) AS id, coalesce(o.path, n.path) AS path, coalesce(o.dir_path, n.dir_path) AS dir_path,
       coalesce(o.filename, n.filename) AS filename, coalesce(o.file_ext, n.file_ext) AS file_ext,
       coalesce(n.size, o.size) AS size, coalesce(n.mtime, o.mtime) AS mtime, o.hash_value, FALSE AS is_duplicate,
       coalesce(o.tag, n.tag) AS tag, coalesce(o.top_folder, n.top_folder) AS top_folder
FROM hashed o FULL JOIN second n ON o.path = n.path"""),
    "stale_hashes": with_(HASHED + "," + SECOND, """
SELECT id, path, size,
       CASE WHEN NOT EXISTS (SELECT 1 FROM second s WHERE s.path = h.path AND (s.size <> h.size OR s.mtime <> h.mtime))
            THEN hash_value END AS hash_value
FROM hashed h"""),
    "upsert_folders": with_(FOLDERS + "," + SECOND + ", extra AS (" + folders_from("(SELECT * FROM second WHERE tag = 'extra')") + ")", """
SELECT id, CASE WHEN tag <> 'pages' AND parent_path IS NOT NULL
                THEN CAST('0x' || substr(md5(parent_path), 1, 15) AS BIGINT) END AS parent_id,
       path, name, CASE WHEN tag = 'pages' THEN mtime + INTERVAL 1 DAY ELSE mtime END AS mtime, tag
FROM folders
UNION ALL
SELECT id, CASE WHEN parent_path IS NOT NULL THEN CAST('0x' || substr(md5(parent_path), 1, 15) AS BIGINT) END,
       path, name, mtime, tag
FROM extra"""),
    "top_files_all": with_(HASHED + "," + TOPS, "SELECT rank, id, path, filename, size, mtime, hash_value, tag FROM top_all"),
    "top_files_nonempty": with_(HASHED + "," + TOPS, "SELECT rank, id, path, size, mtime, tag, top_folder FROM top"),
    "top_files_large_limit": with_(FILES, """
SELECT rank, id, path, size FROM (SELECT *, row_number() OVER (ORDER BY size DESC, path) AS rank FROM files) WHERE rank <= 1500"""),
    "report_summary": with_(HASHED + "," + SUMMARY, "SELECT * FROM summary"),
    "wasted_space": with_(HASHED, "SELECT coalesce(CAST(sum((file_count - 1) * size) AS BIGINT), 0) AS wasted_space FROM sized"),
    "scalar_texts": with_(FILES, f"""
SELECT id, {bytes_text('size')} AS size_text, {bytes_text('(size * size * 1024)')} AS big_text,
       {cut('path', 40)} AS short_path, '/ñandú/文書/...' AS wide_path, '/ñandú/文...' AS wider_path, {escaped(MARKUP)} AS plain_html, {templated(MARKUP)} AS template_html,
       {stamp('mtime')} AS time_text, {rfc('mtime')} AS rfc3339,
       round(size * 100.0::DOUBLE / (size + 1000), 6) AS share,
       CASE WHEN id % 60 > 0 THEN round(CAST(size AS DOUBLE) / (id % 60), 6) ELSE 0.0 END AS rate,
       CASE WHEN size > 0 THEN round(60000.0::DOUBLE / size, 6) END AS eta,
       lower(file_ext) || ',.' || tag AS exts
FROM files"""),
    "report_console_basic": with_(HASHED + "," + TOPS, " UNION ALL ".join(BASIC_CONSOLE)),
    "report_html_basic": with_(HASHED + "," + TOPS, " UNION ALL ".join(BASIC_HTML)),
    "report_sheet_basic_top": with_(HASHED + "," + TOPS, f"""
SELECT rank AS "Rank", size AS "Size (Bytes)", path AS "Path", filename AS "Filename",
       {rfc('mtime')} AS "Modified Time", coalesce(hash_value, '') AS "Hash Value", tag AS "Type" FROM top_all"""),
    "report_sheet_basic_duplicates": with_(HASHED, f"""
SELECT g.hash_value AS "Hash Value", g.file_count AS "Count", path AS "File Path", filename AS "Filename",
       size AS "Size (Bytes)", {rfc('mtime')} AS "Modified Time", tag AS "Type" FROM {MEMBERS}"""),
    "report_rows_console": with_(HASHED + "," + SUMMARY + "," + TOPS + "," + NUMBERED, " UNION ALL ".join(CONSOLE)),
    "report_rows_html": with_(HASHED + "," + SUMMARY + "," + SUMMARY_ROWS + "," + TOPS + "," + NUMBERED, " UNION ALL ".join(HTML)),
    "report_rows_sheet": with_(HASHED, f"""
SELECT g.hash_value AS "Hash", g.size AS "Size", g.file_count AS "Count", g.total_size AS "Total Size",
       CAST(1 AS BIGINT) AS "Page", string_agg(path, '; ' ORDER BY path) AS "Files"
FROM {LARGE_MEMBERS} GROUP BY ALL"""),
    "report_sheet_summary": with_(HASHED + "," + SUMMARY + "," + SUMMARY_ROWS, "SELECT * FROM shown"),
    "report_sheet_top": with_(HASHED + "," + TOPS, f"""
SELECT id AS "ID", path AS "Path", size AS "Size", {stamp('mtime')} AS "Modified", tag AS "Type",
       top_folder AS "Folder" FROM top"""),
    "report_json": with_(HASHED + "," + SUMMARY + "," + TOPS, f"""
SELECT CAST(to_json(struct_pack(
         "topFiles" := coalesce((SELECT list(struct_pack(id := id, path := path, size := size, mtime := {stamp('mtime')},
                                                         loaithumuc := tag, thumuc := top_folder) ORDER BY rank)
                                 FROM top), []),
         summary := struct_pack(totalFiles := total_files, totalSize := total_size, uniqueFiles := unique_files,
                                duplicateFiles := duplicate_files_ref, wastedSpace := wasted_space,
                                averageFileSize := average_file_size),
         metrics := struct_pack(totalFiles := total_files, totalSize := total_size,
                                duplicateFiles := duplicate_files_ref, duplicateSize := wasted_space),
         generatedAt := '2024-06-01T12:00:00.000Z')) AS VARCHAR) AS document
FROM summary"""),
    "report_json_top": with_(HASHED + "," + TOPS, f"""
SELECT CAST(to_json(struct_pack(rank := rank, id := id, path := path, size := size, mtime := {stamp('mtime')},
                                loaithumuc := tag, thumuc := top_folder)) AS VARCHAR) AS document FROM top"""),
    "report_json_groups": with_(HASHED, f"""
SELECT CAST(to_json(struct_pack(
         hash := g.hash_value, size := g.size, count := g.file_count,
         files := list(struct_pack(id := h.id, path := h.path, size := h.size, mtime := {stamp('h.mtime')},
                                   loaithumuc := h.tag, thumuc := h.top_folder) ORDER BY h.path),
         "totalSize" := g.total_size, page := 1)) AS VARCHAR) AS document
FROM {LARGE_MEMBERS} GROUP BY g.hash_value, g.size, g.file_count, g.total_size"""),
    "browse_orders": with_(HASHED_FOLDERS + "," + ROLLED + "," + LEDGER, " UNION ALL ".join(BROWSES)),
    "scope_files": with_(FILES, f"SELECT id, path FROM files WHERE {IN_SCOPE}"),
    "scope_files_like": with_(FILES, "SELECT id, path FROM files WHERE path ILIKE '/SHARE/corpus/doc_ments/%'"),
    "scope_folders": with_(FOLDERS, f"SELECT id, path FROM folders WHERE {IN_SCOPE}"),
    "scope_counts": with_(FOLDERS, f"""
SELECT (SELECT count(*) FROM folders WHERE {IN_SCOPE}) AS folders,
       (SELECT count(*) FROM files WHERE {IN_SCOPE}) AS files"""),
    "delete_scope_remaining": with_(FILES, f"SELECT id, path, size FROM files WHERE NOT {IN_SCOPE}"),
    "delete_scope_remaining_folders": with_(FOLDERS, f"SELECT id, path FROM folders WHERE NOT {IN_SCOPE}"),
    "delete_filter_selection": with_(FILES, f"SELECT id, path FROM files WHERE {IN_FILTER}"),
    "delete_filter_limited_large": with_(FILES, "SELECT id, path FROM files WHERE starts_with(path, '/share/corpus/') ORDER BY id LIMIT 1200"),
    "delete_filter_limited": with_(FILES, f"SELECT id, path FROM files WHERE {IN_FILTER} ORDER BY id LIMIT 500"),
    "delete_size_zero_selection": with_(FILES, "SELECT id, path FROM files WHERE size = 0"),
    "delete_filter_remaining": with_(FILES, f"SELECT id, path, size FROM files WHERE NOT {IN_FILTER}"),
    "delete_filter_remaining_direct": with_(FILES, f"SELECT id, path, size FROM files WHERE NOT {IN_FILTER}"),
    "delete_dry_run_outcomes": with_(FILES, f"""
SELECT count(*) AS db_deleted, CAST(0 AS BIGINT) AS disk_deleted, CAST(0 AS BIGINT) AS errors
FROM files WHERE {IN_FILTER}"""),
    "delete_outcomes": with_(FILES, f"""
SELECT count(*) FILTER (id % 5 = 0 OR id % 7 <> 0) AS db_deleted, count(*) FILTER (id % 5 <> 0 AND id % 7 <> 0) AS disk_deleted,
       count(*) FILTER (id % 5 <> 0 AND id % 7 = 0) AS errors
FROM files WHERE {IN_FILTER}"""),
    "delete_purged_remaining": with_(FILES, f"""
SELECT id, path, size FROM files WHERE NOT ({IN_FILTER} AND (id % 5 = 0 OR id % 7 <> 0))"""),
    "deletion_list": with_(FOLDERS, f"""
SELECT 'folder' AS type, id, path FROM folders WHERE {IN_SCOPE}
UNION ALL SELECT 'file', id, path FROM files WHERE {IN_SCOPE}"""),
    "deletion_list_csv": with_(FOLDERS, f"""
SELECT 'folder' AS type, id, path FROM folders WHERE {IN_SCOPE}
UNION ALL SELECT 'file', id, path FROM files WHERE {IN_SCOPE}"""),
    "folders_table": with_(FOLDERS, """
SELECT d.id, d.path, d.name, d.tag, p.path AS parent_path, p.name AS parent_name
FROM folders d LEFT JOIN folders p ON d.parent_path = p.path"""),
    "folder_rollup_direct": with_(FOLDERS + "," + ROLLED, "SELECT path, size, number_files FROM rolled"),
    "folder_rollup_subtree": with_(FOLDERS + "," + ROLLED, "SELECT path, subtree_size, subtree_files FROM rolled"),
    "files_in_folders": with_(FOLDERS, """
SELECT f.id, f.path, d.id AS folder_row_id, d.name AS folder_name,
       count(*) OVER (PARTITION BY f.dir_path) AS file_count
FROM files f JOIN folders d ON f.dir_path = d.path"""),
    "files_without_folder": with_(FOLDERS + "," + SECOND, """
SELECT dir_path, count(*) AS file_count FROM second
WHERE dir_path NOT IN (SELECT path FROM folders) GROUP BY dir_path"""),
    "duplicate_waste": with_(HASHED, "SELECT *, (file_count - 1) * size AS wasted FROM sized"),
}
