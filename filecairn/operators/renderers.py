"""Report output: sheet tables, console lines, HTML rows, JSON documents.

Line frames carry the columns to sort by and a ``line``; ``write_lines`` writes them
in that order. Only the small, bounded parts (summary, top-N) sit in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filecairn.functions.text import (
    TEMPLATE_ESCAPES,
    escape_html,
    format_bytes,
    hash_prefix,
    rfc3339_text,
    time_text,
    truncate,
)
from filecairn.plans.ordering import positions

# Sort columns of every line frame.
LINE_ORDER = ["section", "place", "hash_value", "part", "size_rank", "path"]


def _lines(df: DataFrame, section: int, parts: dict[int, Column], **keys: Column) -> DataFrame:
    """Line frame with one line per part for each row; absent sort columns are neutral.

    All parts come from one pass over the rows.
    """
    neutral = {
        "place": F.lit(0).cast("long"),
        "hash_value": F.lit(""),
        "size_rank": F.lit(0).cast("long"),
        "path": F.lit(""),
    }
    keyed = {"section": F.lit(section), **neutral, **keys}
    texts = F.array(*[F.struct(F.lit(n).alias("part"), text.alias("line")) for n, text in parts.items()])
    # The texts come first and the sort columns under private names: an alias such as ``path`` beside
    # them would be taken for the input column inside a lambda.
    rows = df.select(texts.alias("_texts"), *[c.alias("_key_" + n) for n, c in keyed.items()])
    named = rows.select(*[F.col("_key_" + n).alias(n) for n in keyed], F.inline("_texts"))
    return named.select(*LINE_ORDER, "line")


def _line(df: DataFrame, section: int, part: int, line: Column, **keys: Column) -> DataFrame:
    return _lines(df, section, {part: line}, **keys)


def _text(df: DataFrame, section: int, part: int, text: str) -> DataFrame:
    one = df.sparkSession.range(1)
    return _line(one, section, part, F.lit(text))


def _stack(frames: list[DataFrame]) -> DataFrame:
    stacked = frames[0]
    for frame in frames[1:]:
        stacked = stacked.unionByName(frame)
    return stacked


def write_lines(lines: DataFrame, path: str) -> None:
    """Lines in report order as text part files."""
    lines.orderBy(*LINE_ORDER).select("line").write.mode("errorifexists").text(path)


# Sheet tables. Headings are fixed values of the report formats.


def basic_top_sheet(top: DataFrame) -> DataFrame:
    return top.select(
        F.col("rank").alias("Rank"),
        F.col("size").alias("Size (Bytes)"),
        F.col("path").alias("Path"),
        F.col("filename").alias("Filename"),
        rfc3339_text(F.col("mtime")).alias("Modified Time"),
        F.coalesce("hash_value", F.lit("")).alias("Hash Value"),
        F.col("tag").alias("Type"),
    )


def basic_duplicate_sheet(members: DataFrame) -> DataFrame:
    return members.select(
        F.col("hash_value").alias("Hash Value"),
        F.col("file_count").alias("Count"),
        F.col("path").alias("File Path"),
        F.col("filename").alias("Filename"),
        F.col("size").alias("Size (Bytes)"),
        rfc3339_text(F.col("mtime")).alias("Modified Time"),
        F.col("tag").alias("Type"),
    )


def summary_sheet(summary: DataFrame, generated_at: Column | None = None) -> DataFrame:
    """Metric and value rows in display order."""
    # Labels of the summary, in order.
    cells = [
        ("Total Files", F.col("total_files").cast("string")),
        ("Total Size", format_bytes(F.col("total_size"))),
        ("Unique Files", F.col("unique_files").cast("string")),
        ("Duplicate Files", F.col("duplicate_files_ref").cast("string")),
        ("Wasted Space", format_bytes(F.col("wasted_space"))),
        ("Average File Size", format_bytes(F.col("average_file_size"))),
    ]
    if generated_at is not None:
        cells.insert(0, ("Generated At", time_text(generated_at)))
    rows = [
        F.struct(F.lit(i).alias("position"), F.lit(n).alias("Metric"), v.alias("Value"))
        for i, (n, v) in enumerate(cells, start=1)
    ]
    return summary.select(F.inline(F.array(*rows)))


def summary_top_sheet(top: DataFrame) -> DataFrame:
    return top.select(
        F.col("id").alias("ID"),
        F.col("path").alias("Path"),
        F.col("size").alias("Size"),
        time_text(F.col("mtime")).alias("Modified"),
        F.col("tag").alias("Type"),
        F.col("top_folder").alias("Folder"),
    )


def summary_duplicate_sheet(nested: DataFrame) -> DataFrame:
    """One row per group with its paths joined; large groups go on in further pages."""
    return nested.select(
        F.col("hash_value").alias("Hash"),
        F.col("size").alias("Size"),
        F.col("file_count").alias("Count"),
        F.col("total_size").alias("Total Size"),
        F.col("page").alias("Page"),
        F.array_join(F.col("files.path"), "; ").alias("Files"),
    )


# Console lines. Their texts are fixed values of the report formats.


def basic_console(top: DataFrame, groups: DataFrame, members: DataFrame) -> DataFrame:
    """Largest files, then each group by hash with its files."""
    sized = F.format_string("%-10d", F.col("size"))
    return _stack([
        _text(top, 1, 0, "--- Top Largest Files ---"),
        _line(
            top, 1, 1,
            F.concat(F.col("rank").cast("string"), F.lit(". Size: "), sized, F.lit(" Path: "), F.col("path")),
            place=F.col("rank"),
        ),
        _text(top, 2, 0, "--- Duplicate Files ---"),
        _line(
            groups, 3, 0,
            F.format_string("Hash: %s (Count: %d)", "hash_value", "file_count"),
            hash_value=F.col("hash_value"),
        ),
        _line(
            members, 3, 1,
            F.concat(F.lit("  - Size: "), sized, F.lit(" Path: "), F.col("path")),
            hash_value=F.col("hash_value"), size_rank=-F.col("size"), path=F.col("path"),
        ),
    ])


def numbered_groups(groups: DataFrame) -> DataFrame:
    """Groups by size descending with their 1-based number."""
    return positions(groups, [F.desc("size"), F.asc("hash_value")], "number")


def summary_console(
    summary: DataFrame,
    top: DataFrame,
    groups: DataFrame,
    members: DataFrame,
    generated_at: Column | None = None,
) -> DataFrame:
    """Summary, largest files and numbered groups with their files in path order.

    ``groups`` are numbered groups by hash and size, ``members`` their files.
    """
    counted = lambda label, c: F.format_string(f"  {label:<16} %d", c)
    spaced = lambda label, c: F.format_string(f"  {label:<16} %s", format_bytes(F.col(c)))
    figures = {
        0: F.lit("SUMMARY:"),
        1: counted("Total Files:", "total_files"),
        2: spaced("Total Size:", "total_size"),
        3: counted("Unique Files:", "unique_files"),
        4: counted("Duplicate Files:", "duplicate_files_ref"),
        5: spaced("Wasted Space:", "wasted_space"),
    }
    place = dict(place=F.col("number"), hash_value=F.col("hash_value"))
    dated = []
    if generated_at is not None:
        one = summary.sparkSession.range(1)
        dated = [_line(one, 0, 1, F.concat(F.lit("Generated: "), time_text(generated_at)))]
    return _stack([
        _text(summary, 0, 0, "=== FILESYSTEM ANALYSIS REPORT ==="),
        *dated,
        _lines(summary, 1, figures),
        _line(top.agg(F.count("*").alias("n")), 2, 0, F.format_string("TOP %d LARGEST FILES:", "n")),
        _line(
            top, 2, 1,
            F.format_string(
                "%2d. %-50s %s", F.col("rank"), truncate(F.col("path"), 50), format_bytes(F.col("size"))
            ),
            place=F.col("rank"),
        ),
        _line(
            groups.agg(F.count("*").alias("n")), 3, 0,
            F.format_string("DUPLICATE FILES (%d groups):", "n"),
        ),
        _lines(
            groups, 4,
            {
                0: F.format_string("%2d. Hash: %s", F.col("number"), hash_prefix(F.col("hash_value"))),
                1: F.format_string(
                    "    Size: %s, Count: %d, Total: %s",
                    format_bytes(F.col("size")), F.col("file_count"), format_bytes(F.col("total_size")),
                ),
                2: F.lit("    Files:"),
            },
            **place,
        ),
        _line(
            members, 4, 3, F.concat(F.lit("      - "), truncate(F.col("path"), 46)),
            **place, path=F.col("path"),
        ),
    ])


# HTML pages. Titles and headings are fixed values of the report formats.
BASIC_TOP_HEADINGS = ["Rank", "Size (Bytes)", "Path", "Filename", "Modified Time", "Hash Value", "Type"]
BASIC_DUPLICATE_HEADINGS = ["Hash Value", "Count", "File Path", "Filename", "Size (Bytes)", "Modified Time", "Type"]
SUMMARY_HEADINGS = ["Path", "Size", "Modified"]


def _row(*cells: Column) -> Column:
    opened = [F.concat(F.lit("<td>"), c.cast("string"), F.lit("</td>")) for c in cells]
    return F.concat(F.lit("<tr>"), *opened, F.lit("</tr>"))


def _page_start(title: str) -> str:
    return (
        f'<!DOCTYPE html><html><head><meta charset="UTF-8"><title>{title}</title></head>'
        f"<body><h1>{title}</h1>"
    )


def _table_start(headings: list[str]) -> str:
    return "<table><tr>" + "".join(f"<th>{h}</th>" for h in headings) + "</tr>"


def _generated(one: DataFrame, label: str, at: Column | None) -> list[DataFrame]:
    """The line that says when a page was made, if that is known."""
    if at is None:
        return []
    return [_line(one.sparkSession.range(1), 0, 1, F.concat(F.lit(f"<p>{label}: "), time_text(at), F.lit("</p>")))]


def basic_html(
    top: DataFrame, groups: DataFrame, members: DataFrame, top_n: int, generated_at: Column | None = None
) -> DataFrame:
    """Page of two 7-column tables; all text escaped."""
    text = lambda c: escape_html(F.col(c))
    when = rfc3339_text(F.col("mtime"))
    blank = F.lit("")
    return _stack([
        _text(top, 0, 0, _page_start("File Scan Report")),
        *_generated(top, "Generated on", generated_at),
        _text(top, 1, 0, f"<h2>Top {top_n} Largest Files</h2>" + _table_start(BASIC_TOP_HEADINGS)),
        _line(
            top, 2, 0,
            _row(
                F.col("rank"), F.col("size"), text("path"), text("filename"), when,
                F.coalesce("hash_value", blank), text("tag"),
            ),
            place=F.col("rank"),
        ),
        _text(top, 3, 0, "</table><h2>Duplicate Files</h2>" + _table_start(BASIC_DUPLICATE_HEADINGS)),
        _line(
            groups, 4, 0,
            F.format_string(
                '<tr class="hash-group"><td colspan="7">Hash: %s (Count: %d)</td></tr>',
                text("hash_value"), F.col("file_count"),
            ),
            hash_value=F.col("hash_value"),
        ),
        _line(
            members, 4, 1,
            _row(blank, blank, text("path"), text("filename"), F.col("size"), when, text("tag")),
            hash_value=F.col("hash_value"), size_rank=-F.col("size"), path=F.col("path"),
        ),
        _text(top, 5, 0, "</table></body></html>"),
    ])


def summary_html(
    summary: DataFrame, top: DataFrame, groups: DataFrame, members: DataFrame, generated_at: Column | None = None
) -> DataFrame:
    """Page with the summary figures, the largest files, and a table for each group.

    ``groups`` are numbered groups by hash and size, ``members`` their files.
    """
    text = lambda c: escape_html(F.col(c), TEMPLATE_ESCAPES)
    when = time_text(F.col("mtime"))
    metric = F.concat(
        F.lit('<div class="metric">'), F.col("Metric"), F.lit(": "), F.col("Value"), F.lit("</div>")
    )
    place = dict(place=F.col("number"), hash_value=F.col("hash_value"))
    return _stack([
        _text(summary, 0, 0, _page_start("Filesystem Analysis Report")),
        *_generated(summary, "Generated", generated_at),
        _text(summary, 1, 0, "<h2>Summary</h2>"),
        _line(
            summary_sheet(summary).filter(F.col("Metric") != "Average File Size"), 2, 0, metric,
            place=F.col("position").cast("long"),
        ),
        _text(summary, 3, 0, "<h2>Top Largest Files</h2>" + _table_start(SUMMARY_HEADINGS)),
        _line(top, 4, 0, _row(text("path"), format_bytes(F.col("size")), when), place=F.col("rank")),
        _text(summary, 5, 0, "</table><h2>Duplicate Files</h2>"),
        _lines(
            groups, 6,
            {
                0: F.concat(
                    F.format_string(
                        "<h3>Hash: %s (%d files, %s total)</h3>",
                        text("hash_value"), F.col("file_count"), format_bytes(F.col("total_size")),
                    ),
                    F.lit(_table_start(SUMMARY_HEADINGS)),
                ),
                2: F.lit("</table>"),
            },
            **place,
        ),
        _line(
            members, 6, 1, _row(text("path"), format_bytes(F.col("size")), when), **place, path=F.col("path")
        ),
        _text(summary, 7, 0, "</body></html>"),
    ])


# JSON documents. Key names are fixed values of the report format.


def _json_file() -> Column:
    return F.struct(
        "id", "path", "size", time_text(F.col("mtime")).alias("mtime"),
        F.col("tag").alias("loaithumuc"), F.col("top_folder").alias("thumuc"),
    )


def json_top_files(top: DataFrame) -> DataFrame:
    """One document per top file."""
    return top.select("rank", _json_file().alias("file")).select("rank", "file.*")


def json_head(summary: DataFrame, top: DataFrame, generated_at: Column) -> DataFrame:
    """One document: the top files in rank order, summary, metrics and when the report was made."""
    ranked = F.sort_array(F.collect_list(F.struct("rank", _json_file().alias("file"))))
    files = top.agg(F.transform(ranked, lambda r: r["file"]).alias("topFiles"))
    return json_summary(summary, generated_at).select(files.scalar().alias("topFiles"), "*")


def json_summary(summary: DataFrame, generated_at: Column | None = None) -> DataFrame:
    """One document: summary, metrics and, if it is known, when the report was made."""
    shown = F.struct(
        F.col("total_files").alias("totalFiles"),
        F.col("total_size").alias("totalSize"),
        F.col("unique_files").alias("uniqueFiles"),
        F.col("duplicate_files_ref").alias("duplicateFiles"),
        F.col("wasted_space").alias("wastedSpace"),
        F.col("average_file_size").alias("averageFileSize"),
    )
    metrics = F.struct(
        F.col("total_files").alias("totalFiles"),
        F.col("total_size").alias("totalSize"),
        F.col("duplicate_files_ref").alias("duplicateFiles"),
        F.col("wasted_space").alias("duplicateSize"),
    )
    made = [] if generated_at is None else [generated_at.alias("generatedAt")]
    return summary.select(shown.alias("summary"), metrics.alias("metrics"), *made)


def json_groups(nested: DataFrame) -> DataFrame:
    """One document per group (or page of a large group), files in path order."""
    files = F.transform(
        "files",
        lambda f: F.struct(
            f["id"].alias("id"), f["path"].alias("path"), f["size"].alias("size"),
            time_text(f["mtime"]).alias("mtime"),
            f["tag"].alias("loaithumuc"), f["top_folder"].alias("thumuc"),
        ),
    )
    return nested.select(
        F.col("hash_value").alias("hash"), "size", F.col("file_count").alias("count"),
        files.alias("files"), F.col("total_size").alias("totalSize"), "page",
    )
