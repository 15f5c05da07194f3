"""Boundary rows of the scalar functions."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from filecairn.functions import paths, text, times


def values(spark, inputs, column):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, v string")
    return [r[0] for r in rows.orderBy("i").select(column(F.col("v"))).collect()]


def longs(spark, inputs, column):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, v bigint")
    return [r[0] for r in rows.orderBy("i").select(column(F.col("v"))).collect()]


def test_extension(spark):
    given_names = ["a.tar.gz", ".bashrc", "no", "a.", "x.TXT"]
    assert values(spark, given_names, paths.extension) == [".gz", ".bashrc", "", ".", ".TXT"]


def test_parent_and_name(spark):
    given_paths = ["/a/b/c.txt", "/c.txt", "/a/.b"]
    assert values(spark, given_paths, paths.parent_dir) == ["/a/b", "/", "/a"]
    assert values(spark, given_paths, paths.base_name) == ["c.txt", "c.txt", ".b"]


def test_top_folder(spark):
    given_paths = ["/share/ZFS20/Phong/x/y/z.txt", "/a/b.txt", "/", "//a//"]
    assert values(spark, given_paths, paths.top_folder) == ["y", "b.txt", "", "a"]


def test_ancestors(spark):
    got = values(spark, ["/a/b/c", "/a", "/a/b"], lambda c: paths.ancestors(c, 2))
    assert got == [["/a/b", "/a/b/c"], ["/a"], ["/a/b"]]


def test_format_bytes(spark):
    sizes = [0, 1023, 1024, 1280, 1536, 1048575, 5368709120, 9223372036854775807]
    assert longs(spark, sizes, text.format_bytes) == [
        "0 B", "1023 B", "1.0 KB", "1.2 KB", "1.5 KB", "1024.0 KB", "5.0 GB", "8.0 EB",
    ]


def test_format_bytes_rounds_like_c_printf(spark):
    sizes = list(range(1024, 1024 * 20, 7)) + [1024 * k + 128 * j for k in range(1, 9) for j in range(8)]
    assert longs(spark, sizes, text.format_bytes) == ["%.1f KB" % (s / 1024) for s in sizes]


def test_escapes(spark):
    assert values(spark, ["<a href=\"x\">&'</a>"], text.escape_html) == [
        "&lt;a href=&quot;x&quot;&gt;&amp;&#39;&lt;/a&gt;"
    ]
    assert values(spark, ["\"+'"], lambda c: text.escape_html(c, text.TEMPLATE_ESCAPES)) == ["&#34;&#43;&#39;"]


def test_truncate(spark):
    given_text = ["abcdefgh", "abcdefghi", "ééééé"]
    assert values(spark, given_text, lambda c: text.truncate(c, 8)) == ["abcdefgh", "abcde...", "éé..."]


def test_hash_prefix(spark):
    assert values(spark, ["0123456789abcdef"], text.hash_prefix) == ["0123456789ab..."]


def test_parse_time(spark):
    day = 1704153600000000
    cases = {
        "2024-01-02T03:04:05.123456789Z": day + 11045123456,
        "2024-01-02T03:04:05Z": day + 11045000000,
        "2024-01-02 03:04:05.5+07:00": day + 11045500000 - 7 * 3600 * 1000000,
        "2024-01-02 03:04:05Z": day + 11045000000,
        " 2024-01-02 03:04:05 ": day + 11045000000,
        "2024-01-02 03:04:05.25": day + 11045250000,
        "2024-01-02 3:04:05": day + 11045000000,
        "2024-01-02 03:04:05,25": day + 11045250000,
        "2024-01-02T03:04:05": None,
        "2024-01-02": None,
        "2024-13-02 03:04:05": None,
        "": None,
        "  ": None,
        "bad": None,
    }
    got = values(spark, list(cases), lambda c: F.unix_micros(times.parse_time(c)))
    assert dict(zip(cases, got)) == cases


def test_parse_time_ignores_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        got = values(spark, ["1970-01-01 00:00:01"], lambda c: F.unix_micros(times.parse_time(c)))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == [1000000]


def test_normalize_extensions(spark):
    assert paths.normalize_extensions(" .TMP, log,,.log ") == [".tmp", ".log"]
    assert paths.normalize_extensions("  ") == []
    assert values(spark, [" .TMP, log,,.log ", ""], paths.normalized_extensions) == [[".tmp", ".log"], []]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=" ,.aAé", max_size=20))
def test_normalized_extensions_have_dot_and_no_repeats(listed):
    got = paths.normalize_extensions(listed)
    assert len(set(got)) == len(got)
    assert all(e.startswith(".") and e == e.lower() for e in got)


def test_roots(spark):
    specs = ["/share/a:Tag", " /share/a : T:x ", "/share/a", "/share/a/"]
    plain = [paths.parse_root(s) for s in specs]
    assert plain == [("/share/a", "Tag"), ("/share/a", "T:x"), ("/share/a", "a"), ("/share/a/", "a")]
    assert list(zip(values(spark, specs, paths.root_path), values(spark, specs, paths.root_tag))) == plain


@pytest.mark.parametrize("scope", ["", "  ", "/", "\\", "/..", "//", "/a/.."])
def test_scope_guard(scope):
    with pytest.raises(ValueError):
        paths.clean_scope(scope)


def test_scope_is_cleaned():
    assert paths.clean_scope("/a//b/../c/") == "/a/c"
    assert paths.scope_prefix("/a") == paths.scope_prefix("/a/") == "/a/"


def test_figures(spark):
    row = spark.range(1).select(
        text.percent(F.lit(1), F.lit(4)), text.percent(F.lit(1), F.lit(0)), text.rate(F.lit(10), F.lit(4)),
        text.remaining_seconds(F.lit(5), F.lit(15), F.lit(10)), text.megabytes(F.lit(1572864)),
        text.gigabytes(F.lit(1610612736)),
    ).first()
    assert list(row) == [25.0, 0.0, 2.5, 20.0, 1.5, 1.5]
