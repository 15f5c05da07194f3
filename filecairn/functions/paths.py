"""Path columns: parent, base name, extension, labels, roots and ids."""

from __future__ import annotations

import os
import posixpath
import re

from pyspark.sql import Column
from pyspark.sql import functions as F


# In path texts, stands before the two hexadecimal digits of a byte that is no UTF-8, and before itself.
ESCAPE = "\ufffd"
_NOT_TEXT = re.compile("[\udc80-\udcff]")
_ESCAPED = re.compile(f"{ESCAPE}({ESCAPE}|[0-9a-f]{{2}})")


def path_text(raw: bytes) -> str:
    """Text of a path without loss: ``path_bytes`` gives the bytes back.

    A path that is UTF-8 is its own text, but for U+FFFD, which is doubled; any other byte is U+FFFD and
    two hexadecimal digits. Components are mapped one by one, so that the text of a directory
    is the directory part of the text of what it holds, and no two paths have one text.
    """
    text = raw.decode("utf-8", "surrogateescape")
    if text.isascii():
        return text
    return _NOT_TEXT.sub(lambda m: f"{ESCAPE}{ord(m[0]) - 0xDC00:02x}", text.replace(ESCAPE, ESCAPE * 2))


def path_bytes(text: str) -> bytes:
    """The bytes of a path, to open it with."""
    if ESCAPE in text:
        text = _ESCAPED.sub(lambda m: ESCAPE if m[1] == ESCAPE else chr(0xDC00 + int(m[1], 16)), text)
    return text.encode("utf-8", "surrogateescape")


def parent_dir(path: Column) -> Column:
    """Directory part of an absolute path; a file directly under ``/`` has ``/``."""
    cut = F.substring(path, F.lit(1), F.length(path) - F.length(base_name(path)) - 1)
    return F.when(cut == "", F.lit("/")).otherwise(cut)


def base_name(path: Column) -> Column:
    """Last component of a path."""
    return F.substring_index(path, "/", -1)


def extension(name: Column) -> Column:
    """Text from the last dot on, dot and case kept; '' when there is none."""
    return F.when(
        F.contains(name, F.lit(".")), F.concat(F.lit("."), F.substring_index(name, ".", -1))
    ).otherwise(F.lit(""))


def components(path: Column) -> Column:
    """Path components as an array, outer slashes ignored."""
    return F.split(F.btrim(path, F.lit("/")), "/")


def top_folder(path: Column, depth: int = 4) -> Column:
    """Component at 0-based ``depth``, else the last one."""
    parts = components(path)
    return F.coalesce(F.try_element_at(parts, F.lit(depth + 1)), F.element_at(parts, -1))


def ancestors(dir_path: Column, min_depth: int = 1, root: bool = False) -> Column:
    """Every prefix of a directory path that has at least ``min_depth`` components.

    A directory shallower than that yields only itself. ``root`` adds ``/``.
    """
    parts = components(dir_path)
    depth = F.size(parts)
    prefixes = F.transform(
        F.sequence(F.lit(min_depth), F.greatest(depth, F.lit(min_depth))),
        lambda n: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), n), "/")),
    )
    found = F.when(depth >= min_depth, prefixes).otherwise(F.array(dir_path))
    return F.array_union(F.array(F.lit("/")), found) if root else found


def path_id(path: Column) -> Column:
    """64-bit id derived from the path, the same in every scan.

    Rewrites join on the path as well, so a collision can never touch a wrong row.
    """
    return F.xxhash64(path)


def scope_prefix(scope: str) -> str:
    """Scope with exactly the trailing slash a prefix match needs."""
    return scope if scope.endswith("/") else scope + "/"


def clean_scope(scope: str) -> str:
    """Absolute, normalised scope; refuses a missing or root scope."""
    if scope.strip() in ("", "\\"):
        raise ValueError("a deletion scope is required and cannot be empty or a root")
    cleaned = "/" + posixpath.normpath(os.path.abspath(scope)).lstrip("/")
    if cleaned == "/":
        raise ValueError("refusing to use a root directory as deletion scope")
    return cleaned


def normalize_extensions(listed: str) -> list[str]:
    """Comma list to lower-case extensions with a dot, first occurrence kept."""
    trimmed = (part.strip().lower() for part in listed.split(","))
    return list(dict.fromkeys(p if p.startswith(".") else "." + p for p in trimmed if p))


def normalized_extensions(listed: Column) -> Column:
    """Column form of :func:`normalize_extensions`, as an array."""
    parts = F.transform(F.split(listed, ","), lambda p: F.lower(F.trim(p)))
    kept = F.filter(parts, lambda p: p != "")
    dotted = F.transform(
        kept, lambda p: F.when(F.startswith(p, F.lit(".")), p).otherwise(F.concat(F.lit("."), p))
    )
    return F.array_distinct(dotted)


def parse_root(spec: str) -> tuple[str, str]:
    """``path:tag``; without a tag the base name of the path is the tag."""
    path, colon, tag = spec.partition(":")
    if colon:
        return path.strip(), tag.strip()
    return spec, posixpath.basename(spec.rstrip("/")) or "/"


def root_path(spec: Column) -> Column:
    """Path part of a root spec."""
    return F.when(F.contains(spec, F.lit(":")), F.trim(F.substring_index(spec, ":", 1))).otherwise(spec)


def root_tag(spec: Column) -> Column:
    """Tag part of a root spec, else the base name of its path."""
    return F.when(
        F.contains(spec, F.lit(":")),
        F.trim(F.substring(spec, F.instr(spec, ":") + 1, F.length(spec))),
    ).otherwise(base_name(F.rtrim(spec, F.lit("/"))))
