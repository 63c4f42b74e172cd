"""Scalar column expressions shared by the jobs (strings, paths, versions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space removed at both ends of a line (fixed values).
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)

_WORD_EDGE = "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
_SPACE_CHARS = r"\t\n\f\r "


def jre(pattern: str) -> str:
    """RE2 pattern -> Java pattern with the same matches.

    Java's ``\\b`` looks at Unicode letters, its ``\\s`` also takes ``\\x0B``, ``.`` stops at ``\\r``
    and ``$`` also matches before a last line end; all four are replaced.
    """
    out, in_class, i = ["(?s)"], False, 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            nxt = pattern[i + 1]
            if nxt == "b" and not in_class:
                out.append(_WORD_EDGE)
            elif nxt == "s":
                out.append(_SPACE_CHARS if in_class else f"[{_SPACE_CHARS}]")
            else:
                out.append(ch + nxt)
            i += 2
            continue
        if ch == "[" and not in_class:
            in_class = True
            # a leading ']' or '^]' never occurs in our patterns
        elif ch == "[" and in_class:
            ch = "\\["
        elif ch == "]" and in_class:
            in_class = False
        elif ch == "$" and not in_class:
            ch = "\\z"
        out.append(ch)
        i += 1
    return "".join(out)


def matches(col: Column, pattern: str) -> Column:
    return col.rlike(jre(pattern))


def capture(col: Column, pattern: str, group: int = 1) -> Column:
    """The group's text, '' where the pattern does not match."""
    return F.regexp_extract(col, jre(pattern), group)


def strip(col: Column) -> Column:
    return F.btrim(col, F.lit(WHITE_SPACE))


def count_char(col: Column, ch: str) -> Column:
    """How often a one-character string occurs."""
    return F.length(col) - F.length(F.replace(col, F.lit(ch), F.lit("")))


def parts(path: Column) -> Column:
    return F.split(path, "/")


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def file_stem(path: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(file_name(path), r"\.[^.]*\z", "")


def extension(path: Column) -> Column:
    """Lower-cased text after the last dot of the file name, '' without a dot."""
    name = file_name(path)
    return F.when(F.instr(name, ".") > 0, F.lower(F.substring_index(name, ".", -1))).otherwise("")


def abs_path(repo: Column, path: Column) -> Column:
    return F.concat_ws("/", repo, path)


def last_parts(path: Column, n: int = 3) -> Column:
    """The last n path parts (the whole path when it has no more)."""
    return F.substring_index(path, "/", -n)


def cut_bytes(col: Column, n: int, tail: str = "") -> Column:
    """At most n UTF-8 bytes, whole characters only, followed by ``tail`` when something was cut."""
    raw = F.encode(col, "utf-8")
    # a character has at most 4 bytes, so one of these four cuts falls on a character start
    cuts = [F.try_validate_utf8(F.substring(raw, 1, n - k).cast("string")) for k in range(4)]
    return (
        F.when(F.octet_length(col) <= n, col)
        .when(F.octet_length(col) == F.length(col), F.concat(F.substring(col, 1, n), F.lit(tail)))
        .otherwise(F.concat(F.coalesce(*cuts), F.lit(tail)))
    )


def snippet(line: Column) -> Column:
    """Trimmed line, at most 100 bytes and an ellipsis."""
    return cut_bytes(strip(line), 100, "…")


def indent(line: Column, tab: int) -> Column:
    """Width of the leading run of tabs and spaces."""
    run = F.regexp_extract(line, r"^[\t ]*", 0)
    return F.length(run) + (tab - 1) * count_char(run, "\t")


def short_path(path: Column, service: Column) -> Column:
    """Path after the service's directory; else its last 3 parts; else the file name."""
    key = F.concat(F.lit("/"), service, F.lit("/"))
    at = F.call_function("instr", path, key)
    return (
        F.when(at > 0, F.substring(path, at + F.length(key), F.length(path)))
        .when(F.size(parts(path)) > 3, last_parts(path))
        .otherwise(file_name(path))
    )


def dir_of(path: Column) -> Column:
    """Directory with its trailing slash, '' when there is none."""
    return F.regexp_extract(path, r"^(.*/)", 1)


def churn_display(path: Column) -> Column:
    """Paths of more than four parts show the last three after an ellipsis."""
    return F.when(F.size(parts(path)) > 4, F.concat(F.lit("…/"), last_parts(path))).otherwise(path)


def has_word(source: Column, name: str) -> Column:
    """Whole-word test for one fixed name; sets of names use the token join instead."""
    quoted = "".join("\\" + c if not (c.isalnum() or c == "_") else c for c in name)
    return source.rlike(f"(?<![A-Za-z0-9_]){quoted}(?![A-Za-z0-9_])")


def words(col: Column) -> Column:
    """Distinct identifier tokens: a whole-word search for ``\\w+`` is membership in this set."""
    return F.array_distinct(F.regexp_extract_all(col, F.lit("[A-Za-z0-9_]+"), F.lit(0)))


def is_gateway(name: Column) -> Column:
    low = F.lower(name)
    return low.contains("gateway") | low.contains("api-gw") | (low == "api")


def is_proto_service(name: Column) -> Column:
    low = F.lower(name)
    return low.isin("proto", "protobuf", "protos") | low.startswith("proto-") | low.endswith("-proto")


def semver_number(tag: Column, i: int) -> Column:
    """i-th (0-2) number of a version tag; a part that is not a plain number counts 0."""
    bare = F.regexp_replace(tag, r"\Av", "")
    part = F.element_at(F.split(bare, r"\.", 3), i + 1)
    head = F.regexp_extract(part, r"\A[-+]*([^-+]*)", 1)
    return F.coalesce(F.when(head.rlike(r"\A[0-9]+\z"), head.try_cast("bigint")), F.lit(0))
