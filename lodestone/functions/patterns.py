"""Patterns: LIKE and regular expressions in the dialect of the engine.

Regular expressions are Unicode-aware, ``$`` is the end of the text only, and
there are no lookarounds, backreferences, possessive or atomic groups."""

from __future__ import annotations

import re

_REFUSED = re.compile(r"\(\?(?:[=!>]|<[=!])|\\[1-9kGZzA]\b(?<!\\A)(?<!\\z)|[*+?}]\+")


def like(pattern: str) -> str:
    """A LIKE pattern with escapes that Spark accepts: a backslash before any
    other character stands for that character, a last one for itself."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            after = pattern[i + 1 : i + 2]
            out.append(f"\\{after}" if after in ("%", "_", "\\") and after else after or "\\\\")
            i += 2
            continue
        out.append(c)
        i += 1
    return "".join(out)


def regex(pattern: str, insensitive: bool = False) -> str | None:
    """The pattern for Java's engine, or None if it is none."""
    if _REFUSED.search(pattern):
        return None
    out, i, inside = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            out.append(pattern[i : i + 2])
            i += 2
            continue
        if c == "[" and not inside:
            inside = True
            out.append(c)
            if pattern[i + 1 : i + 2] == "^":
                out.append("^")
                i += 1
            if pattern[i + 1 : i + 2] == "]":
                out.append("\\]")
                i += 1
        elif c == "[":
            out.append("\\[")
        elif c == "]":
            inside = False
            out.append(c)
        else:
            out.append("\\z" if c == "$" and not inside else c)
        i += 1
    java = f"(?{'iu' if insensitive else ''}Ud)" + "".join(out)
    return java if not inside and _compiles(java) else None


def _compiles(java: str) -> bool:
    """Tried in Java itself, where the pattern will run."""
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    if spark is None:
        return True
    try:
        spark.sparkContext._jvm.java.util.regex.Pattern.compile(java)
    except Exception:  # py4j wraps the PatternSyntaxException
        return False
    return True


def groups(java: str) -> int:
    """How many groups a pattern has, as Java counts them."""
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    if spark is None:
        return 9
    return spark.sparkContext._jvm.java.util.regex.Pattern.compile(java).matcher("").groupCount()


def replacement(text: str, known: int = 9) -> str:
    """``\\1`` refers to a group, ``\\\\`` is a backslash, ``$`` a dollar. A group
    beyond the ``known`` ones is empty."""
    out, i = [], 0
    while i < len(text):
        c, after = text[i], text[i + 1 : i + 2]
        if c == "\\" and after.isdigit():
            out.append(f"${after}" if int(after) <= known else "")
            i += 2
        elif c == "\\" and after == "\\":
            out.append("\\\\")
            i += 2
        else:
            out.append("\\$" if c == "$" else "\\\\" if c == "\\" else c)
            i += 1
    return "".join(out)
