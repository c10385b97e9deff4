"""String, regular-expression and full-text expressions; all stay in the JVM."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of the evidence that conversations hold. Fixed values.
FENCE = r"```([a-zA-Z0-9_+-]*)\r?\n([\s\S]*?)```"
URL = r"\bhttps?://[^\s)>\]]+"
PATH = r"(?<![\w/])((?:\.{1,2}/|/|[a-zA-Z]:\\)?[\w.\-]+(?:[/\\][\w.\-]+){1,8}(?:\.[a-zA-Z0-9]{1,8})(?::\d+(?::\d+)?)?)(?![\w/])"
PATH_PLACE = r":\d+(:\d+)?$"
TICKET = r"\b([A-Z][A-Z0-9]{1,9}-\d+)\b"
COMMAND = r"(?m)^[ \t]*\$\s+(.+)$"
ERROR = r"(?m)^(?:[A-Z][A-Za-z]+(?:Error|Exception|Warning|Failure))(?::\s.*)?$"
STACK_FRAME = r"(?m)^\s+at\s+[\w$.<>]+\s+\(?[^\s]+:\d+(?::\d+)?\)?"
SHELLS = ("bash", "sh", "zsh", "shell", "console")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def natural_id(*parts: Column | str) -> Column:
    """The first 16 hex digits of the SHA-1 of the parts joined by |."""
    return F.substring(F.sha1(F.concat_ws("|", *[col(p) for p in parts])), 1, 16)


def trim_all(c: Column | str) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(col(c), r"^\s+|\s+$", "")


def normalize_skill(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.lower(col(c)), r"\s+", " "))


def normalize_entity(c: Column | str) -> Column:
    """Lower case, letters and digits only, one plural s off."""
    x = F.regexp_replace(F.lower(col(c)), "[^a-z0-9]", "")
    return F.when((F.length(x) > 3) & x.endswith("s"), F.substring(x, F.lit(1), F.length(x) - 1)).otherwise(x)


def clamp(c: Column | str, n: int) -> Column:
    """Head and tail of a text longer than n, with a note between."""
    c, half = col(c), (n - 32) // 2
    note = F.concat(F.lit("\n\n...[trimmed "), (F.length(c) - 2 * half).cast("string"), F.lit(" chars]...\n\n"))
    return F.when(F.length(c) <= n, c).otherwise(F.concat(F.substring(c, 1, half), note, F.substring(c, F.length(c) - half + 1, F.lit(half))))


def first_line(c: Column | str, n: int = 240) -> Column:
    return F.substring(F.element_at(F.split(col(c), r"\r?\n"), 1), 1, n)


def count_lines(c: Column | str) -> Column:
    return F.size(F.split(col(c), "\n"))


def basename(c: Column | str) -> Column:
    return F.element_at(F.split(col(c), "/"), -1)


def round2(c: Column | str) -> Column:
    """Two decimals, halves up on the binary product."""
    return F.floor(col(c) * 100 + 0.5) / 100


def contains_ci(c: Column | str, fragment: str) -> Column:
    """Case-insensitive containment of a literal fragment; wildcards in it are ordinary characters."""
    safe = fragment.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return col(c).ilike(f"%{safe}%")


def _fold_table() -> tuple[str, str]:
    """Letters of Latin-1 and Latin Extended-A and the plain letters below their marks, by Unicode decomposition."""
    a, b = "", ""
    for i in range(0xC0, 0x180):
        d = unicodedata.normalize("NFD", chr(i))
        if len(d) > 1 and d[0].isascii():
            a, b = a + chr(i), b + d[0]
    return a, b


_MARKED, _PLAIN = _fold_table()


def padded(c: Column | str) -> Column:
    """The words of a text, case and accents folded, single spaces around each."""
    x = F.lower(F.translate(F.coalesce(col(c), F.lit("")), _MARKED, _PLAIN))
    toks = F.filter(F.split(x, r"[^\p{L}\p{N}]+"), lambda t: t != "")
    return F.concat(F.lit(" "), F.array_join(toks, " "), F.lit(" "))


def phrases(query: str) -> list[str] | None:
    """The phrases of a query: every term between spaces is one, cut at punctuation. None: no filter; an empty phrase matches nothing."""
    import re

    terms = query.split()
    if not terms:
        return None
    fold = query.translate(str.maketrans(_MARKED, _PLAIN)).lower()
    return [" ".join(t for t in re.split(r"[^\w]|_", term) if t) for term in fold.split()]


def full_text(columns: Iterable[str], query: str, precomputed: bool = False) -> Column:
    """Whether every term of the query occurs as a phrase in some column."""
    ps = phrases(query)
    if ps is None:
        return F.lit(True)
    if not all(ps):
        return F.lit(False)
    texts = [F.col(c) if precomputed else padded(c) for c in columns]
    out = F.lit(True)
    for p in ps:
        hit = F.lit(False)
        for t in texts:
            hit = hit | t.contains(f" {p} ")
        out = out & hit
    return out
