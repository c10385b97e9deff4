"""Source files that do not parse.

Every file's content, in its latest state, is cut into tokens and parsed in full by the
chart parser from the bundled grammar of its recorded language. The first place that no
alternative can pass is reported.

Defined results: of a path's rows the one with the latest indexed_at counts (ties: the
larger content hash, then content); a null path is no file; null content counts as empty;
empty or comment-only content is valid except where the grammar needs a clause (Go's
package); a language without a grammar, ``unknown`` included, gives no verdict (null).
"""

from __future__ import annotations

import hashlib
import sys
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import grammars as G
from tessera.llm import lexers as L
from tessera.llm.chart import Grammar

_COMMON = {"NAME", "NUM", "STR"}


def _eos(kinds):
    semi, brace, end = kinds[";"], kinds["}"], kinds["EOF"]

    def f(p, K, NL):
        k = K[p]
        if k == semi:
            return p + 1
        return p if k == brace or k == end or NL[p] else -1 - p

    return f


def _nonl(_):
    return lambda p, K, NL: -1 - p if NL[p] else p


def _never(_):
    return lambda p, K, NL: -1 - p


def _any(_):
    return lambda p, K, NL: p + 1


def _keyword(kinds):
    words = {kinds[w] for w in G.JS_WORDS if w in kinds}
    return lambda p, K, NL: p + 1 if K[p] in words else -1 - p


_SCRIPT = {"EOS": _eos, "NONL": _nonl, "NEVER": _never, "KEYWORD": _keyword}
_SCRIPT_CLASSES = _COMMON | {"REGEX", "TPL", "THEAD", "TMID", "TTAIL", "PRIVATE", "ASSIGN", "INC", "BINOP", "HASHBANG"}
#: language: grammar, keywords, token classes, special tests, lexer
LANGUAGES = {
    "python": (G.PYTHON, G.PYTHON_WORDS, _COMMON | {"NL", "IND", "DED", "AUG", "OP", "FHEAD", "FOPEN", "FCLOSE", "FTAIL"}, {}, L.python),
    "javascript": (G.JAVASCRIPT, G.JS_WORDS, _SCRIPT_CLASSES, _SCRIPT, L.script),
    "typescript": (G.TYPESCRIPT, G.JS_WORDS, _SCRIPT_CLASSES, _SCRIPT, L.script),
    "java": (G.JAVA, G.JAVA_WORDS, _COMMON | {"CHAR", "ASSIGN", "INC", "BINOP"}, {}, L.java),
    "go": (G.GO, G.GO_WORDS, _COMMON | {"CHAR", "ASSIGN", "INC", "OP"}, {}, L.go),
    "rust": (G.RUST, G.RUST_WORDS, _COMMON | {"CHAR", "LIFE", "ASSIGN", "OP"}, {"NEVER": _never, "ANY": _any}, L.rust),
    "csharp": (G.CSHARP, G.CSHARP_WORDS, _COMMON | {"CHAR", "ASSIGN", "INC", "OP"}, {}, L.csharp),
    "sql": (G.SQL, G.SQL_WORDS, _COMMON | {"QNAME", "OP", "PARAM"}, {"ANY": _any}, L.sql),
}


@lru_cache(maxsize=None)
def grammar(language: str) -> Grammar:
    text, words, classes, special, _ = LANGUAGES[language]
    g = Grammar(text, words, classes, special=frozenset(special))
    for name, make in special.items():
        g.env["s_" + name] = make(g.keys)
    return g


def error_of(text: str | None, language: str | None) -> tuple[int, str] | None:
    """(line, reason) of the first error that can't be passed, or None."""
    if language not in LANGUAGES:
        return None
    text = text or ""
    if "\0" in text:
        return text[: text.index("\0")].count("\n") + 1, "a null character"
    lex, g = LANGUAGES[language][4], grammar(language)
    try:
        kinds, newline, starts = lex(text)
    except L.Bad as e:
        return text[: e.at].count("\n") + 1, e.what
    plain = [k if type(k) is str else (k[1] if k[1] in g.soft else "NAME") for k in kinds]
    if sys.getrecursionlimit() < 100_000:
        sys.setrecursionlimit(100_000)
    bad = g.parse(plain, newline)
    if bad < 0:
        return None
    at = starts[bad]
    return text[:at].count("\n") + 1, "ends too early" if plain[bad] == "EOF" else f"unexpected {text[at : at + 20].split()[0] if text[at : at + 20].split() else 'end of line'}"


def latest(files: DataFrame) -> DataFrame:
    """The latest row of every path. Contents take part in no sort: the row is chosen by its key first."""
    order = F.struct("indexed_at", "content_hash", F.xxhash64("content"))
    best = files.where("path is not null").groupBy("path").agg(F.max(order).alias("best"))
    mine = files.where("path is not null").withColumn("mine", order)
    return mine.join(best, (mine["path"] == best["path"]) & mine["mine"].eqNullSafe(best["best"]), "left_semi").drop("mine").dropDuplicates(["path"])


def checked(files: DataFrame) -> DataFrame:
    """(path, project_id, language, valid, line, error) of every file."""

    def run(batches):
        known: dict[tuple, tuple | None] = {}
        for b in batches:
            out = []
            for lang, text in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                key = (lang, hashlib.blake2b((text or "").encode("utf-8", "surrogatepass"), digest_size=16).digest() if text is not None else None)
                if key not in known:
                    if len(known) > 50_000:
                        known.clear()
                    known[key] = error_of(text, lang)
                out.append(known[key])
            langs = b.column(2).to_pylist()
            valid = pa.array([None if g not in LANGUAGES else e is None for g, e in zip(langs, out)], pa.bool_())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], valid, pa.array([e and e[0] for e in out], pa.int32()), pa.array([e and e[1] for e in out], pa.string())], names=["path", "project_id", "language", "valid", "line", "error"])

    src = latest(files).select("path", "project_id", "language", "content")
    return src.mapInArrow(run, "path string, project_id string, language string, valid boolean, line int, error string")


def rates(verdicts: DataFrame) -> DataFrame:
    """(project_id, language, n_files, n_checked, n_invalid, rate) per repository and language."""
    bad, known = F.sum((~F.col("valid")).cast("long")), F.count("valid")
    return verdicts.groupBy("project_id", "language").agg(F.count(F.lit(1)).alias("n_files"), known.alias("n_checked"), F.coalesce(bad, F.lit(0)).alias("n_invalid"), F.try_divide(F.coalesce(bad, F.lit(0)), known).alias("rate"))
