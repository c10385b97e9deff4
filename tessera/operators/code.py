"""Symbols from source text: SQL definitions, Python by its own syntax tree, other languages by declarations at line heads.

What a full parser of every language would tell beyond that (calls in them, nested
scopes) is not extracted; see the README.
"""

from __future__ import annotations

import ast
import hashlib
import re
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.runtime import Scratch

NODE = "id string, kind string, name string, qualified_name string, file_path string, language string, start_line int, end_line int, docstring string, signature string, is_exported boolean, is_async boolean"
LINK = "source string, target string, kind string, metadata string, line int"


def node_id(kind: str, qualified: str, path: str) -> str:
    return hashlib.sha1(f"{kind}|{qualified}|{path}".encode()).hexdigest()[:16]


def python_symbols(path: str, text: str) -> tuple[list[tuple], list[tuple], list[tuple]]:
    """(nodes, edges, unresolved references) of a Python file; nothing if it doesn't parse."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return [], [], []
    nodes, edges, refs = [], [], []

    def walk(body: list, parent: str, outer: str, in_class: bool) -> None:
        for x in body:
            if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                kind = "class" if isinstance(x, ast.ClassDef) else "method" if in_class else "function"
                q = f"{outer}.{x.name}" if outer else x.name
                i = node_id(kind, q, path)
                nodes.append((i, kind, x.name, q, path, "python", x.lineno, x.end_lineno, ast.get_docstring(x), text.splitlines()[x.lineno - 1].strip()[:240], not x.name.startswith("_"), isinstance(x, ast.AsyncFunctionDef)))
                if parent:
                    edges.append((parent, i, "contains", None, x.lineno))
                if kind != "class":
                    for c in ast.walk(x):
                        if isinstance(c, ast.Call):
                            f = c.func
                            name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None
                            if name:
                                refs.append((i, name, "calls", c.lineno, path))
                walk(x.body, i, q, kind == "class")
            elif isinstance(x, (ast.Import, ast.ImportFrom)):
                for a in x.names:
                    name = f"{x.module}.{a.name}" if isinstance(x, ast.ImportFrom) and x.module else a.name
                    i = node_id("import", name, path)
                    nodes.append((i, "import", name, name, path, "python", x.lineno, x.end_lineno, None, None, False, False))
                    if parent:
                        edges.append((parent, i, "imports", None, x.lineno))
            elif isinstance(x, ast.Assign) and not outer:
                for t in x.targets:
                    if isinstance(t, ast.Name):
                        kind = "constant" if t.id.isupper() else "variable"
                        i = node_id(kind, t.id, path)
                        nodes.append((i, kind, t.id, t.id, path, "python", x.lineno, x.end_lineno, None, None, not t.id.startswith("_"), False))
                        if parent:
                            edges.append((parent, i, "contains", None, x.lineno))

    file = node_id("file", path, path)
    nodes.append((file, "file", path.rsplit("/", 1)[-1], path, path, "python", 1, text.count("\n") + 1, None, None, False, False))
    walk(tree.body, file, "", False)
    return nodes, edges, refs


_NAME = r'(?:"[^"]+"|`[^`]+`|\[[^\]]+\]|[A-Za-z_][\w$]*)'
_QNAME = rf"{_NAME}(?:\.{_NAME})*"
_BLANK = re.compile(r"--[^\n]*|/\*[\s\S]*?\*/|'(?:''|[^'])*'|(\$[A-Za-z_]*\$)[\s\S]*?\1")
_STATEMENTS = (
    ("table", re.compile(rf"^\s*CREATE\s+(?:OR\s+REPLACE\s+)?(?:GLOBAL\s+|LOCAL\s+)?(?:TEMP(?:ORARY)?\s+|UNLOGGED\s+|EXTERNAL\s+)?TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?({_QNAME})", re.I)),
    ("view", re.compile(rf"^\s*CREATE\s+(?:OR\s+REPLACE\s+)?(?:MATERIALIZED\s+)?VIEW\s+(?:IF\s+NOT\s+EXISTS\s+)?({_QNAME})", re.I)),
    ("index", re.compile(rf"^\s*CREATE\s+(?:UNIQUE\s+)?INDEX\s+(?:CONCURRENTLY\s+)?(?:IF\s+NOT\s+EXISTS\s+)?({_QNAME})\s+ON\s+(?:ONLY\s+)?({_QNAME})", re.I)),
    ("function", re.compile(rf"^\s*CREATE\s+(?:OR\s+REPLACE\s+)?(?:FUNCTION|PROCEDURE|TRIGGER)\s+(?:IF\s+NOT\s+EXISTS\s+)?({_QNAME})", re.I)),
    ("namespace", re.compile(rf"^\s*CREATE\s+SCHEMA\s+(?:IF\s+NOT\s+EXISTS\s+)?({_QNAME})", re.I)),
    ("type_alias", re.compile(rf"^\s*CREATE\s+TYPE\s+({_QNAME})", re.I)),
    ("variable", re.compile(rf"^\s*CREATE\s+SEQUENCE\s+(?:IF\s+NOT\s+EXISTS\s+)?({_QNAME})", re.I)),
    ("alter", re.compile(rf"^\s*ALTER\s+TABLE\s+(?:IF\s+EXISTS\s+)?(?:ONLY\s+)?({_QNAME})", re.I)),
)
_CONSTRAINT = re.compile(r"^(?:CONSTRAINT|PRIMARY|FOREIGN|UNIQUE|CHECK|EXCLUDE|INDEX|KEY|LIKE)\b", re.I)
_REFERENCES = re.compile(rf"\bREFERENCES\s+({_QNAME})", re.I)
_ADDED = re.compile(rf"\bADD\s+(?:COLUMN\s+)?(?:IF\s+NOT\s+EXISTS\s+)?({_NAME})", re.I)


def _bare(name: str) -> str:
    return re.split(r"\.(?=[^.]*$)", name)[-1].strip('"`[]')


def sql_symbols(path: str, text: str) -> tuple[list[tuple], list[tuple], list[tuple]]:
    """(nodes, edges, references to tables) of SQL definitions. Comments, strings and dollar-quoted bodies are blanked with offsets kept."""
    blank = _BLANK.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)
    nodes, edges, refs, ids = [], [], [], {}
    at = 0
    for part in blank.split(";"):
        start, at = at, at + len(part) + 1
        for kind, pattern in _STATEMENTS:
            m = pattern.match(part)
            if not m:
                continue
            line = text.count("\n", 0, start + m.start(1)) + 1
            end = text.count("\n", 0, start + len(part)) + 1
            name = _bare(m[1])
            if kind == "alter":
                table = ids.get(name.lower()) or node_id("table", name, path)
                for a in _ADDED.finditer(part):
                    if not _CONSTRAINT.match(a[1]):
                        i = node_id("field", f"{name}.{_bare(a[1])}", path)
                        nodes.append((i, "field", _bare(a[1]), f"{name}.{_bare(a[1])}", path, "sql", line, end, None, None, False, False))
                        edges.append((table, i, "contains", None, line))
                owner = table
            else:
                kind = "table" if kind == "view" else kind
                owner = node_id(kind, m[1], path)
                ids.setdefault(name.lower(), owner)
                nodes.append((owner, kind, name, m[1], path, "sql", line, end, None, text[start + m.start() : start + m.end()].strip()[:240], True, False))
                if kind == "index":
                    refs.append((owner, _bare(m[2]), "index_on", line, path))
                body = re.search(r"\((.*)\)", part[m.end() :], re.S) if kind == "table" else None
                if body and not re.match(r"\s*AS\b", part[m.end() :], re.I):
                    depth, item, offset = 0, "", m.end() + body.start(1)
                    for k, c in enumerate(body[1] + ","):
                        depth += (c == "(") - (c == ")")
                        if c == "," and depth == 0:
                            s = item.strip()
                            n = re.match(_NAME, s)
                            if n and not _CONSTRAINT.match(s):
                                l = text.count("\n", 0, start + offset + k - len(item.lstrip())) + 1
                                i = node_id("field", f"{m[1]}.{_bare(n[0])}", path)
                                nodes.append((i, "field", _bare(n[0]), f"{m[1]}.{_bare(n[0])}", path, "sql", l, l, None, s[:240], False, False))
                                edges.append((owner, i, "contains", None, l))
                            item = ""
                        else:
                            item += c
            for r in _REFERENCES.finditer(part):
                refs.append((owner, _bare(r[1]), "foreign_key", text.count("\n", 0, start + r.start()) + 1, path))
            break
    return nodes, edges, refs


_V = r"(?:export\s+|default\s+|public\s+|private\s+|protected\s+|internal\s+|static\s+|abstract\s+|final\s+|sealed\s+|async\s+|readonly\s+|partial\s+|pub(?:\([^)]*\))?\s+|declare\s+|unsafe\s+|override\s+|virtual\s+)*"
_DECLARATIONS = {
    "typescript": [("class", rf"^\s*{_V}class\s+(\w+)"), ("interface", rf"^\s*{_V}interface\s+(\w+)"), ("type_alias", rf"^\s*{_V}type\s+(\w+)[^=\n]*="), ("enum", rf"^\s*{_V}(?:const\s+)?enum\s+(\w+)"), ("function", rf"^\s*{_V}function\s*\*?\s*(\w+)"), ("function", rf"^\s*{_V}(?:const|let|var)\s+(\w+)[^=\n]*=\s*(?:async\s*)?(?:\([^)]*\)|\w+)[^=\n]*=>"), ("method", r"^\s+(?:(?:public|private|protected|static|async|override)\s+)*(?!if\b|for\b|while\b|switch\b|return\b|catch\b|constructor\b)(\w+)\s*\([^)]*\)[^;{=\n]*\{")],
    "go": [("function", r"^func\s+(\w+)"), ("method", r"^func\s+\([^)]*\)\s*(\w+)"), ("struct", r"^type\s+(\w+)(?:\[[^\]]*\])?\s+struct\b"), ("interface", r"^type\s+(\w+)(?:\[[^\]]*\])?\s+interface\b"), ("type_alias", r"^type\s+(\w+)\s+=?\s*(?!struct\b|interface\b)\S"), ("constant", r"^const\s+(\w+)"), ("variable", r"^var\s+(\w+)")],
    "rust": [("struct", rf"^\s*{_V}struct\s+(\w+)"), ("enum", rf"^\s*{_V}enum\s+(\w+)"), ("interface", rf"^\s*{_V}trait\s+(\w+)"), ("function", rf"^{_V}fn\s+(\w+)"), ("method", rf"^\s+{_V}fn\s+(\w+)"), ("constant", rf"^\s*{_V}(?:const|static)\s+(?:mut\s+)?(\w+)\s*:"), ("type_alias", rf"^\s*{_V}type\s+(\w+)")],
    "java": [("class", rf"^\s*{_V}(?:class|record)\s+(\w+)"), ("interface", rf"^\s*{_V}@?interface\s+(\w+)"), ("enum", rf"^\s*{_V}enum\s+(\w+)"), ("method", rf"^\s+{_V}(?:<[^>]+>\s*)?[\w<>\[\],.? ]+?\s+(?!new\b|return\b|else\b)(\w+)\s*\([^)]*\)\s*(?:throws [\w, .]+)?[{{;]")],
    "csharp": [("module", r"^\s*namespace\s+([\w.]+)"), ("class", rf"^\s*{_V}(?:class|record)\s+(\w+)"), ("struct", rf"^\s*{_V}struct\s+(\w+)"), ("interface", rf"^\s*{_V}interface\s+(\w+)"), ("enum", rf"^\s*{_V}enum\s+(\w+)"), ("type_alias", rf"^\s*{_V}delegate\s+\S+\s+(\w+)"), ("property", rf"^\s*{_V}[\w<>\[\],.?]+\s+(\w+)\s*\{{\s*(?:get|set|init)"), ("method", rf"^\s+{_V}(?!return\b|new\b|else\b)[\w<>\[\],.?]+\s+(\w+)\s*\([^)]*\)\s*(?:\{{|=>|$)")],
    "dart": [("class", r"^\s*(?:abstract\s+)?class\s+(\w+)"), ("class", r"^\s*mixin\s+(\w+)"), ("enum", r"^\s*enum\s+(\w+)"), ("type_alias", r"^\s*typedef\s+(\w+)"), ("class", r"^\s*extension\s+(\w+)"), ("function", r"^(?:[\w<>?]+\s+)(\w+)\s*\([^)]*\)\s*(?:async\s*)?[{=]")],
}
_DECLARATIONS["javascript"] = _DECLARATIONS["typescript"]
_COMPILED = {k: [(kind, re.compile(p, re.M)) for kind, p in v] for k, v in _DECLARATIONS.items()}


def line_symbols(path: str, text: str, language: str) -> tuple[list[tuple], list[tuple], list[tuple]]:
    blank = re.sub(r"/\*[\s\S]*?\*/|//[^\n]*", lambda m: re.sub(r"[^\n]", " ", m.group()), text)
    nodes = []
    file = node_id("file", path, path)
    nodes.append((file, "file", path.rsplit("/", 1)[-1], path, path, language, 1, text.count("\n") + 1, None, None, False, False))
    seen = set()
    for kind, p in _COMPILED[language]:
        for m in p.finditer(blank):
            line = text.count("\n", 0, m.start(1)) + 1
            if (m[1], line) in seen:
                continue
            seen.add((m[1], line))
            i = node_id(kind, m[1], path)
            head = text.splitlines()[line - 1].strip()[:240]
            nodes.append((i, kind, m[1], m[1], path, language, line, line, None, head, bool(re.match(r"export\b|pub\b|public\b", head)), "async" in head.split("(")[0].split()))
    return nodes, [(file, n[0], "contains", None, n[6]) for n in nodes[1:]], []


def _parse(path: str, language: str, text: str):
    if language == "python":
        return python_symbols(path, text)
    if language == "sql":
        return sql_symbols(path, text)
    if language in _COMPILED:
        return line_symbols(path, text, language)
    return [], [], []


REFERENCE = "from_node_id string, reference_name string, reference_kind string, line int, file_path string"


def extract(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, references) of files (path, language, content). Every file is parsed once; what it gives is written as one table and read back by kind."""
    src = files.where("path is not null and content is not null").select("path", "language", "content")
    kinds = {"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    parts = {"node": NODE, "link": LINK, "ref": REFERENCE}
    fields = {k: [tuple(x.split()) for x in ddl.split(", ")] for k, ddl in parts.items()}
    schema = pa.schema([("part", pa.string()), *[(k, pa.struct([(n, kinds[t]) for n, t in f])) for k, f in fields.items()]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for p, l, t in zip(*(c.to_pylist() for c in b.columns)):
                for (part, f), found in zip(fields.items(), _parse(p, l, t)):
                    rows += [{"part": part, part: dict(zip([n for n, _ in f], r))} for r in found]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    ddl = "part string, " + ", ".join(f"{k} struct<{', '.join(f'{n}: {t}' for n, t in f)}>" for k, f in fields.items())
    got = Scratch(files.sparkSession).save(src.mapInArrow(run, ddl))
    nodes, links, refs = (got.where(F.col("part") == k).select(f"{k}.*") for k in parts)
    return nodes.dropDuplicates(["id"]), links, refs


def table_references(refs: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, stubs): references of definitions to tables by folded name; a name without a definition gets a stub table."""
    r = refs.where(F.col("reference_kind").isin("foreign_key", "index_on")).withColumn("lc", F.lower("reference_name"))
    t = nodes.where("kind = 'table'").groupBy(F.lower("name").alias("lc")).agg(F.min("id").alias("target"))
    missing = r.join(t, "lc", "left_anti").groupBy("lc").agg(F.min("reference_name").alias("name"))
    sid = F.substring(F.sha1(F.concat_ws("|", F.lit("table"), "name", F.lit(""))), 1, 16)
    stubs = missing.select(sid.alias("id"), F.lit("table").alias("kind"), "name", F.col("name").alias("qualified_name"), F.concat(F.lit("(stub) "), "name").alias("signature"))
    every = t.unionByName(stubs.select(F.lower("name").alias("lc"), F.col("id").alias("target")))
    meta = F.to_json(F.struct(F.col("reference_kind").alias("ref_kind"), F.col("reference_name").alias("target_table")))
    return r.join(every, "lc").select(F.col("from_node_id").alias("source"), "target", F.lit("references").alias("kind"), meta.alias("metadata"), "line"), stubs
