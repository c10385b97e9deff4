"""Dependencies and tools that a repository declares."""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import natural_id

MOST_DEPTH = 4
# File names, and folders, that give a tool away. Fixed values.
TOOLS = (
    (r"^Dockerfile", "Docker"),
    (r"^docker-compose\.ya?ml$", "Docker Compose"),
    (r"^Makefile$", "Make"),
    (r"\.tf$", "Terraform"),
    (r"^(skaffold|helmfile)\.ya?ml$", "Kubernetes"),
    (r"^vercel\.json$", "Vercel"),
    (r"^netlify\.toml$", "Netlify"),
    (r"^serverless\.ya?ml$", "Serverless Framework"),
    (r"^\.gitlab-ci\.yml$", "GitLab CI"),
)
FOLDERS = ((".github/workflows", "GitHub Actions"), (".circleci", "CircleCI"), ("k8s", "Kubernetes"), ("kubernetes", "Kubernetes"), ("charts", "Kubernetes"))
#: Names of the files whose content is read.
READ = "{package.json,requirements*.txt,pyproject.toml,go.mod,Cargo.toml,pubspec.yaml,composer.json,Gemfile,pom.xml,build.gradle,build.gradle.kts,*.csproj}"


def tools(path: str) -> list[str]:
    """The tools that a path gives away by its file name or its folders."""
    folder, _, name = path.rpartition("/")
    inside = f"/{folder}/"
    return [tool for pattern, tool in TOOLS if re.search(pattern, name)] + [tool for f, tool in FOLDERS if f"/{f}/" in inside]


def _toml(text: str) -> dict:
    try:
        return tomllib.loads(text)
    except tomllib.TOMLDecodeError:
        return {}


def _json(text: str) -> dict:
    try:
        x = json.loads(text)
    except ValueError:
        return {}
    return x if isinstance(x, dict) else {}


def _npm(t: str) -> list[str]:
    x = _json(t)
    return [k for s in ("dependencies", "devDependencies", "peerDependencies") if isinstance(x.get(s), dict) for k in x[s]]


def _requirements(t: str) -> list[str]:
    return [m[1] for line in t.splitlines() if (m := re.match(r"\s*([A-Za-z0-9][\w.-]*)", line.split("#")[0]))]


def _pyproject(t: str) -> list[str]:
    x = _toml(t)
    own = [m[0] for d in x.get("project", {}).get("dependencies", []) if isinstance(d, str) and (m := re.match(r"[\w.-]+", d))]
    return own + [k for k in x.get("tool", {}).get("poetry", {}).get("dependencies", {}) if k != "python"]


def _go(t: str) -> list[str]:
    t = re.sub(r"//[^\n]*", "", t)
    found = [m for block in re.findall(r"(?ms)^require\s*\((.*?)\)", t) for m in re.findall(r"(?m)^\s*(\S+)\s+v\S+", block)]
    return found + re.findall(r"(?m)^require\s+([^\s(]+)\s+v\S+", t)


def _yaml_section(t: str, names: tuple[str, ...], skip: tuple[str, ...]) -> list[str]:
    out, on = [], False
    for line in t.splitlines():
        if re.match(r"\S", line):
            on = line.split(":")[0].strip() in names
        elif on and (m := re.match(r"  ([A-Za-z_][\w-]*)\s*:", line)) and m[1] not in skip:
            out.append(m[1])
    return out


PARSERS = {
    "package.json": _npm,
    "requirements.txt": _requirements,
    "pyproject.toml": _pyproject,
    "go.mod": _go,
    "Cargo.toml": lambda t: list(_toml(t).get("dependencies", {})),
    "pubspec.yaml": lambda t: _yaml_section(t, ("dependencies", "dev_dependencies"), ("flutter",)),
    "composer.json": lambda t: [k for s in ("require", "require-dev") if isinstance(_json(t).get(s), dict) for k in _json(t)[s] if k != "php"],
    "Gemfile": lambda t: re.findall(r"(?m)^\s*gem\s+['\"]([^'\"]+)", t),
    "pom.xml": lambda t: re.findall(r"<dependency>.*?<artifactId>\s*([^<\s]+)", t, re.S),
    "build.gradle": lambda t: re.findall(r"\b(?:implementation|api|compileOnly|testImplementation)\b[\s(]*['\"]([^'\"]+)", t),
    "csproj": lambda t: re.findall(r"<PackageReference\s+[^>]*Include=\"([^\"]+)", t),
}


def _parser(path: str):
    base = path.rsplit("/", 1)[-1]
    return PARSERS.get(base) or (PARSERS["build.gradle"] if base == "build.gradle.kts" else PARSERS["csproj"] if base.endswith(".csproj") else PARSERS["requirements.txt"] if re.fullmatch(r"requirements[\w.-]*\.txt", base) else None)


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if (parse := _parser(path)) and text:
                out += [(path, "dependency", n) for n in dict.fromkeys(parse(text))]
            out += [(path, "tool", tool) for tool in tools(path)]
        cols = list(zip(*out)) if out else [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=["path", "kind", "name"])


def facts(files: DataFrame) -> DataFrame:
    """(id, kind, title, path): each declared dependency and tool once, from files (path, content) at most four folders deep; of several the first path."""
    f = files.where(F.size(F.split("path", "/")) <= MOST_DEPTH + 1).select("path", "content")
    found = f.mapInArrow(_run, "path string, kind string, name string")
    one = found.groupBy("kind", F.lower("name").alias("lc")).agg(F.min_by("name", "path").alias("title"), F.min("path").alias("path"))
    return one.select(natural_id("kind", "lc").alias("id"), "kind", "title", "path")
