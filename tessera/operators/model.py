"""Model stages: cached, validated, repaired once, offline by default.

A stage is a function of a payload; its results lie in a memo table by agent, model and
input hash. Only payloads without a good result reach the backend, on the executors.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Backend(Protocol):
    def chat(self, system: str, user: str) -> str: ...


class Offline:
    """Has no model; every call fails, and failures are recorded as such."""

    def chat(self, system: str, user: str) -> str:
        raise RuntimeError("no model backend is configured")


class Recorded:
    """Answers by the hash of the user text; for tests and replays."""

    def __init__(self, answers: dict[str, str], default: str | None = None):
        self.answers, self.default = answers, default

    def chat(self, system: str, user: str) -> str:
        got = self.answers.get(user, self.default)
        if got is None:
            raise KeyError("nothing recorded")
        return got


def stable(value: Any) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def input_hash(name: str, version: str, model: str, payload: Any) -> str:
    return hashlib.sha256(f"{name}|{version}|{model}|{stable(payload)}".encode()).hexdigest()


def parsed(payload: str) -> Any:
    """The value of a payload in JSON, so that the order of its keys doesn't matter; else the text."""
    try:
        return json.loads(payload)
    except ValueError:
        return payload


def lenient(text: str) -> Any:
    """JSON from an answer: as it is, from its fenced block, or from the first brace to the last."""
    tries = [text]
    if m := re.search(r"```(?:json)?\s*([\s\S]*?)```", text):
        tries.append(m[1])
    if "{" in text and "}" in text:
        tries.append(text[text.index("{") : text.rindex("}") + 1])
    for t in tries:
        try:
            return json.loads(t)
        except ValueError:
            continue
    raise ValueError("no JSON in the answer")


@dataclass(frozen=True)
class Stage:
    name: str
    version: str
    system: str
    required: dict[str, type] = field(default_factory=dict)
    vocabulary: dict[str, tuple[str, ...]] = field(default_factory=dict)
    post: Callable[[dict], dict] | None = None
    more: Callable[[dict], str | None] | None = None

    def check(self, x: Any) -> str | None:
        """What is wrong with an answer, or None."""
        if not isinstance(x, dict):
            return "not an object"
        for k, t in self.required.items():
            if k not in x:
                return f"{k} is missing"
            if not isinstance(x[k], (int, float) if t is float else t):
                return f"{k} is no {t.__name__}"
        for k, allowed in self.vocabulary.items():
            if k in x and x[k] not in allowed:
                return f"{k} is none of {', '.join(allowed)}"
        if "confidence" in x and not (isinstance(x["confidence"], (int, float)) and 0 <= x["confidence"] <= 1):
            return "confidence is not between 0 and 1"
        return self.more(x) if self.more else None


REGISTRY: dict[str, Stage] = {}


def register(stage: Stage) -> Stage:
    REGISTRY[stage.name] = stage
    return stage


# The axes of triage. Fixed values.
TRIAGE = register(
    Stage(
        "triage", "1", "Label the window on four axes. Answer with JSON.", {"relevance": str, "domain": str, "quality": str, "linkage": str, "confidence": float},
        {
            "relevance": ("on_topic", "off_topic", "mixed", "unknown"),
            "domain": ("business_logic", "architecture", "implementation", "debugging", "devops", "meta_process", "chitchat", "unknown"),
            "quality": ("noise", "boilerplate", "signal", "decision_grade"),
            "linkage": ("this_project", "cross_project", "general_knowledge", "unrelated"),
        },
    )
)


def extractor(name: str, kinds: tuple[str, ...], system: str) -> Stage:
    """A stage whose facts are cut to its kinds; its confidence is their mean."""

    def post(x: dict) -> dict:
        facts = [f for f in x.get("facts", []) if isinstance(f, dict) and f.get("kind") in kinds and f.get("title")]
        c = [f.get("confidence", 0.5) for f in facts]
        return {"facts": facts, "confidence": sum(c) / len(c) if c else 0.0}

    return register(Stage(name, "1", system, {"facts": list}, post=post))


EXTRACTORS = {
    "decision": extractor("decision", ("decision", "constraint", "pattern"), "Extract decisions. Answer with JSON."),
    "businessLogic": extractor("businessLogic", ("business_rule", "entity", "constraint", "pattern"), "Extract business rules. Answer with JSON."),
    "intent": extractor("intent", ("intent",), "Extract intents. Answer with JSON."),
    "problemSolution": extractor("problemSolution", ("problem", "solution"), "Extract problems and solutions. Answer with JSON."),
}


def _action(x: dict) -> str | None:
    """Each action of the clusterer has fields of its own."""
    if x["action"] == "attach":
        return None if isinstance(x.get("conceptId"), str) else "conceptId is missing"
    if not str(x.get("suggestedName") or "").strip():
        return "suggestedName is missing"
    two = x.get("conceptIds")
    return "conceptIds are not two" if x["action"] == "merge" and not (isinstance(two, list) and len(two) == 2 and all(isinstance(i, str) for i in two)) else None


def _kept(field_: str, needed: tuple[str, ...], **allowed: tuple[str, ...]) -> Callable[[dict], list[dict]]:
    """The items of a list that have all the needed texts, with values of the closed vocabularies."""

    def keep(x: dict) -> list[dict]:
        items = [i for i in x.get(field_) or [] if isinstance(i, dict) and all(str(i.get(k) or "").strip() for k in needed)]
        return [i for i in items if all(i.get(k) in v for k, v in allowed.items())]

    return keep


# Vocabularies of the stages. Fixed values.
ACTIONS = ("attach", "create", "merge")
RELATIONS = ("same_as", "variant_of", "supersedes", "contradicts", "none")
VERDICTS = ("consistent", "contradicts", "a_supersedes_b", "b_supersedes_a")
RELATION_KINDS = ("relates_to", "owned_by", "part_of", "depends_on")

CLUSTERER = register(Stage("clusterer", "1", "Attach the fact to one of the concepts, create one, or merge two. Answer with JSON.", {"action": str, "confidence": float, "reason": str}, {"action": ACTIONS}, more=_action))
SUMMARIZER = register(Stage("summarizer", "1", "Name and summarise the concept of these facts. Answer with JSON.", {"name": str, "summary": str, "structured": dict}))
LINKER = register(Stage("linker", "1", "Tell how the two concepts relate. Answer with JSON.", {"relation": str, "confidence": float, "reason": str}, {"relation": RELATIONS}))
VERIFIER = register(Stage("verifier", "1", "Tell whether the two facts agree. Answer with JSON.", {"verdict": str, "confidence": float, "reason": str}, {"verdict": VERDICTS}))

_relations, _gaps = _kept("relationships", ("from", "to", "evidence"), kind=RELATION_KINDS), _kept("gaps", ("title", "why", "evidence"))
_skills, _items = _kept("skills", ("name", "evidence")), _kept("items", ("title", "description", "basis"))


def _domain(x: dict) -> dict:
    r, g = _relations(x), _gaps(x)
    said = len(x.get("relationships") or []) + len(x.get("gaps") or [])
    return {"relationships": r, "gaps": g, "confidence": (len(r) + len(g)) / said if said else 0.0}


DOMAIN_MODELER = register(Stage("domainModeler", "1", "Relations between these entities, and gaps, each with a quotation. Answer with JSON.", {"relationships": list, "gaps": list}, post=_domain))
TECHNICAL_PROFILER = register(Stage("technicalProfiler", "1", "Skills that languages, dependencies and tools show. Answer with JSON.", {"skills": list}, post=lambda x: {"skills": _skills(x), "confidence": len(_skills(x)) / len(x["skills"]) if x["skills"] else 0.0}))
INDUSTRY_CLASSIFIER = register(Stage("industryClassifier", "1", "The industry that the project serves, with evidence. Answer with JSON.", {"industry": str, "confidence": float, "domains": list, "evidence": str}))
INDUSTRY_ENRICHER = register(Stage("industryEnricher", "1", "What is standard in the industry, with its basis. Answer with JSON.", {"items": list}, post=lambda x: {"items": _items(x)[:15], "confidence": 0.5 if _items(x) else 0.0}))


def declared_evidence(evidence: Any, declared: Any):
    """Whether a text of evidence names a declared item, in either direction, case folded."""
    e = F.lower(evidence)
    return F.exists(declared, lambda a: e.contains(F.lower(a)) | F.lower(a).contains(e))


def kept_relations(relations: DataFrame, titles: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Relations (source, target, kind, evidence) whose ends are known titles and differ, of an allowed kind, with evidence; titles meet case folded, the last of equals counts."""
    t = titles.groupBy(F.lower("title").alias("lc")).agg(F.max("id").alias("id"))
    s, g = t.select(F.col("lc").alias("slc"), F.col("id").alias("source_id")), t.select(F.col("lc").alias("tlc"), F.col("id").alias("target_id"))
    r = relations.where(F.col("kind").isin(*kinds) & (F.trim(F.coalesce("evidence", F.lit(""))) != ""))
    j = r.join(s, F.lower("source") == F.col("slc")).join(g, F.lower("target") == F.col("tlc"))
    return j.where("source_id <> target_id").select("source_id", "target_id", "kind", "evidence").distinct()


RUNS = "key string, input_hash string, output_json string, ok boolean, error string"


def with_hash(stage: Stage, payloads: DataFrame, model: str = "offline") -> DataFrame:
    """(key, payload, input_hash): by stage, version, model and the payload's value."""
    name, version = stage.name, stage.version

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["input_hash"] = [input_hash(name, version, model, parsed(p)) for p in b["payload"]]
            yield b

    return payloads.select("key", "payload").mapInPandas(hashed, "key string, payload string, input_hash string")


def run(stage: Stage, payloads: DataFrame, memo: DataFrame | None = None, backend: Backend | None = None, model: str = "offline", concurrency: int = 4) -> DataFrame:
    """(key, input_hash, output_json, ok, error, cached) for payloads (key, payload as JSON text). Failures are results, too; only good ones are reused."""
    backend = backend or Offline()
    h = with_hash(stage, payloads, model)
    if memo is None:
        hits, miss = None, h
    else:
        good = memo.where("ok").groupBy("input_hash").agg(F.max_by("output_json", "produced_at").alias("output_json"))
        hits = h.join(good, "input_hash").select("key", "input_hash", "output_json", F.lit(True).alias("ok"), F.lit(None).cast("string").alias("error"), F.lit(True).alias("cached"))
        miss = h.join(good, "input_hash", "left_anti")

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for key, payload, ih in zip(b["key"], b["payload"], b["input_hash"]):
                text, why = None, None
                user = payload
                for _ in range(2):  # one repair
                    try:
                        text = backend.chat(stage.system, user)
                        x = lenient(text)
                        why = stage.check(x)
                        if why is None:
                            text = stable(stage.post(x) if stage.post else x)
                            break
                    except ValueError as e:
                        why = str(e)
                    except Exception as e:  # the backend failed; a repair won't help
                        why = str(e)
                        break
                    user = f"{payload}\n\nThe last answer was wrong: {why}"
                out.append((key, ih, text if why is None else None, why is None, why))
            yield pd.DataFrame(out, columns=["key", "input_hash", "output_json", "ok", "error"])

    fresh = miss.repartition(concurrency).mapInPandas(call, RUNS).withColumn("cached", F.lit(False))
    return fresh if hits is None else hits.unionByName(fresh)
