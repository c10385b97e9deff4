"""Typed schemas of the layers' tables, closed vocabularies and their checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


FILES = "path string not null, content_hash string, language string, size long, modified_at timestamp, indexed_at timestamp, node_count int, errors array<string>"
NODES = "id string not null, kind string, name string, qualified_name string, file_path string, language string, start_line int, end_line int, start_column int, end_column int, docstring string, signature string, visibility string, is_exported boolean, is_async boolean, is_static boolean, is_abstract boolean, decorators array<string>, type_parameters array<string>, updated_at timestamp"
EDGES = "source string not null, target string not null, kind string not null, metadata string, line int, col int, provenance string"
UNRESOLVED = "from_node_id string, reference_name string, reference_kind string, line int, col int, candidates array<string>, file_path string, language string"
SESSIONS = "id string not null, agent string, source_id string, source_path string, started_at timestamp, ended_at timestamp, title string, ingested_at timestamp, ingest_offset long"
TOOL_CALL = "struct<name: string, args: string, result_excerpt: string, target_paths: array<string>>"
RAW_TURNS = f"source_path string, position long, role string, text string, ts long, tool_calls array<{TOOL_CALL}>"
TURNS = "id string not null, session_id string not null, idx int not null, role string, text string, ts timestamp, raw string"
TOOL_CALLS = "id string not null, turn_id string, name string, args string, result_excerpt string, target_paths array<string>"
WINDOWS = "id string not null, session_id string, start_turn string, end_turn string, text_hash string, text string"
TRIAGE = "window_id string not null, relevance string, domain string, quality string, linkage string, confidence double, rationale string, model string, produced_at timestamp, kept boolean, dup_of string"
FACTS = "id string not null, kind string, title string, summary string, evidence_text string, confidence double, source string, agent_model string, grounding string, scope string, source_url string, created_at timestamp, updated_at timestamp, cluster_id string"
FACT_EDGES = "source string not null, target string not null, kind string not null, weight double, metadata string"
PROVENANCE = "k_node_id string not null, window_id string, span_start int, span_end int"
CODE_LINKS = "k_node_id string not null, code_node_id string, code_file string, weight double"
CONCEPTS = "id string not null, name string, summary string, domain string, scope string, grounding string, member_count int, embedding array<float>"
AGENT_RUNS = "agent_name string, model string, input_hash string, output_json string, ms long, ok boolean, error string, produced_at timestamp"
SKILLS = "id string not null, name string, scope string, kind string, evidence_weight double, grounding string, project_count int"

# Closed vocabularies; fixed values.
LANGUAGES = ("typescript", "javascript", "python", "dart", "go", "rust", "java", "csharp", "sql", "unknown")
ROLES = ("user", "assistant", "tool", "system")
GROUNDINGS = ("structural", "corroborated", "stated", "external", "model")
SCOPES = ("industry", "technical", "meta")
LINK_KINDS = ("same_as", "variant_of", "supersedes", "contradicts")
ENTITY_KINDS = ("entity",)
EVIDENCE_KINDS = ("code_block", "shell_command", "path_mention", "url", "ticket_id", "error_message", "stack_trace", "dependency", "knowledge_gap", "skill", "industry")


def conform(df: DataFrame, schema: StructType | str) -> DataFrame:
    """The columns of a schema (or its DDL), missing ones null, others left out: additive evolution."""
    have = set(df.columns)
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


def violations(df: DataFrame, column: str, allowed: tuple[str, ...]) -> DataFrame:
    """Rows whose value is outside a closed vocabulary; null passes."""
    return df.where(F.col(column).isNotNull() & ~F.col(column).isin(*allowed))


def dangling(child: DataFrame, key: str, parent: DataFrame, parent_key: str = "id") -> DataFrame:
    """Child rows whose parent is missing: empty where the reference holds."""
    return child.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")
