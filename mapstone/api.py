"""The engine's tools by name: each takes a graph and plain arguments and gives Markdown within a budget."""

from __future__ import annotations

from .plans import render

TOOLS = {
    "get_architecture_overview": render.overview,
    "get_module": render.module,
    "find_dependencies": render.dependencies,
    "get_impact": render.impact,
    "search_nodes": render.search,
    "get_file_context": render.file_context,
    "get_doc": render.doc,
    "get_db_schema": render.db_schema,
    "get_entity_relations": render.entity_relations,
    "get_schema_drift": render.schema_drift,
    "get_timeline": render.timeline,
    "get_architecture_history": render.history,
    "get_architecture_diff": render.diff,
}


def call(tool: str, *args, **kwargs) -> str:
    if tool not in TOOLS:
        raise ValueError(f"no tool named {tool}; there are {', '.join(TOOLS)}")
    return TOOLS[tool](*args, **kwargs)
