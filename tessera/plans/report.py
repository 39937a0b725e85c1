"""Markdown reports and the data dictionary, from small collected frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def markdown_table(df: DataFrame, limit: int = 200) -> str:
    """A DataFrame as a Markdown table; for report frames, which are small (limit rows at most)."""
    rows = df.limit(limit).collect()
    cell = lambda v: "" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v).replace("|", "\\|")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join([*lines, *["| " + " | ".join(cell(v) for v in r) + " |" for r in rows]])


def render(title: str, sections: Sequence[tuple[str, DataFrame]]) -> str:
    return "\n\n".join([f"# {title}", *[f"## {name}\n\n{markdown_table(df)}" for name, df in sections]]) + "\n"


def dictionary(tables: dict[str, DataFrame], notes: dict[str, str]) -> str:
    """Columns and types of every table with its description."""
    parts = []
    for name, df in tables.items():
        lines = [f"## {name}", "", notes.get(name, ""), "", "| column | type |", "|---|---|"]
        parts.append("\n".join([*lines, *[f"| {f.name} | {f.dataType.simpleString()} |" for f in df.schema]]))
    return "\n\n".join(parts) + "\n"


def undocumented(tables: dict[str, DataFrame], notes: dict[str, str]) -> list[str]:
    return sorted(set(tables) - set(notes))
