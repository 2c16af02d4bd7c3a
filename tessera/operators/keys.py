"""Joins by the ids of projects' parts. Two projects may number rooms and materials alike, so a project's id belongs to the key."""

from __future__ import annotations

from pyspark.sql import DataFrame


def scoped(left: DataFrame, right: DataFrame, key: str) -> list[str]:
    """The columns to join on: project_id and `key`, or `key` alone where a side (a catalogue that all projects share) has no project_id."""
    return ["project_id", key] if "project_id" in left.columns and "project_id" in right.columns else [key]


def having(df: DataFrame, *columns: str) -> list[str]:
    """Those of the columns that df has."""
    return [c for c in columns if c in df.columns]
