"""Prompts as templates over columns: the text for a model is built where the rows are."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_EXCERPTS = 5
DESCRIPTION_CHARS = 500


def load(path: str | Path) -> dict[str, str]:
    """Named templates of a YAML file."""
    import yaml

    with open(path, encoding="utf-8") as f:
        return {k: v for k, v in (yaml.safe_load(f) or {}).items() if isinstance(v, str)}


def render(template: str, **values: Column) -> Column:
    """``{name}`` placeholders filled from columns; NULL reads as empty."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit(f"{{{name}}}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def context_prompt(template: str, governance_template: str, verbatim: Column, excerpts: Column, **values: Column) -> Column:
    """Prompt for an entity: the shorter governance template where a verbatim definition is known,
    the description cut, and at most five excerpts appended."""
    values = {k: F.left(v, F.lit(DESCRIPTION_CHARS)) if k == "description" else v for k, v in values.items()}
    head = F.when(verbatim.isNotNull(), render(governance_template, **values)).otherwise(render(template, **values))
    listed = F.array_join(F.slice(excerpts, 1, MAX_EXCERPTS), "\n---\n")
    return F.when(F.size(excerpts) > 0, F.concat(head, F.lit("\n\n"), listed)).otherwise(head)
