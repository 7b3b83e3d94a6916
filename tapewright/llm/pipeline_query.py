"""Registers the pipeline at the repository's top as a query."""

from __future__ import annotations

import corpus_pipeline


def queries() -> dict:
    return {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
