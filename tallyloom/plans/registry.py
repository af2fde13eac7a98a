"""All queries outside ``llm``, with their SQL."""

from __future__ import annotations

from tallyloom.plans import core_queries, edges, fits, fusion, governance, inference, measures, more, relational, sequences, studies, texts, vectors

MODULES = (core_queries, relational, sequences, texts, vectors, studies, fits, fusion, governance, inference, measures, more, edges)

FLAGSHIP = "p1_wide_cells"


def queries() -> dict:
    out: dict = {}
    for m in MODULES:
        if both := out.keys() & m.QUERIES.keys():
            raise ValueError(f"two queries of one name: {sorted(both)}")
        out |= m.QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.ORACLES.items()}
