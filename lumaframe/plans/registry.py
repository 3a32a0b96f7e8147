"""All queries of the engine by name, with the SQL each must equal where SQL can say it."""

from __future__ import annotations

from lumaframe.plans import analysis_queries, kernel_queries, pixel_queries, view_queries, vision_queries

MODULES = (pixel_queries, analysis_queries, view_queries, kernel_queries, vision_queries)
QUERIES: dict = {}
ORACLE: dict[str, str] = {}
for _module in MODULES:
    QUERIES.update(_module.QUERIES)
    ORACLE.update(_module.ORACLE)
