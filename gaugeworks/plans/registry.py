"""All registered queries with their checking SQL."""

from gaugeworks.plans import (
    catalog_queries, keyed_queries, lineage_queries, quality_queries, sensor_queries,
    stream_queries,
)

_MODULES = [
    sensor_queries, quality_queries, keyed_queries, catalog_queries, lineage_queries,
    stream_queries,
]

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLE = {name: sql for module in _MODULES for name, sql in module.ORACLE.items()}
