"""All registered queries and their SQL counterparts."""

from __future__ import annotations

from virosieve.workload.ingest_oracles import ingest_oracles
from virosieve.workload.ingest_queries import ingest_queries
from virosieve.workload.oracles import query_oracles
from virosieve.workload.queries import Query, query_operators
from virosieve.workload.source_oracles import source_oracles
from virosieve.workload.source_queries import source_queries
from virosieve.workload.upkeep_queries import upkeep_oracles, upkeep_queries


def all_queries() -> dict[str, Query]:
    return {**query_operators(), **ingest_queries(), **source_queries(), **upkeep_queries()}


def all_oracles() -> dict[str, str]:
    return {**query_oracles(), **ingest_oracles(), **source_oracles(), **upkeep_oracles()}
