"""Every query by name, with the DuckDB SQL it must equal."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Callable], Callable]:
    """Register a query (spark, sf_dir) -> DataFrame; without SQL only its rows can be checked."""

    def register(f: Callable) -> Callable:
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return register


from . import answer_queries, corpus_queries, eval_queries, log_queries, markdown_queries, storage_queries  # noqa: E402, F401
