"""Training-data operators: cleaning, formatting, deduplication, tokenising and search.

Nothing outside this subpackage imports it.  `queries()` and `oracle_sql()` hold the
registered queries of its ten operators; the entry module adds them when it can.
"""

from __future__ import annotations


def queries() -> dict:
    from . import registry

    return registry.queries()


def oracle_sql() -> dict:
    from . import registry

    return registry.oracle_sql()
