"""Training-data operators.  Nothing outside this package imports it.

``queries()`` and ``oracles()`` are what ``__spark_entry__`` registers.
"""

from __future__ import annotations


def queries() -> dict:
    from plumbline.llm import registry

    return registry.queries()


def oracles() -> dict:
    from plumbline.llm import registry

    return registry.oracles()
