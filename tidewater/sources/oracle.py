"""DuckDB statements assembled from named common table expressions."""

from __future__ import annotations

import re
from collections import Counter

from tidewater.sources.fixtures import VIEWS

#: Every named expression; modules add theirs.
NAMED: dict[str, str] = dict(VIEWS)
_WORD = re.compile(r"\b\w+\b")


def statement(final: str) -> str:
    """``final`` with the named expressions that it uses, each before its users; those used more than once are kept as tables."""
    order: list[str] = []

    def visit(sql: str) -> None:
        for word in dict.fromkeys(_WORD.findall(sql)):
            if word in NAMED and word not in order:
                visit(NAMED[word])
                if word not in order:
                    order.append(word)

    visit(final)
    if not order:
        return final
    used = Counter(word for sql in [final, *[NAMED[n] for n in order]] for word in _WORD.findall(sql) if word in NAMED)
    return "with " + ",\n".join(f"{n} as {'materialized ' if used[n] > 1 else ''}(\n{NAMED[n].strip()}\n)" for n in order) + f"\n{final}"
