"""What every match of a pattern holds: short texts whose absence tells, without a search, that a rule finds nothing."""

from __future__ import annotations

import re
import warnings
from collections.abc import Sequence
from functools import lru_cache, reduce
from operator import or_

from pyspark.sql import Column, functions as F

#: Shorter texts tell too little.
LEAST = 2
_PLAIN = re.compile(r"[\x20-\x7E]+")
#: (text, whether letters count in either case); of a tuple of these every match holds one.
Needed = tuple[tuple[str, bool], ...]


def _better(a: Needed | None, b: Needed | None) -> Needed | None:
    """The one whose shortest text is longer, of equal ones that with fewer texts."""
    rank = lambda n: (min(len(text) for text, _ in n), -len(n))
    return b if a is None else a if b is None or rank(a) >= rank(b) else b


def _of_sequence(items, flags: int) -> Needed | None:
    best, run = None, ""

    def closed() -> Needed | None:
        fold = bool(flags & re.IGNORECASE) and run.lower() != run.upper()
        text = run.lower() if fold else run
        return ((text, fold),) if len(text) >= LEAST and _PLAIN.fullmatch(text) else None

    for op, value in items:
        name = str(op)
        if name == "LITERAL":
            run += chr(value)
            continue
        best, run = _better(best, closed()), ""
        inner = None
        if name == "SUBPATTERN":
            inner = _of_sequence(value[3], (flags | value[1]) & ~value[2])
        elif name == "ATOMIC_GROUP":
            inner = _of_sequence(value, flags)
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and value[0] > 0:
            inner = _of_sequence(value[2], flags)
        elif name == "BRANCH":
            parts = [_of_sequence(branch, flags) for branch in value[1]]
            inner = tuple(dict.fromkeys(n for part in parts for n in part)) if all(parts) else None
        best = _better(best, inner)
    return _better(best, closed())


@lru_cache(maxsize=None)
def needed(pattern: str) -> Needed | None:
    """Texts of which every match of a pattern holds one; None where the pattern names none, or is written in a way only Java reads."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("error")  # nested sets are read otherwise there
            parsed = re._parser.parse(pattern)
    except (re.error, Warning, OverflowError, RecursionError):
        return None
    return _of_sequence(parsed, parsed.state.flags)


def may_match(text: Column, pattern: str) -> Column | None:
    """False where ``pattern`` surely matches nowhere in ``text``; None where only the search tells."""
    found = needed(pattern)
    return None if found is None else holds_any(text, found)


def holds_any(text: Column, needs: Sequence[tuple[str, bool]]) -> Column:
    return reduce(or_, [F.contains(F.lower(text) if fold else text, F.lit(value)) for value, fold in needs])
