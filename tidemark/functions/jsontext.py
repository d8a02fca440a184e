"""JSON text compared as value, for Arrow batches in Python workers."""

from __future__ import annotations

import json


def _number(text: str):
    x = float(text)
    return int(x) if x.is_integer() else (x if x == x and abs(x) != float("inf") else text)


def _refuse(word: str):
    raise ValueError(word)


_decoder = json.JSONDecoder(parse_float=_number, parse_constant=_refuse)
_encode = json.JSONEncoder(sort_keys=True, separators=(",", ":"), ensure_ascii=True).encode


def value_text(text: str | None) -> str | None:
    """Canonical text of a JSON value; null if the text is null or no JSON.

    Member order, spacing, escapes and the spelling of numbers don't matter
    (``1``, ``1.0`` and ``1e0`` are equal); a repeated member's last value holds.
    """
    if text is None:
        return None
    try:
        return _encode(_decoder.decode(text))
    except (ValueError, RecursionError):
        return None


def decode(text: str):
    """The value of a text that is whole JSON, fractions kept apart; raises ValueError."""
    try:
        return _strict.decode(text)
    except RecursionError as e:
        raise ValueError("too deep") from e


_strict = json.JSONDecoder(parse_constant=_refuse)
