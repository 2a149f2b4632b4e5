"""Generator slot (O-84): a registry of named callables ``generate(request_json, row) -> str``.

No network client is built. ``echo`` returns the request itself; ``table_reply`` returns the
reply already stored on the row (replies produced earlier by any model, or fixtures), which
lets the model-in-the-loop fold be checked against the relational fold.
"""

from __future__ import annotations

from collections.abc import Callable

Generator = Callable[[str, dict], str]


def echo(request: str, row: dict) -> str:
    return request


def table_reply(request: str, row: dict) -> str:
    return row.get("reply_text") or ""


_REGISTRY: dict[str, Generator] = {"echo": echo, "table_reply": table_reply}


def register(name: str, fn: Generator) -> None:
    _REGISTRY[name] = fn


def get(name: str) -> Generator:
    try:
        return _REGISTRY[name]
    except KeyError:
        raise ValueError(f"unknown generator '{name}'; known: {sorted(_REGISTRY)}") from None
