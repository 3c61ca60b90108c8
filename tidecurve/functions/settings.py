"""Settings of a run, merged from the command line and a nested file of defaults."""

from __future__ import annotations

from typing import Any


def _first(tree: Any, key: str) -> Any:
    """The first value of ``key`` that is not None, in the order of the tree, at any depth."""
    if not isinstance(tree, dict):
        return None
    if not isinstance(tree.get(key), dict) and tree.get(key) is not None:
        return tree[key]
    return next((v for child in tree.values() if (v := _first(child, key)) is not None), None)


def merged(given: dict[str, Any], defaults: dict, architecture: str, objective: str) -> dict[str, Any]:
    """Every key of ``given`` with its own value, else that of its architecture and objective, else the first anywhere."""
    own = (defaults.get(architecture) or {}).get(objective) or {}
    return {k: v if v is not None else own[k] if own.get(k) is not None else _first(defaults, k) for k, v in given.items()}


def inverted_ids(ids: str, highest: int = 3) -> str:
    """A comma list of device ids counted from the other end."""
    return ",".join(str(highest - int(v)) for v in ids.split(",") if v.strip())
