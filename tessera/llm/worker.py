"""What a Python worker remembers from batch to batch.

Spark uses a worker for one task after another, of whatever stage comes next. An operator that
keeps something (a cache, a model) claims the worker for itself; what the operator before had
kept is then released, so that no worker holds the memory of two operators.
"""

from __future__ import annotations

from collections.abc import Callable

_owner: tuple[str, Callable[[], None]] = ("", lambda: None)


def claim(name: str, release: Callable[[], None] = lambda: None) -> None:
    """The worker now belongs to ``name``; ``release`` frees what it keeps when another claims the worker."""
    global _owner
    if _owner[0] != name:
        _owner[1]()
        _owner = name, release
