"""What a Python worker remembers between tasks, and when it lets go.

Workers are reused. An operator whose tokenizer has learnt words keeps them for its
next task; a task of another operator that starts in the same worker drops them.
"""

from __future__ import annotations

from collections.abc import Callable

from graphloom.llm.sampling import give_back_memory

_kept: dict[str, Callable[[], None]] = {}
_now: list[str] = []


def claim(owner: str, forget: Callable[[], None] | None = None) -> None:
    """This worker now works for ``owner``: others' memories go, its own can be dropped by ``forget``."""
    if _now and _now[0] != owner:
        for name in [name for name in _kept if name != owner]:
            _kept.pop(name)()
        give_back_memory()
    _now[:] = [owner]
    if forget:
        _kept[owner] = forget
