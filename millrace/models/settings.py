"""Nested settings by dotted names; driver-side, as models' configurations are."""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping
from pathlib import Path
from typing import Any


class Settings(Mapping[str, Any]):
    """A tree of settings: ``s["a.b"]`` reads a leaf or a branch, each name also in capitals; setting makes missing branches."""

    def __init__(self, values: Mapping[str, Any] | None = None) -> None:
        self._tree: dict[str, Any] = {}
        for name, value in (values or {}).items():
            self[name] = value

    def __setitem__(self, name: str, value: Any) -> None:
        branch, _, rest = name.partition(".")
        if rest:
            below = self._tree.setdefault(branch, Settings())
            if not isinstance(below, Settings):
                raise KeyError(f"{branch} is a value, not a branch")
            below[rest] = value
        else:
            self._tree[branch] = Settings(value) if isinstance(value, Mapping) else value

    def __getitem__(self, name: str) -> Any:
        branch, _, rest = name.partition(".")
        exact = branch if branch in self._tree else next((k for k in self._tree if k.upper() == branch), branch)
        found = self._tree[exact]
        if not rest:
            return found
        if not isinstance(found, Settings):
            raise KeyError(name)
        return found[rest]

    def __iter__(self) -> Iterator[str]:
        return iter(self._tree)

    def __len__(self) -> int:
        return len(self._tree)

    def to_dict(self) -> dict[str, Any]:
        return {k: v.to_dict() if isinstance(v, Settings) else v for k, v in self._tree.items()}

    def dump(self, path: str | Path) -> None:
        Path(path).write_text(json.dumps(self.to_dict(), indent=1))

    @classmethod
    def load(cls, path: str | Path) -> Settings:
        return cls(json.loads(Path(path).read_text()))
