"""Named contexts: which roots belong together, and where their store is. A small driver-side file."""

from __future__ import annotations

import json
import re
from datetime import datetime, timezone
from pathlib import Path

_NAME = re.compile(r"[a-z0-9_-]+")


class ContextError(ValueError):
    pass


class Contexts:
    def __init__(self, data_dir: str):
        self.root = Path(data_dir)
        self.file = self.root / "contexts.json"

    def _load(self) -> dict:
        try:
            found = json.loads(self.file.read_text())
        except (OSError, ValueError):
            return {"active": None, "contexts": {}}
        return found if isinstance(found.get("contexts"), dict) else {"active": None, "contexts": {}}

    def _save(self, state: dict) -> None:
        self.root.mkdir(parents=True, exist_ok=True)
        fresh = self.file.with_suffix(".tmp")
        fresh.write_text(json.dumps(state, indent=2))
        fresh.replace(self.file)

    def _get(self, state: dict, name: str) -> dict:
        if name not in state["contexts"]:
            raise ContextError(f"no context named {name}")
        return state["contexts"][name]

    def create(self, name: str, paths: tuple[str, ...] = ()) -> dict:
        if not _NAME.fullmatch(name):
            raise ContextError("a name has lower-case letters, digits, _ and - only")
        state = self._load()
        if name in state["contexts"]:
            raise ContextError(f"context {name} exists")
        now = datetime.now(timezone.utc).isoformat()
        state["contexts"][name] = {"name": name, "paths": list(dict.fromkeys(paths)), "created": now}
        self._save(state)
        return state["contexts"][name]

    def delete(self, name: str) -> None:
        state = self._load()
        self._get(state, name)
        del state["contexts"][name]
        if state["active"] == name:
            state["active"] = None
        self._save(state)

    def add_path(self, name: str, path: str) -> None:
        state = self._load()
        paths = self._get(state, name)["paths"]
        if path not in paths:
            paths.append(path)
            self._save(state)

    def remove_path(self, name: str, path: str) -> None:
        state = self._load()
        paths = self._get(state, name)["paths"]
        if path not in paths:
            raise ContextError(f"{path} isn't in {name}")
        paths.remove(path)
        self._save(state)

    def use(self, name: str | None) -> None:
        state = self._load()
        if name is not None:
            self._get(state, name)
        state["active"] = name
        self._save(state)

    def get(self, name: str) -> dict:
        return self._get(self._load(), name)

    def list(self) -> list[dict]:
        return sorted(self._load()["contexts"].values(), key=lambda c: c["name"])

    def active(self) -> dict | None:
        state = self._load()
        return state["contexts"].get(state["active"]) if state["active"] else None

    def resolve(self, name: str | None = None) -> dict:
        """The named context, else the active one, else an error."""
        found = self.get(name) if name else self.active()
        if found is None:
            raise ContextError("no context is active; name one")
        return found

    def store_path(self, name: str) -> str:
        return str(self.root / "contexts" / name)
