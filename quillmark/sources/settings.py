"""Settings on the driver: a remote service's address, whether the first run is done, what an older version left behind."""

from __future__ import annotations

import json
import shutil
from pathlib import Path

#: Without all of these the service can't be asked.
NEEDED = ("api_key", "base_url", "model")


def load(path: str) -> dict:
    """Settings from a JSON file; a missing or broken one has none."""
    try:
        got = json.loads(Path(path).read_text("utf-8"))
    except (OSError, ValueError):
        return {}
    return got if isinstance(got, dict) else {}


def save(path: str, settings: dict) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(settings, ensure_ascii=False, indent=2), "utf-8")


def configured(path: str) -> bool:
    s = load(path)
    return all(s.get(k) for k in NEEDED)


def first_run(mark: str) -> bool:
    return not Path(mark).exists()


def setup_done(mark: str) -> None:
    Path(mark).parent.mkdir(parents=True, exist_ok=True)
    Path(mark).write_text("1", "utf-8")


def migrate_history(old: str, new: str) -> int:
    """Copy an older history where there is no new one; how many entries that are. Keys of a service are never copied."""
    if not Path(old).exists() or Path(new).exists():
        return 0
    Path(new).parent.mkdir(parents=True, exist_ok=True)
    shutil.copy2(old, new)
    try:
        rows = json.loads(Path(new).read_text("utf-8"))
    except ValueError:
        return 0
    return len(rows) if isinstance(rows, list) else 0
