"""Validation targets (YAML or JSON) and expected results (JSON): small driver-side files."""

from __future__ import annotations

import json
from pathlib import Path


def load_targets(path: str) -> list[dict]:
    """Checks of a target file. It must be a mapping with a list `checks`, each with check_id and expected_result_key."""
    text = Path(path).read_text(encoding="utf-8")
    if str(path).endswith(".json"):
        found = json.loads(text)
    else:
        import yaml

        found = yaml.safe_load(text)
    if not isinstance(found, dict) or not isinstance(found.get("checks"), list):
        raise ValueError("targets must be a mapping with a list 'checks'")
    for check in found["checks"]:
        if lacking := [k for k in ("check_id", "expected_result_key") if k not in check]:
            raise ValueError(f"a check lacks {', '.join(lacking)}")
    return found["checks"]


def load_expected(path: str) -> dict:
    found = json.loads(Path(path).read_text(encoding="utf-8"))
    if not isinstance(found, dict):
        raise ValueError("expected results must be a JSON object")
    return found
