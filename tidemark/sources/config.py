"""A run's flat settings: ``key: value`` lines, no nesting, no inline comments, the last of equal keys counts."""

from __future__ import annotations

import ast
from pathlib import Path

REQUIRED = ("video_url", "run_id", "output_dir")


def scalar(value: str):
    """Blank is an empty string, null, none and ~ are None, true and false booleans; quoted and bracketed values are Python literals; all else stays text."""
    value = value.strip()
    known = {"": "", "null": None, "none": None, "~": None, "true": True, "false": False}
    if value.lower() in known:
        return known[value.lower()]
    if value[0] in "\"'[":
        try:
            return ast.literal_eval(value)
        except (ValueError, SyntaxError):
            return value.strip("\"'")
    return value


def parse(text: str) -> dict:
    out = {}
    for line in text.lstrip("\ufeff").splitlines():
        if line.strip() and not line.lstrip().startswith("#") and ":" in line:
            key, _, value = line.partition(":")
            out[key.strip()] = scalar(value)
    missing = [key for key in REQUIRED if not str(out.get(key) or "").strip()]
    if missing:
        raise ValueError(f"missing settings: {', '.join(missing)}")
    return out


def load(path: str) -> dict:
    return parse(Path(path).read_text(encoding="utf-8-sig"))


def run_id(value: str) -> str:
    value = (value or "").strip()
    if value in ("", ".", "..") or "/" in value or "\\" in value:
        raise ValueError(f"not a run id: {value!r}")
    return value
