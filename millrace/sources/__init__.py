"""Readers. All take one path or several, local or of any scheme that Hadoop knows, and walk folders recursively."""

from __future__ import annotations

import re


def prefix(value: str) -> str:
    """A store's key prefix as a path pattern: ``s3://b/foo`` also stands for ``foobar/...``, which a folder's path doesn't."""
    return paths(value)[0] + "*"


def paths(value: str | list[str]) -> list[str]:
    """A list of paths; ``s3://`` becomes ``s3a://``, the scheme that Hadoop serves (with its own retries)."""
    return [re.sub("^s3://", "s3a://", p) for p in ([value] if isinstance(value, str) else list(value))]
