"""Settings from a properties file: `key = value` a line, # and ! begin comments."""

from __future__ import annotations

import re
from pathlib import Path

#: Keys that the command line reads; keys that begin with "spark." go to the session.
KEYS = ("root", "port", "splits", "width", "log.level")


def read(path: str) -> dict[str, str]:
    """The file's settings; unknown keys are errors."""
    out: dict[str, str] = {}
    for number, line in enumerate(Path(path).read_text().splitlines(), 1):
        line = line.strip()
        if not line or line[0] in "#!":
            continue
        m = re.fullmatch(r"([\w.]+)\s*[=:]\s*(.*)", line)
        if not m:
            raise ValueError(f"{path}:{number}: can't read {line!r}")
        if m[1] not in KEYS and not m[1].startswith("spark."):
            raise ValueError(f"{path}:{number}: unknown key {m[1]!r}")
        out[m[1]] = m[2]
    return out
