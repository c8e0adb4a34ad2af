"""Settings of a scan, from a key=value file and the command line."""

from __future__ import annotations

import sys
from dataclasses import dataclass, field


@dataclass
class ScanConfig:
    path: str = ""
    threshold: float = 80.0
    output: str = "report.txt"
    html: str = ""
    json: str = ""
    ignore: list[str] = field(default_factory=list)
    git_only: bool = False
    model: str = ""
    tokenizer: str = ""
    zscore: float = 2.5


def _warn(text: str) -> None:
    print(f"warning: {text}", file=sys.stderr)


def load_config(path: str, into: ScanConfig | None = None) -> ScanConfig:
    """Reads key=value lines; # begins a comment line. Lines, numbers and keys that can't be used give a warning only.

    `ignore` may be repeated and adds up; `git-only` is on for "true" and "1".
    """
    c = into or ScanConfig()
    try:
        with open(path, encoding="utf-8") as f:
            lines = f.read().split("\n")
    except OSError:
        _warn(f"can't open {path}")
        return c
    for line in (x.strip(" \t\r\n") for x in lines):
        if not line or line[0] == "#":
            continue
        key, equals, value = (x.strip(" \t\r\n") for x in line.partition("="))
        if not equals:
            _warn(f"no '=' in line: {line}")
        elif key == "threshold":
            try:
                c.threshold = float(value)
            except ValueError:
                _warn(f"threshold is no number: {value}")
        elif key in ("path", "output", "html", "json"):
            setattr(c, key, value)
        elif key == "ignore":
            c.ignore.append(value)
        elif key == "git-only":
            c.git_only = value in ("true", "1")
        else:
            _warn(f"unknown key: {key}")
    return c
