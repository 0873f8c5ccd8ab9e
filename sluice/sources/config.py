"""Settings: defaults, then a YAML file's common and mode sections, then overrides; and rule files read anew when they change."""

from __future__ import annotations

import os
import time
import warnings
from collections.abc import Callable


def flatten(tree: dict, prefix: str = "") -> dict[str, str]:
    """Nested mappings with dotted keys."""
    out: dict[str, str] = {}
    for k, v in (tree or {}).items():
        key = f"{prefix}{k}"
        out |= flatten(v, f"{key}.") if isinstance(v, dict) else {key: "" if v is None else str(v)}
    return out


def merge(mode: str, defaults: dict[str, str], text: str | None = None, overrides: dict[str, str] | None = None) -> dict[str, str]:
    """Later sources win; an override of a value that the file sets gives a warning."""
    out, doc = dict(defaults), {}
    if text:
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("settings in YAML need PyYAML") from e
        tree = yaml.safe_load(text) or {}
        doc = flatten(tree.get("common") or {}) | flatten(tree.get(mode) or {})
    out |= doc
    for k, v in (overrides or {}).items():
        if k in doc and doc[k] != v:
            warnings.warn(f"{k}: {v} replaces {doc[k]} of the file", stacklevel=2)
        out[k] = v
    return out


def parse_arguments(arguments: list[str]) -> dict[str, str]:
    """``key=value`` words."""
    bad = [a for a in arguments if "=" not in a or a.startswith("=")]
    if bad:
        raise ValueError(f"key=value expected: {bad[0]}")
    return dict(a.split("=", 1) for a in arguments)


class Watched:
    """What ``load`` makes of files, made anew when one has changed, at most every ``interval`` seconds; kept, with a warning, if they can't be read.

    Call it in ``foreachBatch``: rules are constants of a batch's plan.
    """

    def __init__(self, paths: list[str], load: Callable, interval: float = 5.0):
        self.paths, self.load, self.interval = paths, load, max(1.0, interval)
        self.seen, self.looked, self.value = self._times(), time.monotonic(), load(*paths)

    def _times(self) -> list[int]:
        return [os.stat(p).st_mtime_ns for p in self.paths]

    def __call__(self):
        if time.monotonic() - self.looked >= self.interval:
            self.looked = time.monotonic()
            try:
                now = self._times()
                if now != self.seen:
                    self.seen = now
                    self.value = self.load(*self.paths)
            except Exception as e:  # whatever is wrong with new files, the last good ones stay in force
                warnings.warn(f"{', '.join(self.paths)}: not read anew: {e}", stacklevel=2)
        return self.value


# Least and greatest value of numeric settings.
BOUNDS = {"snaplen": (64, 262_144), "workers": (1, 32), "queueCapacity": (1, 65_536), "rollMiB": (8, 10_240)}


def checked(settings: dict[str, str]) -> dict[str, str]:
    """The settings, if all numeric ones are whole numbers within their bounds."""
    for key, (least, most) in BOUNDS.items():
        value = settings.get(key)
        if value is not None and not (str(value).strip().isascii() and str(value).strip().isdigit() and least <= int(value) <= most):
            raise ValueError(f"{key} must be a number from {least} to {most}: {value}")
    return settings
