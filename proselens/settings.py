"""Settings: defaults, and a TOML file laid over them."""

from __future__ import annotations

import os
import re
import tomllib
from dataclasses import dataclass, field, replace

from proselens.rulesdata import FLOOR, LISTS, THRESHOLD, WEIGHTS, rule_id

FILE = "proselens.toml"


class SettingsError(ValueError):
    pass


def glob_pattern(glob: str) -> re.Pattern:
    """`*` and `?` stay within a path component, `**` crosses them."""
    out, k = "", 0
    while k < len(glob):
        if glob.startswith("**/", k):
            out, k = out + "(?:.*/)?", k + 3
        elif glob.startswith("/**", k) and k + 3 == len(glob):
            out, k = out + "/.+", k + 3
        elif glob.startswith("**", k):
            out, k = out + ".*", k + 2
        elif glob[k] in "*?":
            out, k = out + ("[^/]*" if glob[k] == "*" else "[^/]"), k + 1
        elif glob[k] == "[":
            end = glob.find("]", k + 2)
            if end < 0:
                raise SettingsError(f"the class of {glob!r} is not closed")
            out, k = out + "[" + glob[k + 1 : end].replace("!", "^", 1) + "]", end + 1
        else:
            out, k = out + re.escape(glob[k]), k + 1
    return re.compile(out)


@dataclass(frozen=True)
class Settings:
    threshold: float = THRESHOLD
    floor: int = FLOOR
    weights: dict[str, float] = field(default_factory=lambda: dict(WEIGHTS))
    lists: dict[str, dict[str, list[str]]] = field(default_factory=lambda: {r: {g: list(w) for g, w in gs.items()} for r, gs in LISTS.items()})
    exclude: tuple[str, ...] = ()
    root: str = "."

    @staticmethod
    def load(path: str | None = None, start: str = ".") -> Settings:
        """From path, or the nearest settings file at or above start (a file or a folder); else the defaults."""
        found = path or find(start)
        return Settings() if found is None else Settings().overlay(found)

    def overlay(self, path: str) -> Settings:
        with open(path, "rb") as f:
            try:
                data = tomllib.load(f)
            except tomllib.TOMLDecodeError as e:
                raise SettingsError(f"{path}: {e}") from e
        if unknown := set(data) - {"threshold", "floor", "exclude", "weights", "lists"}:
            raise SettingsError(f"{path}: unknown keys {sorted(unknown)}")
        weights = dict(self.weights)
        for rule, w in data.get("weights", {}).items():
            weights[_known(rule, weights, path)] = float(w)
        lists = {r: {g: list(ws) for g, ws in gs.items()} for r, gs in self.lists.items()}
        for rule, groups in data.get("lists", {}).items():
            if _known(rule, self.weights, path) not in lists:
                raise SettingsError(f"{path}: {rule} has no word list")
            for group, change in groups.items():
                if group not in lists[rule]:
                    raise SettingsError(f"{path}: {rule} has no group {group}")
                if set(change) - {"add", "remove"}:
                    raise SettingsError(f"{path}: {rule}.{group} takes add and remove")
                words = dict.fromkeys([*lists[rule][group], *change.get("add", [])])
                lists[rule][group] = [w for w in words if w not in set(change.get("remove", []))]
        exclude = tuple(data.get("exclude", self.exclude))
        for g in exclude:
            glob_pattern(g)
        return replace(self, threshold=float(data.get("threshold", self.threshold)), floor=int(data.get("floor", self.floor)), weights=weights, lists=lists, exclude=exclude, root=os.path.dirname(os.path.abspath(path)))

    def excludes(self, path: str) -> bool:
        """Whether a glob matches the path below the root; what lies outside it never matches."""
        inner = os.path.relpath(os.path.normpath(os.path.abspath(path)), os.path.abspath(self.root)).replace(os.sep, "/")
        return not inner.startswith("../") and any(glob_pattern(g).fullmatch(inner) for g in self.exclude)


def _known(rule: str, weights: dict, path: str) -> str:
    try:
        if rule_id(rule) in weights:
            return rule
    except ValueError as e:
        raise SettingsError(f"{path}: {e}") from e
    raise SettingsError(f"{path}: unknown rule {rule}")


def find(start: str) -> str | None:
    at = os.path.abspath(start)
    while True:
        if os.path.isfile(os.path.join(at, FILE)):
            return os.path.join(at, FILE)
        if os.path.dirname(at) == at:
            return None
        at = os.path.dirname(at)
