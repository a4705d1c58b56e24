"""Project configuration from TOML text, read on the driver."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from .engine import Config

#: Rules of the default file with their switches and severities.
DEFAULT_RULES = (
    ("VL001", True, "warning"),
    ("VL002", True, "warning"),
    ("VL003", True, "info"),
    ("VL004", True, "warning"),
    ("VL005", True, "error"),
    ("VL006", True, "info"),
    ("VL007", False, "info"),
)


@dataclass
class Project:
    """What a configuration file says beside the rules."""

    lint: Config = field(default_factory=Config)
    root: str = "."
    target_encoding: str = "utf-8"
    model: str = ""
    fail_on_warning: bool = False
    params: dict[str, dict[str, str]] = field(default_factory=dict)
    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)

    def param(self, rule: str, key: str, default: str = "") -> str:
        return self.params.get(rule, {}).get(key, default)

    def flag(self, rule: str, key: str, default: bool = False) -> bool:
        value = self.params.get(rule, {}).get(key)
        return default if value is None else value in ("true", "1", "yes")

    def number(self, rule: str, key: str, default: int = 0) -> int:
        try:
            return int(self.params[rule][key])
        except (KeyError, ValueError):
            return default


def _bare(value: str) -> str:
    return value[1:-1] if len(value) >= 2 and value[0] == value[-1] == '"' else value


def _leading_number(value: str) -> int:
    digits = ""
    for c in value:
        if not (c.isascii() and c.isdigit()):
            break
        digits += c
    return int(digits or 0)


def parse_config(text: str) -> Project:
    """A line-by-line subset of TOML: sections project, lint and rules.ID, comments on lines of their own.

    Only the literal ``true`` switches on. A rule's section sets its severity even where it
    names none (then warning); unknown severities are info; other keys are its parameters.
    """
    out, section = Project(), ""
    for line in map(str.strip, text.splitlines()):
        if not line or line.startswith("#"):
            continue
        if line.startswith("["):
            section = line[1 : line.rfind("]")].strip() if "]" in line else line[1:].strip()
            if section.startswith("rules."):
                out.lint.rules.setdefault(section[6:], (True, "warning"))
            continue
        key, sign, value = (x.strip() for x in line.partition("="))
        if not sign:
            continue
        if section.startswith("rules."):
            rule = section[6:]
            enabled, severity = out.lint.rules[rule]
            if key == "enabled":
                out.lint.rules[rule] = (value == "true", severity)
            elif key == "severity":
                out.lint.rules[rule] = (enabled, {'"error"': "error", '"warning"': "warning"}.get(value, "info"))
            else:
                out.params.setdefault(rule, {})[key] = _bare(value)
        elif section == "project" and key == "root":
            out.root = _bare(value)
        elif section == "lint":
            if key == "fail_on_warning":
                out.fail_on_warning = value == "true"
            elif key == "max_violations":
                out.lint.max_violations = _leading_number(value)
            elif key == "target_encoding":
                out.target_encoding = _bare(value)
            elif key == "model":
                out.model = _bare(value)
            elif key in ("include", "exclude"):
                getattr(out, key).extend(re.findall(r'"([^"]*)"', value))
    return out


#: The file's name and how far up it is looked for.
FILE_NAME, PARENTS = ".tidewright.toml", 8


def find_config(start: str = ".") -> str | None:
    """The configuration file nearest above a folder of this machine; None without one."""
    import os

    at = os.path.abspath(start)
    for _ in range(PARENTS):
        path = os.path.join(at, FILE_NAME)
        if os.path.isfile(path):
            return path
        if os.path.dirname(at) == at:
            return None
        at = os.path.dirname(at)
    return None


def default_config() -> str:
    """The file that a new project starts with."""
    head = ["[project]", 'root = "."', "", "[lint]", "fail_on_warning = false", "max_violations = 0", 'target_encoding = "utf-8"']
    rules = [x for rule, on, severity in DEFAULT_RULES for x in ("", f"[rules.{rule}]", f"enabled = {str(on).lower()}", f'severity = "{severity}"')]
    return "\n".join([*head, *rules, ""])
