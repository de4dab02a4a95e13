"""Project configuration in TOML."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field

from .tags import MARKER

FILE = "weftgraph.toml"
# Folders that are never searched, and where tests are, by language.
EXCLUDED = ("node_modules", "venv", "vendor", ".git", "dist", "__pycache__", ".weftgraph")
TEST_PATHS = {"python": ("tests",), "typescript": ("__tests__",), "go": ()}
#: The order in which languages are built.
LANGUAGES = ("typescript", "python", "go")


class ConfigError(ValueError):
    pass


@dataclass(frozen=True)
class LanguageConfig:
    language: str
    source_roots: tuple[str, ...]
    test_paths: tuple[str, ...]


@dataclass(frozen=True)
class Config:
    languages: tuple[str, ...]
    root: str = "."
    exclude: tuple[str, ...] = EXCLUDED
    marker: str = MARKER
    sections: dict[str, LanguageConfig] = field(default_factory=dict)
    strict: bool = False
    ignore: tuple[str, ...] = ()

    def language(self, name: str) -> LanguageConfig:
        """A listed language's section, or its defaults."""
        return self.sections.get(name) or LanguageConfig(name, (self.root,), TEST_PATHS.get(name, ()))

    def to_build(self) -> list[LanguageConfig]:
        return [self.language(n) for n in LANGUAGES if n in self.languages]


def _strings(value, fallback: tuple[str, ...]) -> tuple[str, ...]:
    return tuple(value) if isinstance(value, list) and all(isinstance(v, str) for v in value) else fallback


def _string(value, fallback: str) -> str:
    return value if isinstance(value, str) else fallback


def _table(value) -> dict:
    """A section; one of another type has nothing but defaults."""
    return value if isinstance(value, dict) else {}


def parse_config(text: str) -> Config:
    """A configuration; ConfigError for bad TOML, without [project], or without a list of languages."""
    try:
        data = tomllib.loads(text)
    except tomllib.TOMLDecodeError as bad:
        raise ConfigError(f"Invalid TOML: {bad}") from bad
    project = data.get("project")
    if not isinstance(project, dict):
        raise ConfigError("Missing [project] section")
    languages = _strings(project.get("languages"), ())
    if not languages:
        raise ConfigError("project.languages must be a non-empty array of strings")
    sections = {}
    for name in LANGUAGES:
        if name in languages:
            own = _table(data.get(name))
            sections[name] = LanguageConfig(name, _strings(own.get("source_roots"), (".",)), _strings(own.get("test_paths"), TEST_PATHS[name]))
    lint = _table(data.get("lint"))
    return Config(
        languages,
        _string(project.get("root"), "."),
        _strings(project.get("exclude"), EXCLUDED),
        _string(project.get("marker"), MARKER),
        sections,
        lint.get("strict") is True,
        _strings(lint.get("ignore"), ()),
    )


def starter_config(languages: list[str], root: str) -> str:
    """TOML for a new project."""
    listed = lambda items: "[" + ", ".join(f'"{i}"' for i in items) + "]"
    parts = [f'[project]\nlanguages = {listed(languages)}\nroot = "{root}"\nexclude = {listed(EXCLUDED)}\n']
    parts += [f'[{n}]\nsource_roots = ["{root}"]\ntest_paths = ["tests"]\n' for n in ("python", "typescript") if n in languages]
    parts.append("[lint]\nstrict = false\nignore = []\n")
    return "\n".join(parts)
