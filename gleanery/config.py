"""Settings: defaults, a TOML file over them, overrides over both."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, fields, replace
from pathlib import Path

from gleanery.errors import InvalidArgument

# What is indexed by default, and what is not.
INCLUDE_EXTENSIONS = (
    ".py", ".js", ".jsx", ".ts", ".tsx", ".java", ".go", ".rs", ".c", ".h", ".cc", ".hh",
    ".cpp", ".hpp", ".cxx", ".cs", ".md", ".rst", ".toml", ".yaml", ".yml", ".json", ".ini", ".cfg",
)
EXCLUDED_DIRECTORIES = (
    ".git", ".github", ".venv", "__pycache__", ".gleanery", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".tox", ".nox",
    ".cache", "node_modules", ".pnpm-store", ".yarn", ".npm", ".next", ".nuxt", ".svelte-kit", ".gradle", ".idea",
    ".vscode", "dist", "build", "target", "bin", "obj", "out", "coverage", "tmp", "temp",
)
EXCLUDE_GLOBS = tuple(f"**/{name}/**" for name in EXCLUDED_DIRECTORIES)


def _limit(default: int, cap: int):
    return field(default=default, metadata={"cap": cap})


@dataclass(frozen=True)
class Limits:
    """Bounds of what one call may return; each has a cap that settings cannot pass."""

    max_file_bytes: int = _limit(1024 * 1024, 4 * 1024 * 1024)
    max_open_lines: int = _limit(500, 2000)
    max_total_bytes_per_response: int = _limit(256 * 1024, 1024 * 1024)
    max_search_hits: int = _limit(50, 200)
    max_references: int = _limit(50, 200)

    def __post_init__(self):
        for f in fields(self):
            value = getattr(self, f.name)
            if isinstance(value, bool) or not isinstance(value, int) or not 1 <= value <= f.metadata["cap"]:
                raise InvalidArgument(f"{f.name} must be an integer from 1 to {f.metadata['cap']}")


@dataclass(frozen=True)
class Settings:
    limits: Limits = Limits()
    include_extensions: tuple[str, ...] = INCLUDE_EXTENSIONS
    exclude_globs: tuple[str, ...] = EXCLUDE_GLOBS
    python_enabled: bool = True

    def merged(self, table: dict) -> Settings:
        """These settings with those of a parsed file, which has the tables limits, index, adapters and security."""
        security = table.get("security", {})
        for key in ("denylist_override", "denylist_allowlist", "denylist_relax"):
            if key in security:
                raise InvalidArgument(f"security.{key}: the denylist can't be relaxed")
        known = {f.name for f in fields(Limits)}
        limits = replace(self.limits, **{k: v for k, v in table.get("limits", {}).items() if k in known and v is not None})
        index = table.get("index", {})
        lists = {}
        for key in ("include_extensions", "exclude_globs"):
            if key in index:
                if not isinstance(index[key], list) or not all(isinstance(x, str) for x in index[key]):
                    raise InvalidArgument(f"index.{key} must be a list of strings")
                lists[key] = tuple(index[key])
        enabled = table.get("adapters", {}).get("python_enabled", self.python_enabled)
        if not isinstance(enabled, bool):
            raise InvalidArgument("adapters.python_enabled must be true or false")
        return replace(self, limits=limits, python_enabled=enabled, **lists)


def load_settings(path: str | Path | None = None, overrides: dict | None = None) -> Settings:
    table = tomllib.loads(Path(path).read_text()) if path is not None and Path(path).exists() else {}
    return Settings().merged(table).merged(overrides or {})
