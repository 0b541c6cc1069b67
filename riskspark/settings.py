"""Weights, thresholds and scan options. Precedence: overrides, then TOML, then environment, then defaults."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, field, fields, replace
from pathlib import Path

# Points of each rule.
WEIGHTS: dict[str, float] = {
    "long_function": 10, "deep_nesting": 15, "high_branching": 10, "no_error_handling": 20, "global_variables": 15, "duplicate_code": 10, "low_test_coverage": 20,
    "high_complexity": 12, "god_file": 8, "bare_except": 8, "long_parameter_list": 5, "mutable_default_arg": 6, "magic_numbers": 3, "todo_debt": 3, "low_comment_ratio": 3,
    "change_frequency": 15, "bugfix_density": 18, "revert_history": 14, "recent_churn": 8, "many_authors": 8, "fix_follow_rate": 12, "knowledge_silo": 6,
    "high_fan_in": 10, "high_centrality": 8,
}
# Where rules begin to fire, and the bands of scores.
THRESHOLDS: dict[str, float] = {
    "long_function_lines": 100, "max_nesting_depth": 3, "nested_loop_depth": 3, "branch_count": 15, "cyclomatic_complexity": 20, "god_file_loc": 600, "max_parameters": 6,
    "duplicate_ratio": 0.12, "low_coverage": 0.5, "magic_number_count": 12, "todo_count": 5, "low_comment_ratio": 0.03, "commit_count": 20, "bugfix_ratio": 0.25, "revert_count": 1,
    "recent_commits_30d": 8, "author_count": 5, "fix_follow_rate": 0.3, "ownership_ratio": 0.9, "fan_in": 8, "band_medium": 35, "band_high": 60, "band_critical": 85,
}
# Suffixes of source files and their languages.
LANGUAGES: dict[str, str] = {
    ".py": "python", ".pyi": "python", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".ts": "typescript", ".tsx": "tsx", ".go": "go", ".java": "java", ".rb": "ruby",
    ".rs": "rust", ".c": "c", ".h": "c", ".cc": "cpp", ".cpp": "cpp", ".cxx": "cpp", ".hpp": "cpp", ".cs": "c_sharp", ".php": "php", ".kt": "kotlin", ".swift": "swift", ".scala": "scala",
    ".sh": "bash", ".bash": "bash", ".lua": "lua", ".r": "r", ".pl": "perl", ".dart": "dart", ".ex": "elixir", ".exs": "elixir",
}
# Languages that share another's vocabulary.
ALIASES = {"typescript": "javascript", "tsx": "javascript", "jsx": "javascript", "c_sharp": "java", "csharp": "java", "objc": "c", "r": "python", "perl": "python"}
# Paths that are not scanned.
EXCLUDES: tuple[str, ...] = (
    ".git/*", ".hg/*", ".svn/*", "node_modules/*", "vendor/*", "third_party/*", ".venv/*", "venv/*", "env/*", "virtualenv/*", "__pycache__/*", "*.egg-info/*", ".eggs/*", "dist/*", "build/*", "out/*",
    "target/*", ".next/*", ".nuxt/*", "coverage/*", "htmlcov/*", ".pytest_cache/*", ".mypy_cache/*", ".ruff_cache/*", ".tox/*", ".nox/*", ".riskspark/*", "*.min.js", "*.bundle.js", "*.min.css", "*.map",
    "*_pb2.py", "*_pb2_grpc.py", "*.pb.go", "*.generated.*", "*.g.dart", "migrations/*", "*.lock", "package-lock.json", "yarn.lock", "poetry.lock",
)
# Parts of paths that mark tests.
TEST_MARKERS = ("test_", "_test.", "tests/", "test/", "spec/", ".spec.", ".test.", "__tests__/", "conftest.py", "testing/")


@dataclass(frozen=True)
class Settings:
    weights: dict[str, float] = field(default_factory=lambda: dict(WEIGHTS))
    thresholds: dict[str, float] = field(default_factory=lambda: dict(THRESHOLDS))
    excludes: tuple[str, ...] = EXCLUDES
    includes: tuple[str, ...] = ()
    languages: dict[str, str] = field(default_factory=lambda: dict(LANGUAGES))
    history_days: int = 730
    max_file_bytes: int = 1_500_000
    ignore_tests: bool = False
    use_git: bool = True
    use_ml: bool = True
    extra_fix_pattern: str | None = None

    def __getitem__(self, name: str) -> float:
        """A weight as `w_name` or a threshold as `t_name`."""
        kind, _, name = name.partition("_")
        return {"w": self.weights, "t": self.thresholds}[kind][name]

    def literals(self) -> dict[str, str]:
        """For SQL templates: w_* and t_* as literals of doubles."""
        return {f"{k}_{n}": f"{float(v)!r}D" for k, d in (("w", self.weights), ("t", self.thresholds)) for n, v in d.items()}


def _merged(base: dict, new: dict, what: str) -> dict:
    if unknown := set(new) - set(base):
        raise ValueError(f"unknown {what}: {sorted(unknown)}")
    return base | {k: type(base[k])(v) for k, v in new.items()}


def load(path: str | os.PathLike | None = None, env: dict[str, str] | None = None, **overrides) -> Settings:
    """A malformed or missing TOML file counts as none. `excludes` extend the defaults, `includes` replace them; None overrides nothing."""
    env, out = os.environ if env is None else env, Settings()
    simple = {f.name: f for f in fields(Settings) if f.name not in ("weights", "thresholds", "excludes", "includes", "languages")}
    layers: list[dict] = [{n: env[f"RISKSPARK_{n.upper()}"] for n in simple if f"RISKSPARK_{n.upper()}" in env}]
    if path and Path(path).is_file():
        try:
            layers.append(tomllib.loads(Path(path).read_text()))
        except (tomllib.TOMLDecodeError, UnicodeDecodeError):
            pass
    layers.append({k: v for k, v in overrides.items() if v is not None})
    for layer in layers:
        for name, value in layer.items():
            if name in ("weights", "thresholds", "languages"):
                old = getattr(out, name)
                out = replace(out, **{name: old | value if name == "languages" else _merged(old, value, name)})
            elif name == "excludes":
                out = replace(out, excludes=(*out.excludes, *value))
            elif name == "includes":
                out = replace(out, includes=tuple(value))
            elif name in simple:
                now = getattr(out, name)
                kind = bool if isinstance(now, bool) else int if isinstance(now, int) else str
                out = replace(out, **{name: value.lower() in ("1", "true", "yes") if kind is bool and isinstance(value, str) else kind(value)})
    return out


def load_env(path: str | os.PathLike = ".env", env: dict[str, str] | None = None) -> dict[str, str]:
    """What a file of NAME=value lines adds to the environment; names that are set stay. No file adds nothing."""
    env, added = os.environ if env is None else env, {}
    if Path(path).is_file():
        for line in Path(path).read_text(errors="replace").splitlines():
            name, equals, value = line.strip().removeprefix("export ").partition("=")
            name, value = name.strip(), value.strip()
            if equals and name and not name.startswith("#") and name not in env:
                added[name] = value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'" else value
    env.update(added)
    return added


def starter(path: str | os.PathLike) -> Path:
    """A settings file to begin with; an existing file is never overwritten."""
    simple = [f"# {f.name} = {str(getattr(Settings(), f.name)).lower()}" for f in fields(Settings) if isinstance(getattr(Settings(), f.name), bool | int)]
    tables = [line for name, values in (("weights", WEIGHTS), ("thresholds", THRESHOLDS)) for line in ("", f"[{name}]", *(f"# {k} = {v}" for k, v in values.items()))]
    with open(path, "x") as f:
        f.write("\n".join(["# excludes = []", *simple, *tables, ""]))
    return Path(path)
