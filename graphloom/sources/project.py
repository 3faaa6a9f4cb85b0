"""Projects on disk: which language, where its workspace is, which command scans it."""

from __future__ import annotations

import json
import os
import sys
from dataclasses import dataclass, field
from pathlib import Path

#: File name ends that tell a language, in order of precedence.
LANGUAGE_FILES = {
    "java": (".java",),
    "go": (".go",),
    "cpp": (".cpp", ".cc", ".cxx", ".hpp", ".h", ".hh"),
    "rust": (".rs",),
}
SKIPPED = ("target", "node_modules")
DEPTH = 5
WORKSPACE = ".graphloom"
DEFAULT_CONFIG = {"default": "src", "types": []}


def detect_language(root: str | Path, available: tuple[str, ...] = tuple(LANGUAGE_FILES)) -> str | None:
    """The first available language, by precedence, with a file within DEPTH levels; hidden entries and SKIPPED are left out."""
    found: set[str] = set()
    level = [Path(root)]
    for _ in range(DEPTH):
        below: list[Path] = []
        for folder in level:
            try:
                entries = sorted(os.scandir(folder), key=lambda e: e.name)
            except OSError:
                continue
            for e in entries:
                if e.name.startswith(".") or e.name in SKIPPED:
                    continue
                if e.is_dir():  # links to folders too; DEPTH ends circles
                    below.append(Path(e.path))
                else:
                    found |= {k for k, ends in LANGUAGE_FILES.items() if e.name.endswith(ends)}
        level = below
    return next((k for k in LANGUAGE_FILES if k in found and k in available), None)


def find_workspace(start: str | Path) -> Path | None:
    here = Path(start).resolve()
    return next((p / WORKSPACE for p in (here, *here.parents) if (p / WORKSPACE).is_dir()), None)


def find_or_create_workspace(start: str | Path) -> Path:
    found = find_workspace(start)
    if found is None:
        found = Path(start).resolve() / WORKSPACE
        found.mkdir(parents=True)
    return found


def init(project: str | Path) -> Path:
    """A workspace with a default config, unless there is one. Any config stands in for the built-in rules."""
    folder = find_or_create_workspace(project)
    config = folder / "config.json"
    if not config.exists():
        config.write_text(json.dumps(DEFAULT_CONFIG, indent=2) + "\n")
    return folder


@dataclass
class Frontends:
    """language -> argument list of the scanner, looked up in the environment's folder, in the given ones, then beside the program
    (frontends) or in its installation (../libexec/frontends)."""

    folders: list[str] = field(default_factory=list)
    variable: str = "GRAPHLOOM_FRONTENDS"

    def command(self, language: str) -> list[str] | None:
        places = [os.environ[self.variable]] if os.environ.get(self.variable) else []
        program = Path(sys.argv[0] or ".").resolve().parent
        installed = [program / "frontends", program.parent / "libexec" / "frontends"]
        for folder in (*places, *self.folders, *installed):
            for name in (f"scan-{language}", f"scan-{language}.py"):
                path = Path(folder) / name
                if path.is_file():
                    return ["python3", str(path)] if name.endswith(".py") else [str(path)]
        return None

    def available(self) -> list[str]:
        return [k for k in LANGUAGE_FILES if self.command(k)]
