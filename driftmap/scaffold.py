"""``python -m driftmap.scaffold FOLDER``: a new project folder with a settings file and a manifest."""

from __future__ import annotations

import sys
from pathlib import Path

SETTINGS = '''"""Settings of this run: see driftmap.config.Settings for all of them."""

from driftmap.config import Settings

MANIFEST = "../input/file_list.txt"
OUTPUT = "../output"
SETTINGS = Settings(neighbours_kept=100, neighbours_used=100, eigenpairs=10, tau=0.5)
'''
MANIFEST = """# File:<path> lines, each followed by Dataset:<name> lines if not all datasets are wanted.
"""


def new_project(folder: str) -> Path:
    """The first free of proj_000 ... proj_999 in ``folder``, with input, output and src."""
    for n in range(1000):
        project = Path(folder) / f"proj_{n:03d}"
        if not project.exists():
            for name in ("input", "output", "src"):
                (project / name).mkdir(parents=True)
            (project / "src" / "settings.py").write_text(SETTINGS)
            (project / "input" / "file_list.txt").write_text(MANIFEST)
            return project
    raise RuntimeError("all of proj_000 to proj_999 are taken")


if __name__ == "__main__":
    print(new_project(sys.argv[1] if len(sys.argv) > 1 else "."))
