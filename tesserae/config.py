"""Configuration: which files are searched, which folders are left out, how large a file may be."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field

from tesserae.functions.globs import matches

#: The default patterns, folders and size, and the keys of the file.
FOLDER = ".tesserae"
PATH = f"{FOLDER}/config.json"


@dataclass
class FtsConfig:
    include: list[str] = field(default_factory=lambda: ["*.go"])
    exclude_dirs: list[str] = field(default_factory=lambda: ["vendor", ".git", "node_modules", "testdata", FOLDER])
    max_file_size_kb: int = 50


@dataclass
class Config:
    fts: FtsConfig = field(default_factory=FtsConfig)
    #: Patterns of the symbol index; nothing reads them, but a file that has them keeps them.
    index_include: list[str] | None = None

    @staticmethod
    def from_json(text: str) -> Config:
        """A present file is taken as it is: keys it lacks are empty, not defaults."""
        raw = json.loads(text)
        fts, index = raw.get("fts") or {}, raw.get("index")
        return Config(FtsConfig(list(fts.get("include") or []), list(fts.get("excludeDirs") or []), int(fts.get("maxFileSizeKB") or 0)), None if index is None else list(index.get("include") or []))

    @staticmethod
    def load(path: str = PATH) -> Config:
        """Defaults where there is no file."""
        if not os.path.exists(path):
            return Config()
        with open(path, encoding="utf-8") as f:
            return Config.from_json(f.read())

    def to_json(self) -> str:
        out = {"fts": {"include": self.fts.include, "excludeDirs": self.fts.exclude_dirs, "maxFileSizeKB": self.fts.max_file_size_kb}}
        return json.dumps(out if self.index_include is None else out | {"index": {"include": self.index_include}}, indent=2)

    def save(self, path: str = PATH) -> None:
        with open(path, "w", encoding="utf-8") as f:
            f.write(self.to_json())

    def matches_fts(self, path: str) -> bool:
        return any(matches(p, os.path.basename(path)) for p in self.fts.include)

    def is_excluded_dir(self, name: str) -> bool:
        return name in self.fts.exclude_dirs
