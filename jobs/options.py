"""What the command lines of the jobs share: a configuration file, overridden by arguments."""

from __future__ import annotations

import argparse
import json
import logging
import os
from typing import Any


def options(description: str, config: str, **defaults: Any) -> dict[str, Any]:
    """The values of a configuration file (JSON, by default ``config`` beside the job), overridden by
    arguments of the same names; a name without a value anywhere is an error."""
    parser = argparse.ArgumentParser(description=description)
    parser.add_argument("--config", default=os.path.join(os.path.dirname(os.path.abspath(__file__)), config))
    for name, value in defaults.items():
        parser.add_argument(f"--{name.replace('_', '-')}", dest=name, type=type(value) if value is not None else str)
    given = vars(parser.parse_args())
    with open(given.pop("config"), encoding="utf-8") as f:
        found = defaults | json.load(f)
    found |= {k: v for k, v in given.items() if v is not None}
    missing = [k for k in defaults if found.get(k) is None]
    if missing:
        parser.error(f"no value for {', '.join(missing)}")
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    return found
