"""What a process is told about itself: rank, optimizer, run id; and the log of a rank."""

from __future__ import annotations

import os
import re
import time
from collections.abc import Mapping
from pathlib import Path


def rank(engine: object, attribute: str, variable: str) -> int:
    """From the engine's attribute, else from the environment, else -1; text that isn't a number counts as 0."""
    value = getattr(engine, attribute, None)
    if value is not None:
        return int(value)
    text = os.environ.get(variable)
    if text is None:
        return -1
    number = re.match(r"\s*[+-]?\d+", text)
    return int(number[0]) if number else 0


def group_rank(param: object, fallback: int) -> int:
    """The rank in the parameter's process group where it says one, else ``fallback``."""
    group = getattr(param, "ds_process_group", None)
    own = group() if callable(group) else getattr(group, "rank", None)
    return fallback if own is None else int(own() if callable(own) else own)


def optimizer(engine: object, given: object = None) -> object:
    """The one given, else the engine's own, else None."""
    return given if given is not None else getattr(engine, "optimizer", None)


def state_mapping(opt: object) -> Mapping | None:
    """The optimizer's states, or those of the optimizer it wraps."""
    for x in (opt, getattr(opt, "optimizer", None)):
        if x is not None and getattr(x, "state", None) is not None:
            return x.state
    return None


def has_flat_groups(opt: object) -> bool:
    """Whether states are sharded in flat groups of both precisions."""
    return opt is not None and hasattr(opt, "fp16_partitioned_groups_flat") and hasattr(opt, "fp32_partitioned_groups_flat")


def sanitize(token: str) -> str:
    return re.sub(r"[^A-Za-z0-9_.\-]", "_", token)


def run_id(root: Path, variable: str = "TESSERA_RUN_ID", key: str = "local") -> str:
    """One id for all processes of a run: the environment's, else that in the run's file under ``root``, else
    a time stamp, which the first process to create the file sets for all."""
    if os.environ.get(variable):
        return os.environ[variable]
    path = Path(root) / f".run_{sanitize(key)}.id"
    mine = time.strftime("%Y%m%d_%H%M%S")
    try:
        with path.open("x") as f:
            f.write(mine)
        return mine
    except FileExistsError:
        return path.read_text().strip() or mine


class RankLog:
    """Lines appended to the log of a rank, each on disk before the next."""

    def __init__(self, root: str | Path, number: int, name: str = "tessera.log", **named: str):
        root = Path(root)
        root.mkdir(parents=True, exist_ok=True)
        self.path = root / run_id(root, **named) / f"rank_{number}" / name
        self.path.parent.mkdir(parents=True, exist_ok=True)

    def write(self, line: str) -> None:
        with self.path.open("a") as f:
            f.write(line + "\n")
