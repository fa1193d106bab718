"""Run configuration: composed YAML files, seeds, and the snapshot of a run."""

from __future__ import annotations

import json
import os
import random
import re
from collections.abc import Mapping
from dataclasses import dataclass
from pathlib import Path
from typing import Any

import numpy as np
import yaml

from .committed import put

_REFERENCE = re.compile(r"\$\{([^}]+)\}")


def _looked_up(tree: Mapping, path: str) -> Any:
    for part in path.split("."):
        if not isinstance(tree, Mapping) or part not in tree:
            raise KeyError(f"${{{path}}} refers to nothing in its file")
        tree = tree[part]
    return tree


def resolved(value: Any, tree: Mapping, seen: tuple[str, ...] = ()) -> Any:
    """``value`` with each ``${a.b}`` replaced by what stands at that place of ``tree``; alone, it keeps its type."""
    if isinstance(value, Mapping):
        return {k: resolved(v, tree, seen) for k, v in value.items()}
    if isinstance(value, list):
        return [resolved(v, tree, seen) for v in value]
    if not isinstance(value, str):
        return value

    def one(path: str) -> Any:
        if path in seen:
            raise ValueError(f"${{{path}}} refers to itself")
        return resolved(_looked_up(tree, path), tree, (*seen, path))

    alone = _REFERENCE.fullmatch(value)
    return one(alone[1]) if alone else _REFERENCE.sub(lambda m: str(one(m[1])), value)


def composed(folder: str, names: tuple[str, ...] = ("base", "train", "data", "lora")) -> dict[str, dict]:
    """One section for each file; references are resolved within a file, before it is nested."""
    parts = {n: yaml.safe_load((Path(folder) / f"{n}.yaml").read_text(encoding="utf-8")) or {} for n in names}
    return {n: resolved(p, p) for n, p in parts.items()}


def source_config(sources: Mapping[str, Mapping], path: str) -> Mapping:
    """The first source with this path."""
    for found in sources.values():
        if found.get("hf_path") == path:
            return found
    raise KeyError(f"no source has the path {path}")


@dataclass(frozen=True)
class RandomState:
    """The states of the generators that the driver side uses."""

    python: tuple
    numpy: tuple


def seed_all(seed: int) -> None:
    """Seeds the driver's generators; everything in tables is drawn by hash of a seed and needs none."""
    os.environ["PYTHONHASHSEED"] = str(seed)
    random.seed(seed)
    np.random.seed(seed)


def captured() -> RandomState:
    return RandomState(random.getstate(), np.random.get_state())


def restored(state: RandomState) -> None:
    random.setstate(state.python)
    np.random.set_state(state.numpy)


def write_snapshot(config: Mapping, folder: str) -> None:
    """The exact configuration of a run, and which generators' states there are."""
    state = captured()
    put(f"{folder}/config_snapshot.yaml", yaml.safe_dump(dict(config), sort_keys=False))
    put(f"{folder}/rng_present.json", json.dumps({n: getattr(state, n) is not None for n in ("python", "numpy")}))
