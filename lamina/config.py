"""Run configuration: defaults, merging, expansion and range checks."""

from __future__ import annotations

import copy
import json
import math
import os
from typing import Any

MAGNIFICATIONS = (5, 10, 20, 40)

#: Default parameters that results depend on.
DEFAULTS: dict[str, Any] = {
    "profile": "production",
    "magnifications": list(MAGNIFICATIONS),
    "fine_level": 1,
    "coarse_level": 2,
    "semantic": {
        "category_top_k": 3,
        "use_artifact_score": True,
        "weights": {"architecture": 0.30, "tissue_compartment": 0.20, "pathology_state": 0.20, "cellular_nuclear": 0.15, "scale_context": 0.15},
    },
    "coverage": {"min_tiles": 20, "min_patients": 3},
    "buckets": {
        "top_quantile": 0.80,
        "exclude_artifacts": True,
        "artifact_exclude": 0.80,
        "support_exclude_patients": 5,
        "bridge": {"artifact": 0.70, "patients": 10, "coverage": 3},
        "architecture_bridge": {"score": 0.70, "artifact": 0.70, "patients": 10, "coverage": 3},
        "architecture_specific": {"score": 0.70, "artifact": 0.70, "patients": 10, "coverage": 3, "entropy": 0.50},
        "rare_clean": {"artifact": 0.60, "patients": 5},
        "tissue_specific": {"artifact": 0.70, "patients": 10, "entropy": 0.50},
    },
    "audit": {"clusters_per_bucket": 50, "tiles_per_cluster": 20, "tiles_per_slide": 2, "sample_rows": 1_000_000, "candidate_factor": 10, "seed": 7},
    "clustering": {"k": [4096, 512], "iterations": 50, "fit_rows": 200_000, "seed": 7},
}


def merged(base: dict, over: dict) -> dict:
    """base with the entries of over, nested dictionaries merged key by key."""
    out = copy.deepcopy(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else copy.deepcopy(v)
    return out


def expanded(value: Any) -> Any:
    """Environment variables and ~ expanded in every string."""
    if isinstance(value, str):
        return os.path.expanduser(os.path.expandvars(value))
    if isinstance(value, dict):
        return {k: expanded(v) for k, v in value.items()}
    return [expanded(v) for v in value] if isinstance(value, list) else value


def checked(config: dict) -> dict:
    """The config, or ValueError with every rule that it breaks."""
    wrong = []
    need = lambda good, what: wrong.append(what) if not good else None
    need(config["profile"] in ("production", "smoke"), "profile is production or smoke")
    need(config["coarse_level"] == config["fine_level"] + 1, "the coarse level follows the fine one")
    need(len(set(config["magnifications"])) == len(config["magnifications"]) > 0, "magnifications are distinct")
    need(config["semantic"]["category_top_k"] > 0, "category_top_k is positive")
    need(math.isclose(sum(config["semantic"]["weights"].values()), 1.0, rel_tol=1e-5, abs_tol=1e-8), "weights sum to 1")
    need(0 <= config["buckets"]["top_quantile"] <= 1, "top_quantile is from 0 to 1")
    need(isinstance(config["semantic"]["use_artifact_score"], bool), "use_artifact_score is a boolean")
    need(isinstance(config["buckets"]["exclude_artifacts"], bool), "exclude_artifacts is a boolean")
    for part in ("coverage", "audit"):
        for k, v in config[part].items():
            need(k == "seed" or v > 0, f"{part}.{k} is positive")
    if wrong:
        raise ValueError("; ".join(wrong))
    return config


def load(path: str | None = None, over: dict | None = None) -> dict:
    """Defaults, then the file, then `over`; relative `*_path` and `*_dir` entries are taken from the file's folder."""
    config = copy.deepcopy(DEFAULTS)
    if path:
        with open(path, encoding="utf-8") as f:
            given = expanded(json.load(f))
        here = os.path.dirname(os.path.abspath(path))
        rooted = lambda k, v: os.path.normpath(os.path.join(here, v)) if isinstance(v, str) and k.endswith(("_path", "_dir")) and "://" not in v else v
        config = merged(config, {k: rooted(k, v) for k, v in given.items()})
    return checked(merged(config, over or {}))


def magnification_folders(items: list[str], wanted: tuple[int, ...] = MAGNIFICATIONS) -> dict[int, str]:
    """MAG=DIR items as a dictionary that has exactly the wanted magnifications."""
    out: dict[int, str] = {}
    for item in items:
        mag, sep, folder = item.partition("=")
        if not sep or not folder or not mag.rstrip("x").isdigit():
            raise ValueError(f"not MAG=DIR: {item!r}")
        if int(mag.rstrip("x")) in out:
            raise ValueError(f"magnification {mag} is given twice")
        out[int(mag.rstrip("x"))] = expanded(folder)
    if set(out) != set(wanted):
        raise ValueError(f"magnifications {sorted(out)} are not {sorted(wanted)}")
    return out
