"""Run manifest: which stages are done, for which config and inputs, and whether the run is approved."""

from __future__ import annotations

import json
import os
from collections.abc import Callable

from lamina.functions.documents import canonical_hash
from lamina.sources.writers import json_atomic, json_text


class ManifestError(RuntimeError):
    pass


def fingerprint(records: list[tuple[str, int, int]]) -> str:
    """Hash of (path, size, time) records in path order."""
    return canonical_hash([list(r) for r in sorted(records)])


class Manifest:
    """Stages run in their order; starting one forgets it, all later ones and the approval. With a storage (see `lamina.session`), the file may lie in any store."""

    def __init__(self, path: str, stages: list[str], config: dict, inputs: str, storage=None) -> None:
        self.path, self.stages, self.storage = path, stages, storage
        identity = {"config_hash": canonical_hash(config), "input_fingerprint": inputs, "profile": config.get("profile", "production")}
        if storage.exists(path) if storage else os.path.exists(path):
            self.state = json.loads(self._read())
            for k in ("config_hash", "input_fingerprint"):
                if self.state[k] != identity[k]:
                    raise ManifestError(f"{k} has changed since the run began")
        else:
            self.state = identity | {"schema_version": 1, "stages": {}, "approved": False}

    def _read(self) -> str:
        if self.storage:
            return self.storage.read(self.path)
        with open(self.path, encoding="utf-8") as f:
            return f.read()

    def save(self) -> None:
        if self.storage:
            self.storage.write(self.path, json_text(self.state))
        else:
            json_atomic(self.path, self.state)

    def begin(self, stage: str, outputs: list[str], exists: Callable[[str], bool], remove: Callable[[str], None], overwrite: bool = False) -> bool:
        """False if the stage is done and its outputs are there; else clears the way, or refuses."""
        at = self.stages.index(stage)
        missing = [s for s in self.stages[:at] if self.state["stages"].get(s, {}).get("status") != "completed"]
        if missing:
            raise ManifestError(f"{stage} needs {missing}")
        there = [p for p in outputs if exists(p)]
        done = self.state["stages"].get(stage, {}).get("status") == "completed"
        if done and not overwrite:
            if len(there) == len(outputs):
                return False
            raise ManifestError(f"outputs of {stage} are missing")
        if there and not overwrite:
            raise ManifestError(f"outputs of {stage} exist without a record: {there}")
        for p in there:
            remove(p)
        for s in self.stages[at:]:
            self.state["stages"].pop(s, None)
        self.state["approved"] = False
        self.state["stages"][stage] = {"status": "running", "outputs": outputs}
        self.save()
        return True

    def complete(self, stage: str, **facts) -> None:
        self.state["stages"][stage] |= {"status": "completed"} | facts
        self.save()

    def fail(self, stage: str, error: Exception) -> None:
        self.state["stages"][stage] = {"status": "failed", "error": f"{type(error).__name__}: {error}"}
        self.save()

    def approve(self, passed: bool, reviewed: bool, rendered: bool) -> bool:
        """Only a production run that passed everything is approved."""
        self.state["approved"] = passed and reviewed and rendered and self.state["profile"] == "production"
        self.save()
        return self.state["approved"]

    def binding(self, selection_hash: str) -> dict[str, str]:
        return {"run_config_hash": self.state["config_hash"], "run_input_fingerprint": self.state["input_fingerprint"], "audit_selection_sha256": selection_hash}


def run_stages(manifest: Manifest, work: dict[str, Callable[[], dict]], outputs: dict[str, list[str]], exists: Callable[[str], bool], remove: Callable[[str], None], first: str | None = None, last: str | None = None, overwrite: bool = False) -> list[str]:
    """Runs the stages from first to last; returns those that ran."""
    names = manifest.stages
    a, b = names.index(first) if first else 0, names.index(last) if last else len(names) - 1
    if a > b:
        raise ManifestError("the first stage comes after the last")
    ran = []
    for stage in names[a : b + 1]:
        if not manifest.begin(stage, outputs.get(stage, []), exists, remove, overwrite):
            continue
        try:
            facts = work[stage]()
        except Exception as error:
            manifest.fail(stage, error)
            raise
        manifest.complete(stage, **(facts or {}))
        ran.append(stage)
    return ran


def may_resume(stored: dict, current: dict) -> bool:
    """A sampler goes on only under an identical contract."""
    return canonical_hash(stored) == canonical_hash(current)


def contract_faults(root: dict, dataset: dict, expected: dict, production: bool) -> list[str]:
    """What is wrong with the provenance attributes of an embedding file."""
    faults = [k for k in expected if root.get(k) != expected[k]]
    faults += [f"{k} differs" for k in sorted(set(root) | set(dataset)) if root.get(k) != dataset.get(k)]
    if bool(root.get("fixture_only")) and production:
        faults.append("fixture in production")
    return faults
