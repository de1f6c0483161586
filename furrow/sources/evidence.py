"""Evidence of a study on the driver: logs that only grow, sealed files, fold assignments, and a check before a one-shot
evaluation. All of it is a few rows or hashes a field, whatever the size of the run matrix."""

from __future__ import annotations

import hashlib
import json
import os
from collections import Counter
from collections.abc import Iterable
from pathlib import Path

from ..operators.splits import FOLDS, SEED, content_hash, log_entry


def file_hash(path: str | Path) -> str:
    """SHA-256 of a file's bytes."""
    return hashlib.sha256(Path(path).read_bytes()).hexdigest()


def entries(path: str | Path) -> list[dict]:
    """A log's entries, each checked against its own hash, its place and its predecessor; a missing file is an empty log."""
    if not Path(path).exists():
        return []
    out = [json.loads(line) for line in Path(path).read_text(encoding="utf-8").splitlines() if line.strip()]
    before = None
    for k, e in enumerate(out):
        if e != log_entry(k, e.get("payload"), before):
            raise ValueError(f"entry {k} of the log was altered")
        before = e["entry_hash"]
    return out


def _line(entry: dict) -> str:
    return json.dumps(entry, sort_keys=True, ensure_ascii=False) + "\n"


def append(path: str | Path, payload: dict) -> dict:
    """Adds an entry after the last one, on disk before it returns."""
    log = entries(path)
    entry = log_entry(len(log), payload, log[-1]["entry_hash"] if log else None)
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with open(path, "a", encoding="utf-8") as f:
        f.write(_line(entry))
        f.flush()
        os.fsync(f.fileno())
    return entry


def append_rows(path: str | Path, rows: Iterable[dict]) -> int:
    """Adds a checkpoint's rows as JSON lines, each on disk before the next; rows whose run key is there already are left out."""
    p = Path(path)
    done = {json.loads(line)["run_key"] for line in p.read_text(encoding="utf-8").splitlines() if line.strip()} if p.exists() else set()
    added = 0
    with open(p, "a", encoding="utf-8") as f:
        for row in rows:
            if row["run_key"] in done:
                continue
            done.add(row["run_key"])
            f.write(json.dumps(row, sort_keys=True, ensure_ascii=False, allow_nan=False) + "\n")
            f.flush()
            os.fsync(f.fileno())
            added += 1
    return added


def sealed(path: str | Path, artifact: str, key: str) -> str | None:
    """What a log's first entry of an artifact says of ``key``; the whole log is verified first."""
    return next((str(e["payload"][key]) for e in entries(path) if e["payload"].get("artifact") == artifact and key in e["payload"]), None)


def replace_unless_sealed(new: str | Path, target: str | Path, log: str | Path, artifact: str, key: str) -> None:
    """Moves a file into place at once; other bytes than those that the log has sealed are refused."""
    told = sealed(log, artifact, key)
    if told is not None and file_hash(new) != told:
        raise ValueError(f"{artifact} is sealed with other bytes")
    Path(target).parent.mkdir(parents=True, exist_ok=True)
    os.replace(new, target)


def fields_of_manifest(manifest: dict) -> list[str]:
    """All fields of a study, from the manifest's licences, which don't depend on results; a field that only results name
    is an error."""
    licenses = manifest.get("licenses")
    if not isinstance(licenses, dict) or not licenses or not all(licenses):
        raise ValueError("the manifest names no fields")
    fields = sorted(map(str, licenses))
    seen = {str(i).partition(":")[0] for i in manifest.get("effective_pool_size_by_instance") or {}}
    if foreign := sorted(seen - set(fields)):
        raise ValueError(f"results name fields that have no licence: {foreign}")
    return fields


def assignment(fields: Iterable[str], n_folds: int = FOLDS, seed: int = SEED) -> list[dict]:
    """``splits.grouped_folds`` of a list of fields, in order of fields; each field once, at least one a fold."""
    names = [str(f) for f in fields]
    if len(set(names)) != len(names) or "" in names:
        raise ValueError("a field is there twice or has no name")
    if n_folds < 2 or len(names) < n_folds:
        raise ValueError("there are fewer fields than folds")
    dealt = sorted(names, key=lambda f: (hashlib.sha256(f"{seed}\x1f{f}".encode()).digest(), f))
    return sorted(({"field_id": f, "fold": k % n_folds + 1} for k, f in enumerate(dealt)), key=lambda a: a["field_id"])


def fold_evidence(manifest: dict, holdout: dict, *, n_folds: int = FOLDS, seed: int = SEED) -> dict:
    """The assignment of all fields that aren't held out, with its hashes; ``holdout`` has ``field_ids`` and ``seal_hash``."""
    fields, held = fields_of_manifest(manifest), [str(f) for f in holdout["field_ids"]]
    if len(set(held)) != len(held) or set(held) - set(fields):
        raise ValueError("the holdout repeats a field or names one that the manifest lacks")
    dealt = assignment([f for f in fields if f not in set(held)], n_folds, seed)
    sizes = Counter(a["fold"] for a in dealt)
    base = {
        "seed": seed, "n_folds": n_folds, "manifest_hash": content_hash(manifest), "holdout_hash": content_hash(holdout), "n_all_fields": len(fields), "n_holdout_fields": len(held),
        "n_training_fields": len(dealt), "fold_sizes": {str(k): sizes[k] for k in range(1, n_folds + 1)}, "assignments": dealt, "assignment_hash": content_hash(dealt),
    }
    return verified({**base, "spec_hash": content_hash(base)})


def verified(evidence: dict) -> dict:
    """The evidence, if it agrees with itself: sorted, each field once, sizes that differ by one at most, hashes that hold."""
    dealt = evidence["assignments"]
    names = [a["field_id"] for a in dealt]
    sizes = Counter(a["fold"] for a in dealt)
    counted = {str(k): sizes[k] for k in range(1, evidence["n_folds"] + 1)}
    checks = {
        "order": names == sorted(names), "repeats": len(names) == len(set(names)) == evidence["n_training_fields"], "folds": set(sizes) <= set(range(1, evidence["n_folds"] + 1)),
        "sizes": evidence["fold_sizes"] == counted and max(counted.values()) - min(counted.values()) <= 1, "assignment": evidence["assignment_hash"] == content_hash(dealt),
        "spec": evidence["spec_hash"] == content_hash({k: v for k, v in evidence.items() if k != "spec_hash"}),
    }
    if wrong := [k for k, v in checks.items() if not v]:
        raise ValueError(f"the evidence contradicts itself: {wrong}")
    return evidence


def register(evidence: dict, path: str | Path) -> dict:
    """Makes the evidence a log's first entry; the same may be registered again, another is refused."""
    payload = {"artifact": "genesis", **{k: verified(evidence)[k] for k in ("seed", "n_folds", "manifest_hash", "holdout_hash", "n_training_fields", "assignment_hash", "spec_hash")}}
    if Path(path).exists():
        log = entries(path)
        if not log or log[0] != log_entry(0, payload, None):
            raise ValueError("the log begins with something else")
        return log[0]
    return append(path, payload)


class Holdout:
    """Fields that are sealed once and can only be checked afterwards."""

    def __init__(self):
        self._sealed: str | None = None

    @staticmethod
    def _named(ids: Iterable[str], seed: int) -> str:
        return content_hash({"problem_ids": sorted(ids), "seed": seed})

    def seal(self, ids: Iterable[str], seed: int) -> str:
        if self._sealed is not None:
            raise RuntimeError("the holdout is sealed already")
        if not (names := sorted(ids)):
            raise ValueError("a holdout has a field")
        self._sealed = self._named(names, seed)
        return self._sealed

    def verify(self, ids: Iterable[str], seed: int) -> None:
        if self._sealed is None or self._named(ids, seed) != self._sealed:
            raise ValueError("this isn't the sealed holdout")


def preflight(log: str | Path, files: dict[str, tuple[str, str, str]], order: list[str], fields: Iterable[str], training: Iterable[str], holdout: Iterable[str]) -> None:
    """What must hold before a one-shot evaluation, else an error that names all faults.

    ``files`` has for each path the artifact, the key and the name of the result that the log must bind to its bytes;
    the log's artifacts must be ``order`` so far and no more; training and holdout must part the fields.
    """
    faults = []
    log_entries = entries(log)
    found = [e["payload"].get("artifact") for e in log_entries]
    if found != list(order):
        faults.append(f"the log holds {found}, not {list(order)}")
    for path, (artifact, key, name) in files.items():
        told = next((str(e["payload"][key]) for e in log_entries if e["payload"].get("artifact") == artifact and key in e["payload"]), None)
        if not Path(path).exists():
            faults.append(f"{name}: {path} is missing")
        elif told != file_hash(path):
            faults.append(f"{name}: the log binds {artifact}.{key} to other bytes")
    whole, learnt, held = set(fields), set(training), set(holdout)
    if learnt & held or learnt | held != whole:
        faults.append("training and holdout don't part the fields")
    if faults:
        raise ValueError("; ".join(faults))
