"""Sinks: one CSV file with an atomic replace, and run manifests."""

from __future__ import annotations

import csv
import hashlib
import json
import os
import tempfile
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame


def write_single_csv(frame: DataFrame, path: str | Path, encoding: str = "utf-8") -> int:
    """Stream rows to a temporary file beside ``path``, then replace it; the old file stays on failure.

    ``utf-8-sig`` puts a byte order mark in front, as spreadsheets want.
    """
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=target.parent, suffix=".part")
    try:
        with os.fdopen(handle, "w", newline="", encoding=encoding) as out:
            writer = csv.writer(out)
            writer.writerow(frame.columns)
            n = 0
            for row in frame.toLocalIterator():
                writer.writerow(row)
                n += 1
            out.flush()
            os.fsync(out.fileno())
        os.replace(name, target)
    except BaseException:
        Path(name).unlink(missing_ok=True)
        raise
    return n


def write_json_records(frame: DataFrame, path: str | Path) -> int:
    """The rows as one JSON array of objects, nulls kept, written like :func:`write_single_csv`."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=target.parent, suffix=".part")
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as out:
            n = 0
            out.write("[")
            for row in frame.toLocalIterator():
                out.write((",\n" if n else "\n") + json.dumps(row.asDict(recursive=True), default=str, ensure_ascii=False))
                n += 1
            out.write("\n]\n")
        os.replace(name, target)
    except BaseException:
        Path(name).unlink(missing_ok=True)
        raise
    return n


def fingerprint(path: str | Path) -> dict:
    """Size and SHA-256 of a file, or of all files of a folder by name."""
    root = Path(path)
    digest, size = hashlib.sha256(), 0
    for file in sorted(p for p in ([root] if root.is_file() else root.rglob("*")) if p.is_file()):
        digest.update(str(file.relative_to(root)).encode() if file != root else b"")
        with file.open("rb") as f:
            while chunk := f.read(1 << 20):
                digest.update(chunk)
                size += len(chunk)
    return {"bytes": size, "sha256": digest.hexdigest()}


def write_manifest(path: str | Path, task: str, inputs: Sequence[str], outputs: Sequence[str], parameters: dict, metrics: dict) -> dict:
    """JSON evidence of a run: fingerprints of inputs and outputs, parameters and results."""
    body = {
        "task": task,
        "inputs": {str(p): fingerprint(p) for p in inputs},
        "outputs": {str(p): fingerprint(p) for p in outputs},
        "parameters": parameters,
        "metrics": metrics,
    }
    body["digest"] = hashlib.sha256(json.dumps(body, sort_keys=True).encode()).hexdigest()
    Path(path).write_text(json.dumps(body, indent=1, sort_keys=True))
    return body


def verify_manifest(path: str | Path, task: str) -> dict:
    """The manifest if its digest and all fingerprints still hold; ``ValueError`` otherwise."""
    body = json.loads(Path(path).read_text())
    digest = body.pop("digest", None)
    if digest != hashlib.sha256(json.dumps(body, sort_keys=True).encode()).hexdigest() or body["task"] != task:
        raise ValueError("the manifest was changed or belongs to another task")
    for name, known in {**body["inputs"], **body["outputs"]}.items():
        if not Path(name).exists() or fingerprint(name) != known:
            raise ValueError(f"{name} differs from the manifest")
    return body
