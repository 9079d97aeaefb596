"""Model bundles: versioned folders with everything that scoring needs, on Hadoop's file system.

``<base>/v000001/`` holds named JSON or text files and, written last, ``manifest.json`` with each file's SHA-256, the metric, the threshold and a few scored
rows. A version without a manifest is unfinished and never opened. ``CURRENT`` names the version in use; it is replaced after its version is
complete, so a reader sees the old bundle or the new one and nothing between. Files are a model's parameters, a few kilobytes, and are written by the driver.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

MANIFEST, CURRENT = "manifest.json", "CURRENT"
#: Largest difference between a stored and a new score of the same row.
TOLERANCE = 1e-4


class Folder:
    """The few operations on small files that a bundle needs."""

    def __init__(self, spark: SparkSession, base: str):
        self._jvm, self._conf, self.base = spark._jvm, spark._jsc.hadoopConfiguration(), base.rstrip("/")

    def _at(self, name: str):
        path = self._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}" if name else self.base)
        return path, path.getFileSystem(self._conf)

    def write(self, name: str, text: str) -> None:
        """Write under another name, then rename, so that no half-written file has this name."""
        path, fs = self._at(name)
        draft, _ = self._at(f"{name}.draft")
        out = fs.create(draft, True)
        out.write(bytearray(text.encode()))
        out.close()
        fs.delete(path, False)
        if not fs.rename(draft, path):
            raise OSError(f"{path} can't be written")

    def read(self, name: str) -> str | None:
        path, fs = self._at(name)
        if not fs.exists(path):
            return None
        source = fs.open(path)
        try:
            return bytes(source.readAllBytes()).decode()
        finally:
            source.close()

    def folders(self) -> list[str]:
        path, fs = self._at("")
        return sorted(s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()) if fs.exists(path) else []


@dataclass
class Bundle:
    version: str
    files: dict[str, str]
    metric: float | None
    threshold: float | None
    #: Rows with their scores when the bundle was written: (features, score).
    examples: list[tuple[list[float], float]] = field(default_factory=list)

    def parity(self, scores: Sequence[float]) -> float:
        """The largest difference between the stored scores and ``scores`` of the examples' features, which must stay below the tolerance."""
        if len(scores) != len(self.examples):
            raise ValueError(f"{len(self.examples)} examples and {len(scores)} scores")
        worst = max((abs(a - s) for (_, s), a in zip(self.examples, scores, strict=True)), default=0.0)
        if not worst < TOLERANCE:
            raise ValueError(f"version {self.version} scores its examples otherwise, by {worst}")
        return worst


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def save(
    spark: SparkSession, base: str, files: Mapping[str, str], metric: float | None = None, threshold: float | None = None,
    examples: Sequence[tuple[Sequence[float], float]] = (),
) -> str:
    """A new version with these files, which becomes the current one; its name."""
    folder = Folder(spark, base)
    taken = [int(n[1:]) for n in folder.folders() if n[:1] == "v" and n[1:].isdigit()]
    version = f"v{max(taken, default=0) + 1:06d}"
    for name, text in files.items():
        if name in (MANIFEST, CURRENT) or "/" in name:
            raise ValueError(f"{name} is no name for a file of a bundle")
        folder.write(f"{version}/{name}", text)
    manifest = {
        "files": {n: _digest(t) for n, t in files.items()}, "metric": metric, "threshold": threshold, "examples": [[list(map(float, x)), float(p)] for x, p in examples]
    }
    folder.write(f"{version}/{MANIFEST}", json.dumps(manifest, indent=2, sort_keys=True))
    folder.write(CURRENT, version)
    return version


def current(spark: SparkSession, base: str) -> Bundle | None:
    """The version in use, or None."""
    version = Folder(spark, base).read(CURRENT)
    return open_version(spark, base, version.strip()) if version else None


def open_version(spark: SparkSession, base: str, version: str) -> Bundle:
    """One version; an error if it is unfinished or a file isn't the one that was written."""
    folder = Folder(spark, base)
    text = folder.read(f"{version}/{MANIFEST}")
    if text is None:
        raise ValueError(f"{base}/{version} holds no finished bundle")
    manifest, files = json.loads(text), {}
    for name, digest in manifest["files"].items():
        found = folder.read(f"{version}/{name}")
        if found is None or _digest(found) != digest:
            raise ValueError(f"{version}/{name} is not the file that was written")
        files[name] = found
    return Bundle(version, files, manifest["metric"], manifest["threshold"], [(x, p) for x, p in manifest["examples"]])


def save_if_better(
    spark: SparkSession, base: str, files: Mapping[str, str], metric: float, threshold: float | None = None,
    examples: Sequence[tuple[Sequence[float], float]] = (),
) -> tuple[str, bool]:
    """A new version if its metric is strictly greater than the current one's; the version in use, and whether it is new."""
    held = current(spark, base)
    if held is not None and held.metric is not None and not metric > held.metric:
        return held.version, False
    return save(spark, base, files, metric, threshold, examples), True


def amend(spark: SparkSession, base: str, threshold: float) -> str:
    """The current version once more with another threshold."""
    held = current(spark, base)
    if held is None:
        raise ValueError(f"{base} holds no bundle")
    return save(spark, base, held.files, held.metric, threshold, held.examples)
