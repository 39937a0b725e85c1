"""Immutable, checksummed snapshots: <root>/<run_id>/manifest.json and <source>/<series>/page-NNNN.<ext>."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterable
from dataclasses import dataclass, field
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "manifest.json"
FILE_SCHEMA = "source string, series string, concept string, page int, path string, url string, http_status int, content_type string, bytes bigint, sha256 string"


class SnapshotIntegrityError(Exception):
    """A snapshot's files don't agree with its manifest."""


@dataclass(frozen=True)
class RawPage:
    """One response of a source, as received."""

    url: str
    http_status: int
    content_type: str
    content: bytes

    @property
    def extension(self) -> str:
        return "csv" if "csv" in self.content_type else "json"


@dataclass
class SnapshotWriter:
    """Writes one run once: an existing run folder is refused, files are byte copies, the manifest comes last."""

    root: str | os.PathLike
    run_id: str
    scope: dict
    files: list[dict] = field(default_factory=list)
    failures: list[dict] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.folder = Path(self.root) / self.run_id
        self.folder.mkdir(parents=True, exist_ok=False)
        self.started_at = datetime.now(UTC).isoformat()

    def write_pages(self, source: str, series: str, concept: str, pages: Iterable[RawPage]) -> int:
        n = 0
        for n, page in enumerate(pages, 1):
            path = Path(source) / series / f"page-{n:04d}.{page.extension}"
            (self.folder / path).parent.mkdir(parents=True, exist_ok=True)
            (self.folder / path).write_bytes(page.content)
            self.files.append({"source": source, "series": series, "concept": concept, "page": n, "path": path.as_posix(), "url": page.url, "http_status": page.http_status, "content_type": page.content_type, "bytes": len(page.content), "sha256": hashlib.sha256(page.content).hexdigest()})
        return n

    def record_failure(self, source: str, concept: str, error: str) -> None:
        self.failures.append({"source": source, "concept": concept, "error": error})

    def finalize(self) -> Path:
        manifest = {"run_id": self.run_id, "started_at": self.started_at, "finished_at": datetime.now(UTC).isoformat(), "scope": self.scope, "files": self.files, "failures": self.failures}
        (self.folder / MANIFEST).write_text(json.dumps(manifest, indent=1, sort_keys=True), encoding="utf-8")
        return self.folder


def read_manifest(spark: SparkSession, run_dir: str) -> dict:
    """The manifest through Spark's readers, so that any store will do."""
    return json.loads(spark.read.text(f"{run_dir}/{MANIFEST}", wholetext=True).first()[0])


def manifest_files(spark: SparkSession, manifest: dict) -> DataFrame:
    rows = [tuple(f.get(c.split()[0]) for c in FILE_SCHEMA.split(", ")) for f in manifest["files"]]
    return spark.createDataFrame(rows, FILE_SCHEMA).withColumn("run_id", F.lit(manifest["run_id"]))


def relative_path(path, run_dir: str):
    """The path below the run folder, whatever the scheme in front."""
    return F.regexp_extract(path, "/" + escape_regex(os.path.basename(run_dir.rstrip("/"))) + "/(.*)$", 1)


def escape_regex(text: str) -> str:
    return "".join(c if c.isalnum() or c in "_-" else "\\" + c for c in text)


def verify_snapshot(spark: SparkSession, run_dir: str) -> DataFrame:
    """(path, problem) of every file that is missing, changed or not listed; empty for an intact snapshot.

    The files are hashed where they are read, in parallel, and meet the manifest in a full outer join.
    """
    listed = manifest_files(spark, read_manifest(spark, run_dir)).select("path", F.col("sha256").alias("expected"))
    stored = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(run_dir)
    found = stored.select(relative_path(F.col("path"), run_dir).alias("path"), F.sha2("content", 256).alias("actual")).where(F.col("path") != MANIFEST)
    problem = F.when(F.col("actual").isNull(), "missing").when(F.col("expected").isNull(), "unlisted").when(F.col("actual") != F.col("expected"), "checksum mismatch")
    return listed.join(found, "path", "full_outer").select("path", problem.alias("problem")).where(F.col("problem").isNotNull())
