"""Settings of an audit: small frozen values that stay on the driver."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field
from pathlib import Path

from siftwell.fixed_values import CHUNK_REPORT_GLOB, MERGED_REPORT, REPORT_FIELDS


@dataclass(frozen=True)
class Criteria:
    forbidden_words: list[str] = field(default_factory=list)
    topics_to_exclude: list[str] = field(default_factory=list)
    tone_requirements: list[str] = field(default_factory=list)
    additional_instructions: str = ""

    @property
    def digest(self) -> str:
        """Short stable fingerprint, kept with every verdict."""
        text = json.dumps(asdict(self), sort_keys=True, ensure_ascii=False)
        return hashlib.sha256(text.encode("utf-8")).hexdigest()[:16]


@dataclass(frozen=True)
class UrlSpec:
    user: str
    base_url: str


@dataclass(frozen=True)
class AuditSpec:
    criteria: Criteria
    url: UrlSpec
    number_of_chunks: int = 5
    report_fields: list[str] = field(default_factory=lambda: list(REPORT_FIELDS))
    max_retries: int = 3
    archive_path: str | None = None
    store_path: str | None = None
    output_path: str | None = None
    clear_store: bool = False
    merge_pattern: str = CHUNK_REPORT_GLOB
    merge_output_name: str = MERGED_REPORT

    def __post_init__(self):
        check_chunk_count(self.number_of_chunks)


def check_chunk_count(n: int) -> None:
    if n <= 0:
        raise ValueError("number_of_chunks must be > 0")


def check_chunk_id(chunk_id: int, n: int) -> None:
    check_chunk_count(n)
    if not 0 <= chunk_id < n:
        raise ValueError(f"chunk_id {chunk_id} out of range [0, {n})")


def load_spec(path: str | Path) -> AuditSpec:
    """Settings from a JSON file; relative paths count from the file's folder.

    Parts that only matter to a model service (its name, batch folder) are
    left to the user's client and ignored here.
    """
    path = Path(path).resolve()
    if not path.exists():
        raise FileNotFoundError(f"Settings file not found: {path}")
    try:
        raw = json.loads(path.read_text(encoding="utf-8"))
    except json.JSONDecodeError as e:
        raise ValueError(f"Invalid JSON in settings file: {e}") from e

    sections = ["criteria", "cache", "processing", "model", "run_defaults", "url_builder"]
    absent = [s for s in sections if s not in raw]
    if absent:
        raise TypeError(f"Missing top-level keys: {', '.join(absent)}")

    def located(section: str, key: str) -> str:
        value = raw[section][key]
        return value if "://" in value else str((path.parent / value).resolve())

    try:
        return AuditSpec(
            criteria=Criteria(**raw["criteria"]),
            url=UrlSpec(**raw["url_builder"]),
            number_of_chunks=raw["processing"]["number_of_chunks"],
            report_fields=raw["processing"]["default_csv_fields"],
            max_retries=raw["model"]["max_retries"],
            archive_path=located("run_defaults", "file_path"),
            store_path=located("cache", "directory"),
            output_path=located("run_defaults", "output_path"),
            clear_store=raw["run_defaults"]["clear_cache"],
            merge_pattern=raw["processing"].get("merge_pattern", CHUNK_REPORT_GLOB),
            merge_output_name=raw["processing"].get("merge_output_name", MERGED_REPORT),
        )
    except KeyError as e:
        raise TypeError(f"Missing setting: {e}") from e
