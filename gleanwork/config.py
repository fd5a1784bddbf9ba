"""Configuration of a run. Subjects, labels and models are settings, not code."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields, replace
from pathlib import Path

DISCARD = "discard"


@dataclass(frozen=True)
class AuditThresholds:
    """Bounds of the image metrics. The metrics' scales are those of operators.images."""

    min_luma_stddev: float = 4.0
    min_sat_stddev: float = 4.0
    min_sat_mean: float = 8.0
    min_colorfulness: float = 6.0
    flat_tile_ratio: float = 0.6
    min_laplacian_var: float = 12.0
    min_edge_density: float = 0.01
    min_entropy: float = 3.0
    flat_grid_size: int = 8
    flat_tile_stddev_max: float = 3.0
    edge_threshold: float = 24.0
    variance_max_side: int = 512


@dataclass(frozen=True)
class CurationConfig:
    limit: int = 20
    max_results_per_query: int = 80
    max_urls_multiplier: int = 2
    min_bytes: int = 15_000
    max_bytes: int = 15_000_000
    phash_distance: int = 6
    skip_classify: bool = False
    manifest: bool = True
    ignore_classify_errors: bool = False
    reject_thumbnails: bool = False
    blocked_hosts: tuple[str, ...] = ()
    length_tolerance: bool = False
    audit_limit: int = 50
    # Suffixes, extensions and content types that results depend on.
    labels: tuple[str, ...] = ("original", "wallpaper", "photo", "illustration", "render", "other", DISCARD)
    extensions: tuple[str, ...] = (".jpg", ".jpeg", ".png")
    content_types: tuple[str, ...] = ("image/jpeg", "image/jpg", "image/pjpeg", "image/png", "application/octet-stream")
    search_queries: tuple[str, ...] = ()
    variant_suffixes: tuple[str, ...] = ("fanart", "2d art", "3d render", "key art", "screenshot", "official art", "wallpaper", "nsfw", "sfw", "remake")
    filetype_suffixes: tuple[str, ...] = ("filetype:jpg", "filetype:png")
    extra_queries: tuple[str, ...] = ()
    # for providers only
    download_concurrency: int = 8
    classify_concurrency: int = 3
    search_concurrency: int = 2
    request_timeout: float = 20.0
    queue_size: int = 200
    max_download_retries: int = 3
    max_classify_retries: int = 2
    max_search_retries: int = 3
    user_agent: str = "gleanwork/0.1"
    api_key: str = ""
    base_url: str = ""
    model_primary: str = "primary"
    model_fallback: str = "fallback"
    out_dir: str = "curated"
    log_dir: str = "logs"
    db_path: str = ""
    audit: AuditThresholds = field(default_factory=AuditThresholds)

    @property
    def url_cap(self) -> int:
        """URLs that a run takes from all queries together."""
        return max(1, self.limit * self.max_urls_multiplier)

    @property
    def ledger_path(self) -> str:
        return self.db_path or str(Path(self.out_dir, "ledger"))

    def with_out_dir(self, out_dir: str) -> CurationConfig:
        """A new output folder also moves the ledger."""
        return replace(self, out_dir=out_dir, db_path="")


def load_config(path: str | None = None, environ: dict[str, str] | None = None) -> CurationConfig:
    """Settings of a YAML file over the defaults; GLEANWORK_API_KEY outranks the file.

    Unknown keys are ignored. A missing file leaves the defaults.
    """
    raw: dict = {}
    if path and Path(path).exists():
        import yaml

        raw = yaml.safe_load(Path(path).read_text()) or {}
    known = {f.name: f for f in fields(CurationConfig)}
    values = {k: tuple(v) if isinstance(v, list) else v for k, v in raw.items() if k in known and k != "audit" and v is not None}
    bounds = {f.name for f in fields(AuditThresholds)}
    values["audit"] = AuditThresholds(**{k: v for k, v in (raw.get("audit") or {}).items() if k in bounds})
    if key := (environ if environ is not None else os.environ).get("GLEANWORK_API_KEY"):
        values["api_key"] = key
    return CurationConfig(**values)
