"""Store locations: local paths, s3:// and gcs:// URIs to Hadoop paths."""

from __future__ import annotations

import posixpath
from dataclasses import dataclass, field
from urllib.parse import parse_qs, urlsplit

from sediment.errors import ConfigError

SECRETS = {"access_key_id", "secret_access_key", "session_token", "credential"}
OPTIONS = {"region", "endpoint", "cache_dir"}


@dataclass(frozen=True)
class StoreLocation:
    """``path`` is what Spark reads and writes; credentials come from the Hadoop configuration only."""

    path: str
    options: dict[str, str] = field(default_factory=dict)

    def child(self, *names: str) -> str:
        return posixpath.join(self.path, *names)


def parse_store(uri: str = "sediment-store") -> StoreLocation:
    """``s3://bucket/prefix?region=..``, ``gcs://bucket/prefix`` (or gs), any other scheme, or a local path."""
    if not uri:
        raise ConfigError("empty store location")
    parts = urlsplit(uri)
    if parts.scheme in ("s3", "s3a", "gcs", "gs"):
        if not parts.netloc:
            raise ConfigError(f"no bucket in {uri.partition('?')[0]}")
        given = {k: v[-1] for k, v in parse_qs(parts.query).items()}
        if SECRETS & given.keys():
            raise ConfigError("credentials belong in the Hadoop configuration, not in a URI")
        if unknown := given.keys() - OPTIONS:
            raise ConfigError(f"unknown options: {', '.join(sorted(unknown))}")
        scheme = "s3a" if parts.scheme.startswith("s3") else "gs"
        return StoreLocation(f"{scheme}://{parts.netloc}{parts.path.rstrip('/')}", given)
    return StoreLocation(uri.rstrip("/") or "/")


def hadoop_options(location: StoreLocation) -> dict[str, str]:
    """Settings that the location's options stand for."""
    found = {}
    bucket = urlsplit(location.path).netloc
    if "region" in location.options:
        found[f"fs.s3a.bucket.{bucket}.endpoint.region"] = location.options["region"]
    if "endpoint" in location.options:
        found[f"fs.s3a.bucket.{bucket}.endpoint"] = location.options["endpoint"]
    return found


def safe_target(dest: str, path: str) -> str:
    """``path`` under ``dest``; refuses absolute paths and anything that climbs out."""
    target = posixpath.normpath(posixpath.join(dest, path))
    root = posixpath.normpath(dest)
    if path.startswith("/") or target != root and not target.startswith(root.rstrip("/") + "/") or ".." in path.split("/"):
        raise ConfigError(f"{path!r} leaves the destination")
    return target
