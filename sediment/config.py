"""Settings of chunking, similarity and backup, with their validation."""

from __future__ import annotations

from dataclasses import dataclass

from sediment.errors import ConfigError

KIB = 1024
MIB = 1024 * KIB


@dataclass(frozen=True)
class ChunkConfig:
    """Least, average and greatest chunk size in bytes."""

    min_size: int = 16 * KIB
    avg_size: int = 32 * KIB
    max_size: int = 128 * KIB

    def __post_init__(self):
        if self.min_size < 64:
            raise ConfigError("min_size must be at least 64")
        if self.avg_size < 2 * self.min_size:
            raise ConfigError("avg_size must be at least twice min_size")
        if self.max_size < 2 * self.avg_size:
            raise ConfigError("max_size must be at least twice avg_size")
        if self.max_size > MIB:
            raise ConfigError("max_size must be at most 1 MiB")

    @classmethod
    def from_chunk_size(cls, size: int) -> ChunkConfig:
        """The profile around one average size."""
        return cls(max(size // 2, 64), size, min(4 * size, MIB))


#: Profiles for text tables, whose rows are far shorter than files.
TEXT = ChunkConfig(512, 1024, 4096)
FINE = ChunkConfig(128, 256, 1024)


@dataclass(frozen=True)
class SimilarityConfig:
    """``threshold`` gates tiers: 0 turns similarity off; up to 0.70 all tiers pass, up to 0.85 the upper two, above it the highest."""

    threshold: float = 0.7
    candidates_per_bucket: int = 5
    head_tail_filter: bool = False

    def __post_init__(self):
        object.__setattr__(self, "threshold", min(1.0, max(0.0, self.threshold)))

    @property
    def enabled(self) -> bool:
        return self.threshold > 0

    @property
    def least_tier(self) -> int:
        return 1 if self.threshold <= 0.70 else 2 if self.threshold <= 0.85 else 3


@dataclass(frozen=True)
class BackupOptions:
    chunks: ChunkConfig = ChunkConfig()
    similarity: SimilarityConfig = SimilarityConfig()
    level: int = 3
    force: bool = False
    #: Bytes after which a pack is full.
    pack_bytes: int = 16 * MIB
