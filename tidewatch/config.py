"""Default settings, one dataclass per concern. Durations are in seconds."""

from __future__ import annotations

from dataclasses import dataclass

MINUTE = 60
HOUR = 3600
DAY = 86400


@dataclass(frozen=True)
class IngestSettings:
    topic: str = "service-logs"
    batch_size: int = 100
    batch_interval_ms: int = 500
    max_fetch_bytes: int = 10_000_000
    # Messages of a micro-batch at most, while nothing is measured yet and at any speed.
    max_per_trigger: int = 1_000_000
    # A micro-batch should be written in this time; the newest batches tell the speed.
    flush_target_s: int = 30
    paced_by: int = 20


@dataclass(frozen=True)
class RollupSettings:
    width_s: int = MINUTE
    refresh_start_s: int = 10 * MINUTE
    refresh_end_s: int = MINUTE
    # A (bucket, service) group with more rows than this gets its percentile by
    # distributed selection instead of one in-memory value map.
    hot_rows: int = 500_000


@dataclass(frozen=True)
class DetectSettings:
    window_s: int = 60 * MINUTE
    width_s: int = MINUTE
    z_warning: float = 2.5
    z_critical: float = 4.0
    ewma_alpha: float = 0.3
    # Series are cut into chunks of this many buckets so that a few services
    # still fill many tasks.
    chunk_buckets: int = 1440

    @property
    def chunk_s(self) -> int:
        """Chunk length; never shorter than the window, so one halo is enough."""
        return max(self.chunk_buckets * self.width_s, self.window_s)


@dataclass(frozen=True)
class ReadSettings:
    feed_hours: float = 24
    feed_limit: int = 50
    ui_feed_limit: int = 30
    health_hours: float = 1
    lookback_hours: int = 6
    context_limit: int = 50
