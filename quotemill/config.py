"""Options and the source registry."""

from __future__ import annotations

from dataclasses import dataclass, field

from . import fixed_values as fv


@dataclass(frozen=True)
class Source:
    name: str
    format: str
    idle_timeout_ms: int = fv.IDLE_TIMEOUT_MS

    def check(self) -> None:
        if not self.name.strip():
            raise ValueError("source name is required")
        if not self.format.strip():
            raise ValueError(f"source '{self.name}' has no format")
        if self.idle_timeout_ms <= 0:
            raise ValueError(f"source '{self.name}' needs a positive idle timeout")


DEFAULT_SOURCES = (
    Source("alpha", fv.ALPHA),
    Source("beta", fv.BETA),
    Source("gamma", fv.GAMMA),
)


@dataclass(frozen=True)
class Options:
    sources: tuple[Source, ...] = field(default=DEFAULT_SOURCES)
    batch_size: int = fv.BATCH_SIZE
    flush_interval_ms: int = fv.FLUSH_INTERVAL_MS
    dedup_window_ms: int = fv.DEDUP_WINDOW_MS
    max_retries: int = fv.MAX_RETRIES
    retry_initial_ms: int = fv.RETRY_INITIAL_MS
    retry_max_ms: int = fv.RETRY_MAX_MS
    stability_ms: int = fv.STABILITY_MS
    heartbeat_ms: int = fv.HEARTBEAT_MS
    max_message_bytes: int = fv.MAX_MESSAGE_BYTES

    def check(self) -> Options:
        positive = ("batch_size", "flush_interval_ms", "dedup_window_ms", "stability_ms", "heartbeat_ms",
                    "max_message_bytes")
        for name in positive:
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be positive")
        if self.max_retries < 0:
            raise ValueError("max_retries must not be negative")
        if not 0 <= self.retry_initial_ms <= self.retry_max_ms:
            raise ValueError("retry delays must satisfy 0 <= initial <= max")
        if not self.sources:
            raise ValueError("at least one source is required")
        seen = set()
        for source in self.sources:
            source.check()
            if source.name.lower() in seen:
                raise ValueError(f"duplicate source name '{source.name}'")
            seen.add(source.name.lower())
        return self
