"""Options, error codes, and the budget that one reading of a document spends."""

from __future__ import annotations

import math
import time
from dataclasses import asdict, dataclass, field, fields

UNREADABLE, READ_FAILED, BAD_HEADER, NO_OBJECTS, NO_PAGES, BAD_RANGE, LIMIT = range(1, 8)


class PdfError(Exception):
    def __init__(self, code: int, message: str):
        super().__init__(message)
        self.code, self.message = code, message


def limit(message: str) -> PdfError:
    return PdfError(LIMIT, message)


MIB = 1 << 20


@dataclass(frozen=True)
class Options:
    """Nineteen limits. All are positive integers, but streamingThreshold may be 0 and deadlineSeconds is a positive number or None."""

    streamingThreshold: int = 5 * MIB
    maxCMapSize: int = MIB
    objectChunkSize: int = 262_144
    maxObjects: int = 500_000
    maxPages: int = 100_000
    maxStreamBytes: int = 100 * MIB
    maxDecodedBytesTotal: int = 512 * MIB
    maxContentOperators: int = 10_000_000
    maxRecursionDepth: int = 64
    maxWarnings: int = 1_000
    deadlineSeconds: float | None = None
    maxInputBytes: int = 256 * MIB
    maxObjectBytes: int = 101 * MIB
    maxContentTokens: int = 2_000_000
    maxArrayElements: int = 20_000
    maxCMapEntries: int = 100_000
    maxExtractedTextBytes: int = 32 * MIB
    maxCacheBytes: int = 8 * MIB
    maxOperandBytes: int = 16 * MIB

    def __post_init__(self) -> None:
        for name, value in asdict(self).items():
            if name == "deadlineSeconds":
                if value is not None and not (math.isfinite(value) and value > 0):
                    raise ValueError("deadlineSeconds must be a finite number above 0")
            elif value < (0 if name == "streamingThreshold" else 1):
                raise ValueError(f"{name} is too small")

    def __hash__(self) -> int:
        """Of a few, as what documents share is looked up by it often."""
        return hash((self.maxObjects, self.maxRecursionDepth, self.maxArrayElements))

    @classmethod
    def of(cls, given: dict[str, str] | None) -> Options:
        """From strings or numbers; names may be in any case."""
        names = {f.name.lower(): f.name for f in fields(cls)}
        found: dict[str, float | int] = {}
        for key, value in (given or {}).items():
            if (name := names.get(key.lower())) is None:
                raise ValueError(f"unknown option {key}")
            found[name] = float(value) if name == "deadlineSeconds" else int(value)
        return cls(**found)


COUNTERS = (
    "xref_sections",
    "objects_indexed",
    "objects_loaded",
    "object_bytes_read",
    "decoded_streams",
    "decoded_bytes",
    "decoded_work_bytes",
    "content_operators",
    "content_tokens",
    "cmap_entries",
    "generated_text_bytes",
    "cache_bytes",
    "cache_evictions",
)
#: Cannot be compared between runs.
TIMINGS = ("first_page_ms", "duration_ms", "peak_memory_bytes")


def utf8_size(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode("utf-8", "surrogatepass"))


@dataclass
class Budget:
    options: Options
    began: float = field(default_factory=time.monotonic)
    counts: dict[str, int] = field(default_factory=lambda: dict.fromkeys(COUNTERS, 0))
    warnings: list[str] = field(default_factory=list)
    operand_bytes: int = 0
    cmap_bytes: int = 0

    def deadline(self) -> None:
        most = self.options.deadlineSeconds
        if most is not None and time.monotonic() - self.began > most:
            raise limit("PDF parsing deadline exceeded.")

    def warn(self, text: str) -> None:
        most = self.options.maxWarnings
        if len(self.warnings) < most:
            self.warnings.append(text)
        else:
            self.warnings[most - 1] = "Additional warnings truncated."

    def objects(self, n: int) -> None:
        if n > self.options.maxObjects:
            raise limit("PDF object count exceeds maxObjects.")

    def work(self, n: int) -> None:
        self.counts["decoded_work_bytes"] += n
        if self.counts["decoded_work_bytes"] > self.options.maxDecodedBytesTotal:
            raise limit("Intermediate decoded data exceeds maxDecodedBytesTotal.")

    def decoded(self, n: int) -> None:
        if n > self.options.maxStreamBytes:
            raise limit("Decoded PDF stream exceeds maxStreamBytes.")
        if self.counts["decoded_bytes"] + n > self.options.maxDecodedBytesTotal:
            raise limit("Decoded PDF data exceeds maxDecodedBytesTotal.")
        self.counts["decoded_streams"] += 1
        self.counts["decoded_bytes"] += n

    def text(self, n: int) -> None:
        if self.counts["generated_text_bytes"] + n > self.options.maxExtractedTextBytes:
            raise limit("Generated text exceeds maxExtractedTextBytes.")
        self.counts["generated_text_bytes"] += n

    def bounded(self, parts: list[str], size: int, more: str) -> int:
        """Append to a text under construction; its new size in bytes."""
        size += utf8_size(more)
        if size > self.options.maxExtractedTextBytes:
            raise limit("Extracted text exceeds maxExtractedTextBytes.")
        parts.append(more)
        return size

    def cmap(self, n: int) -> None:
        self.deadline()
        self.counts["cmap_entries"] += 1
        if self.counts["cmap_entries"] > self.options.maxCMapEntries:
            raise limit("CMap expansion exceeds maxCMapEntries.")
        self.cmap_bytes += n + 128
        if self.cmap_bytes > self.options.maxCacheBytes:
            raise limit("CMap allocation exceeds maxCacheBytes.")

    def operands(self, n: int) -> None:
        self.operand_bytes += n
        if self.operand_bytes > self.options.maxOperandBytes:
            raise limit("Content operands exceed maxOperandBytes.")
