"""Argument checks shared by the operators; they run while a plan is being built."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

# The settings a run uses unless told otherwise.
MAX_TEXT_BYTES = 5_242_880
MIN_CHUNK_SIZE = 1000
MAX_CHUNK_SIZE = 1500
OVERLAP_SIZE = 250
MAX_CLUSTERS = 12
MIN_SENTENCES = 8
MIN_CLUSTER_SIZE_FOR_OUTPUT = 2
REPRESENTATIVE_DISTANCE_RATIO = 1.2
MAX_REPRESENTATIVE_SENTENCES = 3
SENTENCES_BEFORE = 1
SENTENCES_AFTER = 1
EMBEDDING_BATCH_SIZE = 64
KMEANS_ROUNDS = 50
KEYWORD_LIMIT = 5
MIN_CLUSTER_SIZE = 2


def positive_int(name: str, value: Any) -> int:
    """Return ``value`` when it is an int above zero; booleans do not count as ints."""
    if isinstance(value, bool) or not isinstance(value, int) or value <= 0:
        raise ValueError(f"{name} must be a positive integer, got {value!r}")
    return value


def non_negative_int(name: str, value: Any) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or value < 0:
        raise ValueError(f"{name} must be an integer of at least 0, got {value!r}")
    return value


def positive_number(name: str, value: Any) -> float:
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not value > 0:
        raise ValueError(f"{name} must be a positive number, got {value!r}")
    return float(value)


@dataclass(frozen=True)
class ChunkSettings:
    """Chunk lengths in characters. The overlap is clamped to ``[0, min_chunk_size]``."""

    min_chunk_size: int = MIN_CHUNK_SIZE
    max_chunk_size: int = MAX_CHUNK_SIZE
    overlap_size: int = OVERLAP_SIZE

    def __post_init__(self) -> None:
        if self.max_chunk_size < self.min_chunk_size:
            raise ValueError("max_chunk_size must not be smaller than min_chunk_size")
        object.__setattr__(self, "overlap_size", max(0, min(self.overlap_size, self.min_chunk_size)))


@dataclass(frozen=True)
class ClusterSettings:
    """How the chunks of one document are grouped and which of them speak for a group."""

    max_clusters: int = MAX_CLUSTERS
    min_sentences: int = MIN_SENTENCES
    min_cluster_size_for_output: int = MIN_CLUSTER_SIZE_FOR_OUTPUT
    representative_distance_ratio: float = REPRESENTATIVE_DISTANCE_RATIO
    max_representative_sentences: int = MAX_REPRESENTATIVE_SENTENCES

    def __post_init__(self) -> None:
        positive_int("max_clusters", self.max_clusters)
        positive_int("min_sentences", self.min_sentences)
        positive_int("min_cluster_size_for_output", self.min_cluster_size_for_output)
        positive_number("representative_distance_ratio", self.representative_distance_ratio)
        positive_int("max_representative_sentences", self.max_representative_sentences)
