"""What a source adapter has to say."""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import DataFrame


class SourceAdapter(ABC):
    """What a source has to say; scanning, writing and publishing are shared."""

    regime: str
    identity_columns: tuple[str, ...]
    review_rules: tuple = ()

    @abstractmethod
    def parse(self, bronze: DataFrame) -> DataFrame:
        """Silver rows of documents (sha256, text)."""

    @abstractmethod
    def normalize(self, silver: DataFrame) -> DataFrame:
        """Gold candidates of silver rows."""
