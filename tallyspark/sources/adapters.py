"""Interfaces of what this library does not bring: page readers, a second reader, a hosted sheet.

No such service or library is used or tested here; an adapter fills in the tables that these describe.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame


class PageReader(Protocol):
    """Files (sha256, name, content) to PAGE rows, as a mapInArrow or mapInPandas stage with its engine held per worker."""

    def read(self, files: DataFrame) -> DataFrame: ...


class SecondReader(Protocol):
    """Documents that need another reading (sha256, name, raw_text) to replies (sha256, json of SECOND_READING)."""

    def ask(self, documents: DataFrame) -> DataFrame: ...


class SheetClient(Protocol):
    """A hosted sheet's three calls; errors carry a status, which tells whether another try may help."""

    def values(self, sheet: str) -> list[list]: ...

    def write(self, sheet: str, first_row: int, rows: list[list]) -> None: ...

    def delete(self, sheet: str, rows: list[int]) -> None: ...
