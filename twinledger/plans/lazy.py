"""Named results that are planned only when somebody asks for them."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame


class Tables(Mapping[str, DataFrame]):
    """Read-only mapping of table names to DataFrames, each built on first access."""

    def __init__(self, builders: dict[str, Callable[[], DataFrame]]):
        self._builders, self._built = dict(builders), {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            self._built[name] = self._builders[name]()
        return self._built[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._builders)

    def __len__(self) -> int:
        return len(self._builders)

    def having(self, **more: Callable[[], DataFrame]) -> Tables:
        """The same tables and further ones."""
        return Tables({**{n: (lambda n=n: self[n]) for n in self}, **more})
