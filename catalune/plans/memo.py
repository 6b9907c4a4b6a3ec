"""Results that are kept until what they were made from moves on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from catalune.operators.graphs import kept


class Revisions:
    """A counter for each part of a collection; edits raise those of the parts they touch."""

    def __init__(self):
        self.of: dict[str, int] = {}

    def touch(self, *parts: str) -> None:
        for p in parts:
            self.of[p] = self.of.get(p, 0) + 1


class Memo:
    """Written results by name. One is made again only if a part that it names has another revision than when it was."""

    def __init__(self, revisions: Revisions):
        self.revisions, self.have, self.made = revisions, {}, 0

    def get(self, name: str, parts: list[str], build: Callable[[], DataFrame]) -> DataFrame:
        now = tuple(self.revisions.of.get(p, 0) for p in parts)
        if name not in self.have or self.have[name][0] != now:
            self.have[name] = (now, kept(build()))
            self.made += 1
        return self.have[name][1]
