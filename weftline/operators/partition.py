"""Splitting the id space into contiguous ranges, half-open as all scans are."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from uuid import UUID

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InvalidRange, NoPartition
from ..schemas import MAX_ID, NIL_ID


@dataclass(frozen=True)
class KeyRange:
    """`start` to `end` in `parts` ranges of equal width; the last takes the remainder."""

    start: str
    end: str
    parts: int

    def __post_init__(self) -> None:
        if self.parts <= 0:
            raise InvalidRange(f"a range needs one part at least, not {self.parts}")
        if UUID(self.start).int >= UUID(self.end).int:
            raise InvalidRange(f"the range from {self.start} to {self.end} is empty")

    @classmethod
    def full(cls, parts: int) -> KeyRange:
        return cls(NIL_ID, MAX_ID, parts)

    @property
    def bounds(self) -> list[str]:
        """The `parts` + 1 ends of the ranges."""
        low, high = UUID(self.start).int, UUID(self.end).int
        # the width counts the upper end itself, so that a power of two splits the full space evenly
        width = (high - low + 1) // self.parts
        return [self.start, *[str(UUID(int=low + width * i)) for i in range(1, self.parts)], self.end]

    def extents(self, part: int) -> tuple[str, str]:
        if not 0 <= part < self.parts:
            raise InvalidRange(f"there is no part {part} of {self.parts}")
        return self.bounds[part], self.bounds[part + 1]

    def part_of(self, id_: Column) -> Column:
        """Number of the range that an id lies in; null outside."""
        edges = self.bounds
        inside = (id_ >= edges[0]) & (id_ < edges[-1])
        passed = [(id_ >= edge).cast("int") for edge in edges[1:-1]]
        total = passed[0] if passed else F.lit(0)
        for p in passed[1:]:
            total = total + p
        return F.when(inside, total)


@dataclass(frozen=True)
class FixedPartition:
    """The part that this process takes, when a deployment fixes it. The scheduler owns this on a cluster."""

    part: int
    parts: int

    def extents(self) -> tuple[str, str]:
        return KeyRange.full(self.parts).extents(self.part)


@dataclass(frozen=True)
class RecordPartition:
    """The part that a process takes by its place among its peers: the number behind the last dash of its host
    name, of as many parts as `lookup` (say, of service records) finds. Raises NoPartition while that is unknown."""

    host: str
    lookup: Callable[[], Sequence]

    def extents(self) -> tuple[str, str]:
        number = self.host.rpartition("-")[2]
        if not number.isdigit():
            raise NoPartition(f"no number behind the last dash of {self.host!r}")
        try:
            parts = len(self.lookup())
        except OSError as error:
            raise NoPartition("the peers are not known yet") from error
        if int(number) >= parts:
            raise NoPartition(f"part {number} of {parts} known peers")
        return KeyRange.full(parts).extents(int(number))
