"""What an event table holds: properties, wire layout, clock and bucket width."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, replace

from pyspark.sql import types as T

#: Seconds from the Unix epoch to 2012-01-01T00:00:00Z, where mission time begins.
MISSION_EPOCH = 1_325_376_000
DAY = 86_400.0


@dataclass(frozen=True)
class EventSchema:
    """Fixed-width events <time, p1..pn> with properties of 0..255.

    wire lists (field, numpy type) of a record, big-endian; names starting with "_" are skipped.
    """

    props: tuple[str, ...]
    wire: tuple[tuple[str, str], ...]
    time: str = "time"
    width: float = 60.0
    low: int = 0
    high: int = 255

    @property
    def columns(self) -> list[str]:
        return [self.time, *self.props]

    @property
    def record_bytes(self) -> int:
        import numpy as np

        return np.dtype(list(self.wire)).itemsize

    def spark(self) -> T.StructType:
        """Unsigned bytes become ShortType: ByteType is signed and would break values from 128."""
        return T.StructType([T.StructField(self.time, T.DoubleType()), *[T.StructField(p, T.ShortType()) for p in self.props]])

    def with_width(self, width: float) -> "EventSchema":
        return replace(self, width=width)

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> "EventSchema":
        d = json.loads(text)
        return cls(**d | {"props": tuple(d["props"]), "wire": tuple(map(tuple, d["wire"]))})


#: The 16-byte high-energy record.
HE = EventSchema(
    props=("detID", "channel", "pulse", "eventType"),
    wire=(("time", ">f8"), ("detID", "u1"), ("channel", "u1"), ("pulse", "u1"), ("_pad", "V3"), ("eventType", "u1"), ("_end", "V1")),
)
