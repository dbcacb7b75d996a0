"""Declared fields of cell tables: types, defaults, merge rules and checks."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellweave.operators.mesh import RULES

#: Names of field types, and what they are here; an unsigned byte needs a short.
TYPES = {"float": T.FloatType(), "double": T.DoubleType(), "int": T.IntegerType(), "long": T.LongType(), "uint8": T.ShortType()}
BYTES = {"float": 4, "double": 8, "int": 4, "long": 8, "uint8": 1}
STATES = {"fluid": 0, "solid": 1, "geometry_static": 2, "geometry_moving": 3, "unallocated": 4, "ghost": 5}


@dataclass(frozen=True)
class Field:
    """One field of a cell: a number, or a vector of up to 32 components."""

    name: str
    type: str = "float"
    components: int = 1
    halo: int = 0
    rule: str = "arithmetic"
    default: tuple[float, ...] = ()

    def __post_init__(self):
        if not 1 <= len(self.name) <= 64:
            raise ValueError("a field's name has 1 to 64 characters")
        if self.type not in TYPES:
            raise ValueError(f"no field type is named {self.type!r}")
        if not 1 <= self.components <= 32 or not 0 <= self.halo <= 2:
            raise ValueError("a field has 1 to 32 components and a halo of 0 to 2 cells")
        if self.rule not in RULES:
            raise ValueError(f"no averaging rule is named {self.rule!r}")
        if self.default and len(self.default) != self.components:
            raise ValueError("as many defaults as components, or none")

    def spark_type(self) -> T.DataType:
        return TYPES[self.type] if self.components == 1 else T.ArrayType(TYPES[self.type], False)

    def struct(self) -> T.StructField:
        return T.StructField(self.name, self.spark_type(), False, {"rule": self.rule, "halo": self.halo})

    def fill(self) -> Column:
        """Its default, or zero."""
        values = self.default or (0,) * self.components
        one = [F.lit(v).cast(TYPES[self.type]) for v in values]
        return one[0] if self.components == 1 else F.array(*one)

    def bytes_per_cell(self) -> int:
        return BYTES[self.type] * self.components


@dataclass
class Fields:
    """The fields of a session, by name; a second field of a name is not taken."""

    own: dict[str, Field] = field(default_factory=dict)

    def add(self, f: Field) -> bool:
        if f.name in self.own:
            return False
        self.own[f.name] = f
        return True

    def filled(self, cells: DataFrame) -> DataFrame:
        return cells.withColumns({n: f.fill() for n, f in self.own.items() if n not in cells.columns})

    def missing(self, cells: DataFrame) -> list[str]:
        return [n for n in self.own if n not in cells.columns]

    def bound(self, cells: DataFrame, names: list[str]) -> list[Column]:
        """The columns of these names; an unknown one is an error, not a warning."""
        unknown = [n for n in names if n not in cells.columns]
        if unknown:
            raise ValueError(f"unknown fields: {', '.join(unknown)}")
        return [F.col(n) for n in names]

    def rules(self) -> dict[str, str]:
        return {n: f.rule for n, f in self.own.items()}

    def memory(self, cells: int) -> int:
        """Bytes of all fields, each column padded to 64 bytes."""
        return sum(-(-f.bytes_per_cell() * cells // 64) * 64 for f in self.own.values())


def fnv1a(text: str) -> int:
    """The 64-bit FNV-1a hash of a name's UTF-8 bytes."""
    h = 0xCBF29CE484222325
    for b in text.encode():
        h = (h ^ b) * 0x100000001B3 % 2**64
    return h


def fnv1a_all(texts: pa.Array) -> np.ndarray:
    """The hashes of a batch of strings at once: byte by byte over all of them, and not string by string."""
    own = texts.cast(pa.large_binary())
    _, ends, data = own.buffers()
    at = np.frombuffer(ends, np.int64)[own.offset : own.offset + len(own) + 1]
    size, begin = np.diff(at), at[:-1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    h = np.full(len(size), 0xCBF29CE484222325, np.uint64)
    order = np.argsort(-size, kind="stable")  # those that have a byte at a place come first
    left = len(size)
    with np.errstate(over="ignore"):
        for k in range(int(size.max(initial=0))):
            while left and size[order[left - 1]] <= k:
                left -= 1
            some = order[:left]
            h[some] = (h[some] ^ data[begin[some] + k]) * np.uint64(0x100000001B3)
    return h


def kernel(cells: DataFrame, writes: dict[str, Column], mask: Column | None = None) -> DataFrame:
    """A row-wise program: new values of fields where the mask holds; other rows stay as they are."""
    return cells.withColumns({n: c if mask is None else F.when(mask, c).otherwise(F.col(n)) for n, c in writes.items()})
