"""Columns that an operator carries along: by position, so that no name of theirs meets one of the operator's own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def apart(docs: DataFrame, needed: tuple[str, ...]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with all columns but the needed ones called after their place, and what gives a frame their names and order back."""
    places = {name: name if name in needed else f"__column_{i}" for i, name in enumerate(docs.columns)}

    def restore(frame: DataFrame) -> DataFrame:
        return frame.select(*(F.col(place).alias(name) for name, place in places.items()))

    return docs.select(*(docs[quoted(name)].alias(place) for name, place in places.items())), restore


def _plain(kind: T.DataType) -> bool:
    """Whether values of a type can be hashed as they are."""
    if isinstance(kind, T.StructType):
        return all(_plain(f.dataType) for f in kind.fields)
    return _plain(kind.elementType) if isinstance(kind, T.ArrayType) else not isinstance(kind, (T.MapType, T.VariantType))


def row_hash(docs: DataFrame, seed: str = "") -> Column:
    """Hash of all columns; maps and variants count by their JSON text, so maps of another order are other rows."""
    columns = [F.col(quoted(f.name)) if _plain(f.dataType) else F.to_json(F.struct(F.col(quoted(f.name)))) for f in docs.schema.fields]
    return F.xxhash64(*columns, F.lit(seed))
