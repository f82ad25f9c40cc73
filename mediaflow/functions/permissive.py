"""Reading texts that may be malformed: what can't be read is null and named, and never ends a job."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def unread(**fields: tuple[Column, Column]) -> Column:
    """The names of the fields whose text is there, but gave no value: name=(text, value)."""
    names = [F.when(text.isNotNull() & (text != "") & value.isNull(), F.lit(name)) for name, (text, value) in fields.items()]
    return F.filter(F.array(*names), lambda x: x.isNotNull())


def last_of_each(pairs: Column) -> Column:
    """A map of an array of structs (k, v); of repeated keys the last one counts."""
    return F.map_from_entries(F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs) - i - 1, F.lit(0))), lambda y: y["k"] == x["k"])))


def parameters(text: Column, between: str = ";") -> Column:
    """The map of `k=v;k=v`: a name without `=` has a null value, of a repeated name the last value counts."""
    pair = lambda x: F.struct(F.substring_index(x, "=", 1).alias("k"), F.when(F.instr(x, "=") > 0, F.substr(x, F.instr(x, "=") + 1)).alias("v"))
    return last_of_each(F.transform(F.split(text, between), pair))
