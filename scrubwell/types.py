"""The one type that everything composes over."""

from collections.abc import Callable

from pyspark.sql import Column

#: A pure function of a column: no alias, no look-up by name, null in gives null out unless said otherwise.
type ColumnTransform = Callable[[Column], Column]
