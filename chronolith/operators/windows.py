"""Window specs that all generators share: one exchange on path, and one sort where the finer order comes first."""

from pyspark.sql.window import Window, WindowSpec


def part() -> WindowSpec:
    return Window.partitionBy("path")


def rows() -> WindowSpec:
    return part().orderBy("date", "ord")


def running() -> WindowSpec:
    return rows().rowsBetween(Window.unboundedPreceding, 0)


def whole() -> WindowSpec:
    """All rows of the path, in the order that lets one operator take them together with the other frames."""
    return rows().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def trailing(n: int) -> WindowSpec:
    return rows().rowsBetween(-(n - 1), 0)
