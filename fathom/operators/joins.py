"""Broadcasting behind a size check."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

# Largest side that is sent to every executor. Rows here are narrow (ids, a
# term, a number), about 100 bytes each.
BROADCAST_ROWS = 1_000_000


@dataclass(frozen=True)
class Side:
    """A join side and whether its counted size allows a broadcast."""

    df: DataFrame
    small: bool

    def hint(self, df: DataFrame) -> DataFrame:
        """Broadcast hint for this side, or for rows derived from it one to
        one or fewer; without it the join shuffles and AQE splits hot keys."""
        return F.broadcast(df) if self.small else df

    @property
    def side(self) -> DataFrame:
        return self.hint(self.df)


def checked(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> Side:
    """Count the rows, in parallel and without moving them."""
    return Side(df, df.count() <= max_rows)
