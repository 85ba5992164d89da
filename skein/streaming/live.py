"""Live queries: a stream of changes triggers a query again."""

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fingerprint(rows: DataFrame) -> tuple:
    """The number of rows and the sum of their hashes, whatever their types and names: each row is hashed as JSON."""
    told = rows.select(F.to_json(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rows.columns)]), {"ignoreNullFields": "false"}).alias("r"))
    return tuple(told.agg(F.count("*"), F.sum(F.xxhash64("r").cast("decimal(38,0)"))).first())


def watch(changes: DataFrame, query: Callable[[], DataFrame], notify: Callable[[DataFrame], None], checkpoint: str, once: bool = False, first: bool = False):
    """Run `query` after each batch of the streaming DataFrame `changes`, and notify if its rows changed; changes of one batch make one run.

    The rows are computed once: they are kept while they are hashed and told. `first` tells the rows as they are now, at once.
    """
    last: list = []

    def tell() -> None:
        result = query().persist()
        try:
            now = fingerprint(result)
            if not last or last[-1] != now:
                last[:] = [now]
                notify(result)
        finally:
            result.unpersist()

    if first:
        tell()
    writer = changes.writeStream.foreachBatch(lambda batch, number: tell()).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if once else writer.trigger(processingTime="300 milliseconds").start()
