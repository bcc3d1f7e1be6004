"""Index articles as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql.streaming import StreamingQuery

from newsloom.operators.embedding import Embedder
from newsloom.plans.indexing import fill_categories, index_batch
from newsloom.sources.batches import BatchTable


COUNTS = ["indexed", "skipped", "already_indexed", "no_title", "invalid"]


def index_stream(
    articles: DataFrame,
    table: BatchTable,
    as_of: Column,
    checkpoint: str,
    embedder: Embedder | None = None,
    name: str = "articles",
    catalog: Callable[[], DataFrame] | None = None,
    epochs: str | None = None,
    tallies: str | None = None,
    quarantine: str | None = None,
    **trigger,
) -> StreamingQuery:
    """Start indexing a stream of articles into the table.

    Each micro-batch is one committed directory tagged with the query name and
    batch id. A replay after a failure finds its tag and adds nothing; ids that
    came in with an earlier batch are found in the table, which is re-read here.

    ``catalog`` returns the article table (id, category); it is asked again for each
    micro-batch, and articles that arrive without a category get theirs from it.
    ``epochs`` and ``quarantine`` are those of :func:`index_batch`. With a ``tallies``
    path, each micro-batch adds one row there: its id and the counts of
    :func:`newsloom.operators.stats.tally`, observed while the batch is appended.
    """

    def one_batch(rows: DataFrame, batch_id: int) -> None:
        tag = f"{name}-{batch_id}"
        if table.has_batch(tag):
            return
        given = rows if catalog is None else fill_categories(rows, catalog())
        watch = None if tallies is None else Observation(tag)
        index_batch(given, table, as_of, embedder, tag, quarantine, epochs, watch).unpersist()
        if watch is not None:
            counts = watch.get
            row = [(batch_id, *[int(counts[c]) for c in COUNTS])]
            schema = "batch_id bigint, " + ", ".join(f"{c} bigint" for c in COUNTS)
            rows.sparkSession.createDataFrame(row, schema).write.mode("append").parquet(tallies)

    writer = articles.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
