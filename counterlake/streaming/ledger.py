"""Micro-batches with stored state, each applied exactly once.

A step is an ordinary plan: it gets the rows of a batch and the tables that the batch before left, and gives tables.
``Ledger.apply`` writes them into folders of the batch and marks the batch as done last. A batch that is played again
after a failure starts from the state of the batch before and replaces what was half written; one that is marked is
left alone. Readers see marked batches only. The checkpoint of the stream lies beside the ledger, so that the numbers
of batches and the marks belong together.

State tables are replaced as a whole by every batch; the newest two are kept. A source that reports every object at
every tick sends about as many rows as the state holds.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

#: What a step gets besides its batch: a table of the batch before by name (None at first), and a way to hold a
#: relation that several of its tables share until they are written.
Stored = Callable[[str], "DataFrame | None"]
Hold = Callable[[DataFrame], DataFrame]
Step = Callable[[DataFrame, Stored, Hold], dict[str, DataFrame]]


class Ledger:
    """Tables of a stream under ``path``; those in ``states`` replace their predecessors, others add up."""

    def __init__(self, spark: SparkSession, path: str, states: Sequence[str] = ("state",)) -> None:
        self.spark, self.path, self.states = spark, path, tuple(states)

    def _files(self, path: str):
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()), target

    def batches(self) -> list[int]:
        """Numbers of the batches that are done."""
        files, folder = self._files(f"{self.path}/done")
        if not files.exists(folder):
            return []
        return sorted(int(f.getPath().getName()) for f in files.listStatus(folder))

    def _folder(self, name: str, batch: int) -> str:
        return f"{self.path}/{name}/batch={batch}"

    def read(self, name: str) -> DataFrame:
        """All rows of a table so far, or the newest ones of a state table."""
        done = self.batches()
        if not done:
            raise ValueError(f"no batch is done in {self.path}")
        wanted = done[-1:] if name in self.states else done
        return self.spark.read.parquet(*[self._folder(name, n) for n in wanted])

    def apply(self, batch: DataFrame, number: int, step: Step) -> None:
        done = self.batches()
        if number in done:
            return
        before = max((n for n in done if n < number), default=None)
        spark, held = batch.sparkSession, []

        def stored(name: str) -> DataFrame | None:
            return None if before is None else spark.read.parquet(self._folder(name, before))

        def hold(rows: DataFrame) -> DataFrame:
            held.append(rows.persist())
            return rows

        try:
            for name, rows in step(hold(batch), stored, hold).items():
                rows.write.mode("overwrite").parquet(self._folder(name, number))
        finally:
            for rows in held:
                rows.unpersist()
        files, mark = self._files(f"{self.path}/done/{number}")
        files.create(mark).close()
        for name in self.states:
            for old in (n for n in done if before is not None and n < before):
                files, folder = self._files(self._folder(name, old))
                files.delete(folder, True)

    def start(self, stream: DataFrame, step: Step, **trigger) -> StreamingQuery:
        """Run the step on every batch of the stream; ``trigger`` as for ``DataStreamWriter.trigger``."""
        writer = (stream.writeStream.option("checkpointLocation", f"{self.path}/checkpoint")
                  .foreachBatch(lambda batch, number: self.apply(batch, number, step)))
        return (writer.trigger(**trigger) if trigger else writer).start()
