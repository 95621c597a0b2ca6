"""Histories that go on where the last run ended: state kept by Spark for each file or conversation.

``document_blocks`` summarises blocks of code one after the other, each with all blocks and summaries of its file before it, as ``lines.running_history`` does for a whole table; ``remember`` gives each
turn of a conversation the last exchanges before it, as ``lines.memory`` does. Both are streams: what a folder gains is worked on at the next start, a stopped stream goes on from its checkpoint, and
results equal those of one run. A key's state goes when nothing came for ``keep_hours``.

Defined results: within a micro-batch rows are taken in order of their number; a number that is not above the last one of its key was done and is left out. Rows without a key or a number
are left out. A null code or text counts as empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from textloom.session import ship

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HOUR = 3_600_000


class _Kept(StatefulProcessor):
    """Rows of a key in order, with what is kept of those before; it goes by a timer."""

    state = ""

    def __init__(self, keep_hours: float):
        self.keep = int(keep_hours * HOUR)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.done = handle.getValueState("done", "number long")
        self.held = handle.getListState("held", self.state)

    def _new(self, rows, number: str):
        """The rows of all batches that weren't done yet, in order."""
        import pandas as pd

        got = pd.concat(list(rows))
        last = self.done.get()
        got = got[got[number] > last[0]] if last is not None else got
        return got.sort_values(number, kind="stable").drop_duplicates(number)

    def _alive(self, timers) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + self.keep)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        self.held.clear()
        self.done.clear()
        return iter(())

    def close(self) -> None:
        pass


class Summaries(_Kept):
    """Blocks (file, block, code) with their histories; each summary goes into the next history."""

    state = "code string, summary string"

    def __init__(self, summarise: Callable[[str, str], str], keep_hours: float):
        super().__init__(keep_hours)
        self.summarise = summarise

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pandas as pd

        new = self._new(rows, "block")
        history = "".join(f"{code}\n{summary}\n" for code, summary in self.held.get())
        out = []
        for block, code in zip(new["block"], new["code"], strict=True):
            code = "" if pd.isna(code) else code
            summary = self.summarise(history, code)
            out.append((key[0], int(block), code, summary, history))
            history += f"{code}\n{summary}\n"
            self.held.appendValue((code, summary))
        if out:
            self.done.update((out[-1][1],))
        self._alive(timerValues)
        yield pd.DataFrame(out, columns=["file", "block", "code", "summary", "history"])


class Turns(_Kept):
    """Turns (conv_id, turn, role, text) with the last exchanges before each."""

    state = "said string"

    def __init__(self, exchanges: int, keep_hours: float):
        super().__init__(keep_hours)
        self.most = 2 * exchanges

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pandas as pd

        new = self._new(rows, "turn")
        said = [r[0] for r in self.held.get()]
        out = []
        for turn, role, text in zip(new["turn"], new["role"], new["text"], strict=True):
            role, text = ("" if pd.isna(x) else x for x in (role, text))
            out.append((key[0], int(turn), role, text, "\n".join(said)))
            said = [*said, f"{role}: {text}"][-self.most :] if self.most else []
        if out:
            self.done.update((out[-1][1],))
        self.held.clear()
        for s in said:
            self.held.appendValue((s,))
        self._alive(timerValues)
        yield pd.DataFrame(out, columns=["conv_id", "turn", "role", "text", "memory"])


def _run(rows: DataFrame, key: str, processor: _Kept, schema: str, out: str, progress: str):
    spark = rows.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    kept = rows.groupBy(key).transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="ProcessingTime")
    return kept.writeStream.format("parquet").option("path", out).option("checkpointLocation", progress).outputMode("append").trigger(once=True).start()  # with timers, all that is available would never be done


def document_blocks(spark: SparkSession, folder: str, out: str, progress: str, summarise: Callable[[str, str], str], keep_hours: float = 24 * 30):
    """Starts a stream over the Parquet files of ``folder`` (file, block, code) that writes file, block, code, summary and history to ``out``; it ends when all that is there is done."""
    rows = spark.readStream.schema("file string, block long, code string").parquet(folder).filter("file is not null and block is not null")
    return _run(rows, "file", Summaries(summarise, keep_hours), "file string, block long, code string, summary string, history string", out, progress)


def remember(spark: SparkSession, folder: str, out: str, progress: str, exchanges: int = 2, keep_hours: float = 24 * 30):
    """Starts a stream over the Parquet files of ``folder`` (conv_id, turn, role, text) that adds memory, the last exchanges before each turn."""
    rows = spark.readStream.schema("conv_id long, turn long, role string, text string").parquet(folder).filter("conv_id is not null and turn is not null")
    return _run(rows, "conv_id", Turns(exchanges, keep_hours), "conv_id long, turn long, role string, text string, memory string", out, progress)
