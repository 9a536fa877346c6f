"""The token vault as keyed state of a stream: a batch costs what it brings, not what is stored.

Each token has a state of its own (value, entity, when it was written, how often it came).  A row
that is newer than the state replaces it, an older or late one only counts; of equally new rows the
larger value stays, so that the order of rows does not matter.  Changes are appended to a table, and
the vault itself is read from the state of the last committed batch.  Nothing is rewritten: a restart
goes on from the checkpoint, and a batch that runs again starts from the state before it.

Defined cases: rows with a null token are dropped; a null time is older than any other; repeated
rows count; a stream without rows has an empty vault.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

_STATE = "value string, entity string, written long, seen long"
CHANGES = "token string, value string, entity string, written long, seen long"
#: State that can be read and that is kept on disk, not in memory.
SETTINGS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
_OLDEST = -(1 << 63)


class Vault(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entry = handle.getValueState("entry", _STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        value, entity, written, seen = self.entry.get() if self.entry.exists() else (None, None, _OLDEST, 0)
        before = (value, entity, written)
        for batch in rows:
            for v, e, w in zip(batch["value"], batch["entity"], batch["written"].fillna(_OLDEST), strict=True):
                seen += 1
                if (w, v or "") > (written, value or "") or value is None:
                    value, entity, written = v, e, int(w)
        self.entry.update((value, entity, written, seen))
        if (value, entity, written) != before:
            yield pd.DataFrame({"token": [key[0]], "value": [value], "entity": [entity], "written": [written], "seen": [seen]})

    def close(self) -> None:
        pass


def changes(entries: DataFrame) -> DataFrame:
    """Changed vault rows of a stream of (token, value, entity, written)."""
    keyed = entries.where("token IS NOT NULL").groupBy("token")
    return keyed.transformWithStateInPandas(Vault(), CHANGES, "append", "None")


def start(entries: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append changes under ``path``; read all that is there, then stop."""
    for name, value in SETTINGS.items():
        entries.sparkSession.conf.set(name, value)
    return changes(entries).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def current(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(token, value, entity, written, seen) of the last committed batch."""
    state = spark.read.format("statestore").option("stateVarName", "entry").load(checkpoint)
    return state.select(F.col("key.token").alias("token"), "value.value", "value.entity", "value.written", "value.seen")
