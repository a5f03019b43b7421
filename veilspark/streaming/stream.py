"""The exact anonymizer over a streaming frame, with the kernel of each shard in the state store."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..config import AnonymizerConfig
from ..schema import StreamSchema
from ..shared import workspace
from .batch import frame, output_schema
from .kernel import Anonymizer

#: A row with this sequence ends its shard: what waits is published.
END = -1


class ShardProcessor(StatefulProcessor):
    """Keeps a shard's open groups; the rows of a batch are put in order before they are taken, late rows are passed on as such."""

    def __init__(self, schema: StreamSchema, cfg: AnonymizerConfig, shard: str):
        self.schema, self.cfg, self.shard = schema, cfg, shard

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("kernel", "data binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kernel = pickle.loads(bytes(self.state.get()[0])) if self.state.exists() else Anonymizer(self.schema, self.cfg, str(key[0]))
        batch = pd.concat(list(rows)).sort_values(self.schema.seq, kind="stable")  # a shard's rows of one micro-batch
        columns = [self.schema.seq, *(a.name for a in self.schema.quasi), self.schema.sensitive.name]
        out, ends = [], False
        for seq, *values, sensitive in batch[columns].itertuples(index=False, name=None):
            if seq == END:
                ends = True
            else:
                out += [(key[0], x) for x in kernel.step(int(seq), tuple(values), sensitive)]
        if ends:
            out += [(key[0], x) for x in kernel.flush()]
        self.state.update((pickle.dumps(kernel),))
        yield frame(out, self.schema, self.shard)

    def close(self) -> None:
        pass


def anonymize_stream(df: DataFrame, schema: StreamSchema, cfg: AnonymizerConfig, shard: str) -> DataFrame:
    """A streaming frame of published pairs; needs the RocksDB state store provider. Rows with the sequence END flush their shard."""
    keyed = df.withColumn(shard, df[shard].cast("string"))
    return keyed.groupBy(shard).transformWithStateInPandas(ShardProcessor(schema, cfg, shard), output_schema(schema, shard), "Append", "None")


def replay(df: DataFrame, schema: StreamSchema, cfg: AnonymizerConfig, shard: str, parts: int = 2) -> DataFrame:
    """Feeds a batch frame through the streaming form in ``parts`` runs, each from the checkpoint of the one before, ended by a row that flushes each
    shard; returns the published rows. The parts follow the sequence, cut at quantiles of it."""
    spark = df.sparkSession.newSession()
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    folder = workspace(df.sparkSession, "stream")
    rows = df.select(F.col(shard).cast("string").alias(shard), schema.seq, *[a.name for a in schema.quasi], schema.sensitive.name)
    cuts = rows.approxQuantile(schema.seq, [i / parts for i in range(1, parts)], 0.01) if parts > 1 else []
    edges = [None, *cuts, None]
    for lo, hi in zip(edges, edges[1:]):
        part = rows
        if lo is not None:
            part = part.where(F.col(schema.seq) > lo)
        if hi is not None:
            part = part.where(F.col(schema.seq) <= hi)
        else:
            ends = rows.select(shard).distinct().select(shard, F.lit(END).cast(rows.schema[schema.seq].dataType).alias(schema.seq), *[F.lit(None).cast(rows.schema[n].dataType).alias(n) for n in rows.columns[2:]])
            part = part.unionByName(ends)
        part.write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
        query = anonymize_stream(stream, schema, cfg, shard).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint")
        query.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.parquet(f"{folder}/out")
