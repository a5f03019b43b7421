"""The exact anonymizer over a batch frame: each shard is a stream of its own."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import AnonymizerConfig
from ..operators.ordering import dealt
from ..schema import NUMERIC, StreamSchema
from .kernel import Anonymizer, listed


def output_schema(schema: StreamSchema, shard: str) -> str:
    kinds = ", ".join(f"`anon_{a.name}` {'string' if a.kind != NUMERIC else 'bigint' if a.discrete else 'double'}" for a in schema.quasi)
    return f"`{shard}` string, seq bigint, publish_time bigint, pub_seq bigint, cluster bigint, status int, {kinds}"


def output_names(schema: StreamSchema, shard: str) -> list[str]:
    return [shard, "seq", "publish_time", "pub_seq", "cluster", "status", *(f"anon_{a.name}" for a in schema.quasi)]


def frame(rows: list[tuple], schema: StreamSchema, shard: str) -> pd.DataFrame:
    """Whole numbers stay whole where a late row has nulls."""
    out = pd.DataFrame([(s, *r[:5], *r[5]) for s, r in rows], columns=output_names(schema, shard))
    whole = ["seq", "publish_time", "pub_seq", "cluster", "status", *(f"anon_{a.name}" for a in schema.quasi if a.kind == NUMERIC and a.discrete)]
    return out.astype({c: "Int64" for c in whole})


def batch(made: list[tuple[str, list[tuple], list]], schema: StreamSchema, shard: str) -> pa.RecordBatch:
    """The same from (shard, rows of it, their shown values by attribute), column by column."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), *(pa.string() if a.kind != NUMERIC else pa.int64() if a.discrete else pa.float64() for a in schema.quasi)]
    rows = [r for _, some, _ in made for r in some]
    facts = list(zip(*rows))[:5] or [()] * 5
    shown = [made[0][2][i] if len(made) == 1 else [v for _, _, x in made for v in listed(x[i])] for i in range(len(schema.quasi))]
    shards = pa.repeat(pa.scalar(made[0][0], pa.string()), len(rows)) if len(made) == 1 else pa.array([s for s, some, _ in made for _ in some], pa.string())
    return pa.RecordBatch.from_arrays([shards, *(pa.array(c, k) for c, k in zip([*facts, *shown], kinds))], output_names(schema, shard))


def anonymize(df: DataFrame, schema: StreamSchema, cfg: AnonymizerConfig | Callable[[str], AnonymizerConfig], shard: str) -> DataFrame:
    """Shards are dealt by size and arrive in order, so a task holds the open groups of one shard and one batch of rows, never a whole
    shard. All of a shard is one sequence by definition; its guarantees are its own. ``cfg`` may depend on the shard."""
    columns = [shard, schema.seq, *(a.name for a in schema.quasi), schema.sensitive.name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, kernel = None, None
        for rows in batches:
            out = []  # (shard, its rows, what they show) of every shard in this batch
            runs = pc.run_end_encode(rows.columns[0], run_end_type=pa.int64())
            seqs, *values, sensitives = [c.to_pandas().tolist() for c in rows.columns[1:]]
            records, begin = zip(map(int, seqs), zip(*values), sensitives), 0
            for s, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist()):
                if kernel is None or s != current:
                    if kernel is not None:
                        ended = kernel.flush()
                        out.append((current, ended, kernel.shown(ended)))
                    current, kernel = s, Anonymizer(schema, cfg(s) if callable(cfg) else cfg, str(s), late=True)
                step, made = kernel.step, []
                for seq, x, sensitive in islice(records, end - begin):
                    made += step(seq, x, sensitive)
                out.append((s, made, kernel.shown(made)))
                begin = end
            if out:
                yield batch(out, schema, shard)
        if kernel is not None:
            ended = kernel.flush()
            yield batch([(current, ended, kernel.shown(ended))], schema, shard)

    rows = df.select(df[shard].cast("string").alias(shard), *columns[1:])
    return dealt(rows, shard, schema.seq).mapInArrow(run, output_schema(schema, shard))


def anonymize_runs(df: DataFrame, schema: StreamSchema, runs: dict[str, AnonymizerConfig], shard: str) -> DataFrame:
    """Every run of a sweep in one job: a shard of a run is a stream of its own. The rows of ``anonymize``, led by run_id, which must hold no bar."""
    whole = df.withColumn("run_id", F.explode(F.array(*[F.lit(r) for r in runs]))).withColumn(shard, F.concat_ws("|", "run_id", F.col(shard).cast("string")))
    out = anonymize(whole, schema, lambda s: runs[s.split("|", 1)[0]], shard)
    return out.select(F.split_part(shard, F.lit("|"), F.lit(1)).alias("run_id"), F.expr(f"substring(`{shard}`, locate('|', `{shard}`) + 1)").alias(shard), *[F.col(f"`{c}`") for c in out.columns if c != shard])
