"""Token counts of whole texts by a compiled finite-state tokenizer."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumaframe.llm.shingles import text_slices
from lumaframe.llm.transducer import ChunkMap, Machine, Transducer, scan

#: Characters in a chunk, about, and chunk maps that one step of the scan composes.
CHUNK_CHARS, FAN = 1 << 16, 256
_MAP = "uid long, k long, id {0}, n_bytes long, head string, reset boolean, count long, exit binary"


@lru_cache(maxsize=2)
def machine_of(path: str) -> Machine:
    return Machine(Transducer(path))


def count_tokens(text: str, machine: Machine, chunk_chars: int = CHUNK_CHARS) -> int:
    """The state maps of a text's chunks compose to the text's."""
    return scan([machine.map_of(piece) for piece in machine.cut(text, chunk_chars)], machine).total(machine)


def _count(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    machine = machine_of(path)
    for batch in batches:
        for part in text_slices(batch, "text"):
            found = [machine.map_of(t).total(machine) if t else 0 for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("n_bytes"), pa.array(found, pa.int64())], names=["id", "n_bytes", "n_tokens"])


def _cut(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Long texts as rows of chunks."""
    machine = machine_of(path)
    for batch in batches:
        for n in range(batch.num_rows):
            pieces = machine.cut(batch.column("text")[n].as_py(), CHUNK_CHARS)
            for at in range(0, len(pieces), 64):
                some = pieces[at : at + 64]
                same = [pa.array([batch.column(c)[n].as_py()] * len(some), batch.schema.field(c).type) for c in ("uid", "id", "n_bytes")]
                yield pa.RecordBatch.from_arrays([same[0], pa.array(range(at, at + len(some)), pa.int64()), *same[1:], pa.array(some, pa.string())], names=["uid", "k", "id", "n_bytes", "chunk"])


def _rows(maps: list[ChunkMap], uid: pa.Array, k: pa.Array, key: pa.Array, n_bytes: pa.Array) -> pa.RecordBatch:
    made = [pa.array([m.head for m in maps], pa.string()), pa.array([m.reset for m in maps], pa.bool_()), pa.array([m.count for m in maps], pa.int64()), pa.array([pickle.dumps(m.exit) for m in maps], pa.binary())]
    return pa.RecordBatch.from_arrays([uid, k, key, n_bytes, *made], names=["uid", "k", "id", "n_bytes", "head", "reset", "count", "exit"])


def _map(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    machine = machine_of(path)
    for batch in batches:
        for part in text_slices(batch, "chunk"):
            yield _rows([machine.map_of(c) for c in part.column("chunk").to_pylist()], *[part.column(c) for c in ("uid", "k", "id", "n_bytes")])


def _compose(batches: Iterator[pa.RecordBatch], path: str, fan: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by text and place: up to ``fan`` neighbours become one map."""
    machine = machine_of(path)
    types: dict[str, pa.DataType] = {}

    def typed(more: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in more:
            types.update({f.name: f.type for f in batch.schema})
            yield batch

    rows = (row for batch in typed(batches) for row in batch.to_pylist())
    for (uid, k), group in groupby(rows, key=lambda r: (r["uid"], r["k"] // fan)):
        held = list(group)
        maps = [ChunkMap(r["head"], r["reset"], r["count"], pickle.loads(r["exit"])) for r in held]
        yield _rows([scan(maps, machine)], *[pa.array([v], types[c]) for c, v in (("uid", uid), ("k", k), ("id", held[0]["id"]), ("n_bytes", held[0]["n_bytes"]))])


def _totals(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    machine = machine_of(path)
    for batch in batches:
        found = [ChunkMap(r["head"], r["reset"], r["count"], pickle.loads(r["exit"])).total(machine) for r in batch.to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_bytes"), pa.array(found, pa.int64())], names=["id", "n_bytes", "n_tokens"])


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", *, limit: int = 2048) -> DataFrame:
    """Bytes and tokens of each text under a tokenizer file (path on every executor), without added tokens.

    Returns one row for each row of ``docs``: id_col, n_bytes, n_tokens and
    over_limit. A null text counts as empty: 0 bytes, 0 tokens. Null or
    repeated ids and repeated rows are counted like any other; other columns
    are ignored. Texts of one chunk are counted where they are read. Longer
    ones are dealt out as chunks, and the chunks' maps compose in two steps of
    up to FAN neighbours each, more than a text can have chunks.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    counted, mapped = f"id {id_type}, n_bytes long, n_tokens long", _MAP.format(id_type)
    short = rows.where(F.char_length("text") <= CHUNK_CHARS).mapInArrow(partial(_count, path=tokenizer), counted)
    long = rows.where(F.char_length("text") > CHUNK_CHARS).withColumn("uid", F.monotonically_increasing_id())
    chunks = long.mapInArrow(partial(_cut, path=tokenizer), f"uid long, k long, id {id_type}, n_bytes long, chunk string")
    maps = chunks.repartition("uid", "k").mapInArrow(partial(_map, path=tokenizer), mapped)
    for _ in range(2):
        group = maps.repartition(F.col("uid"), F.expr(f"k div {FAN}")).sortWithinPartitions("uid", "k")
        maps = group.mapInArrow(partial(_compose, path=tokenizer, fan=FAN), mapped)
    found = short.union(maps.mapInArrow(partial(_totals, path=tokenizer), counted))
    return found.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
