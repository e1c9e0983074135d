"""What the text operators share: tables, batches, word forms, link components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Rows and bytes handed to a Python worker at once, so long texts cannot fill its memory.
BATCH_ROWS = 1000
BATCH_BYTES = 16 << 20

# 0-9, a-z and every byte of a non-ASCII character are parts of words; the rest separates.
_WORD_BYTES = bytes(
    b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Limit Arrow batches for this session by rows and bytes (never raises a lower limit)."""
    for key, most in (
        ("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS),
        ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES),
    ):
        now = spark.conf.get(key).strip("bB")  # some other unit means it was set by hand
        if now.lstrip("-").isdigit() and not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def as_bytes(column: str = "text") -> Column:
    """UTF-8 bytes of a text column; null counts as empty."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b"").cast("binary"))


def map_batches(
    df: DataFrame,
    make: Callable[[], Callable[[pa.RecordBatch], dict]],
    fields: dict[str, str],
    inputs: tuple[str, ...] = (),
) -> DataFrame:
    """``df`` with columns added batch by batch; same-named columns are replaced.

    ``make`` runs once per task and returns the function from a batch to the new
    columns (name -> Arrow array or list). ``inputs`` are read but not handed back;
    all other columns pass through as they are.
    """
    bounded_batches(df.sparkSession)
    kept = [f for f in df.schema.fields if f.name not in fields and f.name not in inputs]
    added = T.StructType.fromDDL(", ".join(f"`{n}` {t}" for n, t in fields.items()))
    names = [f.name for f in kept]
    types = {f.name: _arrow_type(f.dataType) for f in added.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            if not batch.num_rows:
                continue
            new = step(batch)
            columns = [batch.column(n) for n in names]
            for n, kind in types.items():
                column = new[n]
                columns.append(
                    column if isinstance(column, pa.Array) else pa.array(column, type=kind)
                )
            yield pa.RecordBatch.from_arrays(columns, names=[*names, *types])

    return df.mapInArrow(run, T.StructType([*kept, *added.fields]))


def _arrow_type(kind: T.DataType) -> pa.DataType:
    plain = {
        "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(),
        "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(),
    }
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow_type(kind.elementType))
    if isinstance(kind, T.StructType):
        return pa.struct([(f.name, _arrow_type(f.dataType)) for f in kind.fields])
    return plain[kind.simpleString()]


def with_bytes(
    df: DataFrame, text: str, keep: tuple[str, ...] | None, new: Iterable[str]
) -> DataFrame:
    """The columns to carry along (all by default, without those to be added) and ``__bytes``."""
    names = [c for c in (df.columns if keep is None else keep) if c not in set(new)]
    return df.select(*names, as_bytes(text).alias("__bytes"))


def byte_words(text: bytes) -> list[bytes]:
    """Words of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z."""
    return text.lower().translate(_WORD_BYTES).split()


def sql_words(column: Column) -> Column:
    """The same words joined by single blanks, as a column."""
    lowered = F.translate(F.coalesce(column, F.lit("")), UPPER, UPPER.lower())
    return F.trim(F.regexp_replace(lowered, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one the cluster names in ``spark.checkpoint.dir``."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if not named:
        named = spark.sparkContext.getCheckpointDir() or (
            spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
        )
    return f"{named.rstrip('/')}/llm-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder and read again: lineage ends here.

    A lost executor costs no earlier work, and rows read twice are the same twice.
    """
    return stored_at(df)[0]


def stored_at(df: DataFrame) -> tuple[DataFrame, str]:
    """``stored`` rows and their folder, for tables that are removed before the session ends."""
    path = shared_folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, *folders: str) -> None:
    """Remove stored tables that nothing reads any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node with an edge; root is the smallest node reachable.

    Alternating large-star and small-star steps (Kiveris et al. 2014): every round
    links neighbours to their smallest one, so the number of rounds is logarithmic
    and no component is ever gathered in one place. Rounds are written to the shared
    folder. Nulls and self-links are ignored; an empty input gives an empty result.
    """
    links, folder = stored_at(
        edges.where(f"{a} <> {b}")
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct()
    )
    before = None
    while True:
        state = links.agg(
            F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x")
        ).first()
        if state["n"] == 0 or state == before:
            break
        before = state
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.join(low, "u")
            .where("v > u and v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        links, following = stored_at(
            small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
            .distinct()
        )
        remove(edges.sparkSession, folder)
        folder = following
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def sorted_groups(
    batches: Iterable[pa.RecordBatch], key: str, least: int = 200_000
) -> Iterator[dict[str, np.ndarray]]:
    """Columns of a key-sorted partition in pieces of about ``least`` rows.

    A piece ends where the key changes, so the rows of a key always stay together.
    """
    held: list[pa.RecordBatch] = []
    rows = 0

    def columns(parts):
        joined = pa.Table.from_batches(parts).combine_chunks()
        return {n: joined.column(n).to_numpy() for n in joined.column_names}

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows >= least:
            keys = batch.column(batch.schema.get_field_index(key)).to_numpy()
            cut = int(np.searchsorted(keys, keys[-1]))
            if cut == 0:
                continue
            yield columns([*held[:-1], batch.slice(0, cut)])
            held, rows = [batch.slice(cut)], batch.num_rows - cut
    if rows:
        yield columns(held)
