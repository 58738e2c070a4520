"""Rows known by the file they stand in and their place there, so that texts need no shuffle.

Values for some of the rows are gathered into one map per block of rows of a file, and every
task looks its rows up while it reads them. At most ``MOST`` bytes of maps are broadcast at
once; more of them are looked up file group by file group, and each pass reads only its own
files. Beyond ``MOST_PASSES`` passes the rows are shuffled by file and block instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusengine.session import materialize, scratch_scope

BLOCK = 1024
MOST, MOST_PASSES = 1 << 25, 16


def place_columns(docs: DataFrame) -> tuple[str, str]:
    """Names for the file (a 64-bit hash of its path) and the place in it that ``docs`` doesn't use."""
    lead = "_"
    while {f"{lead}file", f"{lead}place"} & set(docs.columns):
        lead += "_"
    return f"{lead}file", f"{lead}place"


def located(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``docs`` as read from files, and the same with the columns of ``place_columns``.

    What does not come straight from Parquet files is written first.
    """
    file, place = place_columns(docs)

    def mark(df: DataFrame) -> DataFrame:
        at = df.metadataColumn("_metadata")
        return df.withColumns({file: F.xxhash64(at["file_path"]), place: at["row_index"]})

    try:
        return docs, mark(docs)
    except AnalysisException:
        docs = materialize(docs, keep=True)
        return docs, mark(docs)


def in_blocks(entries: DataFrame) -> DataFrame:
    """(file, block, values: map of place in the block to value) of ``entries``, whose columns are file, place and value."""
    file, place, value = entries.columns
    entry = F.struct((F.col(place) % BLOCK).cast("int"), F.col(value))
    return entries.groupBy(file, F.floor(F.col(place) / BLOCK).alias("_block")).agg(F.map_from_entries(F.collect_list(entry)).alias("_values"))


def look_up(marked: DataFrame, at: tuple[str, str], blocks: DataFrame, name: str, value_bytes: int = 8) -> DataFrame:
    """``marked`` (whose columns ``at`` are file and place) with the column ``name``: the value of ``in_blocks``, else null."""
    file, place = at
    marked = marked.withColumn("_block", F.floor(F.col(place) / BLOCK))
    size = blocks.agg(F.sum(F.size("_values") * (value_bytes + 4) + 64)).first()[0] or 0
    passes = -(-size // MOST) or 1
    near = F.broadcast if passes <= MOST_PASSES else (lambda df: df)
    passes = passes if passes <= MOST_PASSES else 1
    out = None
    for k in range(passes):
        of_pass = (lambda df, k=k: df.filter(F.pmod(file, F.lit(passes)) == k)) if passes > 1 else (lambda df: df)
        met = of_pass(marked).join(near(of_pass(blocks)), [file, "_block"], "left")
        part = met.withColumn(name, F.element_at("_values", (F.col(place) % BLOCK).cast("int"))).drop("_values", "_block")
        out = part if out is None else out.unionByName(part)
    return out


def decide(docs: DataFrame, verdict: Callable[[DataFrame, tuple[str, str]], DataFrame]) -> DataFrame:
    """``docs`` by the verdicts of ``verdict(marked docs, (file, place))``: these two columns and ``copies``.

    A row with 0 copies goes, others are returned as often as their copies say, all columns as they
    were. Only copies other than 1 are looked up. The verdict's scratch tables are deleted.
    """
    docs, marked = located(docs)
    file, place = place_columns(docs)
    with scratch_scope(docs.sparkSession):
        odd = verdict(marked, (file, place)).filter("copies <> 1").select(file, place, F.col("copies").cast("int"))
        odd = materialize(in_blocks(odd), keep=True)
    met = look_up(marked, (file, place), odd, "_copies", 4).withColumn("_copies", F.coalesce("_copies", F.lit(1))).filter("_copies > 0")
    return met.select(*docs.columns, F.explode(F.sequence(F.lit(1), "_copies")).alias("_copy")).drop("_copy")
