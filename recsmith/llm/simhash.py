"""Operator 2: SimHash near-duplicates by meet-in-the-middle ball hashing."""

from __future__ import annotations

import uuid
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, map_texts
from .components import components

#: Shingles hashed at a time.
BLOCK = 1 << 16


def fingerprint(text: str, shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of the ASCII-lower-cased words' shingles, repeats counted.

    A text of fewer words than ``shingle`` is one shingle; without words it is zero.
    """
    import xxhash

    words = text.encode().lower().split()  # bytes: A-Z only, and white space is exactly [ \t-\r]
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    digest, counts = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        part = words[at : at + BLOCK + shingle - 1]
        grams = [b" ".join(part)] if n == 1 else map(b" ".join, zip(*(part[i:] for i in range(shingle))))
        data = b"".join([digest(g, seed) for g in grams])
        counts += np.unpackbits(np.frombuffer(data, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def simhash(df: DataFrame, shingle: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp`` with the fingerprint as a signed 64-bit number (one pass, no shuffle)."""

    def run(ids: list, texts: list[str]) -> dict:
        got = np.array([fingerprint(t, shingle, seed) for t in texts], np.uint64)
        return {"doc_id": ids, "fp": got.view(np.int64)}

    return map_texts(df, run, "doc_id bigint, fp bigint", id_col, text_col)


def ball_links(fingerprints: DataFrame, max_bits: int = 2, col: str = "fp") -> DataFrame:
    """Links ``a, b`` that connect all fingerprints differing in at most ``max_bits`` bits.

    ``fingerprints`` are distinct.  Each emits every variant within half the distance;
    two of them lie within ``max_bits`` exactly when they share a variant.  A variant is
    shared by no more fingerprints than the ball holds, and all of those are within
    ``max_bits`` of each other, so each is linked to the smallest: connections stay whole
    without all pairs.  Links are deduplicated and verified by their bit count.
    """
    if max_bits < 0 or max_bits % 2:
        raise ValueError("max_bits must be even and not negative")
    masks = [sum(1 << i for i in c) for k in range(max_bits // 2 + 1) for c in combinations(range(64), k)]
    flips = F.array(*[F.lit(m - (1 << 64) if m >= 1 << 63 else m).cast("bigint") for m in masks])
    variants = fingerprints.select(F.col(col).alias("b"), F.explode(flips).alias("_mask")).select("b", F.col("b").bitwiseXOR(F.col("_mask")).alias("v"))
    low = variants.selectExpr("b", "min(b) over (partition by v) as a")
    pairs = low.where("a < b").select("a", "b").distinct()
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)


def simhash_components(
    df: DataFrame, shingle: int = 3, max_bits: int = 2, seed: int = 42, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Near-duplicate classes of all documents: ``doc_id, fingerprint, component_id``.

    Texts are read once; from there only (id, fingerprint) rows move.  Equal fingerprints
    collapse by a partial aggregate before any search, so thousands of copies are one
    node; ball hashing and components run on distinct fingerprints.  The final join on
    the fingerprint is a plain equi-join whose hot keys Spark splits.

    ``component_id`` is the smallest id reachable over links, the row's own included.
    Null texts are empty; texts without words have fingerprint zero and link like any
    other.  Rows with a null id take no part in links of others' classes: they get their
    fingerprint and a null ``component_id``.  Repeated rows each give a row.  An empty
    table gives no rows; other columns are ignored.
    """
    out = _classes(df, shingle, max_bits, seed, id_col, text_col)
    return out.select(
        "doc_id",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"),
    )


def _classes(df: DataFrame, shingle: int, max_bits: int, seed: int, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, fp, root, component_id`` of every row: the class by its smallest fingerprint and by its smallest id."""
    prints = cut_lineage(simhash(df, shingle, seed, id_col, text_col))
    nodes = cut_lineage(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = components(ball_links(nodes, max_bits))
    classes = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    smallest = classes.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = classes.join(smallest, "root").select(F.col("fp").alias("_node"), "root", "component_id")
    return prints.join(named, prints["fp"] == named["_node"], "left").drop("_node")


def near_dedup(
    df: DataFrame, shingle: int = 3, max_bits: int = 2, seed: int = 42, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Keep one row (of the smallest id) of each near-duplicate class, all columns as given.

    Only the ids to drop are joined to the documents.  Rows that repeat an id are told
    apart by their texts: each belongs to its own text's class, and of those that share class and
    smallest id the one with the smallest fingerprint stays (then by the row's content), so no text is lost
    whose class has no other row.  Rows with a null id cannot be named and all stay.  Columns may have
    any name and type.  An empty table gives no rows.
    """
    classes = cut_lineage(_classes(df, shingle, max_bits, seed, id_col, text_col))
    # names that no column of the input has
    again, gone, fp, root, best, turn = (f"_{uuid.uuid4().hex}" for _ in range(6))
    named = F.col(f"`{id_col}`").cast("bigint")
    repeated = classes.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias(again))
    several = not repeated.isEmpty()
    dropped = classes.where("component_id != doc_id").select(F.col("doc_id").alias(gone)).distinct()
    if not several:
        return df.join(dropped, named == F.col(gone), "left_anti")
    repeated = cut_lineage(repeated)
    single = df.join(repeated, named == F.col(again), "left_anti").join(dropped, named == F.col(gone), "left_anti")

    @F.pandas_udf("bigint")
    def print_of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t or "", shingle, seed) for t in texts], np.uint64).view(np.int64))

    # only rows whose id repeats are hashed again, with their columns
    rows = df.join(repeated, named == F.col(again), "left_semi").withColumn(fp, print_of(F.col(f"`{text_col}`").cast("string")))
    of = classes.select(F.col("fp").alias(again), F.col("root").alias(root), F.col("component_id").alias(best)).distinct()
    rows = rows.join(of, F.col(fp) == F.col(again)).where(named == F.col(best))
    content = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))
    first = Window.partitionBy(best, root).orderBy(fp, F.xxhash64(content))  # Spark keeps each task's first row only
    rows = rows.withColumn(turn, F.row_number().over(first)).where(F.col(turn) == 1)
    return single.unionByName(rows.select(*[F.col(f"`{c}`") for c in df.columns]))
