"""Word shingles, classes of equal sets and dealing of hot rows, for the operators that compare sets of shingles."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.base import written
from gridloom.llm.components import components

U = np.uint64
ASCII_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a permutation of 64-bit numbers."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Shingler:
    """Sets of 64-bit shingle hashes; remembers the hashes of words up to a bound."""

    def __init__(self, width: int, remembered: int = 100_000):
        self.width, self.remembered, self.known = width, remembered, {}

    def set_of(self, text: str | None) -> np.ndarray:
        """The sorted distinct shingles of a text."""
        found = (text or "").encode().translate(ASCII_LOWER).split()  # bytes split at the six ASCII spaces
        if not found:
            return np.empty(0, U)
        known = self.known
        if len(known) > self.remembered:
            known.clear()
        for w in set(found).difference(known):
            known[w] = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
        h = np.fromiter(map(known.__getitem__, found), U, len(found))
        n = min(self.width, len(h))
        size = len(h) - n + 1
        out = np.full(size, n, U)
        for k in range(n):
            out = mixed(out * U(0x9E3779B97F4A7C15) + h[k : k + size])
        out.sort()
        return out[np.append(True, out[1:] != out[:-1])]


def prefix_size(size: int, percent: int) -> int:
    """Of how many first shingles, in any one order of all, a set shares at least one with every set that it links with."""
    return size - -(-percent * size // 100) + 1


def hashed(column: str, salt: int) -> Column:
    """A hash of a column between 0 and 1."""
    return F.shiftrightunsigned(F.xxhash64(column, F.lit(salt)), 1) / F.lit(float(1 << 63))


def copies(rows: DataFrame, n: str, name: str, wide: int = 32) -> DataFrame:
    """Each row `n` times, numbered: first a row for each stretch of numbers, dealt anew, then the stretch's rows, so that no
    task makes or reads all copies of a row that many blocks need."""
    stretch = rows.withColumn("stretch", F.explode(F.sequence(F.lit(0), F.floor((F.col(n) - 1) / wide).cast("int"))))
    dealt = stretch.repartition("doc_id", "stretch")
    last = F.least(F.col(n) - 1, F.col("stretch") * wide + (wide - 1))
    return dealt.withColumn(name, F.explode(F.sequence(F.col("stretch") * wide, last.cast("int")))).drop("stretch")


named: Callable[..., Column] = lambda *c: F.concat_ws(":", *c)


def equal_sets(rows: DataFrame) -> DataFrame:
    """(doc_id, rep) of rows (doc_id, fingerprint): every document belongs to the class of its set, named by its smallest id; an id
    with several sets has a row for each, which ties their classes together."""
    # a table of its own, so that the join below is free to split a fingerprint that many rows share
    classes = written(rows.where("fingerprint is not null and doc_id is not null").groupBy("fingerprint").agg(F.min("doc_id").alias("rep")))
    owned = rows.where("doc_id is not null").join(classes, "fingerprint", "left").select("doc_id", F.coalesce("rep", "doc_id").alias("rep"))
    return written(owned.distinct())


def grouped(rows: DataFrame, owned: DataFrame, found: DataFrame) -> DataFrame:
    """Each of rows (doc_id, n_shingles) with component_id and kept, of the links (u, v) found and the classes of equal sets."""
    ties = owned.where("doc_id != rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    groups = components(found.unionByName(ties))
    named = rows.select("doc_id", "n_shingles").join(groups.select(F.col("node").alias("doc_id"), F.col("root").alias("found")), "doc_id", "left")
    component = F.coalesce("found", "doc_id")
    return named.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
