"""Exact duplicates by composable polynomial fingerprints and chunkwise comparison.

Texts are equal when they are identical after every run of white space has been
replaced by one space. A text's fingerprint is its length and the polynomial
sum(byte[i] * base^(n-1-i)) modulo 2^31-1 for two bases. It composes:
H(AB) = H(A) * base^|B| + H(B). Chunks of a text are hashed on their own, and
those of huge texts by tasks of their own. Texts with equal fingerprints are
compared with the text of the smallest doc_id, chunk by chunk; those that differ
after all form groups of their own, until none is left.

Defined cases: a null text is an empty one. A null doc_id comes after all
others. Of repeated rows (same doc_id and text) one is kept. An empty table
gives an empty result. Other columns of the input are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .spans import SPACE
from .tables import SALTS, salted_left_join, text_of

MODULUS = 2**31 - 1
BASES = (1_103_515_245, 1_664_525_027)
CHUNK_BYTES = 1 << 18
HUGE_BYTES = 1 << 25
SPACE_RUN = r"[\x20\x09-\x0D]+"

# hash for either base, length, begins with a space, ends with a space
Part = tuple[int, int, int, bool, bool]
EMPTY: Part = (0, 0, 0, False, False)
_powers: dict[int, np.ndarray] = {}


def collapse(data: np.ndarray) -> np.ndarray:
    """Bytes with each run of white space replaced by one space."""
    space = SPACE[data]
    keep = ~space
    keep[1:] |= ~space[:-1]
    if len(data):
        keep[0] = True
    out = np.where(space, np.uint8(32), data)
    return out[keep]


def _power(base: int, n: int) -> np.ndarray:
    if base not in _powers or len(_powers[base]) < n:
        out = np.ones(1, np.uint64)
        while len(out) < n:
            step = np.uint64(pow(base, len(out), MODULUS))
            out = np.concatenate([out, out * step % np.uint64(MODULUS)])
        _powers[base] = out
    return _powers[base]


def chunk_part(raw: np.ndarray) -> Part:
    """The fingerprint of one chunk of raw bytes."""
    data = collapse(raw)
    n = len(data)
    if n == 0:
        return EMPTY
    values = data.astype(np.uint64)[::-1]
    h = [int((values * _power(b, n)[:n]).sum() % np.uint64(MODULUS)) for b in BASES]
    return h[0], h[1], n, bool(data[0] == 32), bool(data[-1] == 32)


def join_parts(a: Part, b: Part) -> Part:
    """Fingerprint of the text of ``a`` followed by that of ``b``; a run of white space may span both."""
    if not a[2] or not b[2]:
        return a if a[2] else b
    ha, hb, n = list(a[:2]), list(b[:2]), b[2]
    if a[4] and b[3]:
        hb = [(h - 32 * pow(base, n - 1, MODULUS)) % MODULUS for h, base in zip(hb, BASES)]
        n -= 1
    joined = [(x * pow(base, n, MODULUS) + y) % MODULUS for x, y, base in zip(ha, hb, BASES)]
    return joined[0], joined[1], a[2] + n, a[3], b[4]


def fingerprint(raw: np.ndarray, chunk: int = CHUNK_BYTES) -> Part:
    part = EMPTY
    for i in range(0, len(raw), chunk):
        part = join_parts(part, chunk_part(raw[i:i + chunk]))
    return part


def _sha256(raw: bytes) -> str:
    words = raw.split()
    if raw and SPACE[raw[0]]:
        words.insert(0, b"")
    if raw and SPACE[raw[-1]]:
        words.append(b"")
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _print_rows(chunk: int, modulus: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"high": [], "low": [], "length": [], "sha": []}
            for raw in batch.column(1).cast(pa.large_binary()).to_pylist():
                a, b, n, _, _ = fingerprint(np.frombuffer(raw, np.uint8), chunk)
                for key, value in zip(out, (a % modulus, b % modulus, n, _sha256(raw))):
                    out[key].append(value)
            yield pa.record_batch([batch.column(0), *[pa.array(v, t) for v, t in zip(
                out.values(), (pa.int64(), pa.int64(), pa.int64(), pa.string()))]],
                names=["doc_id", *out])
    return run


def _part_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = [chunk_part(np.frombuffer(x, np.uint8)) for x in batch.column("raw").to_pylist()]
        columns = list(zip(*parts)) if parts else [[]] * 5
        yield pa.record_batch(
            [batch.column(i) for i in range(4)]
            + [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()))],
            names=["row", "doc_id", "sha", "chunk", "a", "b", "n", "first", "last"])


def _combine_rows(modulus: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("chunk")
        part = EMPTY
        for values in zip(*[table.column(c).to_pylist() for c in ("a", "b", "n", "first", "last")]):
            part = join_parts(part, values)
        head = table.slice(0, 1)
        return pa.table({"doc_id": head.column("doc_id"), "high": pa.array([part[0] % modulus], pa.int64()),
                         "low": pa.array([part[1] % modulus], pa.int64()),
                         "length": pa.array([part[2]], pa.int64()), "sha": head.column("sha")})
    return run


def normalised(text) -> F.Column:
    return F.regexp_replace(text, SPACE_RUN, " ")


def fingerprints(docs: DataFrame, chunk: int = CHUNK_BYTES, huge: int = HUGE_BYTES,
                 modulus: int = MODULUS) -> DataFrame:
    """One row per document: doc_id, fingerprint (high, low, length) and sha of the normalised text.

    Texts over ``huge`` bytes are cut into chunk rows that any task may hash;
    their hashes meet again as a few numbers per chunk.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text"))
    kind = "doc_id long, high long, low long, length long, sha string"
    plain = rows.where(F.octet_length("text") <= huge).mapInArrow(_print_rows(chunk, modulus), kind)
    cut = (rows.where(F.octet_length("text") > huge)
           .withColumn("row", F.monotonically_increasing_id())
           .withColumn("sha", F.sha2(F.encode(normalised(F.col("text")), "utf-8"), 256))
           .withColumn("raw", F.encode("text", "utf-8"))
           .select("row", "doc_id", "sha", "raw",
                   F.explode(F.sequence(F.lit(0), F.expr(f"(octet_length(raw) - 1) div {chunk}").cast("int")))
                   .alias("chunk"))
           .select("row", "doc_id", "sha", "chunk",
                   F.expr(f"substring(raw, chunk * {chunk} + 1, {chunk})").alias("raw"))
           .repartition("row", "chunk"))
    parts = cut.mapInArrow(_part_rows, "row long, doc_id long, sha string, chunk int, a long, b long, n long, "
                                       "first boolean, last boolean")
    return plain.unionByName(parts.groupBy("row").applyInArrow(_combine_rows(modulus), kind))


def _differing(docs: DataFrame, members: DataFrame, chunk: int) -> DataFrame:
    """The members (key, sha, print, head_key, head_sha) whose text is not that of their head.

    Only chunk rows meet: a member's with the same chunk of its head. A head's
    chunks are repeated once per salt, so that a hot group is spread.
    """
    wanted = (members.select("key", "sha")
              .union(members.select("head_key", "head_sha")).distinct())
    chunks = written(
        docs.select(_key(F.col("doc_id")).alias("key"), text_of(docs).alias("text"))
        .join(wanted, "key")
        .withColumn("raw", F.encode(normalised(F.col("text")), "utf-8"))
        .where(F.sha2("raw", 256) == F.col("sha"))
        .select("key", "sha", "raw", F.explode(F.sequence(
            F.lit(0), F.expr(f"greatest(octet_length(raw) - 1, 0) div {chunk}").cast("int"))).alias("chunk"))
        .select("key", "sha", "chunk", F.expr(f"substring(raw, chunk * {chunk} + 1, {chunk})").alias("raw")))
    salt = F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")
    own = members.join(chunks, ["key", "sha"]).withColumn("salt", salt)
    heads = (members.select("print", F.col("head_key").alias("key"), F.col("head_sha").alias("sha")).distinct()
             .join(chunks, ["key", "sha"])
             .select("print", "chunk", F.col("raw").alias("head_raw"),
                     F.explode(F.array(*[F.lit(i) for i in range(SALTS)])).alias("salt")))
    return (own.join(heads, ["print", "chunk", "salt"], "left")
            .groupBy("key", "sha", "print")
            .agg(F.min(F.coalesce(F.col("raw") == F.col("head_raw"), F.lit(False))).alias("same"))
            .where(~F.col("same")).drop("same"))


def _key(doc_id: F.Column) -> F.Column:
    return F.coalesce(doc_id.cast("string"), F.lit(""))


def _groups(prints: DataFrame) -> DataFrame:
    head = F.struct(F.col("doc_id").isNull(), "doc_id", "row", "sha")
    return (prints.groupBy("print").agg(F.count("*").alias("n"), F.min(head).alias("head"))
            .where("n > 1"))


def duplicate_groups(docs: DataFrame, chunk: int = CHUNK_BYTES, huge: int = HUGE_BYTES,
                     modulus: int = MODULUS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    ``modulus`` is lowered only in tests, to make fingerprints collide.
    """
    prints = written(fingerprints(docs, chunk, huge, modulus).select(
        "doc_id", "sha", F.concat_ws(":", "high", "low", "length").alias("print"),
        F.monotonically_increasing_id().alias("row")))
    turn = 0
    while True:
        grouped = salted_left_join(prints, _groups(prints), "print", F.col("row"))
        members = (grouped.where("head is not null")
                   .select(_key(F.col("doc_id")).alias("key"), "sha", "print",
                           _key(F.col("head.doc_id")).alias("head_key"), F.col("head.sha").alias("head_sha"))
                   .where("key != head_key or sha != head_sha").distinct())
        differ = written(_differing(docs, written(members), chunk))
        if differ.isEmpty():
            break
        turn += 1
        moved = differ.withColumn("moved", F.lit(True))
        prints = written(
            prints.withColumn("key", _key(F.col("doc_id"))).join(moved, ["key", "sha", "print"], "left")
            .select("doc_id", "sha", F.when(F.col("moved"), F.concat("print", F.lit(f"/{turn}")))
                    .otherwise(F.col("print")).alias("print"), "row"))
    single = F.col("head").isNull()
    return grouped.select(
        "doc_id", F.when(single, F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (single | (F.col("head.row") == F.col("row"))).alias("kept"), F.col("sha").alias("text_sha256"))


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """The documents that stay, all columns; of rows with the same doc_id and text one stays."""
    text = F.sha2(F.encode(normalised(text_of(docs)), "utf-8"), 256)
    kept = (duplicate_groups(docs).where("kept")
            .select(_key(F.col("doc_id")).alias("key"), F.col("text_sha256").alias("sha")))
    # the document in a struct of its own: its columns may have any names
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), _key(docs["doc_id"]).alias("key"),
                       text.alias("sha"))
    # repeated rows share key and hash: the smallest survives, without a sort of the texts
    return rows.join(kept, ["key", "sha"], "left_semi").dropDuplicates(["key", "sha"]).select("doc.*")
