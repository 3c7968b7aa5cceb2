"""SimHash fingerprints and their links within a Hamming distance, by pigeonring filtering.

A fingerprint is cut into ``SEGMENTS`` segments on a ring. If two fingerprints
differ in at most t bits, there is a segment from which every chain of l
consecutive segments differs in at most floor(l * t / SEGMENTS) bits. Chains of
budget 0 and 1 become join keys: the segments of budget 0 agree, and one half of
the segments of budget 1 agrees. Longer chains are checked on the pairs that
meet, and the full Hamming distance last.

Tasks give a spanning forest of the links inside one key, never all pairs. Keys
that hold more than ``BLOCK`` fingerprints are compared block against block in
tasks of their own; no pair is left out.

``near_groups`` is the query's contract: three words, 3 bits. ``drop_near_duplicates`` is
the pipeline's stage: five words and a Jaccard similarity of ``SIMILAR`` or more. There the same
pigeonring keys bring together texts whose fingerprints link at 3 bits. Other pairs that similar differ in
more bits than segments can be told apart by, so texts that share band keys of a min-hash signature meet
too; the ring filters all these candidates, and the texts decide.

Defined cases: null text is empty; a text without words has fingerprint zero,
which is linked like any other; null doc_ids never name a component unless the
component has no other; repeated rows share a fingerprint and a component (the
stage keeps all rows of the document that stays); long texts are hashed in the
row; other columns are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .components import components
from .spans import LOWER, mix, ragged, words
from .tables import salted_left_join, text_of

BITS = 64
DISTANCE = 3
SEGMENTS = 8
BLOCK = 4096
SEED = 42
# near copies of the pipeline: shingles of so many words, in common to at least this share
WORDS = 5
SIMILAR = 0.8
# differing bits of texts that similar: about 10 on average, three standard deviations more and a bit
WIDE = 20
WIDE_SEGMENTS = 16
# least hashes of a text; pairs whose sketches agree by less than LEAST_SHARE are not compared
SKETCH = 64
LEAST_SHARE = 0.625
# values per band key: at a Jaccard of 0.8, 16 bands of 4 miss one pair in 5,000
BAND = 4

_random = np.random.default_rng(20240603)
_FACTORS = _random.integers(1, 2**63, SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _random.integers(0, 2**63, SKETCH, dtype=np.uint64)


def _shingle_hashes(text: str, size: int) -> np.ndarray:
    """XXH64 of every word shingle, of all words if there are fewer; none if there is no word."""
    raw = np.frombuffer(text.encode(), np.uint8)
    starts, ends, _ = words(raw, np.array([0, len(raw)]))
    n = len(starts)
    if n == 0:
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    joined = b" ".join(LOWER[raw].tobytes().split())
    begin = np.cumsum(lengths + 1) - lengths - 1
    over = begin + lengths
    if n < size:
        firsts, lasts = [0], [len(joined)]
    else:
        firsts, lasts = begin[:n - size + 1].tolist(), over[size - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(firsts, lasts)), np.uint64, len(firsts))


def _majority(hashed: np.ndarray) -> int:
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashed), 1 << 16):
        bits = np.unpackbits(hashed[i:i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * ones > len(hashed)).tolist())


def fingerprint(text: str, size: int = 3) -> int:
    """Bit-wise majority of the XXH64 of all word shingles; 0 if there is no word."""
    return _majority(_shingle_hashes(text, size))


def _fingerprint_rows(size: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t, size) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.record_batch([batch.column(0), pa.array(prints.view(np.int64), pa.int64())],
                                  names=["doc_id", "print"])
    return run


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id and 64-bit fingerprint (as a signed number) of every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text"))
    return rows.mapInArrow(_fingerprint_rows(size), "doc_id long, print long")


def budgets(distance: int = DISTANCE, segments: int = SEGMENTS) -> list[int]:
    """The bits by which the chain of l + 1 segments may differ."""
    return [(length * distance) // segments for length in range(1, segments + 1)]


def ring_masks(distance: int = DISTANCE, segments: int = SEGMENTS) -> list[tuple[int, int]]:
    """The (start, mask) of each join key: a chain of budget 0 and one half of the chain up to budget 1."""
    width, spent = BITS // segments, budgets(distance, segments)
    sure = spent.count(0)
    if not sure:
        raise ValueError("more segments than differing bits are needed")
    more = spent.count(1) if distance > 1 else segments - sure
    more_bits = min(more, segments - sure) * width

    def ring(first: int, n: int) -> int:
        return sum(1 << ((first + i) % BITS) for i in range(n))

    keys = []
    for start in range(segments):
        at = start * width
        head, tail = ring(at, sure * width), at + sure * width
        half = more_bits // 2
        keys += [(start, head | ring(tail, half)), (start, head | ring(tail + half, more_bits - half))]
    return keys


def within_ring(differ: np.ndarray, start: int, distance: int = DISTANCE, segments: int = SEGMENTS) -> np.ndarray:
    """Whether the chains from ``start`` keep their budgets; the last of them is the Hamming distance."""
    width = BITS // segments
    turned = differ
    if start:
        turned = (differ >> np.uint64(start * width)) | (differ << np.uint64(BITS - start * width))
    good = np.ones(differ.shape, bool)
    for length, budget in enumerate(budgets(distance, segments), 1):
        mask = np.uint64((1 << min(BITS, length * width)) - 1)
        good &= np.bitwise_count(turned & mask) <= budget
    return good


def _forest(left: np.ndarray, right: np.ndarray, start: int, distance: int) -> list[tuple[int, int]]:
    """Links between two blocks of fingerprints (or inside one, if they are the same), as a spanning forest."""
    nodes = np.unique(np.concatenate([left, right]))
    parent = np.arange(len(nodes))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    at_left, at_right = np.searchsorted(nodes, left), np.searchsorted(nodes, right)
    found = []
    for i in range(len(left)):
        good = within_ring(left[i] ^ right, start, distance)
        for j in np.unique(parent[at_right[good]]):
            a, b = root(int(at_left[i])), root(int(j))
            if a != b:
                found.append((int(nodes[at_left[i]]), int(nodes[at_right[good][parent[at_right[good]] == j][0]])))
                parent[max(a, b)] = min(a, b)
    return found


def _link_rows(starts: list[int], distance: int):
    """Links among rows (task, mask, print, side) sorted by task; a task may span batches."""
    def links(prints: np.ndarray, sides: np.ndarray, mask: int) -> list[tuple[int, int]]:
        if len(prints) < 2:
            return []
        left, right = prints[sides != 1], prints[sides != 0]
        return _forest(left, right, starts[mask], distance)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None

        def emit(done: list[np.ndarray]):
            task, mask, prints, sides = done
            edges = []
            cut = np.flatnonzero(np.diff(task)) + 1
            for a, b in zip([0, *cut], [*cut, len(task)]):
                if b - a > 1:
                    edges += links(prints[a:b].view(np.uint64), sides[a:b], int(mask[a]))
            pairs = np.array(edges, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        for batch in batches:
            now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now)]
            if not len(now[0]):
                continue
            last = int(np.searchsorted(now[0], now[0][-1]))
            held = [x[last:] for x in now]
            yield emit([x[:last] for x in now])
        if held is not None:
            yield emit(held)
    return run


def links(prints: DataFrame, distance: int = DISTANCE, block: int = BLOCK, segments: int = SEGMENTS) -> DataFrame:
    """Spanning links (a, b) between distinct fingerprints (``print``) of at most ``distance`` differing bits."""
    keys = ring_masks(distance, segments)
    masks = F.array(*[F.lit(m - (1 << 64) if m >= 1 << 63 else m) for _, m in keys])
    keyed = (prints.select("print", F.posexplode(masks).alias("mask", "bits"))
             .select("print", "mask", F.xxhash64("mask", F.col("print").bitwiseAND(F.col("bits"))).alias("key")))
    counts = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = keyed.join(counts, "key")
    plain = met.where(f"n <= {block}").select(F.col("key").alias("task"), "mask", "print",
                                              F.lit(2).alias("side"))
    # a hot key: block i meets block j in a task of its own, for all i <= j
    hot = (met.where(f"n > {block}")
           .withColumn("blocks", F.expr(f"cast(ceil(n / {block}) as int)"))
           .withColumn("own", F.pmod(F.xxhash64("print"), F.col("blocks")).cast("int"))
           .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
           .select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("task"),
                   "mask", "print",
                   F.expr("case when own = other then 2 when own < other then 0 else 1 end").alias("side")))
    tasks = plain.unionByName(hot)
    return (tasks.repartition("task").sortWithinPartitions("task").select("task", "mask", "print", "side")
            .mapInArrow(_link_rows([s for s, _ in keys], distance), "a long, b long").distinct())


def near_groups(docs: DataFrame, size: int = 3, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable) of every document."""
    rows = written(fingerprints(docs, size))
    classes = written(rows.groupBy("print").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    joined = written(links(classes.select("print"), distance, block))
    linked = joined.select(F.col("a").alias("node")).union(joined.select("b")).distinct()
    # the fingerprint itself is the label: unique, and never null
    found = components(linked.withColumn("label", F.col("node")), joined)
    names = (found.join(classes, found["node"] == classes["print"])
             .groupBy("label").agg(F.min("least").alias("component_id")))
    of_print = found.join(names, "label").select(F.col("node").alias("print"), "component_id")
    wide = (classes.join(of_print, "print", "left")
            .where("n > 1 or component_id is not null")
            .select("print", F.coalesce("component_id", "least").alias("component_id")))
    return (salted_left_join(rows, wide, "print", F.col("doc_id"))
            .select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"),
                    F.coalesce("component_id", "doc_id").alias("component_id")))


def signature(hashed: np.ndarray) -> np.ndarray:
    """The least value of a text's distinct shingle hashes under each of ``SKETCH`` mixings."""
    least = np.full(SKETCH, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashed), 1 << 12):
        least = np.minimum(least, (hashed[i:i + (1 << 12), None] * _FACTORS + _SHIFTS).min(axis=0))
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    """One key for every ``BAND`` values; texts of Jaccard s share one with probability s^BAND."""
    keys = np.arange(1, SKETCH // BAND + 1, dtype=np.uint64)
    for part in least.reshape(-1, BAND).T:
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + part)
    return keys


_RINGS = np.array([m for _, m in ring_masks()], np.uint64)


def ring_keys(fingerprint: int) -> np.ndarray:
    """The pigeonring's join keys: fingerprints of at most ``DISTANCE`` differing bits share one."""
    places = np.arange(1, len(_RINGS) + 1, dtype=np.uint64) << np.uint64(32)
    return mix(mix(np.uint64(fingerprint) & _RINGS) + places)


def _sketch_rows(size: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, sizes, keys, sketches = [], [], [], []
            for text in batch.column(2).to_pylist():
                hashed = _shingle_hashes(text, size)
                distinct = np.unique(hashed)
                least = signature(distinct)
                prints.append(_majority(hashed))
                sizes.append(len(distinct))
                keys.append(np.concatenate([ring_keys(prints[-1]), band_keys(least)]).view(np.int64))
                sketches.append(mix(least).astype(np.uint8).tobytes())
            yield pa.record_batch([batch.column(0), batch.column(1),
                                   pa.array(np.array(prints, np.uint64).view(np.int64), pa.int64()),
                                   pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64())),
                                   pa.array(sketches, pa.binary())],
                                  names=["node", "doc_id", "print", "shingles", "keys", "sketch"])
    return run


def _sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, SKETCH)


def _ring(differ: np.ndarray, distance: int, segments: int) -> np.ndarray:
    """Whether from some segment all chains keep their budgets, the whole ring included."""
    good = np.bitwise_count(differ) <= distance
    at = np.flatnonzero(good)
    kept = np.zeros(len(at), bool)
    for start in range(segments):
        kept |= within_ring(differ[at], start, distance, segments)
    good[at] = kept
    return good


def _maybe_similar(similar: float, distance: int, segments: int):
    """Of rows (a, b, shingles, sketch, print and the same of b) the (a, b) that can be similar."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = [batch.column(i).to_numpy() for i in (2, 5)]
            left, right = [_sketches(batch.column(i)) for i in (3, 6)]
            good = (np.minimum(n, m) >= similar * np.maximum(n, m)) & (
                (left == right).sum(axis=1) >= LEAST_SHARE * SKETCH)
            differ = (batch.column(4).to_numpy() ^ batch.column(7).to_numpy()).view(np.uint64)
            yield batch.select([0, 1]).filter(pa.array(good & _ring(differ, distance, segments)))
    return run


def _between_rows(similar: float, distance: int, segments: int):
    """For tasks of outsiders (side 0) and all rows (side 1) of a key: links (a, b) that join components.

    Candidates are told by sketch, size and ring; the shingle sets decide. A pair whose components are one by
    then is not looked at, so a task gives fewer links than it has components, and no failing pair is a row.
    """
    def links(task: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        side, node, size = [task.column(c).to_numpy() for c in ("side", "node", "shingles")]
        part = np.unique(task.column("label").to_numpy(), return_inverse=True)[1]
        prints = task.column("print").to_numpy().view(np.uint64)
        sketch = _sketches(task.column("sketch").combine_chunks())
        lists = task.column("hashes").combine_chunks()
        ids = np.unique(lists.flatten().to_numpy(), return_inverse=True)[1]
        length = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        begin = np.cumsum(length) - length
        held = np.zeros(int(ids.max(initial=-1)) + 1, bool)
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        found: list[tuple[int, int]] = []
        step = max(1, (1 << 23) // (SKETCH * max(1, len(right))))
        for at in range(0, len(left), step):
            own = left[at:at + step]
            agree = (sketch[own][:, None, :] == sketch[right][None, :, :]).sum(axis=2, dtype=np.int16)
            n, m = size[own][:, None], size[right][None, :]
            good = ((agree >= LEAST_SHARE * SKETCH) & (np.minimum(n, m) >= similar * np.maximum(n, m))
                    & (np.bitwise_count(prints[own][:, None] ^ prints[right][None, :]) <= distance))
            for i in np.flatnonzero(good.any(axis=1)):
                me = own[i]
                others = right[good[i]]
                others = others[part[others] != part[me]]
                others = others[_ring(prints[me] ^ prints[others], distance, segments)]
                if not len(others):
                    continue
                mine = ids[begin[me]:begin[me] + length[me]]
                held[mine] = True
                flat = held[ids[ragged(begin[others], length[others])]]
                sums = np.concatenate([[0], np.cumsum(flat)])
                over = np.cumsum(length[others])
                both = sums[over] - sums[over - length[others]]
                held[mine] = False
                others = others[both >= similar * (length[me] + length[others] - both)]
                for other in others:
                    if part[other] != part[me]:
                        found.append((int(node[me]), int(node[other])))
                        part[part == part[other]] = part[me]
        a, b = np.array(found, np.int64).reshape(-1, 2).T
        return np.minimum(a, b), np.maximum(a, b)

    def run(task: pa.Table) -> pa.Table:
        return pa.table([pa.array(x) for x in links(task)], names=["a", "b"])
    return run


def _set_rows(size: int):
    """The distinct shingle hashes of each text, in ascending order."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(_shingle_hashes(t, size)).view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "hashes"])
    return run


def shingle_set(text: str, size: int = WORDS) -> set[tuple[bytes, ...]]:
    """The distinct word shingles; all words as one if there are fewer, none if there is no word."""
    own = LOWER[np.frombuffer(text.encode(), np.uint8)].tobytes().split()
    if len(own) < size:
        return {tuple(own)} if own else set()
    return set(zip(*[own[i:] for i in range(size)]))


def jaccard(left: set, right: set) -> float:
    """Common share of two sets; two empty ones are alike."""
    both = len(left & right)
    return both / (len(left) + len(right) - both) if left or right else 1.0


def _similar_rows(size: int, similar: float):
    """Of rows (a, b, text, other) the (a, b) whose texts are similar."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # many pairs share a text: that of a group's first node
            seen: dict[int, np.ndarray] = {}

            def hashed(column: int, i: int) -> np.ndarray:
                node = batch.column(column)[i].as_py()
                if node not in seen:
                    seen[node] = np.unique(_shingle_hashes(batch.column(column + 2)[i].as_py(), size))
                return seen[node]

            good = []
            for i in range(batch.num_rows):
                x, y = hashed(0, i), hashed(1, i)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(both >= similar * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))
    return run


def _node(docs: DataFrame) -> Column:
    """What tells rows apart: doc_id and text together, so that a doc_id on two texts is two documents."""
    return F.xxhash64(docs["doc_id"].cast("long"), text_of(docs))


def _beside(pairs: DataFrame, rows: DataFrame, columns: list[str]) -> DataFrame:
    """The pairs (a, b) with ``columns`` of the row of a, then those of the row of b as other_..."""
    left = rows.select(F.col("node").alias("a"), *columns)
    right = rows.select(F.col("node").alias("b"), *[F.col(c).alias(f"other_{c}") for c in columns])
    return (pairs.join(left, "a").join(right, "b")
            .select("a", "b", *columns, *[f"other_{c}" for c in columns]))


def _merged(labels: DataFrame, fresh: DataFrame) -> DataFrame:
    """``labels`` (node, label) after fresh links (a, b): only the graph of labels is searched for components."""
    of_a = labels.select(F.col("node").alias("a"), F.col("label").alias("la"))
    of_b = labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
    joined = written(fresh.join(of_a, "a").join(of_b, "b").where("la <> lb")
                     .select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct())
    if joined.isEmpty():
        return labels
    nodes = joined.select(F.col("a").alias("node")).union(joined.select("b")).distinct()
    found = components(nodes.withColumn("label", F.col("node")), joined)
    found = found.select(F.col("node").alias("label"), F.col("label").alias("least"))
    return written(labels.join(found, "label", "left").select("node", F.coalesce("least", "label").alias("label")))


def _asked(hard: DataFrame, rows: DataFrame, block: int) -> DataFrame:
    """The tasks of keys with outsiders: blocks of outsiders (side 0) against blocks of all (side 1).

    ``hard`` has key, node, label, outside; rows are repeated as often as there are blocks of the other side.
    """
    counts = (hard.groupBy("key").agg(F.count("*").alias("n"), F.count_if("outside").alias("m"))
              .select("key", F.expr(f"cast(ceil(n / {block}) as int)").alias("across"),
                      F.expr(f"cast(ceil(m / {block}) as int)").alias("down")))
    dealt = (salted_left_join(hard, counts, "key", F.col("node"))
             .withColumn("i", F.pmod(F.xxhash64("node"), F.col("down")).cast("int"))
             .withColumn("j", F.pmod(F.xxhash64("node"), F.col("across")).cast("int")))
    left = (dealt.where("outside").withColumn("side", F.lit(0))
            .withColumn("j", F.explode(F.sequence(F.lit(0), F.col("across") - 1))))
    right = (dealt.withColumn("side", F.lit(1))
             .withColumn("i", F.explode(F.sequence(F.lit(0), F.col("down") - 1))))
    both = left.unionByName(right).select("key", "i", "j", "side", "node", "label")
    return both.join(rows, "node")


def similar_pairs(docs: DataFrame, size: int = WORDS, similar: float = SIMILAR, distance: int = WIDE,
                  segments: int = WIDE_SEGMENTS, block: int = BLOCK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (node, doc_id, ...) of all documents, links (a, b) of nodes whose texts are similar, and the
    component (node, label) of every node that shares a key.

    Texts that share a pigeonring key or a band key are candidates. First each meets its key's least node, which settles
    groups of copies with a link per member. Members that stay apart from it then meet all members of the
    key that are not in their component, in a task per block and block, with their shingle sets. The ring of
    the fingerprints filters candidates, the shingles decide.
    """
    texts = docs.select(_node(docs).alias("node"), F.col("doc_id").cast("long").alias("doc_id"),
                        text_of(docs).alias("text"))
    rows = written(texts.mapInArrow(_sketch_rows(size), "node long, doc_id long, print long, shingles long, "
                                                        "keys array<long>, sketch binary").dropDuplicates(["node"]))
    keyed = rows.select("node", F.explode("keys").alias("key"))
    groups = (keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("head"))
              .where("n > 1").select("key", "head"))
    met = written(salted_left_join(keyed, groups, "key", F.col("node")).where("head is not null")
                  .select("key", "node", "head"))

    def checked(pairs: DataFrame) -> DataFrame:
        asked = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        # only the texts of candidates move
        needed = written(texts.join(asked, "node", "left_semi").select("node", "text").dropDuplicates(["node"]))
        return written(_beside(pairs, needed, ["text"]).mapInArrow(_similar_rows(size, similar), "a long, b long"))

    stars = met.where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b")).distinct()
    maybe = written(_beside(stars, rows, ["shingles", "sketch", "print"])
                    .mapInArrow(_maybe_similar(similar, distance, segments), "a long, b long"))
    found = checked(maybe)
    labels = _merged(written(met.select("node").distinct().withColumn("label", F.col("node"))), found)
    known = (met.join(labels, "node")
             .join(labels.select(F.col("node").alias("head"), F.col("label").alias("of_head")), "head")
             .withColumn("outside", F.col("label") != F.col("of_head")))
    # two members have met already; and where none is outside, all are linked
    open_ = known.groupBy("key").agg(F.count("*").alias("n"), F.max("outside").alias("any")).where("any and n > 2")
    hard = written(known.join(open_.select("key"), "key", "left_semi").select("key", "node", "label", "outside"))
    wanted = written(hard.select("node").distinct())
    sets = written(texts.join(wanted, "node", "left_semi").select("node", "text").dropDuplicates(["node"])
                   .mapInArrow(_set_rows(size), "node long, hashes array<long>")
                   .join(rows.select("node", "print", "shingles", "sketch"), "node"))
    fresh = written(_asked(hard, sets, block).groupBy("key", "i", "j")
                    .applyInArrow(_between_rows(similar, distance, segments), "a long, b long").distinct())
    found, labels = found.union(fresh), _merged(labels, fresh)
    return rows, found, labels


def drop_near_duplicates(docs: DataFrame, size: int = WORDS, similar: float = SIMILAR, distance: int = WIDE,
                         segments: int = WIDE_SEGMENTS) -> DataFrame:
    """One document of each component of similar texts, that of the smallest doc_id, all columns.

    What goes is a small table of rows; it is sent along only where Spark finds it small.
    """
    rows, _, labels = similar_pairs(docs, size, similar, distance, segments)
    labels = labels.join(rows.select("node", "doc_id"), "node")
    # null doc_ids come last
    stays = labels.groupBy("label").agg(
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "node"))["node"].alias("stays"))
    gone = labels.join(stays, "label").where("node <> stays").select(F.col("node").alias("_gone"))
    return docs.join(gone, _node(docs) == gone["_gone"], "left_anti")
