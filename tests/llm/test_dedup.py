import hashlib
import re
import struct
import zlib

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import components, exact_dedup, shards, simhash

WS = re.compile(r"[\x20\x09-\x0D]+")


def norm(t):
    return WS.sub(" ", t or "")


@given(st.text("ab \t\né", max_size=60), st.integers(1, 9))
@settings(max_examples=150, deadline=None)
def test_fingerprints_compose(text, chunk):
    raw = np.frombuffer(text.encode(), np.uint8)
    whole = exact_dedup.chunk_part(raw)
    assert exact_dedup.fingerprint(raw, chunk) == whole
    assert whole[2] == len(norm(text).encode())
    assert exact_dedup._sha256(raw.tobytes()) == hashlib.sha256(norm(text).encode()).hexdigest()


@pytest.mark.parametrize("options", [{}, {"modulus": 3}, {"huge": 40, "chunk": 7}])
def test_groups_equal_brute_force(documents, plain, options):
    got = exact_dedup.duplicate_groups(documents, **options).collect()
    groups = {}
    for d, t, *_ in plain:
        groups.setdefault(norm(t), []).append(d)
    want = sorted(((str(d), str(min([x for x in groups[norm(t)] if x is not None], default=None)),
                    len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for d, t, *_ in plain))
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == want
    kept = [r.text_sha256 for r in got if r.kept]
    assert len(kept) == len(set(kept)) == len(groups)


def test_kept_documents_keep_their_columns(documents, plain):
    out = exact_dedup.drop_duplicates(documents)
    assert out.columns == documents.columns
    assert sorted(norm(r.text) for r in out.collect()) == sorted({norm(t) for _, t, *_ in plain})


def fingerprint(text):
    words = [w.lower() if w.isascii() else "".join(c.lower() if c.isascii() else c for c in w)
             for w in WS.split(text or "") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashed = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashed) > len(hashed))


def test_simhash_equals_brute_force(documents, plain):
    prints = [(d, fingerprint(t)) for d, t, *_ in plain]
    label = {p: {p} for _, p in prints}
    for a in list(label):
        for b in list(label):
            if bin(a ^ b).count("1") <= 3 and label[a] is not label[b]:
                label[a] |= label[b]
                for x in label[a]:
                    label[x] = label[a]
    least = {}
    for d, p in prints:
        key = min(label[p])
        least[key] = min([x for x in (least.get(key), d) if x is not None], default=None)
    got = simhash.near_groups(documents).collect()
    assert (sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got)
            == sorted((str(d), f"{p:016x}", str(least[min(label[p])])) for d, p in prints))


@pytest.mark.parametrize("block", [4, 4096])
def test_links_keep_components(spark, block):
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 2**63, 25, dtype=np.uint64)
    prints = {int(c) for c in centres}
    for c in centres:
        for _ in range(12):
            x = int(c)
            for b in rng.integers(0, 64, rng.integers(1, 6)):
                x ^= 1 << int(b)
            prints.add(x)
    signed = [(x - (1 << 64) if x >= 1 << 63 else x,) for x in prints]
    df = spark.createDataFrame(signed, "print long")
    edges = simhash.links(df, block=block)
    found = components.components(df.selectExpr("print as node", "print as label"), edges)
    got = {r.node % (1 << 64): r.label for r in found.collect()}
    seen, groups = set(), 0
    for x in prints:
        if x in seen:
            continue
        todo, group = [x], set()
        while todo:
            y = todo.pop()
            if y in group:
                continue
            group.add(y)
            todo += [z for z in prints if bin(y ^ z).count("1") <= 3]
        seen |= group
        groups += 1
        assert len({got[y] for y in group}) == 1
    assert len(set(got.values())) == groups


@given(st.integers(0, 2**64 - 1), st.sets(st.integers(0, 63), max_size=3))
@settings(max_examples=300, deadline=None)
def test_ring_keys_miss_no_pair(x, flips):
    y = x
    for b in flips:
        y ^= 1 << b
    differ = np.array([x ^ y], np.uint64)
    assert any(x & m == y & m and simhash.within_ring(differ, s)[0] for s, m in simhash.ring_masks())


def test_shards(documents, plain):
    tree = shards.Tree.even(4, 2, 5)
    got = shards.place(documents, tree, 40).collect()
    assert len(got) == len(plain)
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert all(r.grown_shard in (r.shard, 40) and 0 <= r.shard < 40 for r in got)
    of_id = {}
    for r in got:
        assert of_id.setdefault(r.doc_id, r.shard) == r.shard


def plain_shard(key, tree):
    """The tree descended by hand; the hash of (id, name) chains the id's into the name's seed."""
    def hash_long(value, seed):
        return xxhash.xxh64_intdigest(struct.pack("<q", value), seed % 2**64)

    def least(children):
        def draw(child):
            seed = 42 if key is None else hash_long(key, 42)
            h = xxhash.xxh64_intdigest(child[0].encode(), seed)
            unit = np.float64(((h >> 11) + 0.5)) / np.float64(1 << 53)
            return -np.log(unit) / child[1], child[0]
        return min(map(draw, children))[1]

    return int(least(tree.shards[least(tree.racks[least(tree.regions)])]))


def test_shards_by_hand(documents, plain):
    tree = shards.Tree.even(4, 2, 5)
    got = shards.place(documents, tree, 40).collect()
    want = [(d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode()), "key", plain_shard(d, tree),
             plain_shard(d, tree.grown(40))) for d, t, *_ in plain]
    assert sorted(((r.doc_id, r.size, r.text_crc32, r.law, r.shard, r.grown_shard) for r in got), key=str) == sorted(
        want, key=str)


def test_a_weight_moves_documents_only_into_its_subtree(spark):
    df = spark.range(8000).selectExpr("id as doc_id")
    tree = shards.Tree.even(4, 2, 5)
    heavier = shards.Tree(tree.regions, {**tree.racks, "r2": (("r2.0", 9.0), ("r2.1", 5.0))}, tree.shards)
    both = shards.shard_of(shards.shard_of(df, "doc_id", tree, "a"), "doc_id", heavier, "b").where("a <> b").collect()
    # r2 holds shards 20 to 29, its first rack 20 to 24
    assert len(both) > 50 and all(25 <= r.a < 30 and 20 <= r.b < 25 for r in both)


def test_shares_follow_weights(spark):
    df = spark.range(20_000).selectExpr("id as doc_id", "'' as text")
    tree = shards.Tree.even(4, 2, 5)
    counts = {r["shard"]: r["count"] for r in shards.place(df, tree, 40).groupBy("shard").count().collect()}
    assert len(counts) == 40 and 400 < min(counts.values()) and max(counts.values()) < 600
    moved = shards.place(df, tree, 40).where("grown_shard = 40").count()
    assert 380 < moved < 600


@pytest.mark.parametrize("run", [exact_dedup.duplicate_groups, simhash.near_groups,
                                 lambda d: shards.place(d, shards.Tree.even(2, 2, 2), 8)])
def test_empty_table(documents, run):
    assert run(documents.limit(0)).count() == 0


def near_texts():
    """600 texts of 80 to 400 words, and for each a copy with a few words changed."""
    rng = np.random.default_rng(11)
    rows = []
    for i in range(600):
        own = [f"w{x}" for x in rng.zipf(1.3, rng.integers(80, 400)) % 5000]
        copy = list(own)
        for at in rng.choice(len(own), max(1, len(own) // int(rng.integers(35, 120))), replace=False):
            copy[at] = "changed"
        rows += [(2 * i, " ".join(own)), (2 * i + 1, " ".join(copy))]
    return rows


def test_near_copies_of_the_pipeline(spark):
    rows = near_texts()
    words = [t.split() for _, t in rows]
    sets = [set(zip(*[w[k:] for k in range(5)])) for w in words]
    alike = {(i, i + 1) for i in range(0, len(rows), 2)
             if len(sets[i] & sets[i + 1]) >= 0.8 * len(sets[i] | sets[i + 1])}
    close = {p for p in alike if len(sets[p[0]] & sets[p[1]]) < 0.85 * len(sets[p[0]] | sets[p[1]])}
    assert 60 < len(close) < len(alike) < 600
    kept = {r.doc_id for r in simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    gone = set(range(len(rows))) - kept
    assert gone <= {b for _, b in alike}  # no text without a similar one goes
    assert len(gone) >= 0.95 * len(alike)
    assert len(gone & {b for _, b in close}) >= 0.9 * len(close)


def text_rows(spark, words):
    return spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(words)], "doc_id long, text string")


def components_of(sets):
    label = list(range(len(sets)))
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if simhash.jaccard(sets[i], sets[j]) >= 0.8]
    for _ in sets:
        before = list(label)
        for i, j in pairs:
            label[i] = label[j] = min(label[i], label[j])
        if before == label:
            break
    return pairs, label


@pytest.mark.parametrize("block", [simhash.BLOCK, 150])
def test_family_of_alike_texts(spark, block):
    """600 texts of one template, of which only 300 pairs are near copies: no pair is lost to the others."""
    rng = np.random.default_rng(3)
    template, words = [f"t{i}" for i in range(300)], []
    for i in range(300):
        own = list(template)
        for at in rng.choice(300, 11, replace=False):
            own[at] = f"v{i}x{at}"
        copy = list(own)
        for at in rng.choice(300, 3, replace=False):
            copy[at] = f"c{i}x{at}"
        words += [own, copy]
    sets = [set(zip(*[w[k:] for k in range(5)])) for w in words]
    pairs, label = components_of(sets)
    assert 300 <= len(pairs) < 400
    docs = text_rows(spark, words)
    _, found, _ = simhash.similar_pairs(docs, block=block)
    linked = {(r.a, r.b) for r in found.collect()}
    assert len(linked) >= 0.98 * len(pairs)
    if block == simhash.BLOCK:
        kept = {r.doc_id for r in simhash.drop_near_duplicates(docs).collect()}
        assert set(label) <= kept and len(kept) <= len(set(label)) + 0.02 * 300


def test_links_of_a_group_do_not_grow_with_its_square(spark):
    rng = np.random.default_rng(4)
    base, words = [f"b{i}" for i in range(200)], []
    for i in range(800):
        own = list(base)
        own[rng.integers(200)] = f"e{i}"
        words.append(own)
    docs = text_rows(spark, words)
    _, found, _ = simhash.similar_pairs(docs)
    assert found.count() <= 6 * 800
    assert {r.doc_id for r in simhash.drop_near_duplicates(docs).collect()} == {0}


def test_member_unlike_the_first_but_like_another(spark):
    """A chain: each text is a near copy of the next only, wherever its key's first node stands."""
    words = []
    for chain in range(40):
        own = [f"{chain}w{i}" for i in range(200)]
        for step in range(5):
            words.append(list(own))
            own[40 * step + 10:40 * step + 22] = [f"{chain}s{step}x{i}" for i in range(12)]
    sets = [set(zip(*[w[k:] for k in range(5)])) for w in words]
    pairs, label = components_of(sets)
    assert len(pairs) == 160 and len(set(label)) == 40
    assert {r.doc_id for r in simhash.drop_near_duplicates(text_rows(spark, words)).collect()} == set(label)


def test_passage_shared_by_many(spark):
    """Half of each text is one passage: none is a near copy."""
    passage = [f"p{i}" for i in range(100)]
    words = [passage + [f"o{d}x{i}" for i in range(100)] for d in range(500)]
    assert simhash.drop_near_duplicates(text_rows(spark, words)).count() == 500


def test_clashing_names_stay(spark):
    rows = [(1, "a b c", "keep me", "x", "y", 1), (2, "a  b c", "gone", "x", "y", 2), (3, "other", "keep", "x", "y", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _key string, _sha string, key string, sha int")
    for out in (exact_dedup.drop_duplicates(docs), simhash.drop_near_duplicates(docs.where("doc_id <> 2"))):
        assert out.columns == docs.columns
        assert sorted(tuple(r) for r in out.collect()) == [rows[0], rows[2]]


def test_two_texts_under_one_doc_id(spark):
    """Only the near copy goes, not the other text of its doc_id."""
    text = " ".join(f"w{i}" for i in range(200))
    rows = [(1, text), (2, text + " more"), (2, "another text that is like none of them")]
    kept = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == sorted([rows[0], rows[2]])


def test_the_stage_meets_by_pigeonring_keys():
    """Fingerprints of at most 3 differing bits share a key of the stage, whatever the band keys are."""
    import pyarrow as pa

    r = np.random.default_rng(9)
    for _ in range(300):
        print_ = int(r.integers(0, 2**64, dtype=np.uint64))
        other = print_
        for bit in r.choice(64, 3, replace=False):
            other ^= 1 << int(bit)
        assert set(simhash.ring_keys(print_).tolist()) & set(simhash.ring_keys(other).tolist())
    batch = pa.record_batch([pa.array([1]), pa.array([1]), pa.array(["one two three four five six"])],
                            names=["node", "doc_id", "text"])
    row = next(simhash._sketch_rows(5)([batch])).to_pylist()[0]
    own = simhash.ring_keys(row["print"] % 2**64).view(np.int64).tolist()
    assert row["keys"][:len(own)] == own and len(row["keys"]) == len(own) + simhash.SKETCH // simhash.BAND
