"""MinHash near-duplicates with sequential Bayesian verification.

1. A document is its set of word shingles. Equal sets form a class (their hash is
   the key) and one node, for which the row of the smallest doc_id stands.
2. Representatives are banded: ``BANDS`` bands of ``ROWS`` MinHash values. A pair
   at the similarity threshold shares no band with probability
   (1 - 0.8 ** ROWS) ** BANDS, about 3e-6.
3. A document is paired with the smallest one of its buckets. Signatures are
   compared batch by batch; a pair is pruned once its posterior chance to reach
   the threshold is under ``MISS`` (uniform prior). Survivors are confirmed on
   their full sets, and links make components.
4. Where a bucket still holds several components, all members outside its largest
   one are compared with all others, as pairs or, in buckets over ``SMALL``, in
   blocks, again batch by batch; survivors are confirmed and components made
   again. So no link between members of a bucket is lost, and members that are
   joined already cost nothing.

No group meets in one task: centres and buckets are split into blocks or left to
joins that split by size, and pairs inside a joined group are never made.

Defined results: a text without words has the empty set and is linked with
nothing; fewer words than a shingle make one shingle of them all. A component is
named by its smallest doc_id, or NULL where no row has one. It keeps the row of
that id (a missing id goes last) and, if the id repeats with other texts, of the
smallest text hash; rows equal in both are kept or not together.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelscope.llm.common import cut, table, utf8
from labelscope.llm.components import components
from labelscope.llm.quality import windows, word_hashes

BANDS, ROWS = 42, 6
VALUES = BANDS * ROWS
#: Linked from NUMERATOR / DENOMINATOR on.
NUMERATOR, DENOMINATOR = 80, 100
#: Values compared at a time, and the chance to lose a true pair in a comparison.
BATCH, MISS = 42, 1e-6
#: Members of a bucket, or pairs of a centre, that meet in one group.
BLOCK = 256
#: Pairs of buckets up to this size are made; those of larger ones are compared in blocks.
SMALL = 16
_PREPARED = "doc_id long, text_hash long, n_shingles long, key binary, signature binary"
#: What finds a row again: its text, its id, and whether it has none.
_PLACE = ["text_hash", "id_or_0", "no_id"]


# --- sets and signatures ---------------------------------------------------------


def shingle_set(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text, A-Z in lower case."""
    h = word_hashes(text.lower())
    if not len(h):
        return h
    if len(h) < size:
        return windows(h ^ np.uint64(len(h)), len(h))  # unlike a shingle of ``size`` words
    w = windows(h, size)
    w.sort()
    return w[np.concatenate([[True], w[1:] != w[:-1]])]


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20240229)
    return draw.integers(1, 1 << 32, VALUES, np.uint32) | np.uint32(1), draw.integers(0, 1 << 32, VALUES, np.uint32)


def signature(shingles: np.ndarray, factors: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """Low halves of the MinHash values; unequal values agree once in 65,536 cases."""
    x = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    least = np.full(VALUES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 512):
        y = x[at:at + 512, None] * factors + shifts
        y ^= y >> np.uint32(15)
        y *= np.uint32(0x846CA68B)
        np.minimum(least, y.min(axis=0), out=least)
    return (least ^ (least >> np.uint32(16))).astype(np.uint16)


def prepare(docs: DataFrame, size: int) -> DataFrame:
    """``doc_id, text_hash, n_shingles, key, signature``; key and signature are NULL for the empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors, shifts = _permutations()
        for batch in batches:
            sizes, keys, signatures = [], [], []
            for text in batch["text"].to_pylist():
                s = shingle_set(text, size)
                sizes.append(len(s))
                keys.append(set_key(s) if len(s) else None)
                signatures.append(signature(s, factors, shifts).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["text_hash"], pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(signatures, pa.binary())],
                ["doc_id", "text_hash", "n_shingles", "key", "signature"])

    text = utf8(F.col("text"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text")).mapInArrow(run, _PREPARED)


def place(doc_id: Column, text_hash: Column) -> list[Column]:
    """The columns ``_PLACE``, none of them NULL."""
    return [c.alias(n) for c, n in zip((text_hash, F.coalesce(doc_id.cast("long"), F.lit(0)), doc_id.isNull()), _PLACE, strict=True)]


def set_key(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


# --- sequential verification -----------------------------------------------------


def least_matches(values: int = VALUES, batch: int = BATCH, miss: float = MISS) -> list[tuple[int, int]]:
    """After how many values how many must agree, for the posterior chance of
    a similarity of at least the threshold to stay at ``miss`` or more."""
    grid = (np.arange(200_000) + 0.5) / 200_000
    above = grid >= NUMERATOR / DENOMINATOR
    log, log_not = np.log(grid), np.log1p(-grid)
    out = []
    for n in range(batch, values + 1, batch):
        low, high = 0, n
        while low < high:  # the chance grows with the matches
            m = (low + high) // 2
            density = m * log + (n - m) * log_not
            density = np.exp(density - density.max())
            low, high = (low, m) if density[above].sum() >= miss * density.sum() else (m + 1, high)
        out.append((n, low))
    return out


def plausible(left: np.ndarray, right: np.ndarray, needed: list[tuple[int, int]]) -> np.ndarray:
    """Which rows of two signature arrays survive all batches; pruned rows are compared no further."""
    alive, agreed, done = np.arange(len(left)), np.zeros(len(left), np.int64), 0
    for n, m in needed:
        agreed = agreed + (left[alive, done:n] == right[alive, done:n]).sum(axis=1)
        stay = agreed >= m
        alive, agreed, done = alive[stay], agreed[stay], n
        if not len(alive):
            break
    return alive


def _stack(signatures: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(signatures), np.uint16).reshape(len(signatures), VALUES)


def pruned(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs ``a, b`` that their signatures leave plausible."""
    needed = least_matches()

    @F.pandas_udf("boolean")
    def check(left: pd.Series, right: pd.Series) -> pd.Series:
        out = np.zeros(len(left), bool)
        if len(left):
            out[plausible(_stack(left.tolist()), _stack(right.tolist()), needed)] = True
        return pd.Series(out)

    own = lambda node, name: reps.select(F.col("node").alias(node), F.col("signature").alias(name))
    both = pairs.join(own("a", "_left"), "a").join(own("b", "_right"), "b")
    return both.where(check("_left", "_right")).select("a", "b").distinct()


def shingle_sets(docs: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """``node, own``: the packed full sets of ``nodes`` (node, ``_PLACE``, again); the texts move once.

    Of rows equal in id and text (``again``) one set is taken.
    """
    text = utf8(F.col("text"))
    texts = docs.select(*place(F.col("doc_id"), F.xxhash64(text)), text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [shingle_set(t, size).tobytes() for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["node"], batch["again"], pa.array(own, pa.binary())], ["node", "again", "own"])

    sets = cut(texts.join(nodes, _PLACE).select("node", "again", "text").mapInArrow(run, "node long, again boolean, own binary"))
    once = cut(sets.where("again").groupBy("node").agg(F.first("own").alias("own")))
    return sets.where("not again").select("node", "own").union(once)


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs ``a, b`` whose full shingle sets reach the threshold.

    Sets gather by ``a``: its own first, those of its partners after; a busy ``a``
    is repeated over blocks of its partners.
    """
    pairs = cut(pairs)
    salts = pairs.groupBy("a").agg((1 + F.floor((F.count("*") - 1) / BLOCK)).cast("int").alias("salts"))
    salted = pairs.join(salts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"))
    # b is NULL in the row that brings the set of a itself.
    owners = salts.select(F.col("a").alias("node"), "a", F.lit(None).cast("long").alias("b"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    wanted = owners.union(salted.select(F.col("b").alias("node"), "a", "b", "salt"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, own = None, []
        for batch in batches:
            left, right = [], []
            for a, b, salt, raw in zip(*(batch[c].to_pylist() for c in ("a", "b", "salt", "own")), strict=True):
                this = np.frombuffer(raw, np.uint64)
                if (a, salt) != group:
                    group, own = (a, salt), []
                if b is None:
                    own.append(this)
                elif any(_linked(x, this) for x in own):
                    left.append(a)
                    right.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    met = sets.join(wanted, "node").select("a", "b", "salt", "own")
    return met.repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first()).mapInArrow(verify, "a long, b long").distinct()


def _linked(x: np.ndarray, y: np.ndarray) -> bool:
    if DENOMINATOR * min(len(x), len(y)) < NUMERATOR * max(len(x), len(y)):
        return False
    z = np.concatenate([x, y])
    z.sort()
    shared = int((z[1:] == z[:-1]).sum())
    return DENOMINATOR * shared >= NUMERATOR * (len(z) - shared)


# --- candidates ------------------------------------------------------------------


def band_members(reps: DataFrame) -> DataFrame:
    """``band, bucket, node``: the bands of every representative."""
    keys = F.expr(f"transform(sequence(0, {BANDS - 1}), i -> xxhash64(substring(signature, i * {2 * ROWS} + 1, {2 * ROWS}), i))")
    return reps.select("node", F.posexplode(keys).alias("band", "bucket"))


def split_buckets(members: DataFrame, joined: DataFrame) -> DataFrame:
    """``band, bucket, node, component, members, outsiders, outer`` of buckets that hold several components.

    ``outer`` marks the members outside a bucket's largest component.
    """
    placed = members.join(joined, "node", "left").select("band", "bucket", "node", F.coalesce("component", "node").alias("component"))
    parts = placed.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    split = parts.groupBy("bucket").agg(
        F.sum("n").alias("members"), F.count("*").alias("parts"), F.max(F.struct("n", "component")).alias("main")).where("parts > 1")
    return placed.join(split, "bucket").select(
        "band", "bucket", "node", "component", "members", (F.col("members") - F.col("main.n")).alias("outsiders"),
        (F.col("component") != F.col("main.component")).alias("outer"))


def pairs_across(split: DataFrame) -> DataFrame:
    """Pairs ``a, b`` across components inside small buckets."""
    small = split.where(F.col("members") <= SMALL)
    left = small.where("outer").select("bucket", F.col("node").alias("x"), F.col("component").alias("p"))
    right = small.select("bucket", F.col("node").alias("y"), F.col("component").alias("q"))
    return left.join(right, "bucket").where("p <> q").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def links_across(split: DataFrame, reps: DataFrame, sets: DataFrame) -> DataFrame:
    """Links ``a, b`` across components inside larger buckets.

    Each member outside the largest component meets every member of the bucket:
    blocks of the first against blocks of all, one group a pair of blocks. A pair
    is compared in the first band that it shares, signatures first and full sets
    then, and only until its member is linked to the other component.
    """
    large = split.where(F.col("members") > SMALL).select(
        "*", (1 + F.floor((F.col("members") - 1) / BLOCK)).cast("int").alias("blocks"), (1 + F.floor((F.col("outsiders") - 1) / BLOCK)).cast("int").alias("outers"))
    block = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    lefts = large.where("outer").select("band", "bucket", block(F.col("outers")).alias("p"), every(F.col("blocks")).alias("q"), F.lit(0).alias("side"), "node", "component")
    rights = large.select("band", "bucket", every(F.col("outers")).alias("p"), block(F.col("blocks")).alias("q"), F.lit(1).alias("side"), "node", "component")
    needed = least_matches()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []
        for batch in batches:
            found: list[tuple[int, int]] = []
            columns = [batch[c].to_pylist() for c in ("bucket", "p", "q", "band", "side", "node", "component", "signature", "own")]
            for bucket, p, q, *row in zip(*columns, strict=True):
                if (bucket, p, q) != group:
                    found += _across(held, needed)
                    group, held = (bucket, p, q), []
                held.append(row)
            yield _pairs(found)
        yield _pairs(_across(held, needed))

    whole = reps.select("node", "signature").join(sets, "node")
    ordered = lefts.union(rights).join(whole, "node").repartition("bucket", "p", "q").sortWithinPartitions("bucket", "p", "q")
    return ordered.select("bucket", "p", "q", "band", "side", "node", "component", "signature", "own").mapInArrow(compare, "a long, b long").distinct()


def _across(held: list[list], needed: list[tuple[int, int]]) -> list[tuple[int, int]]:
    left, right = [r for r in held if r[1] == 0], [r for r in held if r[1] == 1]
    if not left or not right:
        return []
    nodes, parts = np.array([r[2] for r in right]), np.array([r[3] for r in right])
    signatures, own = _stack([r[4] for r in right]), [np.frombuffer(r[5], np.uint64) for r in right]
    found = []
    for band, _, node, part, raw, shingles in left:
        others = np.flatnonzero(parts != part)
        if not len(others):
            continue
        this, mine = np.frombuffer(raw, np.uint16), np.frombuffer(shingles, np.uint64)
        near = others[plausible(np.broadcast_to(this, (len(others), VALUES)), signatures[others], needed)]
        equal = signatures[near] == this
        near, equal = near[first := _first_band(equal) == band], equal[first]
        linked: set[int] = set()
        for i in near[np.argsort(-equal.sum(axis=1), kind="stable")].tolist():
            if parts[i] not in linked and _linked(mine, own[i]):
                linked.add(int(parts[i]))
                found.append((min(node, int(nodes[i])), max(node, int(nodes[i]))))
    return found


def _first_band(equal: np.ndarray) -> np.ndarray:
    return equal.reshape(len(equal), BANDS, ROWS).all(axis=2).argmax(axis=1)


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])


def judged(docs: DataFrame, size: int) -> DataFrame:
    """``doc_id, text_hash, n_shingles, component_id, kept`` of every row of ``docs`` (doc_id, text)."""
    prepared = cut(prepare(docs, size))
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    classes = prepared.where("key is not null").groupBy("key").agg(F.min(row).alias("row"), F.first("signature").alias("signature"))
    # Nodes in the order of the ids: what copies were made from tends to come first, and is the centre of its star.
    nodes = cut(classes.select("key", "row").orderBy("row").select("key", F.monotonically_increasing_id().alias("node")))
    reps = cut(classes.join(nodes, "key"))
    bands = band_members(reps)
    shared = bands.groupBy("bucket").agg(F.count("*").alias("n"), F.min("node").alias("a")).where("n > 1")
    members = cut(bands.join(shared, "bucket").select("band", "bucket", "node", "a"))
    again = prepared.select(*place(F.col("doc_id"), F.col("text_hash"))).groupBy(*_PLACE).agg(F.count("*").alias("n")).where("n > 1").select(*_PLACE, F.lit(True).alias("again"))
    places = reps.join(members.select("node").distinct(), "node", "left_semi").select("node", *place(F.col("row.doc_id"), F.col("row.text_hash")))
    sets = shingle_sets(docs, places.join(again, _PLACE, "left").select("node", *_PLACE, F.coalesce("again", F.lit(False)).alias("again")), size)
    # One pair a member first: with the least of all the members it shares a bucket with.
    stars = members.where("node <> a").groupBy("node").agg(F.min("a").alias("a")).select("a", F.col("node").alias("b"))
    joined = components(confirmed(pruned(stars, reps), sets))
    split = cut(split_buckets(members, joined))
    rest = cut(confirmed(pruned(pairs_across(split), reps), sets).union(links_across(split, reps, sets)))
    if not rest.isEmpty():
        joined = components(joined.where("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b")).union(rest))
    named = reps.select("key", "node", "row").join(joined, "node", "left").select("key", "row", F.coalesce("component", "node").alias("component"))
    firsts = named.groupBy("component").agg(F.min("row").alias("chosen"))
    found = prepared.join(named.join(firsts, "component").select("key", "chosen"), "key", "left")
    alone = F.col("key").isNull()
    return found.select(
        "doc_id", "text_hash", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("chosen.doc_id")).alias("component_id"),
        (alone | (F.col("doc_id").eqNullSafe(F.col("chosen.doc_id")) & (F.col("text_hash") == F.col("chosen.text_hash")))).alias("kept"))


def near_duplicates(docs: DataFrame, size: int = 5) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row of ``docs`` (doc_id, text)."""
    return judged(docs, size).drop("text_hash")


def op3_minhash_near_dup(spark, sf_dir: str) -> DataFrame:
    """Components of all documents linked by 2-word shingles."""
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), 2)


def stage_near_dup(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each group of near copies (5-word shingles).

    Rows equal in id, given or missing, and text become one.
    """
    chosen = judged(docs.select("doc_id", "text"), 5).where("kept").select(*place(F.col("doc_id"), F.col("text_hash")))
    # Rows travel whole in a struct, whatever their columns are called.
    placed = docs.select(F.struct(*docs.columns).alias("_row"), *place(F.col("doc_id"), F.xxhash64(utf8(F.col("text")))))
    once = Window.partitionBy(*_PLACE).orderBy(F.lit(0))
    return placed.join(chosen, _PLACE, "left_semi").withColumn("_n", F.row_number().over(once)).where("_n = 1").select("_row.*")


#: All pairs with a common shingle, for the test tables; components by reach.
OP3_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s
  FROM words),
shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n + b.n) AS n, count(*) AS k FROM shingles a
  JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY 1, 2),
links AS (SELECT x, y FROM shared WHERE 100 * k >= 80 * (n - k)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (
  SELECT doc_id AS node, doc_id AS seen FROM documents
  UNION SELECT reach.node, both_ways.y FROM reach JOIN both_ways ON reach.seen = both_ways.x)
SELECT doc_id, len(s)::BIGINT AS n_shingles, c AS component_id, doc_id = c AS kept
FROM sets JOIN (SELECT node, min(seen) AS c FROM reach GROUP BY node) r ON r.node = doc_id
"""
