"""Near-duplicates (3): a multi-index Hamming join over b-bit MinHash signatures, confirmed on full shingle sets.

A signature is `chunks` chunks of `per_chunk` symbols, 16 bits each. Two signatures that differ in at most
`2 * chunks - 1` symbols have a chunk that differs in at most one (pigeonhole). Leaving out each symbol of each chunk in
turn enumerates every single error a chunk may hold, so both signatures give the same key at least once: all pairs up to
that distance meet, whatever the data. Pairs at the asked similarity further apart than that are found with the same
keys but not with certainty; `miss` bounds that chance for the scheme.

Who shares a key forms a group around its smallest member. A group that fits in one block is compared at once; a larger
one first with its smallest member, block by block. What links to that needs no further comparison with its like; only
the members that don't link are compared, in pairs of blocks, with all of the group. A block returns a spanning forest
of its links, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import byte_lists, cut, drop_ids, join_hot, shingle_set, text_of
from tabloom.llm.components import components

SHINGLE_WORDS = 5
#: Members of a block and the shingles they may hold together.
BLOCK_MEMBERS = 128
BLOCK_SHINGLES = 1_500_000
#: Ids that are broadcast, at most.
BROADCAST_IDS = 1_000_000
#: Parts into which the rows of a hub are dealt where they meet what belongs to the hub.
SALTS = 32


@dataclass(frozen=True)
class Scheme:
    """percent: links have 100 * intersection >= percent * union."""

    percent: int
    chunks: int
    per_chunk: int = 5

    @property
    def symbols(self) -> int:
        return self.chunks * self.per_chunk

    @property
    def sure_distance(self) -> int:
        return 2 * self.chunks - 1

    @property
    def miss(self) -> float:
        """Chance that a pair of exactly this similarity shares no key."""
        j, s = self.percent / 100, self.per_chunk
        return (1 - j**s - s * (1 - j) * j ** (s - 1)) ** self.chunks


def scheme_for(percent: int, most_miss: float = 1e-5) -> Scheme:
    """The fewest chunks under which a pair at the threshold is missed with a chance of most_miss at most."""
    if not 50 <= percent <= 100:
        raise ValueError("percent must be from 50 to 100")
    return next(s for n in range(2, 400) if (s := Scheme(percent, n)).miss <= most_miss)


# --- signatures ---------------------------------------------------------------------------------


def _hashes(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240607)
    return rng.integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, n, dtype=np.uint64)


def signatures(sets: list[np.ndarray], symbols: int) -> np.ndarray:
    """One row of 16-bit MinHash symbols for each non-empty set."""
    flat = np.concatenate(sets)
    at = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), symbols), np.uint16)
    for k, (a, b) in enumerate(zip(*_hashes(symbols), strict=True)):
        low = np.minimum.reduceat(flat * a + b, at)
        out[:, k] = (low * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(48)
    return out


def _fingerprint(batches: Iterator[pa.RecordBatch], symbols: int) -> Iterator[pa.RecordBatch]:
    import xxhash

    for batch in batches:
        texts = byte_lists(batch.column("text"))
        for lo in range(0, max(1, len(texts)), 1000):
            sets = [shingle_set(t, SHINGLE_WORDS) for t in texts[lo : lo + 1000]]
            full = [s for s in sets if len(s)]
            sig = iter(signatures(full, symbols)) if full else iter(())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(lo, 1000),
                    pa.array(map(len, sets), pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    pa.array([next(sig).tobytes() if len(s) else None for s in sets], pa.binary()),
                ],
                ["doc_id", "n_shingles", "set_key", "sig"],
            )


def _keys(batches: Iterator[pa.RecordBatch], scheme: Scheme) -> Iterator[pa.RecordBatch]:
    """(key, rep): each chunk with each of its symbols left out."""
    s = scheme.per_chunk
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint16).reshape(n, scheme.chunks, s).astype(np.uint64)
        rep = np.asarray(batch.column("rep"))
        for c in range(scheme.chunks):
            for left_out in range(s):
                key = np.zeros(n, np.uint64)
                for i in range(s):
                    if i != left_out:
                        key = (key << np.uint64(16)) ^ (key >> np.uint64(48)) ^ sig[:, c, i]
                salt = np.uint64((c * s + left_out + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))
                key = (key ^ salt) * np.uint64(0xFF51AFD7ED558CCD)
                key = (key ^ (key >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(rep)], ["key", "rep"])


# --- confirmation -------------------------------------------------------------------------------


def _inter(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
    """Sizes of the intersections of all of left with all of right (None: left), by products of 0/1 matrices."""
    both = left + (right or [])
    flat = np.concatenate(both)
    owner = np.repeat(np.arange(len(both)), [len(s) for s in both])
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count[column] > 1  # what only one set holds is in no intersection
    owner, column = owner[shared], column[shared]
    _, column = np.unique(column, return_inverse=True)
    n, m, width = len(left), len(right or left), 4096
    out = np.zeros((n, m), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, (lo, lo + width))
        dense = np.zeros((len(both), width), np.float32)
        dense[owner[a:b], column[a:b] - lo] = 1
        out += dense[:n] @ (dense[n:] if right is not None else dense).T
    return out


def _forest(link: np.ndarray) -> np.ndarray:
    """Label of each vertex: the lowest index reachable over the symmetric matrix link."""
    n = len(link)
    label = np.arange(n)
    while True:
        low = np.where(link, label[None, :], n).min(axis=1)
        new = np.minimum(label, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def block_links(left: list[tuple[int, np.ndarray]], right: list[tuple[int, np.ndarray]] | None, percent: int) -> list[tuple[int, int]]:
    """Edges (u, v) that connect what the links within left, or between left and right, connect."""
    both = left + (right or [])
    sets, sizes = [s for _, s in both], np.array([len(s) for _, s in both], np.int64)
    n = len(left)
    if right is None:
        inter = _inter(sets, None)
    else:
        inter = np.zeros((len(both), len(both)), np.float32)
        inter[:n, n:] = _inter(sets[:n], sets[n:])
        inter[n:, :n] = inter[:n, n:].T
    inter = np.rint(inter).astype(np.int64)
    link = 100 * inter >= percent * (sizes[:, None] + sizes[None, :] - inter)
    ids = np.array([i for i, _ in both])
    return [(int(ids[i]), int(ids[r])) for i, r in enumerate(_forest(link)) if i != r and ids[i] != ids[r]]


def _confirm(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by group; a group is held until the next one begins."""
    key, held = None, []

    def done() -> list[tuple[int, int]]:
        if len(held) < 2:
            return []
        if key[1] == key[2]:
            return block_links([x[1:] for x in held], None, percent)
        a, b = [x[1:] for x in held if x[0] == key[1]], [x[1:] for x in held if x[0] != key[1]]
        return block_links(a, b, percent) if a and b else []

    def out(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["u", "v"])

    for batch in batches:
        found = []
        columns = [batch.column(c).to_pylist() for c in ("hub", "i", "j", "b", "rep")]
        for hub, i, j, b, rep, text in zip(*columns, byte_lists(batch.column("text")), strict=True):
            if (hub, i, j) != key:
                found += done()
                key, held = (hub, i, j), []
            held.append((b, rep, shingle_set(text, SHINGLE_WORDS)))
        yield out(found)
    yield out(done())


def _meet_hub(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (hub, b), the hub's own first: each member with whether it links to its hub."""
    key, own = None, []
    for batch in batches:
        linked = []
        columns = [batch.column(c).to_pylist() for c in ("hub", "b", "rep")]
        for hub, b, rep, text in zip(*columns, byte_lists(batch.column("text")), strict=True):
            if (hub, b) != key:
                key, own = (hub, b), []
            s = shingle_set(text, SHINGLE_WORDS)
            if rep == hub:
                own.append(s)
                linked.append(True)
                continue
            inter = [len(np.intersect1d(s, h, assume_unique=True)) for h in own]
            linked.append(any(100 * x >= percent * (len(s) + len(h) - x) for x, h in zip(inter, own, strict=True)))
        yield pa.RecordBatch.from_arrays([batch.column("hub"), batch.column("rep"), batch.column("n"), pa.array(linked, pa.bool_())], ["hub", "rep", "n", "linked"])


# --- the operator -------------------------------------------------------------------------------


def _with_hub(rows: DataFrame, hubs: DataFrame, how: str) -> DataFrame:
    """rows joined with hubs on hub; a hub may have any share of the rows, so both sides are salted."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(SALTS)))
    return salted.join(hubs.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), ["hub", "salt"], how).drop("salt")


def _blocks(n: Column, shingles: Column) -> Column:
    return F.ceil(F.greatest(n / F.lit(BLOCK_MEMBERS), shingles / F.lit(BLOCK_SHINGLES))).cast("int")


def _links(star: DataFrame, sizes: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """Edges (u, v) that connect what the links within the groups of star (hub, rep) connect."""
    member = star.join(sizes, "rep")  # hub, rep, n
    # the texts of members once; those of all others are not shuffled where the members' ids fit in a broadcast
    ids = cut(star.select(F.col("rep").alias("id")).distinct(), "ids")
    known = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    rows = cut(rows.join(known, F.col("doc_id") == F.col("id"), "left_semi"), "texts")
    large = cut(member.groupBy("hub").agg(_blocks(F.count("*"), F.sum("n")).alias("blocks")).where("blocks > 1"), "large")
    sized = _with_hub(member, large, "left")
    within = lambda b, i, j: (F.lit(x).cast("int").alias(n) if isinstance(x, int) else x.alias(n) for x, n in ((b, "b"), (i, "i"), (j, "j")))

    def texts(members: DataFrame) -> DataFrame:
        return rows.join(members, rows.doc_id == members.rep).drop("doc_id")

    # with the hub: the hub goes to every block
    part = sized.where("blocks IS NOT NULL AND rep <> hub").select("hub", "rep", "n", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("b"))
    hubs = large.join(sizes, F.col("hub") == F.col("rep")).select("hub", "rep", "n", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b"))
    met = texts(part.unionByName(hubs)).withColumn("other", F.col("rep") != F.col("hub")).repartition("hub", "b").sortWithinPartitions("hub", "b", "other")
    met = met.select("hub", "b", "rep", "n", "text").mapInArrow(partial(_meet_hub, percent=percent), "hub long, rep long, n long, linked boolean")
    met = cut(met.groupBy("hub", "rep").agg(F.max("n").alias("n"), F.max("linked").alias("linked")), "met")
    # those that don't link: among themselves and with those that do
    count = lambda c: (F.sum(c.cast("int")), F.sum(F.when(c, F.col("n")).otherwise(0)))
    open_hubs = met.groupBy("hub").agg(_blocks(*count(~F.col("linked"))).alias("nb"), _blocks(*count(F.col("linked"))).alias("na")).where("nb > 0")
    rest = _with_hub(met.where("rep <> hub"), open_hubs, "inner")
    spot = F.when(F.col("linked"), F.col("nb") + F.pmod(F.xxhash64("rep"), F.col("na"))).otherwise(F.pmod(F.xxhash64("rep"), F.col("nb"))).cast("int")
    last = F.when(F.col("linked"), F.col("nb")).otherwise(F.col("nb") + F.col("na")) - 1
    rest = rest.select("hub", "rep", spot.alias("b"), F.explode(F.sequence(F.lit(0), last)).alias("o"))
    rest = rest.select("hub", "rep", *within(F.col("b"), F.least("b", "o"), F.greatest("b", "o")))

    small = sized.where("blocks IS NULL").select("hub", "rep", *within(0, 0, 0))
    groups = texts(small.unionByName(rest)).repartition("hub", "i", "j").sortWithinPartitions("hub", "i", "j")
    found = groups.select("hub", "i", "j", "b", "rep", "text").mapInArrow(partial(_confirm, percent=percent), "u long, v long")
    return found.unionByName(met.where("linked AND rep <> hub").select(F.col("rep").alias("u"), F.col("hub").alias("v")))


def near_duplicates(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id (smallest doc_id reachable), kept.

    Links: 100 * intersection >= percent * union of the sets of distinct 5-word shingles (A-Z lower-cased; fewer words:
    the whole sequence as one shingle). Null and empty texts have no shingles and no link. Rows of one doc_id are one
    document: all have its component, and are kept or dropped together. A null doc_id has a null component_id and is
    kept. An empty table gives an empty table. Other columns are not read.
    """
    scheme = scheme_for(percent)
    rows = text_of(docs, id_col, text_col)
    marks = cut(rows.mapInArrow(partial(_fingerprint, symbols=scheme.symbols), "doc_id long, n_shingles long, set_key binary, sig binary"), "marks")
    usable = marks.where("doc_id IS NOT NULL AND n_shingles > 0")
    # equal sets: one representative, the smallest id
    by_set = usable.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n"), F.first("sig").alias("sig"), F.count("*").alias("copies"))
    reps = cut(by_set, "reps")
    sizes = reps.agg(F.sum("copies").alias("rows"), F.count("*").alias("reps")).first()
    keys = reps.select("rep", "sig").mapInArrow(partial(_keys, scheme=scheme), "key long, rep long")
    shared = cut(keys.groupBy("key").agg(F.count("*").alias("c"), F.min("rep").alias("hub"), F.max("rep").alias("last")).where("hub < last").drop("last"), "shared")
    star = cut(join_hot(keys, shared, "key", sizes["reps"] * scheme.chunks * scheme.per_chunk, "c").select("hub", "rep").distinct(), "star")
    near = components(_links(star, reps.groupBy("rep").agg(F.max("n").alias("n")), rows, percent).distinct())
    # equal texts of one id with different sets: its classes are linked through the id
    ranked = reps.select("set_key", "rep", "copies")
    classes = join_hot(usable, ranked, "set_key", sizes["rows"] or 0, "copies").select("doc_id", "rep").distinct()
    split = classes.groupBy("doc_id").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high")
    if not split.isEmpty():
        more = classes.join(split.select("doc_id", "low"), "doc_id").select(F.col("rep").alias("u"), F.col("low").alias("v"))
        near = components(near.select(F.col("id").alias("u"), F.col("component_id").alias("v")).unionByName(more))
    # a set's component is found once for the set, then dealt to its documents
    ranked = ranked.join(near, F.col("rep") == F.col("id"), "left").select("set_key", F.coalesce("component_id", "rep").alias("component_id"), "copies")
    out = join_hot(marks, cut(ranked, "classes"), "set_key", sizes["rows"] or 0, "copies", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, percent: int = 80) -> DataFrame:
    """docs without those that near_duplicates drops; columns unchanged."""
    return drop_ids(docs, near_duplicates(docs, percent).where("NOT kept").select("doc_id"))
