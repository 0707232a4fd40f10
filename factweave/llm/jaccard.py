"""N-gram Jaccard join by a blocked sparse product of documents and word n-grams."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, mix64, shingle_sets, text_or_empty, written
from .tables import query, table

WORDS = 5
PERCENT = 75
GROUP_DOCS, GROUP_GRAMS = 4096, 3 << 19  # texts (n-grams) whose incidence is laid out at once
BLOCK = 2_000_000  # incidences in a block of the matrix
LOCAL_SHARE, SHARE = 0.02, 0.01  # an n-gram in that share of a group (of all texts) is a frequent one
ROUNDS = 1
SPREAD = 0.08  # how far from the most shared set a later round may look for the one it pairs a column with
KEY = (1 << 48) - 1


# ------------------------------------------------------------------ sets of n-grams
def _digest(grams: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(grams.tobytes(), digest_size=8).digest(), "little", signed=True)


def _groups(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[list, list[np.ndarray]]]:
    """The rows of the first column and the n-gram sets of the texts, some thousand texts at a time."""
    ids, sets, total = [], [], 0
    for batch in batches:
        for doc_id, grams in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(column), WORDS)):
            ids.append(doc_id)
            sets.append(grams)
            total += len(grams)
            if len(ids) >= GROUP_DOCS or total >= GROUP_GRAMS:
                yield ids, sets
                ids, sets, total = [], [], 0
    if ids:
        yield ids, sets


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, sets in _groups(batches, 1):
        digests = [_digest(g) if len(g) else None for g in sets]
        once = {d: g for d, g in zip(digests, sets) if d is not None}
        frequent = None
        if once:
            grams, counts = np.unique(np.concatenate(list(once.values())), return_counts=True)
            often = counts >= max(2, LOCAL_SHARE * len(once))
            frequent = grams[often].astype("<u8").tobytes() + counts[often].astype("<u8").tobytes()
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array([len(g) for g in sets], pa.int64()), pa.array(digests, pa.int64()), pa.array([frequent] + [None] * (len(ids) - 1), pa.binary())],
            ["doc_id", "n", "set_id", "frequent"])


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for raw in batch.column(0).to_pylist():
            both = np.frombuffer(raw, "<u8").reshape(2, -1)
            yield pa.RecordBatch.from_arrays([pa.array(both[0].view(np.int64)), pa.array(both[1].view(np.int64))], ["gram", "c"])


def profiles(docs: DataFrame) -> DataFrame:
    """(doc_id, n, set_id) of docs(doc_id, text), written: the size of the text's n-gram set and a hash of the set, equal for
    equal sets, null for an empty one; and, on some rows, the n-grams frequent among a group of texts."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return written(rows.mapInArrow(_profiles, "doc_id long, n long, set_id long, frequent binary"), "profiles")


# ------------------------------------------------------------------ the incidence matrix in blocks
def _incidence(blocks: int, frequent: np.ndarray):
    """Rows (block, sets, lights, keys, heavies, often, home, sizes): for a group of texts the n-grams of one block of columns,
    set by set, with the number of each set's n-grams there; and the sizes of the sets whose first n-gram is there.

    An n-gram's hash modulo `blocks` is its block, and 48 more bits its key there; a frequent one goes by its number, to a
    block that its text's set chooses, so that no block takes all the texts with it.
    """
    names = ["block", "sets", "lights", "keys", "heavies", "often", "home", "sizes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, sets in _groups(batches, 1):
            new = {}
            for g in sets:
                if len(g):
                    d = _digest(g)
                    if d not in seen:
                        new[d] = g
            seen.update(new)
            if len(seen) > 1 << 20:
                seen.clear()
            if not new:
                continue
            ids = np.array(list(new), dtype=np.int64)
            size = np.array([len(g) for g in new.values()])
            own = np.repeat(np.arange(len(ids)), size)
            grams = np.concatenate(list(new.values()))
            at = np.minimum(np.searchsorted(frequent, grams), max(len(frequent) - 1, 0))
            often = frequent[at] == grams if len(frequent) else np.zeros(len(grams), bool)
            block = (grams % np.uint64(blocks)).astype(np.int64)
            block[often] = (mix64(ids.view(np.uint64)) % np.uint64(blocks)).astype(np.int64)[own[often]]
            home = block[np.cumsum(size) - size]
            order = np.argsort(block, kind="stable")
            key = grams // np.uint64(blocks) & np.uint64(KEY)
            cuts = np.flatnonzero(np.diff(block[order], prepend=-1, append=blocks))
            rows = []
            for a, b in zip(cuts[:-1], cuts[1:]):
                i = order[a:b]  # by set, as the sort is stable
                light, heavy = i[~often[i]], i[often[i]]
                used, place = np.unique(own[i], return_inverse=True)
                here = used[home[used] == block[i[0]]]
                rows.append((int(block[i[0]]), ids[used].tobytes(), _planes(np.bincount(place[~often[i]], minlength=len(used))), _six(key[light]),
                             _planes(np.bincount(place[often[i]], minlength=len(used))), at[heavy].astype("<u4").tobytes(), ids[here].tobytes(), _planes(size[here])))
            kinds = [pa.int32()] + [pa.binary()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return run, "block int, sets binary, lights binary, keys binary, heavies binary, often binary, home binary, sizes binary"


def _planes(x: np.ndarray) -> bytes:
    """32-bit numbers, byte by byte, as most are small and the shuffle packs runs of zeros."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _of_planes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1)


def _six(key: np.ndarray) -> bytes:
    return key.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _of_six(raw: bytes) -> np.ndarray:
    k = np.zeros((len(raw) // 6, 8), np.uint8)
    k[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return k.reshape(-1).view("<u8")


def _counted(blocks: int):
    """Of a block, the incidences of n-grams in two sets or more and of the frequent ones, set by set: rows (bucket, block,
    sets, lights, keys, dfs, sets_often, heavies, often, home, sizes), bucketed by set."""
    names = ["bucket", "block", "sets", "lights", "keys", "dfs", "sets_often", "heavies", "often", "home", "sizes"]

    def by_bucket(owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Owners' order by bucket and owner, and where each bucket begins and ends."""
        bucket = (mix64(owner.view(np.uint64) + np.uint64(1)) % np.uint64(blocks)).astype(np.int64)
        order = np.lexsort((owner, bucket))
        return order, np.searchsorted(bucket[order], np.arange(blocks + 1))

    def run(group: pa.Table) -> pa.Table:
        block = group.column("block")[0].as_py()
        keys, owners, often, owners_f, home, sizes = [], [], [], [], [], []
        for i in range(group.num_rows):
            raw = {c: group.column(c)[i].as_py() for c in group.column_names[1:]}
            ids = np.frombuffer(raw["sets"], "<i8")
            keys.append(_of_six(raw["keys"]))
            owners.append(np.repeat(ids, _of_planes(raw["lights"])))
            often.append(np.frombuffer(raw["often"], "<u4"))
            owners_f.append(np.repeat(ids, _of_planes(raw["heavies"])))
            home.append(np.frombuffer(raw["home"], "<i8"))
            sizes.append(_of_planes(raw["sizes"]))
        key, owner = np.concatenate(keys), np.concatenate(owners)
        del keys, owners
        order = np.lexsort((owner, key))
        key, owner = key[order], owner[order]
        fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])]) if len(key) else np.zeros(0, bool)
        key, owner = key[fresh], owner[fresh]  # a set that several tasks laid out counts once
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, int)
        size = np.diff(np.append(start, len(key)))
        df = np.repeat(size, size)
        both = df >= 2
        key, owner, df = key[both], owner[both], df[both]
        order, cuts = by_bucket(owner)
        key, owner, df = key[order], owner[order], df[order]
        often, owner_f, home, sizes = (np.concatenate(x) for x in (often, owners_f, home, sizes))
        order, cuts_f = by_bucket(owner_f)
        often, owner_f = often[order], owner_f[order]
        order, cuts_h = by_bucket(home)
        home, sizes = home[order], sizes[order]
        rows = []
        for b in range(blocks):
            l, f, h = (slice(c[b], c[b + 1]) for c in (cuts, cuts_f, cuts_h))
            (ids, n), (ids_f, n_f) = (np.unique(x, return_counts=True) for x in (owner[l], owner_f[f]))
            if len(ids) or len(ids_f) or h.stop > h.start:
                rows.append((b, block, ids.tobytes(), _planes(n), _six(key[l]), _planes(df[l]), ids_f.tobytes(), _planes(n_f), often[f].tobytes(), home[h].tobytes(), _planes(sizes[h])))
        columns = list(zip(*rows)) if rows else [()] * len(names)
        return pa.table([pa.array(c, k) for c, k in zip(columns, [pa.int32()] * 2 + [pa.binary()] * 9)], names)

    return run, ", ".join(f"{c} {'int' if c in ('bucket', 'block') else 'binary'}" for c in names)


def _rare_first(frequent: np.ndarray, counts: np.ndarray):
    """(set_id, n, grams) of a bucket: each set's size and shared n-grams, the rarest first, ties by hash."""

    def run(group: pa.Table) -> pa.Table:
        owners, grams, dfs, home, sizes = [], [], [], [], []
        for i in range(group.num_rows):
            raw = {c: group.column(c)[i].as_py() for c in group.column_names[1:]}
            owners.append(np.repeat(np.frombuffer(raw["sets"], "<i8"), _of_planes(raw["lights"])))
            grams.append(mix64(_of_six(raw["keys"]) + np.uint64(raw["block"]) * np.uint64(0x9E3779B97F4A7C15 >> 8)))
            dfs.append(_of_planes(raw["dfs"]).astype(np.int64))
            at = np.frombuffer(raw["often"], "<u4")
            owners.append(np.repeat(np.frombuffer(raw["sets_often"], "<i8"), _of_planes(raw["heavies"])))
            grams.append(mix64(frequent[at]))
            dfs.append(counts[at])
            home.append(np.frombuffer(raw["home"], "<i8"))
            sizes.append(_of_planes(raw["sizes"]))
        owner, gram, df = (np.concatenate(x) for x in (owners, grams, dfs))
        order = np.lexsort((gram, df, owner))
        owner, gram = owner[order], gram[order]
        fresh = np.ones(len(owner), dtype=bool)
        fresh[1:] = (gram[1:] != gram[:-1]) | (owner[1:] != owner[:-1])  # frequent ones of a set laid out twice
        owner, gram = owner[fresh], gram[fresh]
        sets, start = np.unique(owner, return_index=True)
        known, first = np.unique(np.concatenate(home), return_index=True)
        n = np.concatenate(sizes)[first][np.searchsorted(known, sets)].astype(np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.append(start, len(owner)).astype(np.int32)), pa.array(gram.view(np.int64)))
        return pa.table([pa.array(sets), pa.array(n), lists], ["set_id", "n", "grams"])

    return run, "set_id long, n long, grams array<long>"


def shared_grams(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(set_id, n, grams) of every set that has n-grams of another one, written: these n-grams, the rarest first."""
    found = rows.where("frequent is not null").select("frequent").mapInArrow(_decoded, "gram long, c long")
    total, sets = rows.agg(F.sum("n"), F.count("set_id")).first()
    # n-grams in at least SHARE of the texts: at most 1/SHARE times the mean size of a set
    often = found.groupBy("gram").agg(F.sum("c").alias("c")).where(F.col("c") >= SHARE * (sets or 0)).toArrow()
    grams, counts = (often.column(i).to_numpy() for i in (0, 1))
    order = np.argsort(grams.view(np.uint64))
    frequent, counts = grams.view(np.uint64)[order], counts[order]
    blocks = max(1, -(-(total or 0) // BLOCK))
    lay, schema = _incidence(blocks, frequent)
    matrix = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(lay, schema)
    shared = matrix.groupBy("block").applyInArrow(*_counted(blocks)).groupBy("bucket").applyInArrow(*_rare_first(frequent, counts))
    return written(shared, "sets")


# ------------------------------------------------------------------ links
def _alike(a: str, b: str) -> Column:
    return (F.col(a) * 100 >= F.col(b) * PERCENT) & (F.col(b) * 100 >= F.col(a) * PERCENT)


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets overlap enough, written."""
    one = sets.select(F.col("set_id").alias("b"), F.col("n").alias("nb"), F.col("grams").alias("gb"))
    two = sets.select(F.col("set_id").alias("a"), F.col("n").alias("na"), F.col("grams").alias("ga"))
    both = pairs.select("a", "b").join(one, "b").join(two, "a")
    overlap = F.size(F.array_intersect("ga", "gb"))
    return written(both.where(overlap * 100 >= (F.col("na") + F.col("nb") - overlap) * PERCENT).select("a", "b"), "links")


def _open_pairs(columns: DataFrame) -> DataFrame:
    """Pairs (a, b), each once, of sets that share a column but not a component and whose sizes and overlap so far allow a link.

    In each column the sets outside its largest component meet all the others, so that a column of one large component and
    few strays costs no more than the strays times the column. The overlap so far is that of the columns in use; what may
    still come is what either set has behind the last of them. A pair counts in its last common column only.
    """
    # of a set's n-grams only those in these columns can be common with a set of another component
    listed = columns.groupBy("set_id").agg(F.sort_array(F.collect_list(F.struct("pos", "gram"))).alias("p"))
    prefix = listed.select("set_id", F.col("p.gram").alias("prefix"))
    top = columns.groupBy("gram", "comp").agg(F.count(F.lit(1)).alias("c")).groupBy("gram").agg(F.max(F.struct("c", "comp")).alias("t"))
    rows = columns.join(top.select("gram", F.col("t.comp").alias("top")), "gram").join(prefix, "set_id")
    names = ["set_id", "comp", "n", "m", "pos", "prefix"]
    a = rows.where("comp <> top").select("gram", *[F.col(c).alias(f"{c}_a") for c in names])
    b = rows.select("gram", "top", *[F.col(c).alias(f"{c}_b") for c in names])

    def may_link(most: Column) -> Column:
        return most * 100 >= (F.col("n_a") + F.col("n_b") - most) * PERCENT

    once = (F.col("comp_b") == F.col("top")) | (F.col("comp_a") < F.col("comp_b"))
    behind = F.least(F.col("m_a") - F.col("pos_a"), F.col("m_b") - F.col("pos_b")) - 1
    at_most = F.least("pos_a", "pos_b") + 1 + behind
    common = F.array_intersect("prefix_a", "prefix_b")
    meet = a.join(b, (a["gram"] == b["gram"]) & (F.col("comp_a") != F.col("comp_b")) & once & _alike("n_a", "n_b") & may_link(at_most)
                  & (F.element_at(common, -1) == a["gram"]) & may_link(F.size(common) + behind))
    return meet.select(F.col("set_id_a").alias("a"), F.col("set_id_b").alias("b"))


def set_components(sets: DataFrame) -> DataFrame:
    """(node, comp) of the sets that link with another one: two sets link when their overlap is at least PERCENT of their
    union.

    Linked sets share one of their rarest n - ceil(n * PERCENT / 100) + 1 n-grams; n-grams that no other set has are of
    no use there. So the product of these columns of the matrix holds every link. Of it a few rounds first take, in each
    column, only the pairs of one set (another one each round) with the sets not yet connected to it. Then all pairs that are
    still in different components are taken, as `_open_pairs` says. Pairs are settled by whole sets. Links inside a
    component are not looked for, as they change nothing.
    """
    need = F.expr(f"(n * {PERCENT} + 99) div 100")
    use = (F.col("n") - need + 1) - (F.col("n") - F.size("grams"))
    rows = sets.where(use > 0).select("set_id", "n", F.size("grams").alias("m"), F.posexplode(F.slice("grams", F.lit(1), use.cast("int"))).alias("pos", "gram"))
    entries = written(rows.withColumn("comp", F.col("set_id")), "entries")
    links = None
    for turn in range(ROUNDS + 1):
        several = entries.groupBy("gram").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("gram")
        mixed = written(entries.join(several, "gram", "left_semi"), "columns")
        if turn < ROUNDS:
            # the set that shares most of itself is likely near the middle of its group; later rounds also try others
            own = 1 - F.col("m") / F.col("n") + F.pmod(F.xxhash64("set_id", F.lit(turn)), F.lit(1000)) * (SPREAD * turn / 1000)
            pick = F.min(F.struct(own, "set_id", "n", "comp")).alias("p")
            picked = mixed.groupBy("gram").agg(pick).select("gram", F.col("p.set_id").alias("a"), F.col("p.n").alias("na"), F.col("p.comp").alias("ca"))
            pairs = mixed.join(picked, "gram").where((F.col("comp") != F.col("ca")) & _alike("n", "na")).select("a", F.col("set_id").alias("b")).distinct()
        else:
            pairs = _open_pairs(mixed)
        new = _linked(pairs, sets)
        links = new if links is None else links.union(new)
        labels = components(links)
        if turn < ROUNDS:
            entries = written(mixed.drop("comp").join(labels, mixed["set_id"] == labels["node"], "left").withColumn("comp", F.coalesce("comp", "set_id")).drop("node"), "entries")
    return labels


def join(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs(doc_id, text): the size of its set of 5-word n-grams and the
    smallest doc_id that links lead to, its own included.

    A null text, an empty one and one without words has an empty set and links with nothing. Texts with equal sets are
    one set, so that copies cost nothing; null ids are never the smallest, and a component of null ids only has a null
    one. An empty table gives an empty result; other columns of docs are not used.
    """
    rows = profiles(docs)
    sets = shared_grams(docs, rows)
    labels = set_components(sets)
    first = rows.where("set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("first"))
    first = first.join(labels, first["set_id"] == labels["node"], "left").select("set_id", "first", F.coalesce("comp", "set_id").alias("comp"))
    first = written(first, "classes")
    smallest = first.groupBy("comp").agg(F.min("first").alias("component_id"))
    of = first.join(smallest, "comp").select("set_id", "component_id")
    out = rows.join(of, "set_id", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


@query("op9_jaccard_join")
def op9_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    """The near-duplicate component of every document."""
    return join(table(spark, folder, "documents").select("doc_id", "text"))
