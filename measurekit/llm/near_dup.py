"""Near-duplicate documents by chosen-path set similarity join.

A document's set is its distinct 5-word shingles. Equal sets are one node from the start. Every other pair is found by trees: at the
root of a tree a few lanes of the minwise signature are selected, and documents with the same minwise token in a selected lane
share a child. A child that is still large and whose documents are not alike branches on by lanes drawn from its own path; small
children are compared exhaustively; large ones of documents that are all alike (branching can't thin them) are compared in
blocks. Independent trees repeat this until a pair at the threshold is missed with probability (1 - 0.75)^LANES at the roots.

Comparing has two rounds. The first proposes a maximum spanning forest of the similar-looking pairs in each node, so that a group of
m near copies costs about m exact checks. The second takes the nodes that still hold more than one group, compares the full sets
of all members of different groups there, and returns a spanning forest of the links it finds. A large node of like documents is cut into
its main group and the rest, its guests: guests are dealt into tables, hosts of the main group are dealt over these tables once, and
full sets are compared at each table, so a node costs as much as it has members. Guests that are not linked there sit down again at
other tables, and those that are left in the end are compared with all members of the node, part by part: this costs guests times
members, of large nodes only. Tables are bounded by rows and by shingles. Only full sets decide. Groups
are joined over links after each round.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from measurekit.llm.shared import Scratch, by_bytes, forest, fresh, lean, linked_groups, mix64, text_bytes

SHINGLE = 5
THRESHOLD = 75                      # percent of the union
SIGNATURE = 64                      # lanes of a signature
TREES = ((0,), (1, 2), (3,), (4,), (5, 6), (7,), (8,), (9, 10))     # lanes selected at the roots: 4/3 = 1 / 0.75 a tree
LANES = sum(map(len, TREES))
SECOND = 7                          # lanes whose nodes the second round goes through: a pair at 0.75 is in none with 0.25^7
LIMIT = 128                         # documents of a node that is compared as a whole
BRANCHES = 2                        # lanes a large node branches by
DEPTH = 6
DENSE = 0.55                        # mean similarity to one of its documents from which a large node no longer branches
LOOSE = 0.5                         # estimated similarity from which a pair is decided exactly: 4.6 standard deviations below 0.75
GUESTS = 64                         # guests at a table
BLOCK = 512                         # hosts at a table
SHINGLES = 1 << 19                  # shingles of the guests, and of the hosts, at a table
ROUNDS = 3                          # times the guests of a large node sit down, the last time with everyone
COLUMNS = 8192

_U = np.uint64
_C1, _C2 = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93)
_rng = np.random.default_rng(20)
_BASE = _U(0xB492B66FBE98F273)
_BACK = _U(pow(0xB492B66FBE98F273, -1, 1 << 64))
_LANE = _rng.integers(1, 1 << 63, SIGNATURE, dtype=np.uint64) * _U(2) + _U(1)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTE[ord("A"):ord("Z") + 1] = _BYTE[ord("a"):ord("z") + 1]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * _C1
    x ^= x >> _U(32)
    x += b
    x *= _C2
    x ^= x >> _U(29)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, _BACK)):
            p = np.full(n, base)
            p[0] = 1
            _POWERS[k] = np.multiply.accumulate(p)
    return _POWERS[0][:n], _POWERS[1][:n]


def shingle_sets(data: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """The set of each text data[at[i]:at[i + 1]] as sorted 64-bit hashes of its shingles."""
    n = len(data)
    none = np.zeros(0, np.uint64)
    if not n:
        return [none] * (len(at) - 1)
    word = ~_SPACE[data]
    before = np.empty(n, bool)
    before[0], before[1:] = False, word[:-1]
    edge = np.zeros(n, bool)
    edge[at[:-1][at[:-1] < n]] = True
    start = np.flatnonzero(word & (~before | edge))
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, word[1:]
    last = np.zeros(n, bool)
    last[at[1:][at[1:] > 0] - 1] = True
    end = np.flatnonzero(word & (~after | last)) + 1
    up, down = _powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * up, out=total[1:])
    words = mix64((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * _C1)
    first = np.searchsorted(start, at)
    grams = words[:max(0, len(words) - SHINGLE + 1)]
    for k in range(1, SHINGLE):
        grams = _pair(grams, words[k:len(words) - SHINGLE + 1 + k])
    out = []
    for s, e in zip(first[:-1].tolist(), first[1:].tolist()):
        if e - s >= SHINGLE:
            out.append(np.unique(grams[s:e - SHINGLE + 1]))
        elif e > s:
            x = np.array([e - s], np.uint64) * _C2
            for k in range(s, e):
                x = _pair(x, words[k:k + 1])
            out.append(x)
        else:
            out.append(none)
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Minwise tokens of non-empty sets: one row of SIGNATURE 32-bit lanes a set."""
    flat = np.concatenate(sets)
    at = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), SIGNATURE), np.uint32)
    for k in range(SIGNATURE):
        out[:, k] = np.minimum.reduceat(flat * _LANE[k], at) >> _U(32)
    return out


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in by_bytes(batches, "data"):
        sets = shingle_sets(*text_bytes(batch.column("data")))
        some = [s for s in sets if len(s)]
        lanes = iter(signatures(some)) if some else iter(())
        sig = [next(lanes).tobytes() if len(s) else None for s in sets]
        key = [int(np.int64(np.add.reduce(mix64(s ^ _C1)).view(np.int64))) if len(s) else None for s in sets]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "doc")), pa.array([len(s) for s in sets], pa.int64()), pa.array(key, pa.int64()), pa.array(sig, pa.binary())],
                                         ["doc_id", "doc", "n", "set", "sig"])


def _lanes(batch: pa.RecordBatch | pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(-1, SIGNATURE)


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            sig, key = _lanes(batch), batch.column("set").to_numpy()
            nodes = [mix64(sig[:, lane].astype(np.uint64) | _U((tree * SIGNATURE + lane + 1) << 32)) for tree, lanes in enumerate(TREES) for lane in lanes]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(nodes).view(np.int64)), pa.array(np.repeat(np.arange(LANES), len(key))), pa.array(np.tile(key, LANES))], ["node", "lane", "set"])


def _branch(branches: int):
    """Members of a node to members of its children: the path, with the token of a lane drawn by it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sig, node = _lanes(batch), batch.column("node").to_numpy().view(np.uint64)
                children = []
                for k in range(branches):
                    path = mix64(node + _U(k + 1) * _C1)
                    token = sig[np.arange(len(node)), LANES + (path % _U(SIGNATURE - LANES)).astype(np.int64)]
                    children.append(_pair(path, token.astype(np.uint64)))
                lane, key = (np.tile(batch.column(c).to_numpy(), branches) for c in ("lane", "set"))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(children).view(np.int64)), pa.array(lane), pa.array(key)], ["node", "lane", "set"])
    return run


def similar_pairs(sig: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (i, j), i < j, that may reach the threshold by signatures and sizes, and the share of equal lanes."""
    found = []
    for s in range(0, len(sig), 64):
        part = slice(s, s + 64)
        share = (sig[part, None, :] == sig[None, :, :]).mean(2)
        small, large = np.minimum(n[part, None], n[None]), np.maximum(n[part, None], n[None])
        i, j = np.nonzero((share >= LOOSE) & (100 * small >= THRESHOLD * large))
        keep = i + s < j
        found.append((i[keep] + s, j[keep], share[i[keep], j[keep]]))
    return tuple(np.concatenate([f[k] for f in found]) for k in range(3))


def _by_group(work: Callable[[pa.Table], tuple[np.ndarray, np.ndarray]], by: str = "group"):
    """Rows sorted by a column, to links (a, b) that `work` finds among the rows of each value; a group holds few rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def links(table: pa.Table) -> pa.RecordBatch:
            key = table.column(by).to_numpy()
            cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]).tolist()
            a, b = zip(*[work(table.slice(s, e - s)) for s, e in zip(cuts, [*cuts[1:], len(key)]) if e - s > 1]) if len(cuts) < len(key) else ((), ())
            a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = (table if rest is None else pa.concat_tables([rest, table])).combine_chunks()
            key = table.column(by).to_numpy()
            other = np.flatnonzero(key != key[-1])
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut:
                yield links(table.slice(0, cut))
            rest = table.slice(cut)
        if rest is not None:
            yield links(rest)
    return run


def _first_round(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """A maximum spanning forest of the similar pairs of a group."""
    key = table.column("set").to_numpy()
    i, j, share = similar_pairs(_lanes(table), table.column("n").to_numpy())
    a, b = np.minimum(key[i], key[j]), np.maximum(key[i], key[j])
    order = np.lexsort((_pair(a.view(np.uint64), b.view(np.uint64)), -share))
    a, b = a[order], b[order]
    keep = forest(a, b) if len(a) else np.zeros(0, bool)
    return a[keep], b[keep]


def common(sets: list[np.ndarray], rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """How many shingles the sets of `rows` and of `columns` have in common: products of 0/1 matrices over slices of the shingles."""
    both = np.concatenate([rows, columns])
    flat = np.concatenate([sets[k] for k in both])
    owner = np.repeat(np.arange(len(both)), [len(sets[k]) for k in both])
    _, code, times = np.unique(flat, return_inverse=True, return_counts=True)
    seen = times[code] > 1
    owner, code = owner[seen], (np.cumsum(times > 1) - 1)[code[seen]]
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    out = np.zeros((len(rows), len(columns)), np.float32)
    for s in range(0, int(code[-1]) + 1 if len(code) else 0, COLUMNS):
        lo, hi = np.searchsorted(code, [s, s + COLUMNS])
        has = np.zeros((len(both), COLUMNS), np.float32)
        has[owner[lo:hi], code[lo:hi] - s] = 1
        out += has[:len(rows)] @ has[len(rows):].T
    return out


def _parts(sets: list[np.ndarray], rows: np.ndarray) -> Iterator[np.ndarray]:
    """The rows in parts of at most BLOCK and of at most SHINGLES shingles, or one."""
    start, held = 0, 0
    for k, row in enumerate(rows.tolist()):
        held += len(sets[row])
        if k > start and (held > SHINGLES or k - start >= BLOCK):
            yield rows[start:k]
            start, held = k, len(sets[row])
    if start < len(rows):
        yield rows[start:]


def _second_round(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between different groups: of guests with all rows, or of all rows where there are no guests."""
    key, root = table.column("set").to_numpy(), table.column("root").to_numpy()
    guest = table.column("guest").to_numpy(zero_copy_only=False)
    sets = [x for part in by_bytes(table.select(["text"]).to_batches(), "text") for x in shingle_sets(*text_bytes(part.column("text")))]
    n = np.array([len(x) for x in sets])
    a, b = [key[:0]], [key[:0]]
    for left in _parts(sets, np.flatnonzero(guest) if guest.any() else np.arange(len(key))):
        for right in _parts(sets, np.arange(len(key))):
            if (root[left][:, None] != root[right][None]).any():
                both = common(sets, left, right)
                i, j = np.nonzero((100 * both >= THRESHOLD * (n[left][:, None] + n[right][None] - both)) & (root[left][:, None] != root[right][None]))
                a.append(key[left[i]])
                b.append(key[right[j]])
    a, b = np.concatenate(a), np.concatenate(b)
    keep = forest(a, b) if len(a) else np.zeros(0, bool)
    return a[keep], b[keep]


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b, text_a, text_b) whose sets reach the threshold."""
    for batch in by_bytes(batches, "text_a", 1 << 17):
        left, right = (shingle_sets(*text_bytes(batch.column(c))) for c in ("text_a", "text_b"))
        both = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(left, right)], np.int64)
        size = np.array([len(x) + len(y) for x, y in zip(left, right)], np.int64)
        linked = pa.array(100 * both >= THRESHOLD * (size - both))
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(linked), batch.column("b").filter(linked)], ["a", "b"])


def _counted(members: DataFrame) -> DataFrame:
    """Members (node, set) of nodes with more than one, with the node's size and smallest set."""
    nodes = members.groupBy("node").agg(F.count("*").alias("size"), F.min("set").alias("leader")).filter("size > 1")
    return members.join(nodes, "node")


def group_near_duplicates(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, doc, n, component_id) of docs(doc_id, doc, data), doc being a key of the row's id and text."""
    signed = scratch.keep(docs.mapInArrow(lean(_sign), "doc_id long, doc long, n long, `set` long, sig binary"), "signed")
    sets = (signed.filter("n > 0").groupBy("set").agg(F.min("doc_id").alias("least"), F.min("doc").alias("doc"), F.min("n").alias("n"), F.min("sig").alias("sig")))
    sets = scratch.keep(sets, "sets")
    lanes = sets.select("set", "n", "sig")

    # trees: small nodes are leaves; large ones branch unless their documents are alike
    # members are written before they are counted and joined with the counts, so each is made once
    members = scratch.keep(sets.select("set", "sig").mapInArrow(lean(_roots), "node long, lane long, `set` long"), "roots")
    level = scratch.keep(_counted(members), "level-0")
    scratch.drop("roots")
    leaves, dense = [level.filter(F.col("size") <= LIMIT)], []
    for depth in range(DEPTH):
        large = level.filter(F.col("size") > LIMIT)
        if large.isEmpty():
            break
        large = scratch.keep(large.join(lanes.select("set", "sig"), "set"), f"large-{depth}")
        leader = large.filter("`set` = leader").select("node", F.col("sig").alias("leader_sig"))
        shares = large.join(leader, "node").select("node", "sig", "leader_sig").mapInArrow(lean(_alike), "node long, share double")
        mean = shares.groupBy("node").agg(F.avg("share").alias("mean"))
        nodes = scratch.keep(mean.select("node", ((F.col("mean") >= DENSE) | F.lit(depth == DEPTH - 1)).alias("dense")), f"nodes-{depth}")
        dense.append(large.join(nodes.filter("dense"), "node").select(*level.columns))
        thin = large.join(nodes.filter("NOT dense"), "node").select("node", "lane", "set", "sig").mapInArrow(lean(_branch(BRANCHES)), "node long, lane long, `set` long")
        level = scratch.keep(_counted(scratch.keep(thin, f"children-{depth}")), f"level-{depth + 1}")
        scratch.drop(f"children-{depth}")
        leaves.append(level.filter(F.col("size") <= LIMIT))
    tail = leaves[0]
    for part in leaves[1:]:
        tail = tail.unionByName(part)
    tail = tail.select("node", "lane", "set", "size", "leader")
    big = None
    for part in dense:
        big = part if big is None else big.unionByName(part)

    # first round
    spread = F.pow(F.lit(2), F.ceil(F.log2(F.col("size") / LIMIT))).cast("long")
    groups = tail.select(F.xxhash64("node").alias("group"), "set")
    if big is not None:
        blocks = big.select(F.xxhash64("node", F.pmod(F.xxhash64("set"), spread)).alias("group"), "set")
        chairs = big.filter("`set` = leader").select("node", "set", F.explode(F.sequence(F.lit(0).cast("long"), spread - 1)).alias("block")).select(F.xxhash64("node", "block").alias("group"), "set")
        groups = groups.union(blocks.union(chairs).distinct())
    pairs = _compared(groups.join(lanes, "set"), _first_round)
    pairs = scratch.keep(pairs.distinct(), "pairs-1")
    ends = pairs.selectExpr("a AS `set`").union(pairs.selectExpr("b AS `set`")).distinct()
    # in a large node of like documents the first round sees blocks, so a set may be like none there and yet like one elsewhere
    compared = ends if big is None else ends.union(big.filter(F.col("lane") < SECOND).select("set")).distinct()
    wanted = compared.join(sets.select("set", "doc"), "set")
    texts = wanted.join(docs.select("doc", "data"), "doc").groupBy("doc", "set").agg(F.first("data").alias("data")).select("set", F.col("data").alias("text"))
    texts = scratch.keep(texts, "texts")
    links = scratch.keep(_decided(pairs, texts), "links-1")
    roots = linked_groups(scratch, links, "groups-1")

    # second round: only where a node holds more than one group
    rooted = lambda m: m.join(roots.withColumnRenamed("id", "set"), "set", "left").withColumn("root", F.coalesce("root", "set"))
    tail = rooted(tail.filter(F.col("lane") < SECOND).join(ends, "set"))
    mixed = tail.groupBy("node").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("node")
    rows = tail.join(mixed, "node").select(F.xxhash64("node").alias("group"), "set", "root", F.lit(False).alias("guest"))
    if big is not None:
        big = big.filter(F.col("lane") < SECOND).join(sets.select("set", "n"), "set").select("node", "set", "n")
        seated, unmet = _seated(scratch, rooted(big), 0)
        rows = rows.union(seated)
    links = links.union(scratch.keep(_compared(rows.join(texts, "set"), _second_round).distinct(), "links-2"))
    roots = linked_groups(scratch, links, "groups-2")

    # a guest has met the hosts of its table only: what is still no part of the main group meets others, at last everyone
    for k in range(1, ROUNDS if big is not None else 1):
        if unmet.isEmpty():
            break
        seated, unmet = _seated(scratch, rooted(unmet), k)
        more = scratch.keep(_compared(seated.join(texts, "set"), _second_round).distinct(), f"links-{k + 2}")
        if not more.isEmpty():
            links = links.union(more)
            roots = linked_groups(scratch, links, f"groups-{k + 2}")

    named = sets.select("set", "least").join(roots.withColumnRenamed("id", "set"), "set", "left").withColumn("root", F.coalesce("root", "set"))
    named = scratch.keep(named, "named")
    scratch.drop_others("signed", "named")
    named = named.join(named.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("set", "component_id")
    out = signed.select("doc_id", "doc", "n", "set").join(named, "set", "left")
    return out.select("doc_id", "doc", "n", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _seated(scratch: Scratch, members: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Members (node, set, n, root) of large nodes with more than one group as rows (group, set, root, guest) to compare in round k, and the
    members (node, set, n) of nodes whose groups have not met in full yet. In small nodes, and in the last round in all, guests meet everyone."""
    of = members.groupBy("node", "root").agg(F.count("*").alias("members"), F.sum("n").alias("shingles")).groupBy("node").agg(
        F.max(F.struct("members", "root", "shingles")).alias("main"), F.sum("members").alias("all"), F.sum("shingles").alias("shingles"))
    most, rest, long = F.col("main.members"), F.col("all") - F.col("main.members"), F.col("shingles") - F.col("main.shingles")
    of = of.filter(rest > 0).withColumn("tables", F.greatest(F.ceil(rest / GUESTS), F.ceil(long / SHINGLES)))
    of = of.select("node", F.col("main.root").alias("main"), "tables", F.greatest(
        F.ceil(most / F.col("tables") / BLOCK), F.ceil(F.col("main.shingles") / F.col("tables") / SHINGLES)).alias("blocks"),
        (F.lit(k == ROUNDS - 1) | (F.col("all") <= 2 * LIMIT)).alias("whole"),
        F.ceil(F.greatest(2 * most / BLOCK, 2 * F.col("main.shingles") / SHINGLES)).alias("hosts"), F.ceil(F.greatest(2 * rest / BLOCK, 2 * long / SHINGLES)).alias("guests"))
    at = F.xxhash64("set", "node", F.lit(k))
    placed = members.join(of, "node").withColumn("guest", F.col("root") != F.col("main")).withColumn("table", F.pmod(at, "tables"))
    placed = placed.withColumn("part", F.pmod(at, F.when(F.col("guest"), F.col("guests")).otherwise(F.col("hosts"))))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    # a host sits at one block of one table, a guest at all blocks of its table; in full, a part of guests meets every part
    block = F.when(F.col("guest"), upto(F.col("blocks"))).otherwise(F.array(F.pmod(F.xxhash64("node", "set"), "blocks")))
    whole = F.when(F.col("guest"), upto(F.col("hosts") + F.col("guests"))).otherwise(upto(F.col("guests")))
    placed = scratch.keep(placed.withColumn("to", F.when(F.col("whole"), whole).otherwise(block)), f"placed-{k}")
    seats, to = placed.withColumn("to", F.explode("to")), F.col("to")
    other = to - F.col("hosts")                             # of a guest: the part of guests it meets, below 0 one of hosts
    cell = (F.when(~F.col("whole"), F.xxhash64("node", "table", "to")).when(~F.col("guest"), F.xxhash64("node", F.lit("hosts"), "to", "part"))
            .when(other < 0, F.xxhash64("node", F.lit("hosts"), "part", "to")).otherwise(F.xxhash64("node", F.lit("guests"), F.least("part", other), F.greatest("part", other))))
    left = F.col("guest") & (~F.col("whole") | (other < 0) | (F.col("part") < other))
    return seats.select(cell.alias("group"), "set", "root", left.alias("guest")), placed.filter("NOT whole AND tables > 1").select("node", "set", "n")


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The share of lanes in which a member equals its node's leader."""
    for batch in batches:
        if batch.num_rows:
            left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, SIGNATURE) for c in ("sig", "leader_sig"))
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array((left == right).mean(1))], ["node", "share"])


def _compared(rows: DataFrame, work: Callable[[pa.Table], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    return rows.repartition("group").sortWithinPartitions("group").mapInArrow(lean(_by_group(work)), "a long, b long")


def _decided(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    side = lambda k: texts.select(F.col("set").alias(k), F.col("text").alias(f"text_{k}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(lean(_decide), "a long, b long")


def near_duplicates(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, doc, n, component_id), one row per row of docs; doc is a 64-bit key of the row's id and text.

    A null text and one without words has no shingles and links with nothing. Rows with one id are one document of that id; a null
    id is the smallest of a component only if all its ids are null. Equal sets are known by a 64-bit sum of their shingles' hashes.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(doc_id), F.col(text)).alias("doc"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("data"))
    return group_near_duplicates(rows, Scratch(docs.sparkSession, "near"))


def keep_one_of_each(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The documents with one of each near-duplicate group, all columns as they came: the one with the component's id, and of several
    rows with that id one. Documents without words all stay."""
    scratch = Scratch(docs.sparkSession, "near-keep")
    found = near_duplicates(docs, text=text, doc_id=doc_id)
    # a component's first row by id and key; ids may be null
    best = found.filter("n > 0").groupBy("component_id").agg(F.min(F.struct("doc_id", "doc")).alias("one"))
    stays = scratch.keep(best.select("one.doc").withColumn("once", F.lit(True)).union(found.filter("n = 0").select("doc", F.lit(False)).distinct()), "stays")
    key, once, at = fresh(docs, "row_key", "row_once", "row_at")
    rows = docs.withColumn(key, F.xxhash64(F.col(doc_id), F.col(text))).join(stays.select(F.col("doc").alias(key), F.col("once").alias(once)), key)
    rows = rows.withColumn(at, F.row_number().over(Window.partitionBy(key).orderBy(once)))
    return rows.filter(~F.col(once) | (F.col(at) == 1)).select(*docs.columns)


def op7_minhash_neardup(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
