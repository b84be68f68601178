"""Merkle manifest of a dataset, with nested-interval labels.

Rows are leaves, ranked inside their group. A node carries the interval of leaf ranks it covers: level k cuts a group's ranks at
multiples of run^k, so an interval contains another exactly if its node is an ancestor, and a node's siblings are the intervals that
are left when its own is taken from its parent's. No tree is ever walked: intervals are joined.

Levels are cut into buckets of LEVELS levels. Upwards, the nodes of one bucket of ranks give all nodes over them in one step, at most
run^LEVELS nodes at a time. Downwards, the nodes at the foot of a bucket join the siblings in it by containment of intervals, and
take the proof of the bucket's top, which the step before made. Both directions shuffle each node once; the rows themselves are
dealt once by range (for ranks) and once by bucket. The groups' subroots are then the leaves of one more tree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from measurekit.llm.shared import Scratch, fresh

RUN = 2                             # consecutive nodes under one parent
LEVELS = 6                          # levels built and joined in one step: at most RUN ** LEVELS nodes in one place
TAMPERED = 7                        # the registered query tampers with rows whose crc32 this divides

_PLACE_BITS = 33                    # monotonically_increasing_id: the partition above, the place in it below


def leaf_digest(*fields: Column) -> Column:
    """Sha-256 (32 bytes) of fields end to end: `-` for null, else the number of UTF-8 bytes, `:` and the value."""
    def cell(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.unhex(F.sha2(F.concat(*map(cell, fields)).cast("binary"), 256))


def hex_text(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def proof_text(proof: Column) -> Column:
    """The siblings' digests as hex text, level by level, left to right."""
    return F.array_join(F.transform(proof, lambda p: F.concat(hex_text(p["left"]), hex_text(p["right"]))), "")


def fold(leaf: Column, proof: Column) -> Column:
    """The root (hex text) that a leaf digest and a proof lead to."""
    def up(below: Column, p: Column) -> Column:
        return F.sha2(F.concat(hex_text(p["left"]), below, hex_text(p["right"])).cast("binary"), 256)

    return F.aggregate(proof, hex_text(leaf), up)


def _ranked(scratch: Scratch, rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """rows with tree (number of the group in ascending order, null first), n (rows of the group) and lo (rank in it, from 0).

    Rows are dealt by range, so that neither a large group nor many groups meet in one task; a rank is the place in the range plus the rows of
    the group in ranges before. The order must tell all rows apart.
    """
    spread = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("place", F.monotonically_increasing_id())
    spread = scratch.keep(spread, f"{name}-spread").withColumn("part", F.shiftright("place", _PLACE_BITS))
    counted = spread.groupBy(group, "part").agg(F.min("place").alias("first"), F.count("*").alias("rows"))
    whole = Window.partitionBy(group)
    before = F.coalesce(F.sum("rows").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # one row per group and range it reaches into
    counted = scratch.keep(counted.select(group, "part", "first", F.sum("rows").over(whole).alias("n"), before.alias("before")), f"{name}-counted")
    starts = counted.filter("before = 0")
    per_part = starts.groupBy("part").count()               # one row per range
    earlier = per_part.select("part", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    trees = (starts.join(earlier, "part")
             .select(F.col(group).alias("of"), (F.col("earlier") + F.row_number().over(Window.partitionBy("part").orderBy(group)) - 1).alias("tree")))
    numbered = counted.join(trees, counted[group].eqNullSafe(trees["of"])).drop("of")
    numbered = numbered.select(F.col(group).alias("of"), F.col("part").alias("in"), "first", "n", "before", "tree")
    ranked = spread.join(numbered, spread[group].eqNullSafe(numbered["of"]) & (spread["part"] == numbered["in"]))
    ranked = ranked.select(*rows.columns, "tree", "n", (F.col("before") + F.col("place") - F.col("first")).alias("lo"))
    ranked = scratch.keep(ranked, f"{name}-ranked")
    scratch.drop(f"{name}-spread", f"{name}-counted")
    return ranked


def _grow(nodes: DataFrame, base: int, run: int, levels: int) -> DataFrame:
    """The nodes (tree, n, lo, hi, digest) of level `base` and those over them, up to `levels` levels, with their level and interval."""
    reach = run ** (base + levels)

    def subtree(tree: int, n: int, lows: list[int], digests: list[bytes], out: list[list]) -> None:
        alone = n <= reach                                  # the group's last bucket: it ends where one node remains
        level, width = base, run ** base
        while True:
            for lo, digest in zip(lows, digests):
                for column, value in zip(out, (tree, n, level, lo, min(lo + width, n), digest)):
                    column.append(value)
            if level == base + levels or alone and len(lows) == 1:
                return
            texts = [d.hex() for d in digests]
            digests = [hashlib.sha256("".join(texts[k:k + run]).encode()).digest() for k in range(0, len(texts), run)]
            lows, level, width = lows[::run], level + 1, width * run

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, lows, digests = None, [], []
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for tree, n, lo, digest in zip(*(batch.column(c).to_pylist() for c in ("tree", "n", "lo", "digest"))):
                if key is not None and key[:2] != (tree, lo // reach):
                    subtree(key[0], key[2], lows, digests, out)
                    lows, digests = [], []
                key = tree, lo // reach, n
                lows.append(lo)
                digests.append(digest)
            yield _nodes(out)
        if key is not None:
            out = [[] for _ in range(6)]
            subtree(key[0], key[2], lows, digests, out)
            yield _nodes(out)

    dealt = nodes.select("tree", "n", "lo", "digest", F.expr(f"lo div {reach}").alias("bucket"))
    dealt = dealt.repartition("tree", "bucket").sortWithinPartitions("tree", "bucket", "lo")
    return dealt.mapInArrow(work, "tree long, n long, level int, lo long, hi long, digest binary")


def _nodes(out: list[list]) -> pa.RecordBatch:
    kinds = pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds)], ["tree", "n", "level", "lo", "hi", "digest"])


def _siblings(nodes: DataFrame, run: int, top: int) -> DataFrame:
    """For each node below level `top` and below the top of its group: what its parent's interval holds left and right of its own."""
    parent = F.expr(f"lo div cast(power({run}, level + 1) as bigint)").alias("parent")
    under = nodes.filter(f"level < {top} AND hi - lo < n").groupBy("tree", "level", parent)
    under = under.agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "digest"))).alias("children"))
    each = under.select("tree", "level", "children", F.explode("children").alias("c"))

    def rest(outside) -> Column:
        return F.aggregate(F.filter("children", outside), F.lit(b""), lambda acc, x: F.concat(acc, x["digest"]))

    return each.select("tree", "level", F.col("c.lo").alias("from"), F.col("c.hi").alias("to"),
                       rest(lambda x: x["hi"] <= F.col("c.lo")).alias("left"), rest(lambda x: x["lo"] >= F.col("c.hi")).alias("right"))


def _proofs(scratch: Scratch, leaves: DataFrame, run: int, levels: int, name: str) -> tuple[DataFrame, DataFrame]:
    """(leaves with their proof up to the top of their group, tops (tree, digest)); leaves: tree, n, lo, digest and a payload."""
    most = leaves.agg(F.max("n")).first()[0] or 0           # one number: how many buckets of levels there are
    nodes, feet, tops = [], [], leaves.filter("n = 1").select("tree", "digest")
    foot, base = leaves.select("tree", "n", "lo", "digest"), 0
    while run ** base < most:
        grown = scratch.keep(_grow(foot.filter(F.col("n") > run ** base), base, run, levels), f"{name}-nodes-{base}")
        tops = tops.union(grown.filter((F.col("lo") == 0) & (F.col("hi") == F.col("n")) & (F.col("n") > run ** base)).select("tree", "digest"))
        nodes.append((base, grown))
        base += levels
        foot = grown.filter(F.col("level") == base).select("tree", "n", "lo", "digest")
        feet.append(foot)
    above = None
    for k, (base, grown) in reversed(list(enumerate(nodes))):
        lower = leaves if k == 0 else feet[k - 1].filter(F.col("n") > run ** base).withColumn("payload", F.lit(None))
        above = _attach(lower, _siblings(grown, run, base + levels), above, base, run, levels)
        if k:
            above = scratch.keep(above.select("tree", F.expr(f"lo div {run ** base}").alias("at"), F.col("proof").alias("upper")), f"{name}-proofs-{base}")
    if above is None:
        above = leaves.withColumn("proof", F.expr("cast(array() as array<struct<left: binary, right: binary>>)"))
    return above, tops


def _attach(lower: DataFrame, siblings: DataFrame, above: DataFrame | None, base: int, run: int, levels: int) -> DataFrame:
    """Nodes of level `base` with their proof: the siblings of all ancestors inside the bucket, then the proof of the bucket's top."""
    reach = run ** (base + levels)
    low = lower.withColumn("bucket", F.expr(f"lo div {reach}")).alias("low")
    side = siblings.withColumn("bucket", F.expr(f"`from` div {reach}")).alias("side")
    inside = ((F.col("low.tree") == F.col("side.tree")) & (F.col("low.bucket") == F.col("side.bucket"))
              & (F.col("side.from") <= F.col("low.lo")) & (F.col("low.lo") < F.col("side.to")))
    step = F.when(F.col("side.level").isNotNull(), F.struct("side.level", "side.left", "side.right"))
    found = (low.join(side, inside, "left").groupBy("low.tree", "low.bucket", "low.lo")
             .agg(F.first("low.n").alias("n"), F.first("low.digest").alias("digest"), F.first("low.payload").alias("payload"),
                  F.sort_array(F.collect_list(step)).alias("steps")))
    found = found.withColumn("proof", F.transform("steps", lambda s: F.struct(s["left"].alias("left"), s["right"].alias("right")))).drop("steps")
    if above is not None:
        found = found.join(above.withColumnRenamed("at", "bucket"), ["tree", "bucket"], "left")
        found = found.withColumn("proof", F.when(F.col("upper").isNull(), F.col("proof")).otherwise(F.concat("proof", "upper"))).drop("upper")
    return found.drop("bucket")


def manifest(rows: DataFrame, *, leaf: str, group: str, order: str, run: int = RUN, levels: int = LEVELS) -> DataFrame:
    """Adds merkle_subroot, merkle_root (binary) and merkle_proof (array of left, right) to the rows, under names no column has.

    leaf names a binary column with the rows' digests. Leaves of one group ascend by the order column; each `run` consecutive nodes (the last run may be
    shorter) are replaced by the sha-256 of their digests as hex text until one remains, the subroot; subroots, ordered by group, give the root in the
    same way. A proof lists, from the leaf up to the root, the digests left and right of the node in its run; both are empty for a node alone.

    A null group is a group of its own, first in order. A null in the order column comes first; rows that tie are ordered by their digest, and
    equal rows take consecutive ranks, each with a proof of its own. A null leaf counts as 32 zero bytes. An empty table has no rows and no root.
    The result reads tables under `spark.checkpoint.dir`, which are written when this function is called.
    """
    names = fresh(rows, "merkle_subroot", "merkle_root", "merkle_proof")
    scratch = Scratch(rows.sparkSession, "merkle")
    zero = F.lit(bytes(32))
    plain = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("payload"))
    plain = plain.select("payload", F.col("payload")[group].alias("of_group"), F.col("payload")[order].alias("by"),
                         F.coalesce(F.col("payload")[leaf], zero).alias("digest"), F.monotonically_increasing_id().alias("row"))
    plain = scratch.keep(plain, "leaves")
    leaves = _ranked(scratch, plain, "of_group", ["by", "digest", "row"], "rank").drop("by", "row")
    scratch.drop("leaves")
    proofs, tops = _proofs(scratch, leaves.drop("of_group"), run, levels, "group")
    # the subroots are numbered in the order of their groups, so a tree's number is its rank among them
    tops = scratch.keep(tops, "tops")
    count = tops.count()
    upper = tops.select(F.lit(0).cast("long").alias("tree"), F.lit(count).cast("long").alias("n"), F.col("tree").alias("lo"), "digest", F.lit(None).alias("payload"))
    subroots, root = _proofs(scratch, upper, run, levels, "upper")
    subroots = subroots.join(root.select("tree", F.col("digest").alias("root")), "tree")
    subroots = scratch.keep(subroots.select(F.col("lo").alias("tree"), F.col("digest").alias("subroot"), "root", F.col("proof").alias("rest")), "subroots")
    out = proofs.join(subroots, "tree")
    return out.select("payload.*", F.col("subroot").alias(names[0]), F.col("root").alias(names[1]), F.concat("proof", "rest").alias(names[2]))


def op11_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED == 0
    cells = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    changed = [F.col("n_chars") + 1 if k == 3 else c for k, c in enumerate(cells)]
    leaves = docs.select("doc_id", "lang", leaf_digest(*cells).alias("leaf"), F.when(tampered, leaf_digest(*changed)).alias("changed"))
    made = manifest(leaves, leaf="leaf", group="lang", order="doc_id")
    folded = fold(F.coalesce("changed", "leaf"), F.col("merkle_proof"))
    out = made.select("doc_id", hex_text(F.col("leaf")).alias("leaf"), hex_text(F.col("merkle_subroot")).alias("subroot"), hex_text(F.col("merkle_root")).alias("root"),
                      F.sha2(proof_text(F.col("merkle_proof")).cast("binary"), 256).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


_CELLS = {c: f"coalesce(strlen({v}::varchar) || ':' || {v}::varchar, '-')" for c, v in
          {"doc_id": "doc_id", "source": "source", "lang": "lang", "n_chars": "n_chars", "changed": "(n_chars + 1)", "text": "text"}.items()}

# crc32 bit by bit over the digits: a value below 0 is one shift
_CRC = """xor(4294967295, list_reduce(list_concat([4294967295::bigint], flatten(list_transform(string_split(doc_id::varchar, ''),
    lambda d: [ascii(d)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"""

SQL = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g,
         sha256({" || ".join(_CELLS[c] for c in ("doc_id", "source", "lang", "n_chars", "text"))}) AS leaf,
         CASE WHEN doc_id IS NOT NULL AND ({_CRC}) % {TAMPERED} = 0
              THEN sha256({" || ".join(_CELLS[c] for c in ("doc_id", "source", "lang", "changed", "text"))}) END AS changed
  FROM documents),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM leaves),
nodes AS (
  SELECT g, 0 AS lvl, i, n, leaf AS h FROM ranked
  UNION ALL
  SELECT g, lvl + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY g, lvl, i // 2, n),
tops AS (SELECT g, h FROM nodes WHERE n = 1),
upper_nodes AS (
  SELECT 0 AS lvl, g AS i, count(*) OVER () AS n, h FROM tops
  UNION ALL
  SELECT lvl + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM upper_nodes WHERE n > 1 GROUP BY lvl, i // 2, n),
steps AS (
  SELECT r.g, r.i, a.lvl, s.h AS sibling, s.i < a.i AS is_left
  FROM ranked r JOIN nodes a ON a.g = r.g AND a.n > 1 AND a.i = r.i >> a.lvl
  LEFT JOIN nodes s ON s.g = a.g AND s.lvl = a.lvl AND s.i = xor(a.i, 1)
  UNION ALL
  SELECT r.g, r.i, 1000 + a.lvl, s.h, s.i < a.i
  FROM ranked r JOIN upper_nodes a ON a.n > 1 AND a.i = r.g >> a.lvl
  LEFT JOIN upper_nodes s ON s.lvl = a.lvl AND s.i = xor(a.i, 1)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY g, i ORDER BY lvl) AS step FROM steps),
folds AS (
  SELECT g, i, 0::bigint AS step, coalesce(changed, leaf) AS h FROM ranked
  UNION ALL
  SELECT f.g, f.i, s.step, sha256(CASE WHEN s.is_left THEN s.sibling ELSE '' END || f.h || CASE WHEN s.is_left = false THEN s.sibling ELSE '' END)
  FROM folds f JOIN numbered s ON s.g = f.g AND s.i = f.i AND s.step = f.step + 1),
folded AS (SELECT g, i, arg_max(h, step) AS h FROM folds GROUP BY g, i),
proofs AS (SELECT g, i, string_agg(coalesce(sibling, ''), '' ORDER BY lvl) AS p FROM steps GROUP BY g, i)
SELECT r.doc_id, r.leaf, t.h AS subroot, u.h AS root, sha256(coalesce(p.p, '')) AS proof_sha256, f.h AS folded_root, f.h = u.h AS verified
FROM ranked r JOIN tops t ON t.g = r.g JOIN upper_nodes u ON u.n = 1 JOIN folded f ON f.g = r.g AND f.i = r.i LEFT JOIN proofs p ON p.g = r.g AND p.i = r.i
"""
