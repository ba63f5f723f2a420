"""Merkle manifest of a data set, by slot pivots.

A leaf is the hash of a row's fields. Leaves of a group lie in ascending order
of doc_id; every `fanout` consecutive nodes have one parent, the hash of their
concatenated digests, until one node is left, the group's subroot. Subroots in
the order of their groups make the top tree and its root.

1. Leaves are written once, then put in order by sampled ranges
   (common.ordered): a group of any size is spread over many ranges, and
   repeated rows are told apart by a stored number.
2. Slot pivot: conditional aggregates spread each parent's children into
   `fanout` columns c0, c1, ...; hashing their concatenation gives the parent.
   A level has one row per parent, so the levels shrink by the fanout.
3. Proofs go down again: a parent hands every child its own path, to which the
   columns left and right of the child's slot are prepended. Leaves sit in the
   columns of the lowest level, which is joined with the level above only; no
   join repeats the leaves.
4. Folding a leaf along its path gives the root it belongs to.

Defined cases: a null field is written `-`; rows without doc_id come first in
their group, rows that agree in doc_id are ordered by their leaf; a group of
one leaf has the leaf as its subroot; an empty table gives no rows; columns
that are not among the fields are ignored.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import CAPITALS, SMALL, beside, lowered, ordered, stored
from .registry import query, table

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEP = "array<struct<left:string,right:string>>"


def hashed(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf_of(columns: dict[str, Column]) -> Column:
    """Hash of the fields: `-` for null, else byte count, colon and value."""
    def field(value: Column) -> Column:
        value = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"),
                                   F.lit(":"), value), F.lit("-"))
    return hashed(F.concat(*(field(c) for c in columns.values())))


def group_key(group: Column) -> Column:
    """A text that orders like the group, null first, and is never null."""
    return F.coalesce(F.concat(F.lit(":"), group.cast("string")), F.lit(""))


def slots(fanout: int) -> list[str]:
    return [f"c{s}" for s in range(fanout)]


def pivoted(nodes: DataFrame, fanout: int) -> DataFrame:
    """key, idx, n, c0.., digest: the parents of key, idx, n, node.

    node is a struct whose first field is the digest; n counts the nodes of
    the key on its level.
    """
    slot = F.col("idx") % fanout
    digests = [F.coalesce(F.col(c)["digest"], F.lit(""))
               for c in slots(fanout)]
    return (nodes.groupBy("key", F.expr(f"idx div {fanout}").alias("idx"))
            .agg(F.ceil(F.max("n") / fanout).alias("n"),
                 *(F.max(F.when(slot == s, F.col("node"))).alias(c)
                   for s, c in enumerate(slots(fanout))))
            .withColumn("digest", hashed(F.concat(*digests))))


def step(slot: Column, fanout: int, names: list[str]) -> Column:
    """(left, right): all slot columns but the own one, concatenated."""
    def side(keep) -> Column:
        return F.concat(*(F.when(keep(s), F.coalesce(
            F.col(c)["digest"], F.lit(""))).otherwise("")
            for s, c in enumerate(names)))
    return F.struct(side(lambda s: slot > s).alias("left"),
                    side(lambda s: slot < s).alias("right"))


def levels_of(nodes: DataFrame, most: int, fanout: int) -> list[DataFrame]:
    """Stored levels above nodes (key, idx, n, node), lowest first.

    most: the largest n. A key takes part up to its last single node.
    """
    levels = []
    while most > 1:
        level = stored(pivoted(nodes.filter("n > 1"), fanout), "level")
        levels.append(level)
        nodes = level.select("key", "idx", "n", F.struct("digest")
                             .alias("node"))
        most = -(-most // fanout)
    return levels


def with_paths(levels: list[DataFrame], top: DataFrame, fanout: int
               ) -> DataFrame | None:
    """The lowest level with the path of each of its rows.

    top: key, path of the keys' last nodes. Each level is joined with the one
    above it, an eighth of its rows at a fanout of eight.
    """
    above, names = None, slots(fanout)
    for level in reversed(levels):
        found = level.filter("n = 1").join(beside(top), "key")
        if above is not None:
            outer = [f"u{c}" for c in names]
            upper = above.select(
                "key", F.col("idx").alias("up"), F.col("path").alias("rest"),
                *(F.col(c).alias(u) for c, u in zip(names, outer,
                                                    strict=True)))
            inner = (level.filter("n > 1").withColumn(
                "up", F.expr(f"idx div {fanout}")).join(upper, ["key", "up"]))
            found = found.unionByName(inner.select(*level.columns, F.concat(
                F.array(step(F.col("idx") % fanout, fanout, outer)), "rest")
                .alias("path")))
        above = stored(found, "paths")
    return above


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf has under the siblings of a path."""
    return F.aggregate(path, leaf, lambda acc, s: hashed(
        F.concat(s["left"], acc, s["right"])))


def siblings(path: Column) -> Column:
    """All sibling digests of a path, level by level, left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(
        s["left"], s["right"])), "")


def manifest(docs: DataFrame, group: str = "lang", fanout: int = 8,
             changed: Column | None = None) -> DataFrame:
    """doc_id, leaf, other, subroot, root, path of every row of docs.

    path: array of (left, right), from the leaf's level to the root. other:
    the leaf of the row with `changed` for its text (null where that is null).
    """
    now = {c: F.col(c) for c in FIELDS}
    other = F.lit(None).cast("string") if changed is None else F.when(
        changed.isNotNull(), leaf_of(now | {"text": changed}))
    rows = stored(docs.select(
        group_key(F.col(group)).alias("key"),
        F.col("doc_id").cast("long").alias("doc_id"),
        leaf_of(now).alias("leaf"), other.alias("other"),
        F.monotonically_increasing_id().alias("tie")), "leaves")
    placed = ordered(rows, ["key", "doc_id", "leaf", "tie"], "ordered")
    groups = stored(placed.groupBy("key").agg(
        F.min("pos").alias("base"), F.count("*").alias("n")), "groups")
    most = groups.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    nodes = (placed.join(beside(groups), "key").select(
        "key", (F.col("pos") - F.col("base")).alias("idx"), "n",
        F.struct(F.col("leaf").alias("digest"), "doc_id", "other", "tie")
        .alias("node")))
    levels = levels_of(nodes, most, fanout)
    single = nodes.filter("n = 1")
    subroots = single.select("key", F.col("node.digest").alias("subroot"))
    for level in levels:
        subroots = subroots.unionByName(level.filter("n = 1").select(
            "key", F.col("digest").alias("subroot")))
    subroots = stored(subroots, "subroots")

    # the top tree has one row per group, in the groups' order
    upper = ordered(subroots, ["key"], "groups-ordered")
    count = subroots.count()
    top_nodes = upper.select(
        F.lit("").alias("key"), F.col("pos").alias("idx"),
        F.lit(count).cast("long").alias("n"),
        F.struct(F.col("subroot").alias("digest"), F.col("key").alias("name"))
        .alias("node"))
    top_levels = levels_of(top_nodes, count, fanout)
    none = F.array().cast(STEP)
    if top_levels:
        origin = docs.sparkSession.range(1).select(
            F.lit("").alias("key"), none.alias("path"))
        lowest = with_paths(top_levels, origin, fanout)
        tops = opened(lowest, fanout).select(
            F.col("node.name").alias("key"),
            F.col("node.digest").alias("subroot"), "path")
        root = top_levels[-1].first()["digest"]
    else:
        tops = subroots.withColumn("path", none)
        root = subroots.agg(F.max("subroot")).first()[0]
    tops = stored(tops.withColumn("root", F.lit(root).cast("string")), "tops")

    tip = tops.select("key", "path")
    found = single.join(beside(tip), "key").select("key", "node", "path")
    lowest = with_paths(levels, tip, fanout)
    if lowest is not None:
        found = found.unionByName(opened(lowest, fanout))
    return (found.join(beside(tops.select("key", "subroot", "root")), "key")
            .select("node.doc_id", F.col("node.digest").alias("leaf"),
                    "node.other", "subroot", "root", "path"))


def opened(level: DataFrame, fanout: int) -> DataFrame:
    """key, node, path of the children that the slots of a level hold."""
    children = F.array(*(F.struct(
        F.col(c).alias("node"),
        F.concat(F.array(step(F.lit(s), fanout, slots(fanout))), "path").alias("path"))
        for s, c in enumerate(slots(fanout))))
    return (level.select("key", F.explode(children).alias("child"))
            .filter("child.node IS NOT NULL")
            .select("key", "child.node", "child.path"))


def sql_field(value: str) -> str:
    return (f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || "
            f"CAST({value} AS VARCHAR), '-')")


def sql_leaf(text: str) -> str:
    return "sha256(concat(%s))" % ", ".join(map(sql_field, (*FIELDS[:-1],
                                                            text)))


#: crc32 of the decimal doc_id, bit by bit.
SQL_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::UBIGINT,
    list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
                   lambda x: ord(x)::UBIGINT)),
    lambda c, x: list_reduce(list_prepend(xor(c, x),
        [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda y, z: xor(y >> 1,
            3988292384::UBIGINT * (y & 1)))))"""

#: Every level of every tree as (key, level, idx, n, h); langs, then the top.
ORACLE = f"""
    WITH RECURSIVE d AS (
        SELECT doc_id, coalesce(':' || lang, '') AS key,
               {sql_leaf("text")} AS leaf,
               CASE WHEN {SQL_CRC} % 3 = 0 THEN {sql_leaf(
                   f"translate(text, '{CAPITALS}', '{SMALL}')")}
               ELSE {sql_leaf("text")} END AS other FROM documents),
    l AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY
                    doc_id NULLS FIRST, leaf, other) - 1 AS idx,
                 count(*) OVER (PARTITION BY key) AS n,
                 row_number() OVER () AS r FROM d),
    t AS (SELECT key, 0 AS lvl, idx, n, leaf AS h FROM l
          UNION ALL
          SELECT key, any_value(lvl) + 1, idx // 8,
                 any_value((n + 7) // 8), sha256(string_agg(h, '' ORDER BY idx))
          FROM t WHERE n > 1 GROUP BY key, idx // 8),
    s AS (SELECT key, h AS subroot, lvl AS depth,
                 row_number() OVER (ORDER BY key) - 1 AS idx,
                 count(*) OVER () AS n FROM t WHERE n = 1),
    u AS (SELECT 0 AS lvl, idx, n, subroot AS h FROM s
          UNION ALL
          SELECT any_value(lvl) + 1, idx // 8, any_value((n + 7) // 8),
                 sha256(string_agg(h, '' ORDER BY idx))
          FROM u WHERE n > 1 GROUP BY idx // 8),
    f AS (SELECT r, 0 AS lev, other AS acc, '' AS proof FROM l
          UNION ALL
          SELECT r, any_value(lev) + 1,
                 sha256(string_agg(CASE WHEN own THEN acc ELSE h END, ''
                                   ORDER BY idx)),
                 any_value(proof) || coalesce(string_agg(h, '' ORDER BY idx)
                                              FILTER (WHERE NOT own), '')
          FROM (SELECT f.r, f.lev, f.acc, f.proof, t.h, t.idx,
                       t.idx = l.idx // CAST(pow(8, f.lev) AS BIGINT) AS own
                FROM f JOIN l USING (r) JOIN s USING (key)
                JOIN t ON t.key = l.key AND t.lvl = f.lev AND f.lev < s.depth
                 AND t.idx // 8 = l.idx // CAST(pow(8, f.lev + 1) AS BIGINT)
                UNION ALL
                SELECT f.r, f.lev, f.acc, f.proof, u.h, u.idx,
                       u.idx = s.idx // CAST(pow(8, greatest(
                           f.lev - s.depth, 0)) AS BIGINT)
                FROM f JOIN l USING (r) JOIN s USING (key)
                JOIN u ON u.n > 1 AND u.lvl = f.lev - s.depth
                 AND u.idx // 8 = s.idx // CAST(pow(8, greatest(
                     f.lev - s.depth, 0) + 1)
                                                AS BIGINT))
          GROUP BY r),
    e AS (SELECT r, max_by(acc, lev) AS folded_root, max_by(proof, lev) AS proof
          FROM f GROUP BY r)
    SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256,
           folded_root, folded_root = root AS verified
    FROM l JOIN s USING (key) JOIN e USING (r),
         (SELECT h AS root FROM u WHERE n = 1)"""


@query("op12_merkle_manifest", sql=ORACLE)
def op12_merkle_manifest(spark, sf_dir):
    third = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    rows = manifest(
        table(spark, sf_dir, "documents"),
        changed=F.when(third & F.col("text").isNotNull(),
                       lowered(F.col("text"))))
    return (rows.withColumn("folded_root", folded(
        F.coalesce("other", "leaf"), F.col("path")))
        .select("doc_id", "leaf", "subroot", "root",
                hashed(siblings(F.col("path"))).alias("proof_sha256"),
                "folded_root",
                (F.col("folded_root") == F.col("root")).alias("verified")))
