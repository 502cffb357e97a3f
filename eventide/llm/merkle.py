"""Merkle manifest of a table by slot pivots.

A leaf is the digest of a row's fields. Leaves are numbered within their group along the key, and every ``FANOUT``
consecutive nodes become one: conditional aggregates spread the children of a parent into one column a slot, and the digest
of the columns, put together, is the parent. The digests of the groups, in the order of the groups, go on in the same way
to the root. Of a level's rows the columns without a node's own slot are its siblings, so proofs go down from the root:
every row of a level meets the proof of its parent once and hands it to its children. Nothing is gathered per group: a
group only is a part of the keys (group, parent), and the places within it come from range partitions.

Digests are lower-case hex SHA-256 of the inputs put together; digests count as hex text.

Cases: fields that are null are ``-``; a null group is a group of its own, before all others; rows with a null key stand
before the others of their group and aren't tampered with; rows with equal keys are ordered by their leaf, and repeated
rows are repeated leaves (their proofs may be dealt among them in any way); a lone leaf is its group's digest and has no
siblings there; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventide.llm.ngram_join import small
from eventide.session import stage

FANOUT = 8
#: The fields of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPER_EVERY = 3
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_table(rows: DataFrame, fields: tuple = FIELDS, key: str = "doc_id", group: str = "lang", text: str = "text") -> DataFrame:
    """Per row: key, group (as text that orders null first), leaf, and the leaf after tampering where the row is tampered with."""
    taken = {c: field(F.col(c)) for c in fields}
    hit = F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(TAMPER_EVERY)) == 0
    changed = {**taken, text: field(F.translate(text, _UPPER, _LOWER))}
    return rows.select(
        F.col(key).alias("key"), F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("group"),
        digest(*taken.values()).alias("digest"), F.when(hit, digest(*changed.values())).alias("tampered"),
    )


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``pos``, the place in their ``group`` along ``order``, and ``m``, the group's size."""
    spread = rows.repartitionByRange("group", *order).sortWithinPartitions("group", *order)
    placed = stage(spread.withColumn("id", F.monotonically_increasing_id()), "placed").withColumn("part", F.shiftright("id", 33))
    sizes = placed.groupBy("part", "group").agg(F.min("id").alias("first"), F.count("*").alias("size"))
    own = Window.partitionBy("group")  # a row per range partition
    before = F.sum("size").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("part", "group", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"), F.sum("size").over(own).alias("m"))
    return placed.join(small(stage(sizes, "sizes")), ["part", "group"]).withColumn("pos", F.col("id") + F.col("shift")).drop("part", "id", "shift")


def _parents(nodes: DataFrame, fanout: int) -> DataFrame:
    """One row per parent: its children, with all they carry, in the columns ``c0`` and so on, and its digest."""
    child = F.struct("digest", *[c for c in nodes.columns if c not in ("group", "pos", "m", "digest")])
    slots = [f"c{i}" for i in range(fanout)]
    spread = nodes.groupBy("group", F.floor(F.col("pos") / fanout).alias("parent"), "m").agg(
        *[F.max(F.when(F.col("pos") % fanout == i, child)).alias(c) for i, c in enumerate(slots)]
    )
    return spread.withColumn("digest", digest(*[_or_nothing(c) for c in slots]))


def _or_nothing(slot: str) -> Column:
    return F.coalesce(F.col(f"{slot}.digest"), F.lit(""))


def climb(nodes: DataFrame, fanout: int = FANOUT) -> tuple[list[DataFrame], DataFrame]:
    """Levels of parents from ``nodes`` (group, pos, m, digest and what they carry) up, and every group's last digest."""
    most = nodes.agg(F.max("m")).first()[0] or 0
    levels, ends = [], []
    while True:
        ends.append(nodes.where("m = 1").select("group", "digest"))
        if most <= 1:
            break
        levels.append(stage(_parents(nodes.where("m > 1"), fanout), "level"))
        most = -(-most // fanout)
        nodes = levels[-1].select("group", F.col("parent").alias("pos"), F.ceil(F.col("m") / fanout).alias("m"), "digest")
    roots = ends[0]
    for end in ends[1:]:
        roots = roots.unionByName(end)
    return levels, roots


def descend(nodes: DataFrame, levels: list[DataFrame], seeds: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """``nodes`` with ``path``, the digests left and right of each step up to the root.

    ``seeds`` has one row per group: the path from the group's last digest on, and columns that all its nodes get.
    """
    slots = [f"c{i}" for i in range(fanout)]
    given = [c for c in seeds.columns if c not in ("group", "path")]
    found = None
    for depth in reversed(range(len(levels))):
        level = levels[depth]
        ends = level.where(F.col("m") <= fanout).select("group", "parent").join(seeds, "group")
        found = ends if found is None else found.unionByName(ends)
        steps = [
            F.struct(F.lit(i).alias("slot"), F.col(c).alias("child"), F.concat(F.lit(""), *map(_or_nothing, slots[:i])).alias("left"),
                     F.concat(F.lit(""), *map(_or_nothing, slots[i + 1 :])).alias("right"))
            for i, c in enumerate(slots)
        ]
        opened = level.join(found, ["group", "parent"]).select("group", "parent", "m", "path", *given, F.explode(F.array(*steps)).alias("step")).where("step.child is not null")
        path = F.concat(F.array(F.struct("step.left", "step.right")), F.col("path")).alias("path")
        if depth:
            found = opened.select("group", (F.col("parent") * fanout + F.col("step.slot")).alias("parent"), path, *given)
        else:
            found = opened.select("group", "step.child.*", path, *given)
    alone = nodes.where("m = 1").drop("pos", "m").join(seeds, "group")
    return alone if found is None else found.unionByName(alone)


def manifest(rows: DataFrame, fields: tuple = FIELDS, key: str = "doc_id", group: str = "lang", text: str = "text", fanout: int = FANOUT) -> DataFrame:
    """Per row: the key, ``leaf``, ``tampered`` (null where it isn't), ``subroot``, ``root`` and ``path``."""
    leaves = stage(leaf_table(rows, fields, key, group, text).withColumn("tie", F.monotonically_increasing_id()), "leaves")
    nodes = numbered(leaves, ["key", "digest", "tie"]).drop("tie")
    levels, roots = climb(nodes, fanout)
    tops = numbered(stage(roots.select(F.lit("").alias("group"), F.col("group").alias("key"), "digest"), "subroots"), ["key"])
    top_levels, root = climb(tops, fanout)
    nowhere = F.array().cast("array<struct<left:string,right:string>>")
    ends = descend(tops, top_levels, root.select("group", nowhere.alias("path"), F.col("digest").alias("root")), fanout)
    seeds = stage(ends.select(F.col("key").alias("group"), "path", "root", F.col("digest").alias("subroot")), "seeds")
    found = descend(nodes, levels, seeds, fanout)
    return found.select(F.col("key").alias(key), F.col("digest").alias("leaf"), "tampered", "subroot", "root", "path")


def verified(proofs: DataFrame) -> DataFrame:
    """``proofs`` with ``proof_sha256``, ``folded_root`` (from the tampered leaf where there is one) and ``verified``."""
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    folded = F.aggregate("path", F.coalesce("tampered", "leaf"), lambda at, s: digest(s["left"], at, s["right"]))
    return proofs.withColumns({"proof_sha256": F.sha2(siblings, 256), "folded_root": folded}).withColumn("verified", F.col("folded_root") == F.col("root"))


def oracle(fields: tuple = FIELDS, key: str = "doc_id", group: str = "lang", text: str = "text", fanout: int = FANOUT) -> str:
    """The query in SQL: recursion upwards over all nodes, then from every leaf up through its siblings."""
    part = lambda e: f"coalesce(cast(strlen(cast({e} as varchar)) as varchar) || ':' || cast({e} as varchar), '-')"
    leaf = lambda text_: "sha256(" + " || ".join(part(text_ if c == text else c) for c in fields) + ")"
    crc = (f"xor(list_reduce(list_transform(string_split(cast({key} as varchar), ''), lambda x: cast(ascii(x) as bigint)), lambda c, b: "
           "list_reduce(range(8), lambda a, i: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end, xor(c, b)), 4294967295), 4294967295)")
    return f"""
  with recursive leaves as (
    select {key}, {group} as g, {leaf(text)} as digest, case when {crc} % {TAMPER_EVERY} = 0 then {leaf(f"translate({text}, '{_UPPER}', '{_LOWER}')")} end as tampered
    from documents),
  placed as (select *, row_number() over (partition by g order by {key} nulls first, digest) - 1 as pos, count(*) over (partition by g) as m from leaves),
  tree as (
    select g, 0 as level, cast(pos as bigint) as pos, cast(m as bigint) as m, digest from placed
    union all
    select g, level + 1, pos // {fanout}, (m + {fanout} - 1) // {fanout}, sha256(string_agg(digest, '' order by pos)) from tree where m > 1
    group by g, level, pos // {fanout}, m),
  subroots as (
    select g, digest as subroot, row_number() over (order by g nulls first) - 1 as pos, count(*) over () as m from tree where m = 1),
  top as (
    select 0 as level, cast(pos as bigint) as pos, cast(m as bigint) as m, subroot as digest from subroots
    union all
    select level + 1, pos // {fanout}, (m + {fanout} - 1) // {fanout}, sha256(string_agg(digest, '' order by pos)) from top where m > 1
    group by level, pos // {fanout}, m),
  whole as (
    select coalesce('=' || g, '') as k, level, pos, m, digest from tree
    union all select null, level, pos, m, digest from top),
  walk as (
    select {key}, digest as leaf, tampered, coalesce('=' || g, '') as k, 0 as level, cast(pos as bigint) as pos, cast(m as bigint) as m,
      coalesce(tampered, digest) as folded, '' as proof, coalesce('=' || g, '') as own from placed
    union all
    select {key}, leaf, tampered, case when m > 1 then k end, case when m > 1 then level + 1 else 0 end,
      case when m > 1 then pos // {fanout} else (select t.pos from subroots t where coalesce('=' || t.g, '') = w.k) end,
      case when m > 1 then (m + {fanout} - 1) // {fanout} else (select max(m) from subroots) end,
      case when m > 1 then sha256((select string_agg(case when n.pos = w.pos then w.folded else n.digest end, '' order by n.pos) from whole n
        where n.k is not distinct from w.k and n.level = w.level and n.pos // {fanout} = w.pos // {fanout})) else folded end,
      proof || case when m > 1 then coalesce((select string_agg(n.digest, '' order by n.pos) from whole n
        where n.k is not distinct from w.k and n.level = w.level and n.pos // {fanout} = w.pos // {fanout} and n.pos <> w.pos), '') else '' end,
      own
    from walk w where k is not null or m > 1)
  select {key}, leaf, s.subroot, r.digest as root, sha256(proof) as proof_sha256, folded as folded_root, folded = r.digest as verified
  from walk w join subroots s on coalesce('=' || s.g, '') = w.own cross join (select digest from top where m = 1) r
  where k is null and w.m = 1"""
