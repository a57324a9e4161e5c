"""Prefix trie of conversations, by a recursion that cuts sequences at half depth.

Depths are dealt into ranges of LEAF turns, pairs of ranges into ranges of twice the depth, and so on to the longest
sequence. Names first: a range's digest is that of its two halves, and going down again the prefix before a lower half is
named by the prefix before the range and the digest of the upper half. So equal prefixes have equal names in every
conversation, all ranges of a size are cut in one job, and a sequence of n turns takes log n jobs. The innermost ranges
are named turn by turn within one row.

Then totals: in its innermost range every node adds to its ancestors there. Going up, all ranges of a size are again
joined at their cut: the totals of the lower tries' tops are grafted on to the nodes of the upper trie that lie on their
path, each found by one member conversation of the top. A level reads no more than the rows of the sequences, and
sequences no longer than LEAF take part in none.

Turns are numbered by range partitions and offsets between them, identifiers of a node are digested in pieces that are
read in order: no conversation and no node is gathered in one task. Texts leave the scan as digests and lengths only.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from feedmill.llm.common import Workspace, field, settle

#: Turns of the innermost ranges. Ids of a piece of a node's list lie this close together.
LEAF, NEAR_IDS = 16, 1024
#: Conversations of a family, whose first one lends its beginning, and the first count of lent turns that does not occur.
FAMILY, MOST_LENT = 100, 6
ROOT = "root"


def _digest(text: Column) -> Column:
    """128 bits of SHA-256 as hexadecimal digits; names and symbols are equal only if what they stand for is."""
    return F.substring(F.sha2(text.cast("binary"), 256), 1, 32)


def _union(parts: list[DataFrame]) -> DataFrame:
    """All rows by column name, null where a part lacks a column."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def numbered_turns(conversations: DataFrame, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """(c, k, sym, chars) of all turns that have a conversation, ``k`` their place in it from 1, and (c, n), its number of turns.

    Turns go by ``turn``, null first, equal ones by the digest of role and text. A range partition numbers the turns of a
    conversation by itself; a conversation that goes on into further partitions has offsets there, one row for each.
    """
    role, text = (F.coalesce(field(x).cast("string"), F.lit("")) for x in ("role", "text"))
    turns = conversations.filter(field("conv_id").isNotNull()).select(
        field("conv_id").cast("bigint").alias("c"), field("turn").alias("turn"), _digest(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)).alias("sym"), F.char_length(text).cast("bigint").alias("chars"), F.monotonically_increasing_id().alias("u")
    )
    order = [F.col("turn").asc_nulls_first(), "sym"]
    dealt = turns.repartitionByRange("c", *order, "u").withColumn("part", F.spark_partition_id())
    local = work.settle(dealt.select("c", "part", F.row_number().over(Window.partitionBy("part", "c").orderBy(*order)).alias("k"), "sym", "chars"))
    counts = local.groupBy("c", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # a border between two partitions cuts one conversation at most: there are fewer offsets than partitions
    offsets = counts.select("c", "part", F.sum("n").over(before).alias("off")).filter("off > 0")
    numbered = local.join(F.broadcast(offsets), ["c", "part"], "left").select("c", (F.col("k") + F.coalesce("off", F.lit(0))).alias("k"), "sym", "chars")
    return numbered, counts.groupBy("c").agg(F.sum("n").alias("n"))


def _lent() -> Column:
    """How many turns conversation ``c`` is lent, at most."""
    return F.crc32(F.col("c").cast("string").cast("binary")) % MOST_LENT


def rebuild(turns: DataFrame, sizes: DataFrame, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """Conversations with the lent beginnings: (c, x, sym, chars, length), ``x`` from 0, and (c, length) of all, turnless ones too.

    The first h turns of conversation c are those of the first conversation of its family, h the crc32 of c as text
    modulo MOST_LENT; its own turns follow from its h-th on.
    """
    own = sizes.select("c", "n", (F.col("c") - F.col("c") % FAMILY).alias("base"), _lent().alias("h"))
    first = sizes.filter(F.col("c") % FAMILY == 0).select(F.col("c").alias("base"), F.col("n").alias("nb"))
    lent = F.least("h", F.coalesce("nb", F.lit(0)))
    plan = work.settle(own.join(first, "base", "left").select("c", "base", "h", lent.alias("m"), (lent + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")))
    heads = turns.filter((F.col("c") % FAMILY == 0) & (F.col("k") < MOST_LENT)).withColumnRenamed("c", "base")
    begun = plan.filter("m > 0").join(heads, "base").filter("k <= m").select("c", (F.col("k") - 1).alias("x"), "sym", "chars", "length")
    rest = turns.filter(F.col("k") > _lent()).join(plan, "c").select("c", (F.col("k") - 1 - F.col("h") + F.col("m")).alias("x"), "sym", "chars", "length")
    return begun.unionByName(rest), plan.select("c", "length")


def _cut_names(blocks: DataFrame, work: Workspace) -> tuple[DataFrame, int]:
    """(c, i, before) for the ranges ``i`` of sequences that have several: the name of the prefix before each. And how many times
    the longest sequence is cut."""
    level = work.settle(blocks.filter(f"length > {LEAF}").select("c", "i", F.lit("").alias("left"), _digest(F.array_join("syms", "")).alias("digest")))
    most = level.agg(F.max("i")).first()[0]
    levels = [level]
    for _ in range((most or 0).bit_length()):
        half = lambda odd: F.max(F.when(F.col("i") % 2 == odd, F.col("digest")))
        pairs = levels[-1].groupBy("c", F.shiftright("i", 1).alias("i")).agg(half(0).alias("left"), half(1).alias("right"))
        levels.append(work.settle(pairs.select("c", "i", "left", _digest(F.concat("left", F.coalesce("right", F.lit("")))).alias("digest"))))
    named = levels[-1].select("c", "i", "left", F.lit("").alias("before"))
    for lower in reversed(levels[:-1]):
        up = named.select("c", F.col("i").alias("up"), F.col("left").alias("upper"), F.col("before").alias("outer"))
        both = lower.withColumn("up", F.shiftright("i", 1)).join(up, ["c", "up"])
        named = work.settle(both.select("c", "i", "left", F.when(F.col("i") % 2 == 0, F.col("outer")).otherwise(_digest(F.concat("outer", "upper"))).alias("before")))
    return named.select("c", "i", "before"), len(levels) - 1


def _named_blocks(turns: DataFrame, work: Workspace) -> tuple[DataFrame, int]:
    """(c, i, names, chars, parent, length): the innermost ranges with the names of their nodes, and how often the longest is cut."""
    row = F.array_sort(F.collect_list(F.struct("x", "sym", "chars")))
    by_range = turns.groupBy("c", F.floor(F.col("x") / LEAF).cast("int").alias("i")).agg(row.alias("t"), F.first("length").alias("length"))
    blocks = work.settle(by_range.select("c", "i", F.transform("t", lambda t: t["sym"]).alias("syms"), F.transform("t", lambda t: t["chars"]).alias("chars"), "length"))
    cuts, times = _cut_names(blocks, work)
    if times:
        alone = blocks.filter(f"length <= {LEAF}").withColumn("before", F.lit(""))
        blocks = alone.unionByName(blocks.filter(f"length > {LEAF}").join(cuts, ["c", "i"]))
    else:
        blocks = blocks.withColumn("before", F.lit(""))
    upto = lambda k: F.array_join(F.slice("syms", F.lit(1), k), "")
    names = F.transform(F.sequence(F.lit(1), F.size("syms")), lambda k: _digest(F.concat(F.col("before"), F.lit("/"), upto(k))))
    named = work.settle(blocks.select("c", "i", names.alias("names"), "chars", "length"))
    start = named.filter("i = 0").withColumn("parent", F.lit(ROOT))
    if not times:
        return start, 0
    ends = named.filter(f"length > {LEAF}").select("c", (F.col("i") + 1).alias("i"), F.element_at("names", -1).alias("parent"))
    return work.settle(start.unionByName(named.filter("i > 0").join(ends, ["c", "i"]))), times


def _graft(blocks: DataFrame, nodes: DataFrame, inner: DataFrame, times: int, work: Workspace) -> list[DataFrame]:
    """(name, saved, leaves) that nodes get from the ranges below their own, one table for each size of range."""
    tops = work.settle(nodes.filter(f"x > 0 and x % {LEAF} = 0").select("name", F.col("conv").alias("c"), (F.col("x") / LEAF).cast("int").alias("i")).join(inner, "name"))
    deep, got = work.settle(blocks.filter(f"length > {LEAF}").select("c", "i", "names")), []
    for j in range(times):
        cut = tops.filter(F.col("i") % (2 << j) == 1 << j)
        if got:
            more = _union(got).groupBy("name").agg(F.sum("saved").alias("s"), F.sum("leaves").alias("l"))
            cut = cut.join(more, "name", "left").select("c", "i", (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved"), (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"))
        cut = cut.select("c", (F.shiftright("i", j) - 1).alias("u"), "saved", "leaves")
        above = deep.withColumn("u", F.shiftright("i", j)).join(cut, ["c", "u"]).select(F.explode("names").alias("name"), "saved", "leaves")
        got.append(work.settle(above.groupBy("name").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))))
    return got


def _id_digests(ends: DataFrame) -> DataFrame:
    """(name, ends_sha256) of (name, c): the SHA-256 of each name's ids in ascending order, comma-joined. A name's ids come in pieces
    of at most NEAR_IDS, in order, and go through one running hash: however many, they are held in no memory together."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda c: c.cast("string")), ",")
    bits = NEAR_IDS.bit_length() - 1
    pieces = ends.groupBy("name", F.shiftright("c", bits).alias("piece")).agg(text.alias("ids"))

    def run(batches):
        name, state = None, None
        for batch in batches:
            out = [[], []]
            for n, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if n != name:
                    if name is not None:
                        out[0].append(name), out[1].append(state.hexdigest())
                    name, state = n, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in out], ["name", "ends_sha256"])
        if name is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (name, state.hexdigest())], ["name", "ends_sha256"])

    ordered = pieces.repartition("name").sortWithinPartitions("name", "piece").select("name", "ids")
    return ordered.mapInArrow(run, "name string, ends_sha256 string")


def trie(turns: DataFrame, sequences: DataFrame, work: Workspace) -> DataFrame:
    """One row for each distinct prefix of the sequences, see ``conversation_trie``. ``turns`` are (c, x, sym, chars, length), ``x`` from 0
    without gaps, ``sequences`` (c, length) of all, those without turns too. The result reads tables of ``work``."""
    blocks, times = _named_blocks(turns, work)
    rows = blocks.select("c", "i", "names", "chars", "parent", "length", F.posexplode("names").alias("k", "name")).select(
        "name", "c", (F.col("i") * LEAF + F.col("k")).alias("x"), F.element_at("chars", F.col("k") + 1).alias("chars"), F.slice("names", F.lit(1), F.col("k") + 1).alias("path"),
        F.when(F.col("k") == 0, F.col("parent")).otherwise(F.get("names", F.col("k") - 1)).alias("parent"), (F.col("i") * LEAF + F.col("k") + 1 == F.col("length")).alias("end"),
    )
    same = [F.first(x).alias(x) for x in ("x", "chars", "path", "parent")]
    nodes = work.settle(rows.groupBy("name").agg(F.min("c").alias("conv"), F.count("*").alias("n"), F.count_if("end").alias("n_end"), *same))
    # all members of a leaf end there; a node's own share goes to itself and its ancestors in the innermost range
    share = [((F.col("n") - 1) * F.col("chars")).alias("saved"), (F.col("n") == F.col("n_end")).cast("bigint").alias("leaves")]
    inner = work.settle(nodes.select(F.explode("path").alias("name"), *share).groupBy("name").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves")))
    grafted = _graft(blocks, nodes, inner, times, work) if times else []
    ends = rows.filter("end").select("name", "c").unionByName(sequences.filter("length = 0").select(F.lit(ROOT).alias("name"), "c"))
    root = work.settle(sequences.agg(F.min("c").alias("conv"), F.count("*").alias("n")).filter("n > 0").select(F.lit(ROOT).alias("name"), "conv", F.lit(-1).alias("x"), "n", F.lit(None).cast("string").alias("parent")))
    parts = [
        nodes.select("name", "conv", "x", "n", "parent"), root, inner, *grafted, nodes.select(*share).agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves")).withColumn("name", F.lit(ROOT)),
        nodes.groupBy(F.col("parent").alias("name")).agg(F.count("*").alias("children")), _id_digests(ends),
    ]
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    whole = _union(parts).groupBy("name").agg(*[F.max(c).alias(c) for c in ("conv", "x", "n", "parent", "ends_sha256")], *[total(c) for c in ("saved", "leaves", "children")])
    whole = work.settle(whole.filter("conv is not null"))
    above = nodes.select(F.col("name").alias("parent"), F.col("conv").alias("above"))
    # the root has the most children and is no key of the join
    top = whole.filter(F.coalesce(F.col("parent") == ROOT, F.lit(True)))
    least = root.agg(F.max("conv")).first()[0]
    placed = whole.filter(F.col("parent") != ROOT).join(above, "parent").unionByName(top.withColumn("above", F.when(F.col("parent").isNotNull(), F.lit(least).cast("bigint"))))
    return placed.select(
        F.col("conv").alias("conv_id"), (F.col("x") + 1).cast("bigint").alias("depth"), F.col("above").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
        F.when(F.col("children") == 0, F.lit(1)).otherwise(F.col("leaves")).cast("bigint").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The prefix trie of the rebuilt conversations: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256).

    A node is a distinct sequence of first turns (role and text; null ones are empty), the root that of none. ``conv_id`` is its
    smallest member, ``saved_tokens`` sums over its subtree the code points of each node's last text for all members but
    one, ``ends_sha256`` digests the members that end there. Turns without ``conv_id`` are left out; turns of equal ``turn``
    go by a digest of role and text; repeated rows are turns each; a conversation may be of any length; an empty table has no
    node, not even a root. Other columns are not read.
    """
    with Workspace(conversations.sparkSession) as work:
        turns, sizes = numbered_turns(conversations, work)
        return settle(trie(*rebuild(turns, sizes, work), work))
