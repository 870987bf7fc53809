"""Operator 12: prefix trie of conversations, balanced parentheses per shard."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.ordinal import group_row_number
from .common import cut_lineage

#: Turns of a conversation that running sums take together, so a very long one is split.
CHUNK = 1_024
#: Different conversations of a shard at most, and conversation numbers hashed in one piece.
SHARD_ROWS = 32_768
ENDS = 4_096
KEY = ["depth", "x1", "x2"]
_EMPTY_SHA = hashlib.sha256(b"").hexdigest()


# ---------------------------------------------------------------- balanced parentheses
class Parens:
    """A balanced parentheses sequence with a tree of the least and greatest excess of its blocks."""

    def __init__(self, bits: np.ndarray, block: int = 64):
        self.bits, self.block = bits, block
        self.excess = np.cumsum(2 * bits.astype(np.int64) - 1)
        used = -(-len(bits) // block)
        self.leaves = 1 << max(0, used - 1).bit_length()
        self.low = np.full(2 * self.leaves, np.iinfo(np.int64).max)
        self.high = np.full(2 * self.leaves, np.iinfo(np.int64).min)
        if used:
            firsts = np.arange(used) * block
            self.low[self.leaves : self.leaves + used] = np.minimum.reduceat(self.excess, firsts)
            self.high[self.leaves : self.leaves + used] = np.maximum.reduceat(self.excess, firsts)
        level = self.leaves
        while level > 1:
            for table, best in ((self.low, np.minimum), (self.high, np.maximum)):
                table[level // 2 : level] = best(table[level : 2 * level : 2], table[level + 1 : 2 * level : 2])
            level //= 2
        #: Leaves (an opening directly closed) up to and including each place.
        self.leaf_rank = np.cumsum((bits == 1) & (np.append(bits[1:], 1) == 0))

    def _in_block(self, start: np.ndarray, block: np.ndarray, target: np.ndarray) -> np.ndarray:
        """First place from ``start`` to the end of ``block`` with the target excess, or -1."""
        out = np.full(len(start), -1, np.int64)
        end = np.minimum((block + 1) * self.block, len(self.bits))
        live, at = np.arange(len(start)), start.copy()
        while len(live):
            live = live[at[live] < end[live]]
            hit = self.excess[at[live]] == target[live]
            out[live[hit]] = at[live[hit]]
            live = live[~hit]
            at[live] += 1
        return out

    def _holds(self, node: np.ndarray, target: np.ndarray) -> np.ndarray:
        return (self.low[node] <= target) & (target <= self.high[node])

    def findclose(self, opens: np.ndarray) -> np.ndarray:
        """The closing place of each opening place."""
        block, target = opens // self.block, self.excess[opens] - 1
        out = self._in_block(opens + 1, block, target)
        far = np.nonzero(out < 0)[0]
        node, want = self.leaves + block[far], target[far]
        waiting = np.arange(len(far))
        while len(waiting):  # up, until a right neighbour holds the target excess
            left = waiting[node[waiting] % 2 == 0]
            beside = left[self._holds(node[left] + 1, want[left])]
            node[beside] += 1
            waiting = np.setdiff1d(waiting, beside, assume_unique=True)
            node[waiting] //= 2
        while len(inner := np.nonzero(node < self.leaves)[0]):  # and down to the first block that does
            child = 2 * node[inner]
            node[inner] = np.where(self._holds(child, want[inner]), child, child + 1)
        found = node - self.leaves
        out[far] = self._in_block(found * self.block, found, want)
        return out


# ---------------------------------------------------------------- one shard
SHARD_SCHEMA = ("depth int, x1 bigint, x2 bigint, conv bigint, n bigint, kids bigint, total bigint, above int, above_conv bigint, "
                "leaves bigint, below bigint, own bigint, spine boolean, path array<struct<depth:int,x1:bigint,x2:bigint>>")  # fmt: skip


def shard_trie(paths: pa.ListArray, root: dict) -> pa.RecordBatch:
    """The nodes of one shard: ``paths`` are the sorted branch points (without the root) of different conversations.

    Opening and closing follow from the common prefix of neighbours.  ``findclose`` delimits
    a subtree, the rank of leaf pairs counts its leaves and the cumulative savings give what
    lies below a node.  Nodes on the first or the last path may go on in other shards: for these
    (``spine``) only what hangs on them directly is given, with the nodes above them.
    """
    size = np.asarray(paths.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    flat = paths.flatten()
    col = {f: flat.field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in ("depth", "x1", "x2", "conv", "n", "kids", "total")}
    start = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    entry = np.arange(len(col["depth"]))
    row = np.repeat(np.arange(len(size)), size)
    level = entry - start[row]
    before = np.where(row > 0, start[np.maximum(row - 1, 0)] + level, 0)
    same = (row > 0) & (level < size[np.maximum(row - 1, 0)])
    same &= (col["x1"][np.where(same, before, 0)] == col["x1"]) & (col["x2"][np.where(same, before, 0)] == col["x2"])
    shared = np.bincount(row[same], minlength=len(size))
    closes = np.concatenate([[0], size[:-1] - shared[1:], size[-1:]])
    opens = np.append(size - shared, 0)
    turns = np.stack([closes, opens], axis=1).reshape(-1)
    bits = np.repeat(np.tile(np.array([0, 1], np.uint8), len(closes)), turns)
    bits = np.concatenate([[1], bits, [0]]).astype(np.uint8)  # the root around all

    new = entry[~same]
    top = lambda f, value: np.concatenate([[value], col[f][new]])
    node = {f: top(f, root[f]) for f in col}
    up = lambda f, value: np.concatenate([[value], np.where(level[new] > 0, col[f][new - 1], root[f])])
    above, above_conv = up("depth", -1), up("conv", 0)
    own = (node["n"] - 1) * (node["total"] - up("total", 0))
    own[0] = 0

    tree = Parens(bits)
    at = np.nonzero(bits == 1)[0]
    end = tree.findclose(at)
    leaves = tree.leaf_rank[end] - tree.leaf_rank[at] + (bits[at + 1] == 0)
    saved = np.concatenate([[0], np.cumsum(own)])
    rank = np.arange(len(at))
    below = saved[rank + (end - at + 1) // 2] - saved[rank + 1]

    # the root, the first path and the last one
    first = np.arange(1 + (size[0] if len(size) else 0))
    last = np.nonzero(end >= len(bits) - 1 - (size[-1] if len(size) else 0))[0]
    spine = np.zeros(len(at), bool)
    spine[first] = spine[last] = True
    parent = dict(zip(first[1:].tolist(), first[:-1].tolist())) | dict(zip(last[1:].tolist(), last[:-1].tolist()))
    part_leaves, part_below = leaves.copy(), below.copy()
    part_leaves[spine] -= bits[at[spine] + 1] == 0
    for v, u in parent.items():
        part_leaves[u] -= leaves[v]
        part_below[u] -= below[v] + own[v]
    route: dict[int, list] = {0: []}
    for v in sorted(parent):
        u = parent[v]
        route[v] = [*route[u], {"depth": int(node["depth"][u]), "x1": int(node["x1"][u]), "x2": int(node["x2"][u])}]
    schema = pa.schema([("depth", pa.int32()), *[(f, pa.int64()) for f in ("x1", "x2", "conv", "n", "kids", "total")], ("above", pa.int32()),
                        *[(f, pa.int64()) for f in ("above_conv", "leaves", "below", "own")], ("spine", pa.bool_()),
                        ("path", pa.list_(pa.struct([("depth", pa.int32()), ("x1", pa.int64()), ("x2", pa.int64())])))])
    values = node | {"above": above, "above_conv": above_conv, "leaves": part_leaves, "below": part_below, "own": own, "spine": spine}
    arrays = [pa.array([route.get(i) for i in range(len(at))] if f.name == "path" else values[f.name], f.type) for f in schema]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def _shards(root: dict, shard_rows: int):
    def run(batches):
        held, n = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, shard_rows):
                part = batch.slice(at, shard_rows)
                if n + part.num_rows > shard_rows and held:
                    yield shard_trie(pa.concat_arrays(held), root)
                    held, n = [], 0
                held.append(part.column(0))
                n += part.num_rows
        if held:
            yield shard_trie(pa.concat_arrays(held), root)

    return run


# ---------------------------------------------------------------- conversations
def positions(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv, pos, a1, a2, words``: every turn's place in its conversation (from 1) and 128 bits of its role and text.

    Turns stand by number, null first, equal numbers by role and content hash; null roles and
    texts are empty; rows without a conversation take no part.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    turns = df.select(
        F.col(conv_col).cast("bigint").alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"), F.xxhash64(role, text).alias("a1"),
        F.xxhash64(F.lit("second"), role, text).alias("a2"), F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("bigint").alias("words"),
    ).where("conv is not null")
    placed = group_row_number(turns, ["conv"], ["turn", "role", "a1", "a2"], name="pos")
    return placed.select("conv", F.col("pos").cast("bigint").alias("pos"), "a1", "a2", "words")


def with_shared_heads(turns: DataFrame, group: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """Each conversation ``c`` behind the first ``crc32(c) % heads`` turns of ``c - c % group``: the turns
    (``conv, pos, a1, a2, words``) and the conversations (``conv, size``), also those without a turn."""
    sizes = turns.groupBy("conv").agg(F.count("*").alias("had"))
    base = (F.col("conv") - F.col("conv") % group).alias("base")
    head = (F.crc32(F.col("conv").cast("string").cast("binary")) % heads).alias("head")
    convs = sizes.select("conv", "had", base, head)
    bases = sizes.where(F.col("conv") % group == 0).select(F.col("conv").alias("base"), F.col("had").alias("base_had"))
    convs = convs.join(bases, "base", "left").withColumn("lead", F.least("head", F.coalesce("base_had", F.lit(0))))
    convs = cut_lineage(convs.select("conv", "base", "head", "lead", (F.col("lead") + F.greatest(F.col("had") - F.col("head"), F.lit(0))).alias("size")))
    # at most heads - 1 turns of a base, wanted by fewer than ``group`` conversations on either side of zero
    first = turns.where((F.col("conv") % group == 0) & (F.col("pos") < heads)).withColumnRenamed("conv", "base")
    led = convs.join(first, "base").where(F.col("pos") <= F.col("lead")).select("conv", "pos", "a1", "a2", "words")
    own = turns.join(convs, "conv").where(F.col("pos") > F.col("head"))
    own = own.select("conv", (F.col("pos") - F.col("head") + F.col("lead")).alias("pos"), "a1", "a2", "words")
    return led.unionByName(own), convs.select("conv", "size")


def prefixes(turns: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``conv, depth, x1, x2, p1, p2, words, total``: 128 bits for the first ``depth`` turns, the same for one
    turn fewer, and the running words.

    The bits are the exclusive or of hashes of turn and place, so running values of
    chunks of a conversation combine: no task sorts a whole conversation.
    """
    salted = turns.select("conv", "pos", F.xxhash64("a1", "a2", "pos").alias("s1"), F.xxhash64("pos", "a2", "a1").alias("s2"), "words",
                          F.floor((F.col("pos") - 1) / chunk).alias("chunk"))
    upto = Window.partitionBy("conv", "chunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    running = salted.select("conv", "chunk", "pos", "s1", "s2", "words", F.bit_xor("s1").over(upto).alias("x1"), F.bit_xor("s2").over(upto).alias("x2"),
                            F.sum("words").over(upto).alias("total"))
    sums = salted.groupBy("conv", "chunk").agg(F.bit_xor("s1").alias("b1"), F.bit_xor("s2").alias("b2"), F.sum("words").alias("bw"))
    earlier = Window.partitionBy("conv").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)  # a row for each chunk
    sums = sums.select("conv", "chunk", *[f.over(earlier).alias(c) for f, c in ((F.bit_xor("b1"), "b1"), (F.bit_xor("b2"), "b2"), (F.sum("bw"), "bw"))])
    out = running.join(sums.where("chunk > 0"), ["conv", "chunk"], "left")
    whole = lambda x, b: F.col(x).bitwiseXOR(F.coalesce(b, F.lit(0)))
    out = out.select("conv", F.col("pos").cast("int").alias("depth"), whole("x1", "b1").alias("x1"), whole("x2", "b2").alias("x2"), "s1", "s2", "words",
                     (F.col("total") + F.coalesce("bw", F.lit(0))).alias("total"))
    return out.select("conv", *KEY, F.col("x1").bitwiseXOR(F.col("s1")).alias("p1"), F.col("x2").bitwiseXOR(F.col("s2")).alias("p2"), "words", "total")


def list_hashes(ends: DataFrame, piece: int = ENDS) -> DataFrame:
    """``depth, x1, x2, ends_sha256`` of ``ends`` (conv and key): the SHA-256 of each node's ascending comma-joined numbers.

    Ranges of (node, number) are joined to texts of up to ``piece`` numbers, so a node where very many
    conversations end spans tasks; its few texts then run through one hash in order.
    """

    def text(batches):
        for batch in batches:
            keys = [batch.column(i).to_numpy() for i in range(3)]
            convs = batch.column(3).to_numpy()
            change = np.zeros(len(convs), bool)
            for k in keys:
                change[1:] |= k[1:] != k[:-1]
            cuts = np.union1d(np.nonzero(change)[0], np.arange(0, len(convs), piece))
            ends_at = np.append(cuts[1:], len(convs)) if len(cuts) else cuts
            if len(cuts):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k[cuts]) for k in keys] + [pa.array(convs[cuts]), pa.array([",".join(map(str, convs[a:b].tolist())) for a, b in zip(cuts, ends_at)])],
                    names=[*KEY, "first", "text"],
                )

    def digest(batches):
        key, state = None, None
        out: list[tuple] = []

        def flush():
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.int64(), pa.string()))], names=[*KEY, "ends_sha256"])
            out.clear()
            return batch

        for batch in batches:
            for *now, _, joined in zip(*[c.to_pylist() for c in batch.columns]):
                if now != key:
                    if key is not None:
                        out.append((*key, state.hexdigest()))
                    key, state = now, hashlib.sha256(joined.encode())
                else:
                    state.update(b"," + joined.encode())
                if len(out) >= ENDS:
                    yield flush()
        if key is not None:
            out.append((*key, state.hexdigest()))
            yield flush()

    ordered = ends.select(*KEY, "conv").repartitionByRange(*KEY, "conv").sortWithinPartitions(*KEY, "conv")
    texts = ordered.mapInArrow(text, "depth int, x1 bigint, x2 bigint, first bigint, text string")
    return texts.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(digest, "depth int, x1 bigint, x2 bigint, ends_sha256 string")


RESULT = ("conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, "
          "ends_sha256 string")  # fmt: skip


def prefix_trie(turns: DataFrame, convs: DataFrame, chunk: int = CHUNK, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The prefix trie of conversations: ``turns`` (``conv, pos, a1, a2, words``) and ``convs`` (``conv, size``).

    Equal prefixes meet by 128-bit keys in partial aggregates, which gives members,
    smallest member and children.  Nodes where conversations end or part are kept, runs of nodes
    between them share their members and are filled in at the end.  The different
    conversations, sorted by their kept nodes, are cut into shards; each shard's trie is encoded in
    balanced parentheses, and nodes on a shard's edges are merged by one aggregate.

    Returns one row per node (see ``RESULT``); no conversations give no rows.
    """
    spark = turns.sparkSession
    whole = convs.agg(F.count("*").alias("n"), F.min("conv").alias("conv")).first()
    if not whole["n"]:
        return spark.createDataFrame([], RESULT)
    steps = cut_lineage(prefixes(turns, chunk))
    nodes = steps.groupBy(*KEY).agg(F.count("*").alias("n"), F.min("conv").alias("conv"), F.max("p1").alias("p1"), F.max("p2").alias("p2"),
                                    F.max("words").alias("words"), F.max("total").alias("total"))
    top = spark.createDataFrame([(0, 0, 0, whole["n"], whole["conv"], None, None, 0, 0)],
                                "depth int, x1 bigint, x2 bigint, n bigint, conv bigint, p1 bigint, p2 bigint, words bigint, total bigint")
    nodes = cut_lineage(nodes.unionByName(top))
    kids = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("x1"), F.col("p2").alias("x2")).agg(F.count("*").alias("kids"))
    # a conversation's end is the one prefix as long as it
    ended = steps.groupBy("conv").agg(F.max(F.struct(*KEY)).alias("last"))
    zero = F.struct(F.lit(0).alias("depth"), F.lit(0).cast("bigint").alias("x1"), F.lit(0).cast("bigint").alias("x2"))
    ends = cut_lineage(convs.select("conv").join(ended, "conv", "left").select("conv", F.coalesce("last", zero).alias("last")).select("conv", "last.*"))
    ending = ends.groupBy(*KEY).agg(F.min("conv").alias("rep"))
    nodes = nodes.join(kids, KEY, "left").join(ending, KEY, "left")
    nodes = nodes.select(*KEY, "n", "conv", "words", "total", F.coalesce("kids", F.lit(0)).alias("kids"), "rep")
    nodes = cut_lineage(nodes)
    kept = nodes.where((F.col("kids") != 1) | F.col("rep").isNotNull() | (F.col("depth") == 0))
    root = {k: v or 0 for k, v in nodes.where("depth = 0").select(*KEY, "n", "conv", "kids", "total").first().asDict().items()}

    # one row for each different conversation: its branch points (never its turns)
    reps = ending.select(F.col("rep").alias("conv"))
    on_path = steps.join(reps, "conv", "left_semi").select(F.col("conv").alias("rep"), *KEY).join(kept.drop("rep", "words"), KEY)
    point = F.struct("depth", "x1", "x2", "conv", "n", "kids", "total")
    paths = on_path.groupBy("rep").agg(F.array_sort(F.collect_list(point)).alias("path"))
    paths = reps.select(F.col("conv").alias("rep")).join(paths, "rep", "left").select(F.coalesce("path", F.array().cast(paths.schema["path"].dataType)).alias("path"))
    code = F.array_join(F.transform("path", lambda s: F.concat(F.lpad(F.hex(s["x1"]), 16, "0"), F.lpad(F.hex(s["x2"]), 16, "0"))), "")
    ordered = paths.withColumn("code", code).repartitionByRange("code").sortWithinPartitions("code").select("path")
    found = cut_lineage(ordered.mapInArrow(_shards(root, shard_rows), SHARD_SCHEMA))

    # shards' edges: what hangs on a node directly goes to it and to all nodes above it
    info = F.struct("conv", "above", "above_conv", "total", "n")
    edge = found.where("spine").groupBy(*KEY).agg(F.max(info).alias("info"), F.max("kids").alias("kids"), F.max("own").alias("own"), F.sum("leaves").alias("leaves"),
                                                  F.sum("below").alias("below"), F.max("path").alias("path"))
    edge = edge.withColumn("leaves", F.col("leaves") + (F.col("kids") == 0).cast("bigint"))
    up = edge.select(F.explode("path").alias("u"), "leaves", (F.col("below") + F.col("own")).alias("below")).select("u.*", "leaves", "below", F.lit(None).cast(
        edge.schema["info"].dataType).alias("info"))
    edge = edge.select(*KEY, "leaves", "below", "info").unionByName(up).groupBy(*KEY).agg(F.max("info").alias("info"), F.sum("leaves").alias("leaves"), F.sum("below").alias("below"))
    done = ["conv", "above", "above_conv", "total", "leaves", "below", "depth"]
    ready = found.where(~F.col("spine")).select(*done).unionByName(edge.select("info.*", "leaves", "below", "depth").select(*done))

    # every node takes its values from the kept node below it: same smallest member, depth within that run
    run = ready.select("conv", "above", "above_conv", F.col("total").alias("run_total"), "leaves", "below", F.col("depth").alias("bottom"))
    run = run.withColumn("part", F.explode(F.sequence(F.floor((F.col("above") + 1) / chunk), F.floor(F.col("bottom") / chunk))))
    all_ = nodes.withColumn("part", F.floor(F.col("depth") / chunk)).join(run, ["conv", "part"]).where("depth > above and depth <= bottom")
    all_ = all_.join(list_hashes(ends), KEY, "left")
    saved = F.when(F.col("depth") == 0, F.col("below")).otherwise(F.col("below") + (F.col("n") - 1) * (F.col("run_total") - F.col("total") + F.col("words")))
    parent = F.when(F.col("depth") > 0, F.when(F.col("depth") == F.col("above") + 1, F.col("above_conv")).otherwise(F.col("conv")))
    return all_.select(
        F.col("conv").alias("conv_id"), F.col("depth").cast("bigint").alias("depth"), parent.alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("kids").alias("n_children"),
        F.col("leaves").alias("n_leaves"), saved.alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(_EMPTY_SHA)).alias("ends_sha256"),
    )


def conversation_trie(df: DataFrame, group: int = 20, heads: int = 4, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                      text_col: str = "text", **options) -> DataFrame:
    """The prefix trie of conversations rebuilt behind shared heads (``with_shared_heads``).

    Returns ``conv_id`` (smallest member), ``depth, parent_conv_id`` (root: null), ``n_convs,
    n_children, n_leaves, saved_tokens`` (words of last texts that members after the
    first share, summed over the subtree) and ``ends_sha256`` for each different prefix.  Null roles
    and texts are empty, rows without a conversation take no part, repeated rows are turns of
    their own, equal turn numbers stand by role and content hash; an empty table gives no rows; other columns are
    ignored.  Prefixes are told apart by 128-bit hashes.
    """
    turns, convs = with_shared_heads(positions(df, conv_col, turn_col, role_col, text_col), group, heads)
    return prefix_trie(turns, convs, **options)
