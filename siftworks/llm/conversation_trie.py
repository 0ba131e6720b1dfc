"""Prefix trie of conversations: sorted turn arrays, adjacent LCPs, one stack sweep, stitched stacks.

A turn is a key of 132 bits of the SHA-256 of its role and text, so equal turns have equal keys and
a conversation is an array of keys of one width.  The arrays are sorted globally by range.  In each
partition one sweep keeps the stack of open nodes of the current array: the length of the prefix
that it shares with the next one (LCP) says which nodes end there.  Nodes that touch the first or
the last array of a partition may go on in its neighbours; their partial sums leave as two spine
rows a partition, and a second sweep over the spines in order of the partitions stitches them.

Bounds, whatever the keys: equal conversations are one row before the sort, so a group of copies
is never gathered.  Turns are numbered by a global sort, not by a window over a conversation.  An
array is cut every ``width`` turns (4,096, or a 64th of the longest conversation) and the trie is
built a level at a time from the deepest, so a conversation of any length is many rows.  The sweep
holds one stack and KIDS finished children a node; a node with more hands their parent over to a
join.  The stitch is one task over two rows a partition.  The list of conversations that end at a
node is hashed as a stream of sorted pieces of at most 65,536 ids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from siftworks.llm.scratch import Scratch

KEY = 22  # characters of a turn's key
WIDTH = 4096  # turns of a segment, at least
LEVELS = 64  # segments of a conversation, at most
KIDS = 256  # children whose parent's smallest member is awaited in the sweep
FLUSH = 4096
_BLOCK = 1 << 16
_NONE = hashlib.sha256(b"").hexdigest()


def numbered_turns(conversations: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, turn, role, text) -> (conv_id, pos from 0, key, n_bytes), by turn, null first.

    Rows of one conversation and turn stand by role, then by key, which is a hash, so that no text
    is shuffled; equal rows all count.  A null role or text counts as empty; rows without a conv_id
    belong to no conversation and go.  Other columns are ignored.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    told = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    key = F.substring(F.base64(F.unhex(F.sha2(told.cast("binary"), 256))), 1, KEY)
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), key.alias("key"), F.octet_length(text).cast("long").alias("n_bytes"),
        F.xxhash64(F.monotonically_increasing_id()).alias("row"),
    )
    rows = scratch.table("turns", rows)  # the sort samples its input: hash the texts once
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "key", "row"]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "key", "n_bytes").mapInArrow(_place, "part int, conv_id long, pos long, key string, n_bytes long")
    placed = scratch.table("placed", placed)
    scratch.drop("turns")
    # Only a partition's first conversation can have begun before it: at most one row a partition is broadcast.
    ends = placed.groupBy("part", "conv_id").agg(F.count(F.lit(1)).alias("n")).groupBy("part").agg(F.min_by(F.struct("conv_id", "n"), "conv_id").alias("a"), F.max_by(F.struct("conv_id", "n"), "conv_id").alias("b"))
    edges = ends.select("part", F.explode(F.array_distinct(F.array("a", "b"))).alias("e")).select("part", "e.*")
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    late = edges.withColumn("before", F.sum("n").over(before)).where("before > 0").select("part", "conv_id", "before")
    return placed.join(F.broadcast(late), ["part", "conv_id"], "left").select("conv_id", (F.col("pos") + F.coalesce("before", F.lit(0))).alias("pos"), "key", "n_bytes")


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number sorted rows inside runs of one conversation of this partition."""
    part, now, at = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        pos = []
        for c in batch.column(0).to_pylist():
            at = at + 1 if c == now else 0
            now = c
            pos.append(at)
        yield pa.RecordBatch.from_arrays([pa.array([part] * len(pos), pa.int32()), batch.column(0), pa.array(pos, pa.int64()), *batch.columns[1:]], names=["part", "conv_id", "pos", "key", "n_bytes"])


def with_heads(turns: DataFrame, family: int = 5, heads: int = 9) -> tuple[DataFrame, DataFrame]:
    """Give conversations of a family one opening: conversation c gets the first h turns of
    conversation c - c % family, then its own turns after its first h; h is crc32(c) % heads.

    -> turns (conv_id, pos, key, n_bytes) and conversations (conv_id, n_turns, 0 included).
    """
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own"))
    each = sizes.select("conv_id", "own", (F.col("conv_id") - F.col("conv_id") % family).alias("first"), h.alias("h"))
    each = each.join(sizes.select(F.col("conv_id").alias("first"), F.col("own").alias("there")), "first", "left")
    head = F.least(F.col("h"), F.coalesce("there", F.lit(0)))
    each = each.select("conv_id", "first", "own", "h", head.alias("head"), (head + F.greatest(F.col("own") - F.col("h"), F.lit(0))).cast("long").alias("n_turns"))
    # A conversation meets its own rows in pieces of _BLOCK rows, so none is one key of the join.
    pieces = each.select("conv_id", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(own - 1) div {_BLOCK}"))).alias("piece"), "h", "head")
    own = turns.withColumn("piece", F.expr(f"pos div {_BLOCK}")).join(pieces, ["conv_id", "piece"]).where("pos >= h")
    own = own.select("conv_id", (F.col("pos") - F.col("h") + F.col("head")).alias("pos"), "key", "n_bytes")
    opening = turns.where(F.col("pos") < heads - 1).withColumnRenamed("conv_id", "first").join(each.select("first", "conv_id", "h"), "first").where("pos < h")
    return own.unionByName(opening.select("conv_id", "pos", "key", "n_bytes")), each.select("conv_id", "n_turns")


def _id(base: str, keys: str) -> str:
    """Of the node at the end of keys below base; _path() is the same for Spark."""
    return hashlib.sha256(f"{base}/{keys}".encode()).hexdigest()[:32]


def _path() -> Column:
    return F.substring(F.sha2(F.concat(F.col("base"), F.lit("/"), F.col("seg")).cast("binary"), 256), 1, 32)


def _ends(rows: DataFrame) -> DataFrame:
    """(path, conv_id) -> path, SHA-256 of its ids in order, hashed piece by piece."""
    pieces = rows.groupBy("path", F.shiftright("conv_id", 16).alias("piece")).agg(F.array_join(F.array_sort(F.collect_list("conv_id")), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, out = None, None, []
        for batch in batches:
            for path, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if path != now:
                    if now is not None:
                        out.append((now, state.hexdigest()))
                    now, state = path, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if len(out) >= FLUSH:
                yield _batch(out, _ENDS)
                out = []
        if now is not None:
            out.append((now, state.hexdigest()))
        yield _batch(out, _ENDS)

    return pieces.repartition("path").sortWithinPartitions("path", "piece").select("path", "ids").mapInArrow(run, "path string, ends string")


_ENDS = pa.schema([("path", pa.string()), ("ends", pa.string())])
_FIELDS = {"n": pa.int64(), "least": pa.int64(), "children": pa.int64(), "leaves": pa.int64(), "saved": pa.int64(), "ends": pa.string(), "hub": pa.int64()}
_OUT = pa.schema([
    ("kind", pa.string()), ("part", pa.int32()), ("side", pa.int32()), ("base", pa.string()), ("seg", pa.string()), ("lens", pa.list_(pa.int64())), *((f"part_{n}", pa.list_(t)) for n, t in _FIELDS.items()),
    ("id", pa.string()), ("depth", pa.int64()), ("conv_id", pa.int64()), ("parent_id", pa.string()), ("parent_conv_id", pa.int64()),
    ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string()),
])
_LONG, _TEXT = "array<long>", "array<string>"
_OUT_SCHEMA = ", ".join(f"{f.name} {'int' if f.type == pa.int32() else 'long' if f.type == pa.int64() else 'string' if f.type == pa.string() else _TEXT if f.name == 'part_ends' else _LONG}" for f in _OUT)
_AT = {f.name: i for i, f in enumerate(_OUT)}


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def shared(a: str, b: str) -> int:
    """Keys that a and b begin with alike; bisection, so that a compare is a memory compare."""
    low, high = 0, min(len(a), len(b)) // KEY
    while low < high:
        mid = (low + high + 1) // 2
        if a[KEY * low : KEY * mid] == b[KEY * low : KEY * mid]:
            low = mid
        else:
            high = mid - 1
    return low


class _Node:
    """An open node.  n, least, leaves and saved are sums over the closed nodes below it."""

    __slots__ = ("children", "ends", "first", "hub", "kids", "leaves", "least", "n", "saved")

    def __init__(self, first: bool):
        self.n, self.least, self.children, self.leaves, self.saved, self.ends, self.hub, self.first, self.kids = 0, None, 0, 0, 0, None, 0, first, []

    def add(self, n: int, least: int | None, children: int, leaves: int, saved: int, ends: str | None, hub: int) -> None:
        self.n, self.children, self.leaves, self.saved, self.hub = self.n + n, self.children + children, self.leaves + leaves, self.saved + saved, self.hub | hub
        self.ends = ends if ends is not None else self.ends
        if least is not None:
            self.least = least if self.least is None else min(self.least, least)

    def partial(self) -> tuple:
        return self.n, self.least, self.children, self.leaves, self.saved, self.ends, self.hub


class _Sweep:
    """The stack of the current array's open nodes; out gathers rows of _OUT."""

    def __init__(self, top: int, whole: bool):
        self.top, self.whole = top, whole  # depth of the arrays' start; whole: nothing goes on outside this partition
        self.stack: list[_Node] = []
        self.base, self.seg, self.lens = None, "", []
        self.left: tuple | None = None
        self.spine: dict[int, tuple] = {}
        self.out: list[tuple] = []

    def _emit(self, kind: str, **values: object) -> None:
        row = [None] * len(_OUT)
        row[0] = kind
        for name, value in values.items():
            row[_AT[name]] = value
        self.out.append(tuple(row))

    def _flush(self, node: _Node, **parent: object) -> None:
        for depth, least, n, children, leaves, saved, ends in node.kids:
            self._emit("node", depth=depth, conv_id=least, n_convs=n, n_children=children, n_leaves=leaves, saved_tokens=saved, ends_sha256=ends, **parent)
        node.kids = []

    def _pop(self) -> None:
        depth = len(self.stack) - 1
        node = self.stack.pop()
        here = _id(self.base, self.seg[: KEY * depth]) if depth else self.base
        if node.first and not self.whole:  # it may have begun in the partition before
            self.spine[depth] = node.partial()
            return self._flush(node, parent_id=here)
        if not depth and self.top:  # the node itself belongs to the level above
            self._emit("root", id=here, n_children=node.children, n_leaves=node.leaves, saved_tokens=node.saved)
            return self._flush(node, parent_id=here)
        leaves = node.leaves if node.children else 1
        saved = node.saved + (node.n - 1) * (self.lens[depth - 1] if depth else 0)
        if node.hub or self.whole:
            self._emit("hub", id=here, conv_id=node.least)
        self._flush(node, parent_conv_id=node.least)
        done = (self.top + depth, node.least, node.n, node.children, leaves, saved, node.ends or _NONE)
        if not depth:
            node.kids = [done]
            return self._flush(node)
        parent = self.stack[-1]
        parent.add(node.n, node.least, 1, leaves, saved, None, 0)
        parent.kids.append(done)
        if len(parent.kids) >= KIDS:
            parent.hub = 1
            self._flush(parent, parent_id=_id(self.base, self.seg[: KEY * (depth - 1)]) if depth > 1 else self.base)

    def open(self, base: str, seg: str, lens: list[int]) -> None:
        """Close what the next array does not share and open what it adds."""
        first = self.base is None
        keep = shared(self.seg, seg) + 1 if base == self.base else 0
        while len(self.stack) > keep:
            self._pop()
        self.base, self.seg, self.lens = base, seg, lens
        if first:
            self.left = (base, seg, lens)
        while len(self.stack) <= len(seg) // KEY:
            self.stack.append(_Node(first))

    def close(self, part: int) -> None:
        """The last array: its nodes may go on in the next partition."""
        if self.base is None:
            return
        if self.whole:
            while self.stack:
                self._pop()
            return
        right: dict[int, tuple] = {}
        for depth, node in enumerate(self.stack):
            (self.spine if node.first else right)[depth] = node.partial()
            self._flush(node, parent_id=_id(self.base, self.seg[: KEY * depth]) if depth else self.base)
        for side, (base, seg, lens), held in ((0, self.left, self.spine), (1, (self.base, self.seg, self.lens), right)):
            if held:
                parts = [held.get(depth, (0, None, 0, 0, 0, None, 0)) for depth in range(len(seg) // KEY + 1)]
                self._emit("spine", part=part, side=side, base=base, seg=seg, lens=lens, **{f"part_{n}": list(v) for n, v in zip(_FIELDS, zip(*parts, strict=True), strict=True)})


def _sweep(top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep = _Sweep(top, whole=False)
        for batch in batches:
            for base, seg, lens, n, least, ends, children, leaves, saved in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sweep.open(base, seg, lens)
                below = children is not None
                sweep.stack[-1].add(n, least, children or 0, leaves or 0, saved or 0, ends, int(below))
                if len(sweep.out) >= FLUSH:
                    yield _batch(sweep.out, _OUT)
                    sweep.out = []
        sweep.close(TaskContext.get().partitionId())
        yield _batch(sweep.out, _OUT)

    return run


def _stitch(top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep = _Sweep(top, whole=True)
        for batch in batches:
            for base, seg, lens, *parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sweep.open(base, seg, lens)
                for node, part in zip(sweep.stack, zip(*parts, strict=True), strict=True):
                    node.add(*part)
                if len(sweep.out) >= FLUSH:
                    yield _batch(sweep.out, _OUT)
                    sweep.out = []
        sweep.close(0)
        yield _batch(sweep.out, _OUT)

    return run


def prefix_trie(turns: DataFrame, conversations: DataFrame, scratch: Scratch, width: int | None = None) -> DataFrame:
    """turns (conv_id, pos, key, n_bytes), conversations (conv_id, n_turns) -> one row a trie node.

    Columns conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256.  Conversations without turns are members of the root; without any
    conversation there is no node.  Keeps the tables that the result reads beyond scratch's block.
    """
    longest = conversations.agg(F.max("n_turns")).first()[0]
    width = width or max(WIDTH, -(-(longest or 0) // LEVELS))
    levels = max(1, -(-(longest or 0) // width))
    at = F.struct((F.col("pos") % width).cast("int").alias("at"), "key", "n_bytes")
    arrays = turns.groupBy("conv_id", F.expr(f"cast(pos div {width} as int)").alias("level")).agg(F.array_sort(F.collect_list(at)).alias("a"))
    arrays = arrays.select("conv_id", "level", F.array_join("a.key", "").alias("seg"), F.col("a.n_bytes").alias("lens"))
    empty = conversations.where("n_turns = 0").select("conv_id", F.lit(0).alias("level"), F.lit("").alias("seg"), F.lit([]).cast("array<long>").alias("lens"))
    arrays = scratch.table("arrays", arrays.unionByName(empty))
    last = conversations.select("conv_id", F.expr(f"cast((greatest(n_turns, 1) - 1) div {width} as int)").alias("last"))
    names = []
    for level in range(levels):  # from the top down: what an array stands below
        rows = arrays.where(F.col("level") == level).drop("level").join(last, "conv_id")
        if level:
            rows = rows.join(above.where("last >= " + str(level)).select("conv_id", F.col("path").alias("base")), "conv_id")
        else:
            rows = rows.withColumn("base", F.lit(""))
        above = scratch.table(f"level{level}", rows.withColumn("path", _path()))
        names.append(above)
    scratch.drop("arrays")
    found, roots = [], None
    for level in reversed(range(levels)):  # from the bottom up: what a node sums over its subtree
        rows = names[level]
        ends = _ends(rows.where(F.col("last") == level).select("path", "conv_id"))
        each = rows.groupBy("path").agg(F.first("base").alias("base"), F.first("seg").alias("seg"), F.first("lens").alias("lens"), F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least"))
        each = each.join(ends, "path", "left")
        if roots is None:
            each = each.withColumns({c: F.lit(None).cast("long") for c in ("n_children", "n_leaves", "saved_tokens")})
        else:
            each = each.join(roots.select(F.col("id").alias("path"), "n_children", "n_leaves", "saved_tokens"), "path", "left")
        each = scratch.table(f"distinct{level}", each.select("base", "seg", "lens", "n", "least", "ends", "n_children", "n_leaves", "saved_tokens"))
        scratch.drop(f"level{level}")
        swept = scratch.table(f"swept{level}", each.repartitionByRange("base", "seg").sortWithinPartitions("base", "seg").mapInArrow(_sweep(level * width), _OUT_SCHEMA))
        scratch.drop(f"distinct{level}")
        spines = swept.where("kind = 'spine'").repartition(1).sortWithinPartitions("part", "side")  # two rows a partition
        stitched = scratch.table(f"stitched{level}", spines.select("base", "seg", "lens", *(f"part_{n}" for n in _FIELDS)).mapInArrow(_stitch(level * width), _OUT_SCHEMA))
        both = swept.unionByName(stitched)
        found.append(both.where("kind in ('node', 'hub')"))
        roots = both.where("kind = 'root'")
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    nodes = every.where("kind = 'node'").select("conv_id", "depth", "parent_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    hubs = every.where("kind = 'hub'").select(F.col("id").alias("parent_id"), F.col("conv_id").alias("of_hub"))
    scratch.hold_only(*(f"{name}{level}" for name in ("swept", "stitched") for level in range(levels)))
    known = nodes.where("parent_id is null").drop("parent_id")
    asked = nodes.where("parent_id is not null").drop("parent_conv_id").join(hubs, "parent_id").withColumnRenamed("of_hub", "parent_conv_id")
    return known.unionByName(asked.select(*known.columns))
