"""Removal of byte strings that earlier documents hold, by bucket-pointer refinement.

A suffix is judged by its first ``length`` bytes.  Sorting all suffixes of a corpus would move
many times its size, so it is made sparse first: in every stretch of ``length`` bytes the GRAM-byte
string with the least hash is its *anchor*.  Equal stretches have equal anchors at equal places, so
only suffixes whose anchor occurs in two documents or more can match.  Anchors are counted in
sliced sketches (see blocks.py); nothing shared is lost.

Initial buckets are the suffixes' anchors: whole buckets meet in one task, with the bytes around
each anchor (30 before, 50 from it on).  Where these are all equal the bucket is settled.  In the
others, bucket-pointer refinement sorts every suffix that reaches over the anchor: the identifiers
of 8-byte strings are refined to 16 bytes by sorting on the identifiers 8 places on, these to 32 by
the new identifiers 16 places on, and these to 50 by those 18 places on.  The smallest doc_id of a
final bucket then decides for all its suffixes.

The bucket of an anchor that very many documents hold would be too large for a task.  It is split:
its suffixes of ``length`` bytes go out one by one, each distinct one once for a block, dealt to
tasks by the hash of all their bytes, and are refined there in the same way.  So the result does not
depend on where the line is drawn.  Long texts are hashed a stretch at a time.

What is exchanged is one row for a slice and a bundle of blocks.  Slices and blocks both grow with the
corpus, so their product would grow with its square; bundles grow with it up to BUNDLE_BYTES.  The
blocks of a bundle are still worked on one after another, so a task needs little more memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from siftworks.llm.blocks import (
    EXCHANGE_SCHEMA, blocks_of, cut, exchange_rows, is_member, pack_blocks, pack_ints, repeated_cells, unpack_ints,
)
from siftworks.llm.hashing import BASES, CHUNK, covered, hash_spans, mix, rolling, runs
from siftworks.llm.scratch import Scratch

LENGTH = 50
GRAM = 20
BLOCK_BYTES = 3 << 18  # a task needs up to 200 times as much memory
BUNDLE_BYTES = 16 * BLOCK_BYTES  # text whose blocks share rows of the exchange, at most
BUNDLES = 128  # bundles of a corpus, below that size
HOT = 5_000  # documents with an anchor from which its bucket is split
_CELLS, _CROWDED, _AROUND, _SINGLE, _VERDICT, _SINGLE_VERDICT = range(6)
_PARTS = 8  # parts in which a task judges its slice
_CELL_FACTOR = 64  # cells of the sketch for each anchor expected


def _sliding(op: np.ufunc, x: np.ndarray, width: int) -> np.ndarray:
    """op over every run of width values, by doubling."""
    size = 1
    while size * 2 <= width:
        x = op(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return op(x[: len(x) - rest], x[rest:]) if rest else x


class _Anchors:
    """Anchors of the texts of a block."""

    def __init__(self, ids: list, texts: list[bytes], length: int, gram: int):
        raw = np.frombuffer(b"".join(texts), np.uint8)
        self.size, self.reach = len(raw), length - gram
        self.lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.ends = np.cumsum(self.lengths)
        self.starts = self.ends - self.lengths
        self.raw = raw
        self.at = np.zeros(0, np.int64)
        self.hash = np.zeros(0, np.uint64)
        known = np.array([i is not None for i in ids], dtype=bool)
        usable = known & (self.lengths >= length)
        if usable.any():
            valid = np.zeros(len(raw) + 1, np.int8)
            np.add.at(valid, self.starts[usable], 1)
            np.add.at(valid, self.ends[usable] - length + 1, -1)
            valid = np.cumsum(valid, dtype=np.int8).astype(bool)  # does a stretch start here?
            parts = [self._of_piece(raw[i : i + CHUNK + length - 1], valid[i : i + CHUNK], i, gram) for i in range(0, len(raw) - length + 1, CHUNK)]
            at = np.concatenate([x for x, _ in parts])
            self.at, first = np.unique(at, return_index=True)  # a stretch on either side of a border may have the same anchor
            self.hash = mix(np.concatenate([h for _, h in parts])[first])  # the least hashes are small numbers; mixed again they spread over the slices
        self.text = np.searchsorted(self.ends, self.at, side="right")
        self.doc = np.array([i if i is not None else 0 for i in ids], dtype=np.int64)[self.text] if len(ids) else self.at

    def _of_piece(self, raw: np.ndarray, valid: np.ndarray, offset: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
        """Anchors of the stretches that start in one piece of the block."""
        h = rolling(raw + np.uint8(1), gram, 0)  # UTF-8 has no byte 255
        short = (h >> np.uint64(32)).astype(np.uint32)
        least = _sliding(np.minimum, short, self.reach + 1)  # of the stretch from each place
        valid = valid[: len(least)]
        floor = np.zeros(len(least) + 2 * self.reach, np.uint32)
        floor[self.reach : self.reach + len(least)] = np.where(valid, least, 0)
        asked = np.zeros(len(floor), bool)
        asked[self.reach : self.reach + len(least)] = valid
        high = _sliding(np.maximum, floor, self.reach + 1)[: len(h)]
        some = _sliding(np.logical_or, asked, self.reach + 1)[: len(h)]
        at = np.flatnonzero(some & (high == short))
        return at + offset, h[at]

    def keep(self, pick: np.ndarray) -> None:
        for name in ("at", "hash", "text", "doc"):
            setattr(self, name, getattr(self, name)[pick])

    def room(self) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the document before each anchor, at most reach, and from it on, at most reach + GRAM."""
        return np.minimum(self.at - self.starts[self.text], self.reach), self.ends[self.text] - self.at


class _Plan:
    def __init__(self, n_bytes: int, length: int, gram: int, slice_entries: int):
        self.length, self.gram, self.reach = length, gram, length - gram
        anchors = max(1, 2 * n_bytes // (self.reach + 2))
        self.bits = max(12, int(np.ceil(np.log2(anchors * _CELL_FACTOR))))
        self.slice_bits = min(self.bits - 8, max(6, int(np.ceil(np.log2(max(1, anchors // slice_entries))))))

    def cells(self, h: np.ndarray) -> np.ndarray:
        return mix(h) >> np.uint64(64 - self.bits)

    def slices(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.slice_bits)).astype(np.int64) if self.slice_bits else np.zeros(len(h), np.int64)


def _sketch(plan: _Plan):
    base = plan.bits - plan.slice_bits

    def rows(bundle: int, parts: list[np.ndarray]) -> pa.RecordBatch:
        cells = np.sort(np.concatenate(parts))
        slices = (cells >> np.uint64(base)).astype(np.int64)
        return exchange_rows([(_CELLS, s, bundle, pack_ints(cells[i:j] - np.uint64(s << base))) for s, i, j in cut(cells, slices)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        for batch in batches:
            for bundle, (_, ids, texts) in zip(batch.column("bundle").to_pylist(), blocks_of(batch), strict=True):
                if parts and bundle != now:
                    yield rows(now, parts)
                    parts = []
                now = bundle
                a = _Anchors(ids, texts, plan.length, plan.gram)
                order = np.lexsort((a.doc, a.hash))
                h, doc = a.hash[order], a.doc[order]
                new = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]) if len(h) else np.zeros(0, bool)
                parts.append(plan.cells(h[new]))
        if parts:
            yield rows(now, parts)

    return run


def _groups(keys: list[np.ndarray], doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows with equal keys: group of each row, first row (least doc) of each group, groups in key order."""
    order = np.lexsort((doc, *keys[::-1]))
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    of = np.empty(len(order), np.int64)
    of[order] = np.cumsum(new) - 1
    return of, order[new], order


class _Told:
    """What a bundle was told: cells, and answers to what its blocks asked, slice by slice in the order of the blocks."""

    def __init__(self, told: pa.Table, plan: _Plan):
        base = plan.bits - plan.slice_bits
        lists: dict[int, list[np.ndarray]] = {_CELLS: [], _CROWDED: []}
        self.answers: dict[tuple[int, int], bytes] = {}
        self.used: dict[tuple[int, int], int] = {}
        for kind, sl, data in zip(*(told.column(n).to_pylist() for n in ("kind", "slice", "data")), strict=True):
            if kind in lists:
                lists[kind].append(unpack_ints(data) + np.uint64(sl << base))
            else:
                self.answers[kind, sl] = data
        self.sets = {k: np.sort(np.concatenate(v)) if v else np.zeros(0, np.uint64) for k, v in lists.items()}

    def next_bits(self, kind: int, sl: int, count: int) -> np.ndarray | None:
        """The next count answers of a slice; None where it has none at all."""
        if (kind, sl) not in self.answers:
            return None
        start = self.used.get((kind, sl), 0)
        self.used[kind, sl] = end = start + count
        held = np.frombuffer(self.answers[kind, sl], np.uint8)[start >> 3 : (end + 7) >> 3]
        return np.unpackbits(held)[start & 7 :][:count]


class _Suffixes:
    """What a block asks about: its distinct surroundings of shared anchors, and single stretches."""

    def __init__(self, ids: list, texts: list[bytes], told: _Told, plan: _Plan):
        a = self.a = _Anchors(ids, texts, plan.length, plan.gram)
        self.told = told
        a.keep(is_member(told.sets[_CELLS], plan.cells(a.hash)))
        crowded = is_member(told.sets[_CROWDED], plan.cells(a.hash))
        before, after = a.room()
        after = np.minimum(after, plan.length)

        def hashed(starts: np.ndarray, ends: np.ndarray, extra: np.ndarray, which: int) -> np.ndarray:
            return mix(hash_spans(a.raw, starts, ends, which) + extra * np.uint64(BASES[3])) if len(starts) else np.zeros(0, np.uint64)

        # surroundings of the anchors that are gathered
        self.rows = np.flatnonzero(~crowded)
        r = self.rows
        room = (before[r] * 64 + after[r]).astype(np.uint64)
        self.of, self.first, _ = _groups([a.hash[r], hashed(a.at[r] - before[r], a.at[r] + after[r], room, 1)], a.doc[r])
        self.slices = plan.slices(a.hash[r][self.first])
        self.before, self.after = before[r], after[r]
        # single stretches over anchors whose bucket is split
        c = np.flatnonzero(crowded)
        starts = []
        for step in range(plan.reach + 1):
            ok = (before[c] >= step) & (after[c] >= plan.length - step)
            starts.append((a.at[c] - step)[ok])
        self.single = np.unique(np.concatenate(starts)) if starts else np.zeros(0, np.int64)
        keys = [hashed(self.single, self.single + plan.length, np.zeros(len(self.single), np.uint64), i) for i in (0, 1)]
        text = np.searchsorted(a.ends, self.single, side="right")
        self.single_doc = np.array([i if i is not None else 0 for i in ids], dtype=np.int64)[text] if len(ids) else self.single
        self.single_of, self.single_first, _ = _groups(keys, self.single_doc)
        self.single_keys = [k[self.single_first] for k in keys]
        self.single_slices = plan.slices(self.single_keys[0])

    def requests(self, plan: _Plan) -> Iterator[tuple[int, int, tuple[bytes, ...]]]:
        """(kind, slice, columns) of the rows that are asked about."""
        a = self.a
        at = a.at[self.rows][self.first]
        doc = a.doc[self.rows][self.first]
        room = np.stack([self.before[self.first], self.after[self.first]], axis=1).astype(np.uint8)
        padded = np.concatenate([np.zeros(plan.reach, np.uint8), a.raw, np.zeros(plan.length, np.uint8)])
        column = np.arange(plan.reach + plan.length)
        for s, i, j in cut(at, self.slices):
            around = padded[at[i:j, None] + column]
            inside = (column >= plan.reach - room[i:j, :1].astype(np.int64)) & (column < plan.reach + room[i:j, 1:].astype(np.int64))
            around[~inside] = 0
            yield _AROUND, s, (doc[i:j].tobytes(), room[i:j].tobytes(), around.tobytes())
        doc = self.single_doc[self.single_first]
        at = self.single[self.single_first]
        for s, i, j in cut(doc, self.single_slices):
            yield _SINGLE, s, (doc[i:j].tobytes(), self.single_keys[0][i:j].tobytes(), padded[at[i:j, None] + column[plan.reach :]].tobytes())

    def stretches(self, plan: _Plan) -> np.ndarray:
        """Starts of the stretches that a smaller document holds as well."""
        a = self.a
        width = plan.reach + 1
        yes = np.zeros((len(self.first), width), bool)
        for s, i, j in cut(self.first, self.slices):
            if (bits := self.told.next_bits(_VERDICT, s, (j - i) * width)) is not None:
                yes[i:j] = bits.reshape(-1, width)
        doc = a.doc[self.rows]
        later = doc > doc[self.first][self.of]  # a smaller document of this block has the same surroundings
        step = plan.reach - np.arange(width)
        fits = (self.before[:, None] >= step) & (self.after[:, None] >= plan.length - step)
        row, col = np.nonzero(fits & (yes[self.of] | later[:, None]))
        found = [a.at[self.rows][row] - step[col]]
        one = np.zeros(len(self.single_first), bool)
        for s, i, j in cut(self.single_first, self.single_slices):
            if (bits := self.told.next_bits(_SINGLE_VERDICT, s, j - i)) is not None:
                one[i:j] = bits
        d = self.single_doc
        found.append(self.single[one[self.single_of] | (d > d[self.single_first][self.single_of])])
        return np.concatenate(found)


def _identifiers(keys: np.ndarray) -> np.ndarray:
    """Bucket identifiers: the rank of each key among the distinct ones, in the shape of keys."""
    return np.unique(keys.ravel(), return_inverse=True)[1].reshape(keys.shape).astype(np.int64)


def refine(around: np.ndarray, length: int) -> np.ndarray:
    """rows x bytes -> identifiers of the length-byte string from each place, by bucket pointers.

    Equal identifiers mean equal strings.  The first buckets are of 8 bytes.
    """
    depth = min(8, length)
    wide = np.lib.stride_tricks.sliding_window_view(around, depth, axis=1)
    first = np.zeros(wide.shape[:2], np.uint64)
    for b in range(depth):
        first = (first << np.uint64(8)) | wide[:, :, b].astype(np.uint64)
    now = _identifiers(first)
    while depth < length:
        step = min(depth, length - depth)
        pointed = now[:, step:]  # the buckets of the suffixes that start step bytes later
        now = _identifiers(now[:, : pointed.shape[1]] * np.int64(pointed.max(initial=0) + 1) + pointed)
        depth += step
    return now


def _batches(rows: np.ndarray, bucket: np.ndarray, size: int = 4096) -> Iterator[np.ndarray]:
    """rows in order, about size at a time, no bucket cut."""
    start = 0
    while start < len(rows):
        end = min(start + size, len(rows))
        end = int(np.searchsorted(bucket, bucket[end - 1], side="right"))
        yield rows[start:end]
        start = end


def _judge(plan: _Plan):
    width, total = plan.reach + 1, plan.reach + plan.length
    big = np.iinfo(np.int64).max

    def around_verdicts(parts: list[bytes]) -> list[bytes]:
        raws = [zstandard.ZstdDecompressor().decompress(p) for p in parts]
        counts = [len(r) // (10 + total) for r in raws]
        doc = np.concatenate([np.frombuffer(r, np.int64, n) for r, n in zip(raws, counts, strict=True)])
        room = np.concatenate([np.frombuffer(r, np.uint8, 2 * n, 8 * n).reshape(n, 2) for r, n in zip(raws, counts, strict=True)])
        text = np.concatenate([np.frombuffer(r, np.uint8, total * n, 10 * n).reshape(n, total) for r, n in zip(raws, counts, strict=True)])
        del raws
        # buckets share their anchor, so a few bytes of it deal them to parts that are judged one after another
        part = (text[:, plan.reach].astype(np.int64) * 7 + text[:, plan.reach + 7] * 31 + text[:, plan.reach + 13] * 131) % _PARTS
        later = np.zeros((len(doc), width), bool)
        for p in range(_PARTS):
            rows = np.flatnonzero(part == p)
            if len(rows):
                later[rows] = smaller_elsewhere(doc[rows], room[rows], text[rows])
        ends = np.cumsum([0, *counts]).tolist()
        return [np.packbits(later[i:j]).tobytes() for i, j in zip(ends, ends[1:], strict=False)]

    def smaller_elsewhere(doc: np.ndarray, room: np.ndarray, text: np.ndarray) -> np.ndarray:
        """rows x places of the stretch: does a smaller document hold the same stretch over the same anchor?"""
        gram = text[:, plan.reach : plan.length]
        key = np.ascontiguousarray(np.concatenate([gram, text, room], axis=1)).view(f"V{plan.gram + total + 2}").ravel()
        _, first, of = np.unique(key, return_index=True, return_inverse=True)
        del key
        least = np.full(len(first), big)
        np.minimum.at(least, of, doc)
        # rows of np.unique are in byte order, so a bucket's rows stand together
        own = gram[first]
        new = np.concatenate([[True], (own[1:] != own[:-1]).any(axis=1)])
        bucket = np.cumsum(new) - 1
        step = plan.reach - np.arange(width)
        fits = (room[first, :1].astype(np.int64) >= step) & (room[first, 1:].astype(np.int64) >= plan.length - step)
        smallest = np.where(fits, least[:, None], big)
        mixed = np.flatnonzero(np.bincount(bucket)[bucket] > 1)
        for part in _batches(mixed, bucket[mixed]):  # equal strings have equal anchors: buckets are apart
            names = refine(text[first[part]], plan.length)
            ok = fits[part]
            best = np.full(names.max() + 1, big)
            np.minimum.at(best, names[ok], np.broadcast_to(least[part, None], names.shape)[ok])
            smallest[part] = np.where(ok, best[names], big)
        return smallest[of] < doc[:, None]

    def single_verdicts(parts: list[bytes]) -> list[bytes]:
        raws = [zstandard.ZstdDecompressor().decompress(p) for p in parts]
        counts = [len(r) // (16 + plan.length) for r in raws]
        doc = np.concatenate([np.frombuffer(r, np.int64, n) for r, n in zip(raws, counts, strict=True)])
        key = np.concatenate([np.frombuffer(r, np.uint64, n, 8 * n) for r, n in zip(raws, counts, strict=True)])
        text = np.concatenate([np.frombuffer(r, np.uint8, plan.length * n, 16 * n).reshape(n, plan.length) for r, n in zip(raws, counts, strict=True)])
        del raws
        order = np.argsort(key, kind="stable")
        later = np.zeros(len(doc), bool)
        for part in _batches(order, key[order]):  # equal strings have equal hashes: buckets are apart
            names = refine(text[part], plan.length)[:, 0]
            best = np.full(names.max() + 1, big)
            np.minimum.at(best, names, doc[part])
            later[part] = doc[part] > best[names]
        ends = np.cumsum([0, *counts]).tolist()
        return [np.packbits(later[i:j]).tobytes() for i, j in zip(ends, ends[1:], strict=False)]

    def run(table: pa.Table) -> pa.Table:
        kind = table.column("kind")[0].as_py()
        parts = table.column("data").to_pylist()
        answers = around_verdicts(parts) if kind == _AROUND else single_verdicts(parts)
        to = _VERDICT if kind == _AROUND else _SINGLE_VERDICT
        return pa.Table.from_batches([exchange_rows([(to, s, b, a) for s, b, a in zip(table.column("slice").to_pylist(), table.column("block").to_pylist(), answers, strict=True)])])

    return run


def _strip(plan: _Plan):
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])

    def run(block_rows: pa.Table, told: pa.Table) -> pa.Table:
        out: list[tuple] = []
        known = _Told(told, plan)
        for _, ids, texts in blocks_of(block_rows.sort_by("block")):
            s = _Suffixes(ids, texts, known, plan)
            gone = covered(s.a.size, s.stretches(plan), plan.length)
            for doc, text, i, j in zip(ids, texts, s.a.starts.tolist(), s.a.ends.tolist(), strict=True):
                drop = gone[i:j]
                n = int(drop.sum())
                kept = s.a.raw[i:j][~drop].tobytes() if n else text
                out.append((doc, j - i, n, len(runs(drop)[0]) if n else 0, kept))
        columns = list(zip(*out, strict=True)) if out else [[]] * len(schema)
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

    return run


def _ask(plan: _Plan):
    def run(block_rows: pa.Table, told: pa.Table) -> pa.Table:
        known, asked = _Told(told, plan), {}
        for _, ids, texts in blocks_of(block_rows.sort_by("block")):
            for kind, sl, columns in _Suffixes(ids, texts, known, plan).requests(plan):
                asked.setdefault((kind, sl), []).append(columns)
        bundle = block_rows.column("bundle")[0].as_py() if block_rows.num_rows else None
        pack = zstandard.ZstdCompressor(level=3).compress
        return pa.Table.from_batches([exchange_rows([(kind, sl, bundle, pack(b"".join(b"".join(c) for c in zip(*parts, strict=True)))) for (kind, sl), parts in asked.items()])])

    return run


def remove_earlier_strings(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, block_bytes: int = BLOCK_BYTES, slice_entries: int = 250_000, bundle_bytes: int | None = None) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, n_bytes, n_removed, n_spans, kept binary): one row per input row.

    Texts are UTF-8 bytes.  A byte goes if a string of ``length`` bytes that covers it also starts in
    a document with a smaller doc_id; strings never cross documents.  kept is what stays, n_spans the
    number of maximal removed runs.  A null text is empty.  Rows with one doc_id are not smaller than
    each other, so repeated rows stay; a row with a null doc_id neither loses bytes nor takes any.
    Other columns are ignored; an empty table gives no rows.  bundle_bytes follows the corpus if None.
    """
    scratch = Scratch(docs.sparkSession)
    blocks = scratch.table("blocks", pack_blocks(docs, block_bytes))
    n_bytes = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    plan = _Plan(n_bytes, length, gram, slice_entries)
    # Blocks are numbered in their task: neighbours make a bundle.
    together = max(1, (min(BUNDLE_BYTES, n_bytes // BUNDLES) if bundle_bytes is None else bundle_bytes) // block_bytes)
    low = F.col("block").bitwiseAND(F.lit((1 << 32) - 1))
    bundle = F.col("block") - low + F.floor(low / together).cast("long")
    text = blocks.select(bundle.alias("bundle"), "block", "doc_ids", "lengths", "data")
    cells = scratch.table("cells", repeated_cells(text.mapInArrow(_sketch(plan), EXCHANGE_SCHEMA), hot, _CROWDED))
    of_bundle = lambda rows: rows.withColumnRenamed("block", "bundle").groupBy("bundle")
    asked = text.groupBy("bundle").cogroup(of_bundle(cells)).applyInArrow(_ask(plan), EXCHANGE_SCHEMA)
    asked = asked.repartition(3 << plan.slice_bits, "kind", "slice")  # about a slice to a task, at any size
    verdicts = scratch.table("verdicts", asked.groupBy("kind", "slice").applyInArrow(_judge(plan), EXCHANGE_SCHEMA))
    scratch.hold()
    told = of_bundle(cells.unionByName(verdicts))
    return text.groupBy("bundle").cogroup(told).applyInArrow(_strip(plan), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
