"""Filling containers of a fixed capacity with items, by swap-based local search.

An item longer than the capacity is cut into full containers and one remainder; nothing else is
cut. The remainders and all shorter items are spread by hash over blocks of a bounded number of
items. A block is packed in one task: a first placement, then a search over the underfull
containers that exchanges one item for one, two for one, or moves an item whenever that raises the
sum of squared fills, until containers run empty and no such step is left. What a block leaves in
underfull containers goes into the next round, where far fewer blocks are packed in the same way;
the last round packs what is left of all blocks. Every round ends in a reliable checkpoint, so a
container's number never depends on a task that ran twice.
"""

from __future__ import annotations

from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.bpe import DEFAULT_RANKS, encode_documents
from plumbline.session import cut_lineage

CAPACITY = 2048
#: Items of a block: what one task packs at a time.
BLOCK_ITEMS = 20_000


def _first_placement(sizes: list[int], capacity: int) -> tuple[list[dict[int, None]], list[int]]:
    """Largest first, each into the container where it leaves the least room: items and fill by container."""
    bins: list[dict[int, None]] = []
    fill: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: some container has room r
    for item in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        s = sizes[item]
        fitting = rooms >> s
        if fitting:
            room = s + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            b, room = len(bins), capacity
            bins.append({})
            fill.append(0)
        bins[b][item] = None
        fill[b] += s
        by_room[room - s].append(b)
        rooms |= 1 << (room - s)
    return bins, fill


class _Search:
    """The local search over the underfull containers of a block.

    The items of all underfull containers but the current one are indexed by size, with a bit set
    of the sizes at hand and its mirror image; the best move, exchange or pair is then a matter of
    a few shifts, however many containers there are.
    """

    def __init__(self, sizes: list[int], bins: list[dict[int, None]], fill: list[int], capacity: int):
        self.sizes, self.bins, self.fill, self.capacity = sizes, bins, fill, capacity
        self.by_size: list[dict[int, int]] = [{} for _ in range(capacity + 1)]  # size -> item -> container
        self.present = self.mirror = 0

    def index(self, item: int, b: int) -> None:
        s = self.sizes[item]
        self.by_size[s][item] = b
        self.present |= 1 << s
        self.mirror |= 1 << (self.capacity - s)

    def unindex(self, item: int) -> int:
        s = self.sizes[item]
        b = self.by_size[s].pop(item)
        if not self.by_size[s]:
            self.present &= ~(1 << s)
            self.mirror &= ~(1 << (self.capacity - s))
        return b

    def _largest(self, most: int) -> int:
        """The largest size above 0 and at most ``most`` at hand, or 0."""
        return max((self.present & ((1 << (min(most, self.capacity) + 1)) - 1)).bit_length() - 1, 0)

    def _pair(self, least: int, most: int) -> tuple[int, int] | None:
        """Two sizes at hand with the largest sum in (least, most]."""
        for total in range(min(most, self.capacity), least, -1):
            both = self.present & (self.mirror >> (self.capacity - total)) & ~1
            while both:
                x = both.bit_length() - 1
                y = total - x
                if y > 0 and (x != y or len(self.by_size[x]) > 1):
                    return x, y
                both &= ~((1 << x) | (1 << max(y, 0)))
        return None

    def step(self, a: int) -> bool:
        """The step that leaves ``a`` with the least room, if it raises the sum of squared fills."""
        room = self.capacity - self.fill[a]
        come: tuple[int, ...] = ()
        go = None
        best = self._largest(room)  # a move
        if best:
            come = (best,)
        mine = sorted({self.sizes[i]: i for i in self.bins[a]}.items())
        for s, item in mine:
            if best == room:
                break
            x = self._largest(room + s)  # one for one
            if x - s > best:
                best, come, go = x - s, (x,), item
        for s, item in mine:
            if best == room:
                break
            pair = self._pair(best + s, room + s)  # two for one
            if pair and sum(pair) - s > best:
                best, come, go = sum(pair) - s, pair, item
        if not best:
            return False
        items = []
        for x in come:
            items.append(next(i for i in self.by_size[x] if i not in items))
        at = [self.by_size[self.sizes[i]][i] for i in items]
        new = {a: self.fill[a] + best}
        for i, b in zip(items, at):
            new[b] = new.get(b, self.fill[b]) - self.sizes[i]
        if go is not None:
            new[at[0]] += self.sizes[go]
        if max(new.values()) > self.capacity or sum(f * f for f in new.values()) <= sum(self.fill[b] ** 2 for b in new):
            return False
        if go is not None:
            del self.bins[a][go]
            self.bins[at[0]][go] = None
            self.index(go, at[0])
        for i, b in zip(items, at):
            self.unindex(i)
            del self.bins[b][i]
            self.bins[a][i] = None
        for b, f in new.items():
            self.fill[b] = f
        return True

    def run(self) -> None:
        waiting = [b for b, f in enumerate(self.fill) if f < self.capacity]
        for b in waiting:
            for i in self.bins[b]:
                self.index(i, b)
        heap = [(-self.fill[b], b) for b in waiting]
        heapify(heap)
        done: set[int] = set()
        while heap:
            # The fullest is topped up until no step is left; then it takes no further part.
            f, a = heappop(heap)
            if a in done or -f != self.fill[a]:
                if a not in done:
                    heappush(heap, (-self.fill[a], a))
                continue
            done.add(a)
            for i in self.bins[a]:
                self.unindex(i)
            while self.fill[a] < self.capacity and self.step(a):
                pass


def pack(sizes: list[int], capacity: int = CAPACITY) -> list[int]:
    """The container of each item (0 <= size <= capacity), numbered from 0 without holes.

    Deterministic for a given order of sizes; no items give no containers.
    """
    bins, fill = _first_placement(sizes, capacity)
    _Search(sizes, bins, fill, capacity).run()
    out, number = [0] * len(sizes), 0
    for x in bins:
        if x:
            for item in x:
                out[item] = number
            number += 1
    return out


def _pack_block(capacity: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n", "d", "k", "piece"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
        pdf["bin"] = np.asarray(pack(pdf["n"].tolist(), capacity), np.int64)
        pdf["fill"] = pdf.groupby("bin")["n"].transform("sum")
        return pdf[["d", "k", "piece", "first", "n", "block", "bin", "fill"]]

    return run


def pack_items(items: DataFrame, n_items: int, capacity: int = CAPACITY, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(d, k, piece, first, n, container) for items (d, k, piece, first, n) with 0 <= n <= capacity.

    ``n_items`` is an upper bound on their number and fixes the number of blocks.
    """
    spark = items.sparkSession
    kind = items.schema["d"].dataType
    schema = T.StructType([T.StructField("d", kind), *(T.StructField(c, T.LongType()) for c in ("k", "piece", "first", "n", "block", "bin", "fill"))])
    done, rest, level = None, items, 0
    while True:
        blocks = max(1, -(-n_items // block_items))
        block = F.pmod(F.xxhash64("d", "k", "piece", F.lit(level)), F.lit(blocks))
        packed = cut_lineage(rest.withColumn("block", block).groupBy("block").applyInPandas(_pack_block(capacity), schema))
        name = F.concat_ws("-", F.lit(f"c{level}"), "block", "bin")
        final = packed if blocks == 1 else packed.where(F.col("fill") == capacity)
        final = final.select("d", "k", "piece", "first", "n", name.alias("container"))
        done = final if done is None else done.unionByName(final)
        if blocks == 1:
            return done
        rest = packed.where(F.col("fill") < capacity).select("d", "k", "piece", "first", "n")
        left = rest.count()
        if left >= n_items:  # nothing became full: more rounds would not help
            open_ = packed.where(F.col("fill") < capacity).select("d", "k", "piece", "first", "n", name.alias("container"))
            return done.unionByName(open_)
        n_items, level = left, level + 1
        if not left:
            return done


def containers(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, path: str = DEFAULT_RANKS) -> DataFrame:
    """(doc_id, text_key, piece, first_token, n_tokens, container): the container of each document or piece.

    A document longer than ``capacity`` is cut into full containers and one remainder, numbered
    from 0; any other is one piece. Null and empty texts are one piece of 0 tokens. A row that is
    repeated with the same text counts once; rows of one doc_id with different texts are different
    items, told apart by text_key. An empty table gives no rows; other columns are not read.
    """
    rows = documents.count()  # from the files' footers; bounds the number of items, as only remainders are packed
    sized = encode_documents(documents, doc_id=doc_id, text=text, path=path, counts_only=True).distinct()
    sized = cut_lineage(sized.select(F.col(doc_id).alias("d"), F.coalesce("text_key", F.lit(0)).alias("k"), "n_tokens"))
    full = F.floor(F.col("n_tokens") / capacity)
    rest: Column = F.col("n_tokens") - full * capacity
    tail = sized.select("d", "k", full.alias("piece"), (full * capacity).alias("first"), rest.alias("n")).where("n > 0 or piece = 0")
    whole = (
        sized.where(full > 0)
        .select("d", "k", F.explode(F.sequence(F.lit(0).cast("long"), full - 1)).alias("piece"))
        .select("d", "k", "piece", (F.col("piece") * capacity).alias("first"), F.lit(capacity).cast("long").alias("n"), F.concat_ws("-", F.lit("full"), "d", "k", "piece").alias("container"))
    )
    packed = pack_items(tail, rows, capacity)
    return packed.unionByName(whole).select(F.col("d").alias(doc_id), F.col("k").alias("text_key"), "piece", F.col("first").alias("first_token"), F.col("n").alias("n_tokens"), "container")
