"""Filling containers of fixed capacity with items of varying size.

Bounded-space online packing: each partition keeps a fixed number of open containers, puts the
next item where the least room is left over, and closes the fullest container when an item fits
none. Containers still open at a partition's end are merged, many partitions at a time.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderlake.session import stage

#: Open containers of a partition for each pack.
WINDOWS = 32
#: Partitions whose open containers meet in one merging task.
FAN_IN = 64


class Packer:
    """Open containers of one pack, ordered by free room; ids count from 0."""

    def __init__(self, capacity: int, windows: int = WINDOWS):
        self.capacity, self.windows, self.made = capacity, windows, 0
        self.open: list[tuple[int, int]] = []  # (free room, id)

    def put(self, size: int) -> tuple[int, list[int]]:
        """Place an item; returns its container and the containers that are closed now."""
        if size > self.capacity:
            raise ValueError("item exceeds the capacity")
        closed, at = [], bisect_left(self.open, (size, -1))
        if at < len(self.open):
            free, box = self.open.pop(at)
        else:
            if len(self.open) >= self.windows:
                closed.append(self.open.pop(0)[1])
            free, box = self.capacity, self.made
            self.made += 1
        if free > size:
            insort(self.open, (free - size, box))
        else:
            closed.append(box)
        return box, closed


def _pieces(size: int, capacity: int) -> list[tuple[int, int]]:
    """(start, size) of the parts of an item: whole capacities, then the rest."""
    return [(at, min(capacity, size - at)) for at in range(0, size, capacity)]


_ROW = "item_id {kind}, piece_no int, token_start bigint, n_tokens bigint, pack_name string, capacity bigint, container string, used bigint, is_open boolean"


def _pack_items(limits: list[tuple[str, int]], windows: int):
    columns = ["item_id", "piece_no", "token_start", "n_tokens", "pack_name", "capacity", "container", "used", "is_open"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        packers = {name: Packer(capacity, windows) for name, capacity in limits}
        inside: dict[tuple[str, int], list[tuple]] = {}  # of open containers only
        out: list[tuple] = []

        def emit(name: str, capacity: int, box: int, is_open: bool) -> None:
            items = inside.pop((name, box))
            used = sum(i[3] for i in items)
            out.extend((*i, name, capacity, f"{part}-{box}", used, is_open) for i in items)

        for batch in batches:
            for item, size in zip(batch["item_id"], batch["n_tokens"]):
                for name, capacity in limits:
                    for no, (start, part_size) in enumerate(_pieces(int(size), capacity)):
                        box, closed = packers[name].put(part_size)
                        inside.setdefault((name, box), []).append((item, no, start, part_size))
                        for full in closed:
                            emit(name, capacity, full, False)
            if out:
                yield pd.DataFrame(out, columns=columns)
                out.clear()
        for name, capacity in limits:
            for _, box in packers[name].open:
                emit(name, capacity, box, True)
        if out:
            yield pd.DataFrame(out, columns=columns)

    return run


def _merge(windows: int):
    """Containers of one group of partitions, largest first, packed into merged containers."""

    def run(key: tuple, batch: pd.DataFrame) -> pd.DataFrame:
        name, group = key
        batch = batch.sort_values(["used", "container"], ascending=[False, True])
        packer = Packer(int(batch["capacity"].iloc[0]), windows)
        to = [packer.put(int(size))[0] for size in batch["used"]]
        return pd.DataFrame({"pack_name": name, "container": batch["container"], "merged": [f"m{group}-{box}" for box in to]})

    return run


def pack(items: DataFrame, limits: DataFrame, item_id: str, size: Column, windows: int = WINDOWS, fan_in: int = FAN_IN) -> DataFrame:
    """Assign every item to a container of each pack.

    ``items`` has a key column ``item_id``; ``size`` is its size, null or 0 for items without
    content, which need no container and give no row. ``limits`` has pack_name and capacity_tokens
    (a handful of rows; rows without a positive capacity are ignored, of a name given twice the
    smallest counts). Returns item_id (named as in ``items``), piece_no, token_start, n_tokens,
    pack_name, container. An item larger than the capacity becomes pieces of full capacity and a
    rest; any other item is one piece. Repeated keys are packed as often as they occur. Empty
    tables give no rows; other columns of ``items`` are ignored.
    """
    packs = [(r["pack_name"], int(r["capacity"])) for r in limits.where("capacity_tokens > 0").groupBy("pack_name").agg(F.min("capacity_tokens").alias("capacity")).orderBy("pack_name").collect()]
    sized = items.select(F.col(item_id).alias("item_id"), size.cast("bigint").alias("n_tokens")).where("n_tokens > 0")
    kind = items.schema[item_id].dataType.simpleString()
    packed = stage(sized.mapInPandas(_pack_items(packs, windows), _ROW.format(kind=kind)), "pack")
    part = F.split("container", "-")[0].cast("bigint")
    left = packed.where("is_open").select("pack_name", "capacity", "container", "used").distinct().withColumn("group", F.floor(part / fan_in))
    merged = left.groupBy("pack_name", "group").applyInPandas(_merge(fan_in * windows), "pack_name string, container string, merged string")
    final = packed.join(merged, ["pack_name", "container"], "left")
    return final.select(F.col("item_id").alias(item_id), "piece_no", "token_start", "n_tokens", "pack_name", F.coalesce("merged", "container").alias("container"))


def fill_report(packed: DataFrame, limits: DataFrame) -> DataFrame:
    """Containers, tokens and filled share for each pack, with the least number of containers that could do."""
    caps = limits.where("capacity_tokens > 0").groupBy("pack_name").agg(F.min("capacity_tokens").alias("capacity"))
    used = packed.groupBy("pack_name", "container").agg(F.sum("n_tokens").alias("used"), F.count(F.lit(1)).alias("n"))
    total = used.groupBy("pack_name").agg(F.count(F.lit(1)).alias("n_containers"), F.sum("used").alias("n_tokens"), F.sum("n").alias("n_pieces"), F.max("used").alias("fullest"))
    both = total.join(F.broadcast(caps), "pack_name")
    return both.select("pack_name", "capacity", "n_containers", "n_pieces", "n_tokens", "fullest", F.ceil(F.col("n_tokens") / F.col("capacity")).alias("least_containers"), F.round(F.col("n_tokens") / (F.col("n_containers") * F.col("capacity")), 4).alias("filled"))
