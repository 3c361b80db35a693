"""Balanced label propagation: documents into shards of equal numbers of rows, linked documents together.

Documents are linked through a shared key (here: equal texts), a star per key instead of pairs. Keys with more rows than a
quarter of a shard, of which there can be few, are seated first, one after another, so that they take as few shards as they can.
The labels of all other documents start from a hash, in proportion to the room left. In every round each key counts its members per shard, and members move to the shard where most of
their neighbours are. Moves obey quotas: a shard's linked rows may not exceed its share of all rows, those who leave it in the
same round counted. Where more rows want to enter than fit, keys enter in the order of a hash, whole, up to the quota; of
the key at the border only part enters. While labels move a shard may exceed its quota by ``SLACK``, as a full set of quotas
would let nobody pass. Rounds end when nobody gains.

Unlinked documents cut no edge wherever they are. They make up the balance at the end: from shards with more rows than
their share, unlinked rows (and, only if these do not suffice, linked ones, key by key) go to shards with less. After that
the numbers of rows of any two shards differ by one at most (law ``rows``).

Only tables of shards x shards x histogram bins reach the driver. A key may hold any share of the rows: votes are
pre-aggregated, and rows are numbered in parts.

A null text counts as empty. Repeated rows are documents of their own with equal texts. An empty table gives an empty
result. Ties between shards are decided by a hash of key and shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aphora.llm.tables import numbered, part_count, stored

SHARDS = 8
ROUNDS = 10
BINS = 256
SLACK = 0.1
#: A key is seated if it has more rows than this part of a shard.
HEAVY = 4
_PART = 50_000


def _unit(*columns: Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 40)) / float(1 << 40)


def _choose(shard: Column, values: list, kind: str) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), shard.cast("int") + 1)


def _admitted(wanted: list[list[int]], room: list[int]) -> list[float]:
    """How many rows may enter each shard: its room and what leaves it, where those who leave must be let in elsewhere.

    ``wanted[a][b]`` rows want to go from a to b. The shares let in shrink from one until they fit.
    """
    shards = len(room)
    demand = [sum(wanted[a][b] for a in range(shards)) for b in range(shards)]
    share = [1.0] * shards
    for _ in range(50):
        for b in range(shards):
            leaves = sum(share[t] * wanted[b][t] for t in range(shards))
            if demand[b]:
                share[b] = min(share[b], max(0.0, room[b] + leaves) / demand[b])
    return [s * d for s, d in zip(share, demand)]


def propagate(linked: DataFrame, quota: list[int], rounds: int = ROUNDS) -> DataFrame:
    """(node, key, size, shard) with labels moved until no member of a key gains, or ``rounds`` are over.

    ``size`` is the number of members of the key. A shard that let in hardly any of those who came is closed for the
    next round, so that they try the next best.
    """
    shards = len(quota)
    now, closed = linked, [False] * shards
    for turn in range(rounds):
        votes = stored(now.groupBy("key", "shard").agg(F.count(F.lit(1)).alias("votes")), "votes")
        held = {r["shard"]: r["n"] for r in votes.groupBy("shard").agg(F.sum("votes").alias("n")).collect()}
        room = [int(quota[b] * (1 + SLACK)) - held.get(b, 0) for b in range(shards)]
        target = votes.where(_choose(F.col("shard"), [not c for c in closed], "boolean"))
        best = target.groupBy("key").agg(F.max(F.struct("votes", F.xxhash64("key", "shard").alias("tie"), "shard")).alias("best"))
        wish = votes.join(best, "key").select("key", F.col("shard").alias("from"), "votes", F.col("best.shard").alias("to"), F.col("best.votes").alias("gain"), F.col("best.tie").alias("tie"))
        wish = wish.where((F.col("from") != F.col("to")) & ((F.col("gain") > F.col("votes")) | ((F.col("gain") == F.col("votes")) & (F.col("tie") > F.xxhash64("key", "from")))))
        wish = stored(wish.withColumn("bin", F.floor(_unit(F.lit(turn), F.col("key")) * BINS).cast("int")), "wishes")
        demand, wanted = [[0] * BINS for _ in range(shards)], [[0] * shards for _ in range(shards)]
        for r in wish.groupBy("from", "to", "bin").agg(F.sum("votes").alias("n")).collect():
            demand[r["to"]][r["bin"]] += r["n"]
            wanted[r["from"]][r["to"]] += r["n"]
        enters = _admitted(wanted, room)
        if sum(enters) < 1:
            if not any(closed) and not any(map(any, demand)):
                break
            newly = [c or any(d) for c, d in zip(closed, demand)]
            if newly == closed or all(newly):
                break
            closed = newly
            continue
        closed = [any(d) and e < 0.02 * sum(d) for d, e in zip(demand, enters)]
        border, part = [], []
        for b in range(shards):
            left, at = int(enters[b]), 0
            while at < BINS and demand[b][at] <= left:
                left -= demand[b][at]
                at += 1
            border.append(at)
            part.append(left / demand[b][at] if at < BINS else 0.0)
        moves = wish.select("key", F.col("from").alias("shard"), "to", "bin")
        joined = now.join(moves, ["key", "shard"], "left")
        edge, share = _choose(F.col("to"), border, "int"), _choose(F.col("to"), part, "double")
        enter = (F.col("bin") < edge) | ((F.col("bin") == edge) & (_unit(F.lit(turn), F.col("node")) < share))
        now = stored(joined.select("node", "key", "size", F.when(enter, F.col("to")).otherwise(F.col("shard")).alias("shard")), "labels")
    return now


def _level(labels: DataFrame, quota: list[int], rows: int) -> DataFrame:
    """(node, shard) after rows of shards above their quota have gone to shards below it; unlinked rows go first."""
    shards = len(quota)
    counts = {(r["shard"], r["tied"]): r["n"] for r in labels.groupBy("shard", (F.col("size") > 1).alias("tied")).agg(F.count(F.lit(1)).alias("n")).collect()}
    over = [counts.get((b, False), 0) + counts.get((b, True), 0) - quota[b] for b in range(shards)]
    quick = [max(0, min(o, counts.get((b, False), 0))) for b, o in enumerate(over)]
    slow = [max(0, o) - q for o, q in zip(over, quick)]
    ends, total = [], 0
    for o in over:
        total += max(0, -o)
        ends.append(total)
    parts = part_count(rows, _PART)
    before, moved = 0, []
    for tied, take in ((False, quick), (True, slow)):
        if not any(take):
            continue
        chosen = labels.where((F.col("size") > 1) == F.lit(tied)).where(_choose(F.col("shard"), take, "bigint") > 0)
        # Parts by key keep the members of a key together in the order; a key larger than a part is spread itself.
        spread = F.when(F.col("size") > _PART, F.xxhash64("node")).otherwise(F.xxhash64("key"))
        ranked = numbered(chosen, ["shard"], ["key", "node"], spread, parts, "k").where(F.col("k") < _choose(F.col("shard"), take, "bigint"))
        starts = [before + sum(take[:b]) for b in range(shards)]
        seat = F.col("k") + _choose(F.col("shard"), starts, "bigint")
        moved.append(ranked.select("node", _within(seat, ends).alias("to")))
        before += sum(take)
    if not moved:
        return labels.select("node", "shard")
    all_moved = moved[0] if len(moved) == 1 else moved[0].unionByName(moved[1])
    return labels.join(all_moved, "node", "left").select("node", F.coalesce("to", "shard").alias("shard"))


def _within(seat: Column, ends: list) -> Column:
    """The first shard whose end lies above the seat."""
    place = F.lit(len(ends) - 1)
    for b in range(len(ends) - 2, -1, -1):
        place = F.when(seat < float(ends[b]), b).otherwise(place)
    return place.cast("int")


def _seated(nodes: DataFrame, sizes: DataFrame, quota: list[int]) -> tuple[DataFrame, list[int]]:
    """(node, shard) of the members of heavy keys, and the quota they leave."""
    heavy = sorted(((r["size"], bytes(r["key"])) for r in sizes.where(F.col("size") * HEAVY > quota[0]).collect()), reverse=True)
    ends, total, left = [], 0, list(quota)
    for q in quota:
        total += q
        ends.append(total)
    if not heavy:
        return nodes.select("node", F.lit(0).alias("shard")).where(F.lit(False)), left
    starts, taken = {}, 0
    for size, key in heavy:
        starts[key] = taken
        taken += size
    for b, end in enumerate(ends):
        left[b] = min(quota[b], max(0, end - taken))
    first = F.element_at(F.create_map(*[x for k, v in starts.items() for x in (F.lit(k.hex()), F.lit(v).cast("bigint"))]), F.lower(F.hex("key")))
    members = nodes.where(F.lower(F.hex("key")).isin([k.hex() for k in starts])).select("node", "key")
    ranked = numbered(members, ["key"], ["node"], F.xxhash64("node"), part_count(heavy[0][0], _PART), "k")
    return ranked.select("node", _within(first + F.col("k"), ends).alias("shard")), left


def shard_documents(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row; equal texts stay together where they can."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    nodes = stored(docs.select(
        F.monotonically_increasing_id().alias("node"), F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"), F.unhex(F.md5(text)).alias("key")), "nodes")
    rows = nodes.count()
    quota = [rows // shards + (b < rows % shards) for b in range(shards)]
    sizes = stored(nodes.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "key-sizes")
    seats, left = _seated(nodes, sizes, quota)
    seats = stored(seats.toDF("node", "seat"), "seats")
    ends = [sum(left[: b + 1]) for b in range(shards)]
    draw = _unit(F.lit(1), F.col("doc_id"), F.col("key")) * float(max(1, ends[-1]))
    begun = nodes.select("node", "key", _within(draw, ends).alias("shard")).join(sizes, "key", "left").join(seats, "node", "left")
    begun = stored(begun.select("node", "key", F.coalesce("size", F.lit(1)).cast("long").alias("size"), F.coalesce("seat", "shard").alias("shard"), F.col("seat").isNotNull().alias("fixed")), "begun")
    light = stored(begun.where("size > 1 and not fixed").select("node", "key", "size", "shard"), "linked")
    settled = propagate(light, left, rounds)
    labels = stored(begun.where("size = 1 or fixed").select("node", "key", "size", "shard").unionByName(settled.select("node", "key", "size", "shard")), "labels")
    final = _level(labels, quota, rows)
    placed = nodes.join(final, "node")
    slots = numbered(placed, ["shard"], ["doc_id", "node"], F.xxhash64("node"), part_count(-(-rows // shards), _PART), "slot")
    return slots.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
