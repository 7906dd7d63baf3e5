"""Sharding by balanced label propagation over linked documents.

Each document starts in a shard by its id. In every round a join finds, per link, how many
bytes of its documents each shard holds; a linked document wants to go where most of them
are. Quotas let documents change shards only as far as the capacities allow, so sizes
stay even. What the rounds leave apart joins the shard that holds most of it, documents
without links fill the shards up to the same size, and a last pass numbers the slots.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkchemo.llm.common import release, stored

#: A link's rows are looked up in parts of at most this fraction of all link rows.
SPREAD = 256
#: Groups above this fraction of a shard are placed one by one: at most shards * BIG of them.
BIG = 64


def _quotas(wanted: dict[tuple[int, int], int], load: list[int], capacity: float) -> dict[tuple[int, int], float]:
    """The share of each wanted move (from, to) -> bytes that may happen.

    Equal amounts may always change places. What is left over fills free capacity, the
    largest wishes first. The table has at most shards * (shards - 1) rows.
    """
    load = list(load)
    granted = {k: min(v, wanted.get(k[::-1], 0)) for k, v in wanted.items()}
    for (a, b), v in sorted(wanted.items(), key=lambda x: (-x[1], x[0])):
        more = max(0.0, min(v - granted[a, b], capacity - load[b]))
        granted[a, b] += more
        load[a] -= more
        load[b] += more
    return {k: granted[k] / v for k, v in wanted.items() if granted[k] > 0}


def _chance(*cols: Column) -> Column:
    """A uniform number in [0, 1) that depends on the columns alone."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 30)) / float(1 << 30)


def _sums(df: DataFrame, *keys: str) -> dict:
    """Bytes by at most two shard columns: a small table."""
    return {tuple(r)[:-1]: r["size"] for r in df.groupBy(*keys).agg(F.sum("size").alias("size")).collect()}


def propagate_labels(nodes: DataFrame, links: DataFrame, shards: int, rounds: int = 10, slack: float = 0.1) -> DataFrame:
    """(node, label) of every linked row of ``nodes`` (node, doc_id, size); in ``links`` (node, link) rows of one link are neighbours.

    A node may have many links. It starts at its doc_id's label and wants the label that
    holds most bytes of its links' nodes, of those with room left; a tie goes by the link.
    Rounds end early when no node wants to move. The sums per link are partial before they
    are shuffled, so a link with a third of all rows sends a row per task; a link with more
    than a share of all rows meets its sums in several tasks.
    """
    first = F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int")
    load = [0] * shards
    for (s,), size in _sums(nodes.select(first.alias("s"), "size"), "s").items():
        load[s] = size
    mean = sum(load) / shards
    capacity = mean * (1 + slack)
    ways = F.ceil(F.col("n") * SPREAD / max(1, links.count())).cast("int")
    # Read from tables, so that the planner can split a hot link's rows in the joins.
    sizes = stored(links.groupBy("link").agg(F.count(F.lit(1)).alias("n")).select("link", ways.alias("ways")), "shard-ways")
    links = stored(links.select("node", "link").join(sizes, "link"), "shard-links")
    state = stored(nodes.join(links.select("node").distinct(), "node", "left_semi").select("node", "doc_id", "size", first.alias("label")), "shard-labels")
    for step in range(rounds):
        held = [F.sum(F.when(F.col("label") == s, F.col("size")).otherwise(0)) for s in range(shards)]
        # Below one byte, a number that depends on link and shard: equal weights don't leave two copies apart.
        tie = [F.pmod(F.xxhash64("link", F.lit(s)), F.lit(1024)) for s in range(shards)]
        by_link = links.join(state, "node").groupBy("link").agg(F.max("ways").alias("ways"), *[(1024 * h + F.when(h > 0, t).otherwise(0)).alias(f"w{s}") for s, (h, t) in enumerate(zip(held, tie, strict=True))])
        spread = by_link.withColumn("way", F.explode(F.sequence(F.lit(0), F.col("ways") - 1))).drop("ways")
        by_node = links.withColumn("way", F.pmod(F.xxhash64("node"), F.col("ways")).cast("int")).join(spread, ["link", "way"]).groupBy("node").agg(*[F.sum(f"w{s}").alias(f"w{s}") for s in range(shards)])
        # A shard that has used half its slack is closed: what it shares with open shards leaves it.
        choice = F.array_max(F.array(*[F.struct(F.col(f"w{s}").alias("w"), (F.col("label") == s).alias("own"), F.lit(-s).alias("s")) for s in range(shards) if load[s] <= (capacity + mean) / 2]))
        want = F.when(choice["w"] > 0, -choice["s"]).otherwise(F.col("label"))
        wishes = stored(state.join(by_node, "node").select("node", "doc_id", "size", "label", want.alias("want")), "shard-wishes")
        wanted = _sums(wishes.where("label <> want"), "label", "want")
        if not wanted:
            release(wishes)
            break
        quotas = _quotas(wanted, load, capacity)
        share = F.lit(0.0)
        for (a, b), q in quotas.items():
            share = F.when((F.col("label") == a) & (F.col("want") == b), q).otherwise(share)
        moves = (F.col("label") != F.col("want")) & (_chance(F.col("node"), F.lit(step)) < share)
        moved = stored(wishes.withColumn("to", F.when(moves, F.col("want")).otherwise(F.col("label"))), "shard-moves")
        release(wishes)
        for (a, b), size in _sums(moved.where("label <> to"), "label", "to").items():
            load[a] -= size
            load[b] += size
        state = moved.select("node", "doc_id", "size", F.col("to").alias("label"))
    return state.select("node", "label")


def gather(links: DataFrame, labels: DataFrame, total: int, shards: int) -> DataFrame:
    """(link, shard, bytes, whole): one shard for each link of ``links`` (node, link, size), that which holds most of it if it has room.

    Links above 1 / BIG of a shard, at most shards * BIG, are placed on the driver by
    falling size, those that fit their own shard there and the others in the emptiest. The
    small ones then stay where they are as far as a shard has room. shard is null for those
    that are left, which fill up shards later on: the small ones ``whole``, big ones that
    would fit no shard cut where it is full.
    """
    goal = total / shards
    parts = links.join(labels, "node").groupBy("link", "label").agg(F.sum("size").alias("bytes"))
    groups = stored(parts.groupBy("link").agg(F.sum("bytes").alias("bytes"), F.max_by("label", F.struct("bytes", F.xxhash64("link", "label"))).alias("label")), "shard-groups")
    room, rows = [goal] * shards, []
    big = groups.where(F.col("bytes") * BIG > goal)
    for r in sorted(big.collect(), key=lambda r: (-r["bytes"], r["link"])):
        s = r["label"] if r["bytes"] <= room[r["label"]] else max(range(shards), key=lambda k: (room[k], -k))
        fits = r["bytes"] <= room[s]
        room[s] -= r["bytes"] if fits else 0
        rows.append(F.struct(*[F.lit(x) for x in (r["link"], s if fits else None, r["bytes"], fits)]))
    kind = "array<struct<link: string, shard: int, bytes: bigint, whole: boolean>>"
    placed = links.sparkSession.range(1).select(F.explode(F.array(*rows).cast(kind)).alias("r")).select("r.*")
    ordered = running_totals(groups.where(F.col("bytes") * BIG <= goal), ["label", "link"], "bytes", "shard-small")
    begin = {r["label"]: r["begin"] for r in ordered.groupBy("label").agg(F.min("before").alias("begin")).collect()}
    fits = F.lit(False)
    for s in range(shards):
        fits = F.when(F.col("label") == s, F.col("before") + F.col("bytes") - begin.get(s, 0) <= room[s]).otherwise(fits)
    return placed.union(ordered.select("link", F.when(fits, F.col("label")).cast("int"), "bytes", F.lit(True)))


def running_totals(df: DataFrame, order: list[str], size: str, name: str) -> DataFrame:
    """``df`` with ``before``: the sum of ``size`` over all rows earlier in ``order``, which must be unique.

    Rows are dealt by range, summed per part, and only the parts' sums (one small row a
    part) meet in one place; then each part adds up its own rows. No task sees them all.
    """
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = stored(df.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), name)
    sums = dealt.groupBy("part").agg(F.sum(size).alias("sum"))
    ahead = sums.select("part", (F.sum("sum").over(Window.orderBy("part")) - F.col("sum")).alias("ahead"))
    here = Window.partitionBy("part").orderBy(*order)
    inside = dealt.withColumn("inside", F.sum(size).over(here) - F.col(size))
    return inside.join(ahead, "part").withColumn("before", F.col("ahead") + F.col("inside")).drop("part", "inside", "ahead")


def shard_documents(docs: DataFrame, shards: int = 8, rounds: int = 10) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) in one of ``shards`` shards of near equal bytes, equal texts together.

    Returns doc_id, size (UTF-8 bytes plus 1), text_crc32, law ('bytes'), shard, slot (from 0
    in each shard, without gaps), grown_shard (null: this law promises nothing for it).

    A null text is an empty one. Each row has a slot of its own, also one that repeats another
    or shares its doc_id. A group of equal texts larger than a shard is split into parts of a
    quarter of a shard; a smaller one stays whole, unless the groups alone leave no shard
    with room for it. An empty table gives an empty result. Other columns are not read.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(
        F.monotonically_increasing_id().alias("node"), "doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"),
        F.md5(text).alias("md5"),
    )
    rows = stored(rows, "shard-rows")  # fixes the rows' numbers
    total = rows.agg(F.sum("size")).first()[0] or 1
    parts = F.when(F.col("bytes") * shards > total, F.ceil(F.col("bytes") * (4 * shards) / total)).otherwise(1).cast("int")
    groups = stored(rows.groupBy("md5").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")).where("n > 1").select("md5", parts.alias("parts")), "shard-equal")
    link = F.concat("md5", F.lit("-"), F.pmod(F.xxhash64("node"), F.col("parts")))
    links = stored(rows.join(groups, "md5").select("node", link.alias("link"), "size"), "shard-linked")
    labels = propagate_labels(rows, links, shards, rounds)
    homes = stored(gather(links, labels, total, shards), "shard-homes")
    homed = links.join(homes.drop("bytes"), "link").select("node", "link", "shard", "whole")
    taken = {r["shard"]: r["bytes"] for r in homes.where("shard is not null").groupBy("shard").agg(F.sum("bytes").alias("bytes")).collect()}
    lacks = [max(0.0, total / shards - taken.get(s, 0)) for s in range(shards)]
    placed = stored(rows.join(homed, "node", "left").withColumn("unit", F.coalesce("link", F.lit("~"))), "shard-placed")
    # Rows without a shard, small groups together and documents without links last, lie on a line that is cut by what each shard lacks.
    loose = running_totals(placed.where("shard is null"), ["unit", "doc_id", "node"], "size", "shard-loose")
    small = F.col("link").isNotNull() & F.col("whole")
    begin = F.min("before").over(Window.partitionBy("link"))  # of a small group: 1 / BIG of a shard at most
    middle = F.col("before") + F.col("size") / 2
    line, scale = F.lit(shards - 1), (total - sum(taken.values())) / max(sum(lacks), 1e-300)
    for s in range(shards - 2, -1, -1):
        line = F.when(F.col("middle") < sum(lacks[: s + 1]) * scale, F.lit(s)).otherwise(line)
    left = loose.where(small).withColumn("middle", begin).unionByName(loose.where(~F.coalesce(small, F.lit(False))).withColumn("middle", middle))
    columns = ["doc_id", "node", "size", "text_crc32", "md5", "shard"]
    put = left.withColumn("shard", line.cast("int")).select(columns).union(placed.where("shard is not null").select(columns))
    numbered = running_totals(put.withColumn("one", F.lit(1).cast("bigint")), ["shard", "md5", "doc_id", "node"], "one", "shard-slots")
    first = {r["shard"]: r["first"] for r in numbered.groupBy("shard").agg(F.min("before").alias("first")).collect()}
    start = F.lit(0).cast("bigint")
    for s, n in first.items():
        start = F.when(F.col("shard") == s, F.lit(n).cast("bigint")).otherwise(start)
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("before") - start).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def op7_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in eight shards of near equal bytes."""
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
