"""Operator 6: sharding by balanced label propagation over links.

Rows of equal texts are neighbours, and so are rows that a table of links names (near duplicates, pages of a host).
Each row starts in a shard that its id decides. Rows of one text are one piece, which moves as a whole; texts
with more rows than a quarter of a shard are cut into pieces of about that size, linked with each other.
In each round every piece hears, over its links (a join of links with where the pieces are, summed by piece), how many
of its neighbours are in which shard, with its own rows' starts as a vote of their own. A piece that has not settled
asks for the shard with most votes among those that have room; one that has settled asks to move if another such
shard has more votes than its own (a hash lets half of them ask in a round, so that neighbours don't swap places
for ever). Of the pieces that ask, in an order that a hash draws anew in each round, those that still fit
are taken: quotas are exact in each round, and what leaves a shard makes room in it. Larger pieces come first,
and those of texts that had to be cut before all others. Rounds go on until no piece that could settle is left and
the links that are cut no longer become fewer; the round with the fewest is the result. Rows without neighbours are
free, and so are those of the last pieces that fit nowhere whole: they fill what is left, so sizes are exact.

Numbers that need an order over all rows come from counts of (bucket, shard) and ranks inside buckets,
never from one sort in one task.

Defined cases: a null text has size 1 and the crc of no bytes, and equals empty texts; null doc_ids and
rows that repeat are placed each for itself (in an order that their hash decides); a link to an id that is not there
or null, or of a row to itself, means nothing, and one to an id that several rows have links them all; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table

SHARDS = 16
BUCKET_ROWS = 50_000
#: pieces of a large group are about this share of a shard
PIECE = 4
_COINS = 1024


def ranked(rows: DataFrame, group: list[str], order: list[str], bucket: str, name: str, scratch: Scratch) -> DataFrame:
    """``rows`` with ``name``: gapless numbers from 0 inside each group, by bucket and then ``order``.

    ``bucket`` is a column of small integers that splits each group evenly; ranks are made inside
    (group, bucket) and shifted by the sizes of the group's buckets before it.
    """
    sizes = rows.groupBy(*group, bucket).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sizes = scratch.save(sizes.select(*group, bucket, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")), "sizes")
    inside = F.row_number().over(Window.partitionBy(*group, bucket).orderBy(*order))
    return rows.withColumn("_rank", inside).join(sizes, [*group, bucket]).withColumn(name, F.col("_before") + F.col("_rank") - 1).drop("_rank", "_before")


def quotas(total: int, shards: int) -> list[int]:
    """Shares of ``total`` that differ by one at most."""
    return [total // shards + (s < total % shards) for s in range(shards)]


def taken(asking: dict[int, dict[int, int]], room: list[int]) -> dict[int, list[int]]:
    """For each shard the coins whose pieces it takes, in order while they fit, given rows by shard and coin."""
    out = {}
    for s, by_coin in asking.items():
        left, own = room[s], []
        for coin in sorted(by_coin):
            if by_coin[coin] <= left:
                left -= by_coin[coin]
                own.append(coin)
        if own:
            out[s] = own
    return out


#: weight of a piece's own start among the votes: less than a link
OWN = 0.5
#: rounds without fewer cut links after which propagation ends
PATIENCE = 3


def _where(links: DataFrame, state: DataFrame, shards: int) -> DataFrame:
    """``links(a, b, w)`` with the share of b's rows in each shard: where it has settled, else where its rows begin."""
    here = F.array(*(F.when(F.col("at").isNull(), F.element_at("start", s + 1) / F.col("size")).otherwise((F.col("at") == s).cast("double")) for s in range(shards)))
    return links.join(state.select(F.col("node").alias("b"), here.alias("here")), "b")


def cut_weight(links: DataFrame, state: DataFrame) -> float:
    """Weight of the links whose ends have settled in different shards, or not both (each of a pair's two directions counts half)."""
    at = state.select("node", "at")
    both = links.join(at.select(F.col("node").alias("a"), F.col("at").alias("x")), "a").join(at.select(F.col("node").alias("b"), F.col("at").alias("y")), "b")
    return both.agg(F.coalesce(F.sum(F.when(~F.col("x").eqNullSafe(F.col("y")) | F.col("x").isNull(), F.col("w") / 2).otherwise(0.0)), F.lit(0.0))).first()[0]


def propagate(pieces: DataFrame, links: DataFrame | None, room: list[int], scratch: Scratch) -> tuple[DataFrame, list[float]]:
    """Label propagation over ``pieces(node, key, piece, size, start, parts)``: the same with ``at``, the shard where the piece has settled (null if nowhere), and the cut weights round by round.

    ``start`` counts the piece's rows by the shards where they begin, ``parts`` into how many pieces its key
    was cut; ``links(a, b, w)`` of nodes in both directions, or None; ``room`` are the shards' quotas.
    """
    shards, room, step, cut_first = len(room), list(room), 0, True
    most = max(1, room[-1] // PIECE)
    columns = ["node", "key", "piece", "size", "start", "parts"]
    state = pieces.withColumn("at", F.lit(None).cast("int"))
    cuts: list[float] = []
    best, since = state, 0
    while True:
        own = [OWN * F.element_at("start", s + 1) / F.col("size") for s in range(shards)]
        voted = state
        if links is not None:
            heard = _where(links, state, shards).groupBy(F.col("a").alias("node")).agg(*(F.sum(F.col("w") * F.col("here")[s]).alias(f"v{s}") for s in range(shards)))
            voted = state.join(heard, "node", "left")
            own = [x + F.coalesce(f"v{s}", F.lit(0.0)) for s, x in enumerate(own)]
        votes = F.array(*own)
        # ties go to shards in an order that the piece decides, so that they don't all meet in one shard
        open_ = [s for s in range(shards) if room[s] > 0]
        if not open_:
            break
        options = F.array(*(F.struct((F.col("size") <= room[s]).alias("fits"), F.col("votes")[s].alias("votes"), F.pmod(F.xxhash64("key", F.lit(s)), F.lit(1 << 20)).alias("tie"), F.lit(s).alias("shard")) for s in open_))
        fresh = F.col("at").isNull() & ((F.col("parts") > 1) if cut_first else F.lit(True))
        settled = F.lit(False)
        if links is not None and not cut_first:
            gains = F.col("best.fits") & (F.col("best.votes") > F.get("votes", F.col("at")) + 1e-9)
            settled = F.col("at").isNotNull() & gains & (F.pmod(F.xxhash64("node", F.lit(step)), F.lit(2)) == 0)
        class_ = F.least(F.lit(15), F.floor(F.log2(F.greatest(F.lit(1.0), F.lit(most) / F.col("size")))))
        asked = voted.select(*columns, "at", votes.alias("votes")).withColumn("best", F.array_max(options))
        asked = asked.select(*columns, "at", F.when(fresh | settled, F.col("best.shard")).alias("wanted"), (class_ * (_COINS // 16) + F.pmod(F.xxhash64("key", "piece", F.lit(step)), F.lit(_COINS // 16))).cast("int").alias("coin"))
        asked = scratch.save(asked, "asked")
        asking: dict[int, dict[int, int]] = {}
        leaving: dict[tuple, dict[int, int]] = {}
        for r in asked.where("wanted is not null").groupBy("wanted", "coin", "at").agg(F.sum("size").alias("n")).collect():  # at most shards x _COINS x (shards + 1) rows
            asking.setdefault(r["wanted"], {})[r["coin"]] = asking.get(r["wanted"], {}).get(r["coin"], 0) + r["n"]
            if r["at"] is not None:
                leaving.setdefault((r["wanted"], r["coin"]), {})[r["at"]] = r["n"]
        take = taken(asking, room)
        goes = F.lit(False)
        for s, coins in take.items():
            goes = goes | ((F.col("wanted") == s) & F.col("coin").isin(coins))
            for c in coins:
                room[s] -= asking[s][c]
                for left, n in leaving.get((s, c), {}).items():
                    room[left] += n
        if not take and cut_first:
            cut_first = False
            scratch.discard(asked)
            continue
        if take:
            state = scratch.save(asked.select(*columns, F.when(goes, F.col("wanted")).otherwise(F.col("at")).alias("at")), "state")
            step += 1
        scratch.discard(asked)
        if links is None or cut_first:
            best = state
            if not take:
                break
            continue
        cuts.append(cut_weight(links, state))
        if len(cuts) == 1 or cuts[-1] < min(cuts[:-1]) or state.where("at is null").count() < best.where("at is null").count():
            best, since = state, 0
        else:
            since += 1
        if not take or since >= PATIENCE:
            break
    return best.select("key", "piece", "size", "at"), cuts


def cut_links(rows: DataFrame, shard: str = "shard", key: str = "key") -> int:
    """How many pairs of rows of the same key lie in different shards."""
    sizes = rows.groupBy(key, shard).agg(F.count("*").cast("decimal(38,0)").alias("n"))
    pairs = lambda n: n * (n - 1) / 2
    by_key = sizes.groupBy(key).agg(pairs(F.sum("n")).alias("every"), F.sum(pairs(F.col("n"))).alias("kept"))
    return int(by_key.agg(F.coalesce(F.sum(F.col("every") - F.col("kept")), F.lit(0))).first()[0])


def _node_links(spark: SparkSession, named: DataFrame, pieces: DataFrame, links: DataFrame | None) -> DataFrame | None:
    """(a, b, w): links between pieces in both directions: of rows that ``links`` names, and between the pieces of one key."""
    cut = pieces.where("parts > 1").select("key", "node", "size")
    # a key has few pieces, each about a quarter of a shard: a few thousand pairs in all
    whole = cut.select("key", F.col("node").alias("a"), F.col("size").alias("x")).join(cut.select("key", F.col("node").alias("b"), F.col("size").alias("y")), "key").where("a <> b").select("a", "b", (F.col("x").cast("double") * F.col("y")).alias("w"))
    if links is None:
        return whole
    node = named.join(pieces.select("key", "piece", "node"), ["key", "piece"]).select("doc_id", "node")
    ends = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    ends = ends.join(node.select(F.col("doc_id").alias("a"), F.col("node").alias("_a")), "a").join(node.select(F.col("doc_id").alias("b"), F.col("node").alias("_b")), "b")
    ends = ends.where("_a <> _b").select(F.expr("stack(2, _a, _b, _b, _a) AS (a, b)")).groupBy("a", "b").agg(F.count("*").cast("double").alias("w"))
    return ends.union(whole).groupBy("a", "b").agg(F.sum("w").alias("w"))


def shard_by_rows(docs: DataFrame, shards: int = SHARDS, bucket_rows: int = BUCKET_ROWS, links: DataFrame | None = None, cuts: list | None = None) -> DataFrame:
    """Shards of ``docs(doc_id, text)`` under the law ``rows``: counts differ by one at most.

    ``links(a, b)`` of doc_ids are neighbours besides equal texts. Returns doc_id, size, text_crc32, law, shard, slot,
    grown_shard (null under this law), key (the text's digest) and start (the shard where the row began). ``cuts``,
    if given, gets the weight of cut links after each round.
    """
    scratch, spark = Scratch(docs.sparkSession, "sharding"), docs.sparkSession
    raw = F.coalesce("text", F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.unhex(F.sha2(raw, 256)).alias("key"))
    # a number for each row, which stays with it from here on
    rows = rows.withColumn("row", F.monotonically_increasing_id()).withColumn("start", F.pmod(F.xxhash64("doc_id", "row"), F.lit(shards)).cast("int"))
    rows = scratch.save(rows, "rows")
    total = rows.count()
    room, buckets = quotas(total, shards), max(1, -(-total // (shards * bucket_rows)))
    most = max(1, room[-1] // PIECE)
    # less than PIECE x shards + shards keys have more rows than a piece
    large = rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > most).select("key", F.ceil(F.col("n") / most).cast("int").alias("parts"))
    large = scratch.save(large, "large")
    cut = rows.join(F.broadcast(large), "key", "left").withColumn("piece", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("row"), F.col("parts")).cast("int")))
    named = None
    if links is not None:
        ids = links.select(F.explode(F.array(F.col("a").cast("long"), F.col("b").cast("long"))).alias("doc_id")).distinct()
        named = scratch.save(cut.join(ids, "doc_id", "left_semi").select("doc_id", "key", "piece").distinct(), "named")
        cut_keys = cut.join(named.select("key", "piece", F.lit(True).alias("linked")).distinct(), ["key", "piece"], "left")
    else:
        cut_keys = cut.withColumn("linked", F.lit(None).cast("boolean"))
    pieces = cut_keys.groupBy("key", "piece").agg(F.count("*").alias("size"), F.coalesce(F.first("parts"), F.lit(1)).alias("parts"), F.array(*(F.count_if(F.col("start") == s) for s in range(shards))).alias("start"), F.first("linked").alias("linked"))
    pieces = scratch.save(pieces.where("size > 1 or parts > 1 or linked").drop("linked").withColumn("node", F.monotonically_increasing_id()), "pieces")
    edges = None
    if links is not None or not large.isEmpty():
        edges = scratch.save(_node_links(spark, named, pieces, links), "edges")
    placed, seen = propagate(pieces, edges, room, scratch)
    if cuts is not None:
        cuts += seen
    placed = placed.where("at is not null").select("key", "piece", "at")
    where = scratch.save(cut.select("row", "key", "piece").join(placed, ["key", "piece"], "left").select("row", "at"), "placed")

    load = dict(where.where("at is not null").groupBy("at").count().collect())
    free = where.where("at is null").select("row", F.lit(0).alias("all"), F.pmod(F.xxhash64("row"), F.lit(buckets * shards)).alias("bucket"))
    free = ranked(free, ["all"], ["row"], "bucket", "place", scratch)
    shard, end = F.lit(shards - 1), sum(room) - sum(load.values())
    for s in reversed(range(shards - 1)):
        end -= room[s + 1] - load.get(s + 1, 0)
        shard = F.when(F.col("place") < end, s).otherwise(shard)
    where = where.where("at is not null").select("row", F.col("at").alias("shard")).union(free.select("row", shard.cast("int").alias("shard")))

    out = rows.join(where, "row").withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)))
    out = ranked(scratch.save(out, "sharded"), ["shard"], ["row"], "bucket", "slot", scratch)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "key", "start")


def op6_balanced_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_rows(table(spark, sf_dir, "documents")).drop("key", "start")
