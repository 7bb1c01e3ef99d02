"""Dense products of two sides that meet by key, in blocks, on the executors.

Rows of both sides with the same key are dealt to the same task and sorted so that a key's items come first: a
task holds one block of item vectors at a time and streams the queries past it, one matrix product for each
Arrow batch. Vectors cross the network once for each key. Whoever makes the keys bounds a block's items
(:func:`split_hot` cuts large keys into blocks and deals their queries over several tasks); queries are unbounded.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: elements of one product (queries of a batch x items of a block) that a task holds at once
PRODUCT = 4 << 20


def vectors(column):
    """An Arrow list column of equally long vectors as a matrix."""
    import numpy as np

    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def best(keys, k: int):
    """(row, column) of the ``k`` least finite keys of each row of a matrix, in their order; ties go to the smaller column."""
    import numpy as np

    if not keys.size:
        return np.zeros(0, int), np.zeros(0, int)
    if k < keys.shape[1]:
        bound = np.partition(keys, k - 1, axis=1)[:, k - 1 : k]
        row, column = np.nonzero((keys <= bound) & np.isfinite(keys))
    else:
        row, column = np.nonzero(np.isfinite(keys))
    order = np.lexsort((column, keys[row, column], row))
    row, column = row[order], column[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], column[place < k]


def matched(queries: DataFrame, items: DataFrame, key: list[str], score: Callable, schema: str, partitions: int | None = None) -> DataFrame:
    """What ``score`` makes of the queries and items of each key.

    ``queries(key…, query, vec)`` and ``items(key…, item, vec)``; query and item may be structs. ``score(q, vecs,
    i, matrix)`` gets Arrow columns and matrices of some queries and of all items of the key (sorted by item), and
    gives Arrow columns in the order of ``schema``; it is called for as few queries at once as ``PRODUCT`` asks.
    """
    names = [x.split()[0] for x in schema.split(", ")]
    qt, it = queries.schema["query"].dataType, items.schema["item"].dataType
    vec = F.col("vec").cast("array<double>").alias("vec")
    rows = items.select(*key, F.lit(0).cast("byte").alias("_side"), F.lit(None).cast(qt).alias("query"), "item", vec)
    rows = rows.union(queries.select(*key, F.lit(1).cast("byte").alias("_side"), "query", F.lit(None).cast(it).alias("item"), vec))
    dealt = rows.repartition(partitions, *key) if partitions else rows.repartition(*key)

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        at, held, block = None, [], None
        for b in batches:
            marks = [b.column(c).to_pylist() for c in (*key, "_side")]
            where = list(zip(*marks, strict=True))
            ends = [k for k in range(1, len(where)) if where[k] != where[k - 1]] + [len(where)]
            begin = 0
            for end in ends:
                own, part = where[begin], b.slice(begin, end - begin)
                begin = end
                if own[:-1] != at:
                    at, held, block = own[:-1], [], None
                if own[-1] == 0:
                    held.append(part)
                    continue
                if not held:
                    continue  # queries of a key without items
                if block is None:
                    ids = pa.concat_arrays([h.column("item") for h in held])
                    # combine_chunks of a struct keeps its fields; items are ordered by them, in their order
                    table = pa.table({"i": ids}).flatten() if pa.types.is_struct(ids.type) else pa.table({"i": ids})
                    order = pc.sort_indices(table, sort_keys=[(c, "ascending") for c in table.column_names])
                    block = ids.take(order), np.concatenate([vectors(h.column("vec")) for h in held])[order.to_numpy()]
                step = max(1, PRODUCT // max(1, len(block[0])))
                for k in range(0, part.num_rows, step):
                    few = part.slice(k, step)
                    out = score(few.column("query"), vectors(few.column("vec")), *block)
                    if len(out[0]):
                        yield pa.RecordBatch.from_arrays(list(out), names=names)

    return dealt.sortWithinPartitions(*key, "_side").mapInArrow(run, schema)


def split_hot(queries: DataFrame, items: DataFrame, key: str, item: Column, query: Column, block_rows: int, query_rows: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``_block`` and ``_deal``: keys of more than ``block_rows`` items are cut into blocks, which all the key's queries visit; queries of more than ``query_rows`` are dealt over copies of the items.

    Only keys that are cut are listed: at most one for each ``block_rows`` items or ``query_rows`` queries, a few
    bytes each, which is what is broadcast.
    """
    n = lambda df, name, most: df.groupBy(key).agg(F.ceil(F.count("*") / most).cast("int").alias(name)).where(F.col(name) > 1)
    hot = n(items, "_blocks", block_rows).join(n(queries, "_deals", query_rows), key, "full_outer")
    hot = F.broadcast(hot.select(key, F.coalesce("_blocks", F.lit(1)).alias("_blocks"), F.coalesce("_deals", F.lit(1)).alias("_deals")))
    one = F.lit(1)
    blocks, deals = F.coalesce("_blocks", one), F.coalesce("_deals", one)
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    items = items.join(hot, key, "left").withColumn("_block", F.pmod(F.xxhash64(item), blocks).cast("int")).withColumn("_deal", every(deals)).drop("_blocks", "_deals")
    queries = queries.join(hot, key, "left").withColumn("_deal", F.pmod(F.xxhash64(query), deals).cast("int")).withColumn("_block", every(blocks)).drop("_blocks", "_deals")
    return queries, items
