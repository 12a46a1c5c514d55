"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Targets: sources share `share` times all words by weight; a target stops at `most` times its source's words, and
what it can't take is shared again by weight among the rest until none is above. That is a water level over sources ordered by
limit per weight, found with windows over the table of sources.

Blocks: rows of a source are spread over shards by a seeded hash, about `shard_words` words each, and laid in seeded
order, shard after shard; every `block_words` words of that stream are a block (of a source with fewer than 64 such blocks every 64th part).
Seats go to sources with blocks of one length by highest quotients votes / (2k + 1), the votes being their targets. A source
with q seats and b blocks takes each block q // b times and q % b of them once more, at even distances from a seeded start. A shard's quota is
the number of chosen blocks that begin in it: the rounding is carried from shard to shard, so a source that has few words in each
still comes within a block of its target. Which words of a row are covered follows from its place in the stream by arithmetic, so blocks are
never rows of a table.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyquilt.llm.common import WORD, col, written


def apportion(votes: list[float], seats: int, limits: list[int]) -> list[int]:
    """Sainte-Lague seats within limits: highest quotients win, ties go to the earlier party.

    The divisor is bisected until rounded votes / divisor fill the seats up to ties, whose seats go by quotient; that gives
    what handing out all seats one by one does.
    """
    n = len(votes)
    seats = min(seats, sum(limit for v, limit in zip(votes, limits) if v > 0))
    if seats <= 0:
        return [0] * n

    def at(divisor: float) -> list[int]:
        return [min(limit, int(min(v / divisor, 2.0**62) + 0.5)) if v > 0 else 0 for v, limit in zip(votes, limits)]

    low, high = 0.0, 4 * max(votes)
    for _ in range(200):
        middle = (low + high) / 2
        if not low < middle < high:
            break
        if sum(at(middle)) > seats:
            low = middle
        else:
            high = middle
    won = [max(0, w - 1) for w in at(high)]  # the last seat of each is handed out by exact quotients, as rounding may err at ties
    have = sum(won)
    heap = [(-votes[i] / (2 * won[i] + 1), i) for i in range(n) if votes[i] > 0 and won[i] < limits[i]]
    heapq.heapify(heap)
    while have < seats:
        _, i = heapq.heappop(heap)
        won[i] += 1
        have += 1
        if won[i] < limits[i]:
            heapq.heappush(heap, (-votes[i] / (2 * won[i] + 1), i))
    return won


def targets(sizes: DataFrame, *, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """`source, rank, source_size, target` from rows `source, size`; sources by code point, null last, weigh `weights` in turn."""
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.orderBy(F.col("source").asc_nulls_last())  # one row a source from here on
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), F.pmod(F.col("rank") - 1, len(weights)).cast("int") + 1)
    table = total.withColumn("rank", F.row_number().over(everything)).withColumn("w", weight).withColumn("limit", F.col("source_size") * float(most))
    level = Window.orderBy(F.col("limit") / F.col("w"), "rank")
    all_ = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    table = table.withColumn("words", F.sum("source_size").over(all_) * float(share))
    table = table.withColumn("left", F.col("words") - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
    table = table.withColumn("rest", F.sum("w").over(level.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    table = table.withColumn("full", F.col("limit") * F.col("rest") <= F.col("left") * F.col("w"))
    capped, weighed = F.sum(F.when(F.col("full"), F.col("limit")).otherwise(0.0)).over(all_), F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("w"))).over(all_)
    table = table.withColumn("per", (F.col("words") - capped) / F.when(weighed > 0, weighed))
    return table.select("source", "rank", "source_size", F.when(F.col("full"), F.col("limit")).otherwise(F.col("per") * F.col("w")).alias("target"))


#: A source has this many blocks at least, if it has as many words.
LEAST_BLOCKS = 64


def seats(goal: DataFrame, *, block_words: int, most: int) -> DataFrame:
    """`goal` with `unit` (words of a block), `blocks` and `seats` of each source; sources with equal units are apportioned together."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        won = apportion(pdf["target"].tolist(), int(pdf["target"].sum() / pdf["unit"].iloc[0] + 0.5), [most * b for b in pdf["blocks"].tolist()])
        return pdf[["rank"]].assign(seats=won)

    unit = F.greatest(F.lit(1), F.least(F.lit(block_words), F.floor(F.col("source_size") / LEAST_BLOCKS))).cast("long")
    goal = goal.withColumn("unit", unit).withColumn("blocks", F.ceil(F.col("source_size") / F.col("unit")).cast("long"))
    won = goal.select("rank", "unit", "blocks", "target").groupBy("unit").applyInPandas(run, "rank int, seats long")  # a row a source
    return goal.join(won.select(F.col("rank").alias("won"), "seats"), F.col("rank") == F.col("won")).drop("won")


def _number(digest: F.Column, at: int) -> F.Column:
    """15 of a digest's hexadecimal digits as a number."""
    return F.conv(F.substring(digest, at, 15), 16, 10).cast("long")


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, block_words: int = 64, shard_words: int = 1 << 24, seed: int = 7) -> DataFrame:
    """`<id_col>, size, source_size, target, taken, spans, text_hash`: a row per row of `docs`.

    spans are structs `first, last`, the words [first, last) of the text in order: what of the row lies in blocks that its source
    takes once more than all others, neighbouring blocks in one span. Their words and the whole takes of the row add up to taken.
    text_hash is the text's xxhash64; id and it say which row is meant.

    size counts the words of a whole text (null: 0); taken is a whole number of words of at most `most * size`.
    A null source is a source of its own, a null id a value like any other: rows are placed by id and text, so many rows of one id
    don't meet in one shard. Repeated rows are rows each: those equal in id and text hold neighbouring places of the stream. Extra
    columns are ignored; an empty table gives no row. A source's taken words miss its target by two blocks at most.
    """
    text = col(text_col).cast("string")
    words = F.coalesce(F.regexp_count(text, F.lit(f"{WORD}+")), F.lit(0)).cast("long")
    rows = docs.select(col(id_col).alias("id"), col(source_col).cast("string").alias("source"), words.alias("size"), F.xxhash64(text).alias("text_hash"), F.coalesce(F.md5(text), F.lit("")).alias("digest"))
    digest = F.md5(F.concat_ws("/", F.lit(str(seed)), F.coalesce(F.col("id").cast("string"), F.lit("null")), F.col("digest")))
    rows = rows.withColumn("digest", digest).select("*", _number(F.col("digest"), 1).alias("place"), _number(F.col("digest"), 16).alias("lot")).drop("digest")
    rows = written(rows, "mix-rows")
    goal = seats(targets(rows, weights=weights, share=share, most=most), block_words=block_words, most=most)
    one = F.greatest(F.col("blocks"), F.lit(1))
    goal = goal.withColumn("blocks", one).withColumn("times", F.expr("seats div blocks")).withColumn("more", F.expr("seats % blocks"))
    goal = written(goal.withColumn("start", F.pmod(_number(F.md5(F.concat_ws("/", F.lit(str(seed + 2)), F.col("rank").cast("string"))), 1), F.col("blocks"))), "mix-targets", partitions=1)
    shards = F.greatest(F.lit(1), F.ceil(F.col("all") / shard_words)).cast("int")
    # rows of no words count as one, so that a shard's rows are bounded as well
    shards = rows.agg(F.coalesce(F.sum(F.col("size") + 1), F.lit(0)).alias("all")).select(shards.alias("n")).first()[0]
    ranks = goal.select("rank", F.col("source").alias("g"))
    rows = rows.join(ranks, F.col("source").eqNullSafe(F.col("g"))).drop("g").withColumn("shard", F.pmod("lot", F.lit(shards)).cast("int"))
    cells = rows.groupBy("shard", "rank").agg(F.sum("size").alias("cell"))
    before = F.sum("cell").over(Window.partitionBy("rank").orderBy("shard")) - F.col("cell")  # one row a shard
    cells = cells.withColumn("before", before).join(goal.drop("source", "seats"), "rank")
    # a cell counts from the block in which it begins; what chosen() carries there is the one product that may pass 2^63
    cells = cells.withColumn("first", F.expr("before div unit")).withColumn("skip", F.expr("before % unit"))
    cells = cells.withColumn("carry", F.expr("cast((cast(first as decimal(19,0)) * cast(more as decimal(19,0)) + start) % blocks as long)"))
    cells = written(cells.drop("cell", "before", "first", "start").withColumnRenamed("rank", "cr").withColumnRenamed("shard", "cs"), "mix-cells")
    stream = Window.partitionBy("shard", "rank").orderBy("place", "id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("within", F.sum("size").over(stream))
    rows = rows.join(cells, (F.col("shard") == F.col("cs")) & (F.col("rank") == F.col("cr")))
    rows = rows.withColumn("end", F.col("skip") + F.col("within")).withColumn("begin", F.col("end") - F.col("size"))
    unit = F.col("unit")
    chosen = lambda k: F.call_function("div", F.col("carry") + k * F.col("more"), F.col("blocks"))

    def covered(x):
        k = F.floor(x / unit)
        return chosen(k) * unit + (chosen(k + 1) - chosen(k)) * (x - k * unit)

    taken = F.col("times") * F.col("size") + F.when(F.col("size") > 0, covered(F.col("end")) - covered(F.col("begin"))).otherwise(F.lit(0))
    low, high = F.floor(F.col("begin") / unit), F.floor((F.col("end") - 1) / unit)
    more = lambda k: chosen(k + 1) > chosen(k)
    of = lambda edge: F.filter(F.sequence(low, high), edge)
    span = lambda k, m: F.struct((F.greatest(k * unit, F.col("begin")) - F.col("begin")).cast("long").alias("first"), (F.least((m + 1) * unit, F.col("end")) - F.col("begin")).cast("long").alias("last"))
    spans = F.zip_with(of(lambda k: more(k) & ((k == low) | ~more(k - 1))), of(lambda k: more(k) & ((k == high) | ~more(k + 1))), span)
    spans = F.when((F.col("size") > 0) & (F.col("more") > 0), spans).otherwise(F.array().cast("array<struct<first:bigint,last:bigint>>"))
    return rows.select(F.col("id").alias(id_col), "size", "source_size", "target", taken.cast("long").alias("taken"), spans.alias("spans"), "text_hash")


def repeat_taken(docs: DataFrame, mixed: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` as the mix takes them: each text as often whole as all its blocks are taken, then a row of its spans, parted by line feeds.

    `mixed` is what mix() returns of `docs`. A span's text runs from its first word to its last. Columns stay. Rows pair with
    `mixed` by id and text hash; only rows equal in both are numbered.
    """
    import re

    names, fields = docs.columns, docs.schema
    mixed = written(mixed.select(col(id_col).alias("__sq_rid"), F.col("text_hash").alias("__sq_rhash"), F.col("size").alias("__sq_size"), "taken", F.col("spans").alias("__sq_spans")), "mix-taken")
    again = written(mixed.groupBy("__sq_rid", "__sq_rhash").count().where("count > 1").select(F.col("__sq_rid").alias("__sq_aid"), F.col("__sq_rhash").alias("__sq_ahash")), "mix-repeated")
    others = F.struct(*(col(c) for c in names if c != text_col))  # without the text, so that a span's row doesn't carry the whole of it
    left = docs.select(others.alias("__sq_row"), col(text_col).cast("string").alias("__sq_text"), col(id_col).alias("__sq_id")).withColumn("__sq_hash", F.xxhash64("__sq_text"))
    same = lambda one, two: F.col(f"__sq_{one}id").eqNullSafe(F.col(f"__sq_{two}id")) & (F.col(f"__sq_{one}hash") == F.col(f"__sq_{two}hash"))
    both = left.join(mixed.join(again, same("r", "a"), "left_anti"), same("", "r"))
    if not again.isEmpty():
        own, other = Window.partitionBy("__sq_id", "__sq_hash").orderBy(F.xxhash64("__sq_row")), Window.partitionBy("__sq_rid", "__sq_rhash").orderBy("taken", "__sq_spans")
        some = left.join(again, same("", "a"), "left_semi").withColumn("__sq_n", F.row_number().over(own))
        several = mixed.join(again, same("r", "a"), "left_semi").withColumn("__sq_rn", F.row_number().over(other))
        both = both.unionAll(some.join(several, same("", "r") & (F.col("__sq_n") == F.col("__sq_rn"))).drop("__sq_n", "__sq_rn"))

    @F.arrow_udf("string")
    def piece(texts, firsts, lasts):
        import pyarrow as pa

        def cut(t, firsts, lasts):
            out, at, begin = [], 0, 0
            for k, m in enumerate(re.finditer(f"{WORD}+", t)):
                if k == firsts[at]:
                    begin = m.start()
                if k + 1 == lasts[at]:
                    out.append(t[begin : m.end()])
                    if (at := at + 1) == len(firsts):
                        break
            return "\n".join(out)

        return pa.array((None if not t.is_valid else cut(t.as_py(), f.as_py(), e.as_py()) for t, f, e in zip(texts, firsts, lasts)), pa.string())

    partial = F.aggregate("__sq_spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"])
    both = both.withColumn("__sq_part", partial)
    whole = F.col("__sq_part") == F.col("__sq_size")  # all blocks of the row are taken once more
    copies = F.expr("(taken - if(__sq_part = __sq_size, 0, __sq_part)) div greatest(__sq_size, 1)").cast("int")
    cuts = (F.col("__sq_part") > 0) & ~whole  # only texts to cut go to Python
    cut = piece(F.when(cuts, F.col("__sq_text")), F.col("__sq_spans.first"), F.col("__sq_spans.last"))
    taken = F.concat(F.array_repeat(F.col("__sq_text"), copies), F.when(cuts, F.array(cut)).otherwise(F.array().cast("array<string>")))
    both = both.select("__sq_row", F.explode(taken).alias("__sq_text"))
    return both.select(*((F.col("__sq_text") if c == text_col else F.col("__sq_row").getField(c)).cast(fields[c].dataType).alias(c) for c in names))
