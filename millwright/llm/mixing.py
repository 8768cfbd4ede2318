"""Mixing sources to target weights by weighted fair queueing.

Every source queues its documents in a shuffled order, once for each time they may be used. The
virtual finish time of a document is the words its source has queued up to its end, over the words
that the source should give: at time 1 each source has given its target. The queues are merged by one
global range sort on finish times and cut where the total budget is reached. Only a document whose
service starts before time 1 stands in a queue, and the one that crosses time 1 stands there in short
pieces, so no source ends further from its target than a piece.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millwright.operators.tiles import global_row_index

from .shared import running_totals, ship, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
PIECE = 8  # words of a piece of the document that crosses the end of its source's share
SPACE = " \t\n\x0b\f\r"
GAP = "[ \\t\\n\\x0B\\f\\r]+"
ADDED = ("size", "source_size", "target", "taken")


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``sizes`` (source, source_size) with number, weight and target.

    Weights repeat over the sources in code point order, null last. Targets are ``weight * level``, but at
    most ``most`` times the source. The level at which they add up to ``share`` of all sizes is found by
    sharing out anew what the full sources leave, until none is above its limit; each round is one
    aggregate, and the driver sees two numbers of it.
    """
    numbered = written(global_row_index(sizes, ["source"]), "mix-sources")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weighted = numbered.select(
        F.col("row_index").alias("number"),
        "source",
        "source_size",
        F.get(cycle, (F.col("row_index") % len(weights)).cast("int")).alias("weight"),
        (F.col("source_size") * float(most)).alias("limit"),
    )
    budget = share * (weighted.agg(F.sum("source_size")).first()[0] or 0)
    level, full = 0.0, -1
    while True:
        above = F.col("limit") <= F.col("weight") * level
        held, open_weight, now = weighted.agg(
            F.coalesce(F.sum(F.when(above, F.col("limit"))), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0)),
            F.count_if(above),
        ).first()
        if now == full or not open_weight:
            break
        level, full = max(level, (budget - held) / open_weight), now
    target = F.least("limit", F.col("weight") * level)
    return weighted.select("number", "source", "source_size", "weight", target.alias("target"))


def mix(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    most: int = MOST,
    piece: int = PIECE,
    keep: Sequence[str] | None = None,
    seed: int = 11,
) -> DataFrame:
    """``docs`` (doc_id, text, source) with size, source_size, target and taken.

    ``size`` counts the words of the whole text (null: none), ``taken`` those that the mix uses, repeats
    counted: ``taken div size`` times the whole text and then its first ``taken mod size`` words. A
    null source is a source like any other; a null doc_id is allowed. Rows that repeat each other are
    documents of their own. The same rows give the same mix however they are laid out. ``keep`` names the
    columns to carry, all by default; a column named like an added one gives way. An empty table gives an empty result.

    Shuffles move a few numbers a document. A large source is split by its shuffled order. The
    sources, counted in the data, are joined with their sizes known to the optimizer.
    """
    names = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ADDED]
    body = F.trim(F.coalesce(F.col("text"), F.lit("")), F.lit(SPACE))
    size = F.when(body == "", 0).otherwise(F.size(F.split(body, GAP))).cast("bigint")
    rows = written(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("mark"),
            F.col("source"),
            size.alias("size"),
            *[F.col(f"`{name}`").alias(f"kept{i}") for i, name in enumerate(names)],
        ),
        "mix-rows",
    )
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = written(source_targets(sizes, weights, share, most), "mix-targets")
    budget = int(share * (sources.agg(F.sum("source_size")).first()[0] or 0))
    theirs = sources.withColumnRenamed("source", "its")

    whole = rows.where("size > 0").select("row", "mark", "source", "size").join(theirs, F.col("source").eqNullSafe(F.col("its")))
    queue = whole.where("target > 0").select(
        "number", "size", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(most - 1).cast("bigint"))).alias("use"), "mark", "row", "target"
    )
    queue = queue.withColumn("shuffled", F.xxhash64(F.lit(seed), "use", "mark"))
    queued = running_totals(queue, ["number", "use", "shuffled", "mark", "size", "row"], "size", "number", "mix-queues")

    # Pieces of what starts in time: the whole document, or short ones if it ends too late.
    in_time = queued.where(F.col("before") < F.col("target"))
    step = F.when(F.col("before") + F.col("size") <= F.col("target"), F.col("size")).otherwise(F.lit(piece).cast("bigint"))
    cut = in_time.withColumn("step", step).withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr("(size - 1) div step"))))
    start = F.col("before") + F.col("i") * F.col("step")
    words = F.least("step", F.col("size") - F.col("i") * F.col("step"))
    pieces = cut.select("number", "row", "target", start.alias("start"), words.alias("words")).where("start < target")
    finish = (F.col("start") + F.col("words")) / F.col("target")
    merged = pieces.select("row", "number", "start", "words", finish.alias("finish"), F.lit(0).cast("bigint").alias("all"))
    served = running_totals(merged, ["all", "finish", "number", "start"], "words", "all", "mix-order")
    used = F.least("words", F.lit(budget).cast("bigint") - F.col("before"))
    taken = served.where(F.col("before") < budget).groupBy("row").agg(F.sum(used).alias("taken"))

    known = rows.join(theirs, F.col("source").eqNullSafe(F.col("its"))).join(taken, "row", "left")
    return known.select(
        *[F.col(f"kept{i}").alias(name) for i, name in enumerate(names)],
        "size",
        "source_size",
        "target",
        F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"),
    )


def mixed_texts(mixed: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, use, text): the texts that a mix consists of, one row for every use, the last one cut after
    its words if it is used in part. ``mixed`` is a result of :func:`mix` that kept ``id`` and ``text``."""
    ship(mixed.sparkSession)
    uses = F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr("(taken - 1) div size")))
    rows = mixed.where("taken > 0").select(F.col(id).alias("doc_id"), uses.alias("use"), F.col(text).alias("text"), "size", "taken")
    word = re.compile(f"[^{SPACE}]+")

    def cut(frames):
        for frame in frames:
            left = (frame["taken"] - frame["use"] * frame["size"]).clip(upper=frame["size"])
            texts = []
            for body, size, n in zip(frame["text"], frame["size"], left, strict=True):
                end = len(body)
                if n < size:
                    for _, found in zip(range(n), word.finditer(body)):
                        end = found.end()
                texts.append(body[:end])
            yield pd.DataFrame({"doc_id": frame["doc_id"], "use": frame["use"], "text": texts})

    id_type = mixed.schema[id].dataType.simpleString()
    return rows.mapInPandas(cut, f"doc_id {id_type}, use bigint, text string")
