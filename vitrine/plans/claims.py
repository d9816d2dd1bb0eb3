"""Claims of unique names, decided in request order.

A holder (a user) has one name (an e-mail) at a time. A claim (seq, holder, name) is
accepted when no other holder has the name at that moment; the holder then has it and
gives up the one before. Accepted claims free names for later ones, so the outcome
depends on order.

1. A name held by someone who makes no claim himself stays held: claims of others to it
   are refused at once.
2. Names that two holders or more may get link these holders. Connected components of
   this graph do not touch each other and are replayed side by side, each in order and
   many in one task: a group for each of them would cost more than its replay.
3. A component of over ``slice_claims`` claims is replayed in slices of that many, in
   order of seq: a slice reads only what is held by the holders, and of the names, that
   occur in it. What a task holds is bounded, whatever a name's or a holder's share of the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .components import components
from .scan import prefix_sum

SLICE_CLAIMS = 200_000
#: Claims of the components that are dealt to one task together.
TASK_CLAIMS = 20_000
OUT = "seq long, holder long, name string, ok boolean"


def replay(claims: Iterator[tuple], held: Iterator[tuple]) -> list[tuple]:
    """(seq, holder, name, ok) of claims (seq, holder, name) in order, from what is held
    (holder, name) before."""
    names: dict[int, str] = {}
    holders: dict[str, set[int]] = {}
    for holder, name in held:
        names[holder] = name
        holders.setdefault(name, set()).add(holder)
    out = []
    for seq, holder, name in sorted(claims):
        ok = not holders.get(name, set()) - {holder}
        if ok:
            holders.get(names.get(holder), set()).discard(holder)
            names[holder] = name
            holders.setdefault(name, set()).add(holder)
        out.append((seq, holder, name, ok))
    return out


def _replay_group(key: tuple, claims: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
    done = replay(zip(claims["seq"], claims["holder"], claims["name"]),
                  zip(held["holder"], held["name"]))
    return pd.DataFrame(done, columns=["seq", "holder", "name", "ok"])


def decide_claims(claims: DataFrame, held: DataFrame,
                  slice_claims: int = SLICE_CLAIMS) -> DataFrame:
    """seq, ok for every claim (seq unique, holder long, name not NULL). ``held``: holder,
    name as it stands before, one row per holder."""
    ensure_checkpoint_dir(claims.sparkSession)
    claims = claims.select("seq", "holder", "name").checkpoint()
    claimants = claims.select("holder").distinct()
    wanted = claims.select("name").distinct()
    # What is held by somebody in the batch, or is a name asked for.
    held = held.select("holder", "name")
    moving = held.join(claimants, "holder", "left_semi")
    fixed = (held.join(wanted, "name", "left_semi").join(claimants, "holder", "left_anti")
             .select("name").distinct())
    open_claims = claims.join(fixed, "name", "left_anti").checkpoint()
    moving = moving.checkpoint()

    meets = (open_claims.select("holder", "name").unionByName(moving).distinct())
    first = meets.groupBy("name").agg(F.min("holder").alias("_first"))
    edges = meets.join(first, "name").select(F.col("holder").alias("u"), F.col("_first").alias("v"))
    roots = components(edges).select(F.col("node").alias("holder"), "root")

    def rooted(df: DataFrame) -> DataFrame:
        return df.join(roots, "holder", "left").withColumn("root", F.coalesce("root", "holder"))

    left, state = rooted(open_claims).checkpoint(), rooted(moving).checkpoint()
    done: DataFrame | None = None
    while True:
        large = left.groupBy("root").count().filter(F.col("count") > slice_claims).select("root")
        now = left
        if large.limit(1).count():
            placed = prefix_sum(left.join(large, "root", "left_semi").withColumn("_one", F.lit(1)),
                                ["root"], [F.col("seq").asc()], "_one", "_pos").drop("_one")
            heads = placed.filter(F.col("_pos") <= slice_claims).drop("_pos")
            now = left.join(large, "root", "left_anti").unionByName(heads).checkpoint()
        near = (state.join(now.select("holder").distinct(), "holder", "left_semi")
                .unionByName(state.join(now.select("name").distinct(), "name", "left_semi"))
                .distinct())
        tasks = max(1, -(-now.count() // TASK_CLAIMS))
        task = F.pmod(F.xxhash64("root"), F.lit(tasks))
        solved = (now.withColumn("_task", task).groupBy("_task")
                  .cogroup(near.withColumn("_task", task).groupBy("_task"))
                  .applyInPandas(_replay_group, OUT).checkpoint())
        done = solved if done is None else done.unionByName(solved)
        left = left.join(solved.select("seq"), "seq", "left_anti").checkpoint()
        if not left.limit(1).count():
            break
        # The last accepted claim of a holder is what he has when the next slice starts.
        moved = (solved.filter("ok").groupBy("holder").agg(F.max_by("name", "seq").alias("name")))
        state = (state.join(moved, "holder", "left_anti").select("holder", "name")
                 .unionByName(moved).transform(rooted).checkpoint())
    return (claims.select("seq").join(done.select("seq", "ok"), "seq", "left")
            .select("seq", F.coalesce("ok", F.lit(False)).alias("ok")))
