"""All-or-nothing requests competing for capacity, decided in a fixed order.

Sequential meaning: requests are taken in ``seq`` order; a request is
accepted iff every one of its lines fits the capacity left by the requests
accepted before it; a rejected request takes nothing.

Distributed plan (rounds). Each round looks at the lines of undecided requests only,
with what accepted earlier requests have left for each of them (``free``). Per
resource, a running sum in ``seq`` order over these lines:

- if every line of a request fits even when all earlier undecided requests are counted,
  it is accepted;
- if some line exceeds what is left for it, the request is rejected.

Both rules agree with the sequential answer, and the earliest undecided
request is always decided (all requests before it are). What a round accepts is taken off
``free`` of the later lines by the next round's running sums, so a decided request
is read once more at most and the rounds shrink with what is open.

Once few lines are open, or when a round decides little (a chain), the undecided requests
are split into connected components (requests that share an open resource, directly or
through others). No request outside a component touches its open resources any more, so
components of at most ``group_lines`` lines are solved in ``seq`` order, many in one
task: a chain of n requests takes one pass, not n rounds. Only a component
beyond that goes through further rounds of the two rules, until its parts are small enough.

Running sums are plain windows per resource; resources of more than ``group_lines``
lines take ``plans.scan.prefix_sum`` instead, which spans many tasks.

Each round is written to the shared checkpoint folder (``session.stored``), which cuts
the lineage and survives lost executors.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .components import components
from .scan import prefix_sum

UNDECIDED, ACCEPTED, REJECTED = "U", "A", "R"
#: Lines of a component that one task solves; larger ones take further rounds.
GROUP_LINES = 200_000
#: Lines of the components that are dealt to one task together.
TASK_LINES = 20_000
#: A round that leaves more than this share of the lines open is followed by components.
SLOW = 0.8


def _solve(res_keys: list[str]):
    """Requests of some components in ``seq`` order. ``free`` is what requests accepted in
    earlier rounds leave for this line."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq", kind="stable")
        res = pdf.groupby(res_keys, sort=False).ngroup().to_numpy()
        free = (pdf["free"] - pdf["qty"]).to_numpy()
        qty, seq = pdf["qty"].to_numpy(), pdf["seq"].to_numpy()
        taken: dict[int, int] = {}
        out = []
        at = 0
        while at < len(pdf):
            end = at
            while end < len(pdf) and seq[end] == seq[at]:
                end += 1
            ok = all(free[k] >= taken.get(res[k], 0) for k in range(at, end))
            if ok:
                for k in range(at, end):
                    taken[res[k]] = taken.get(res[k], 0) + int(qty[k])
            out.append((int(seq[at]), ok))
            at = end
        return pd.DataFrame(out, columns=["seq", "_ok"])
    return run


def _solved_components(open_lines: DataFrame, res_keys: list[str], group_lines: int) -> DataFrame:
    """seq, _ok of the undecided requests in components of bounded size."""
    first = open_lines.groupBy(*res_keys).agg(F.min("seq").alias("_first"))
    edges = open_lines.join(first, res_keys).select(
        F.col("seq").cast("long").alias("u"), F.col("_first").cast("long").alias("v"))
    roots = components(edges).select(F.col("node").alias("seq"), "root")
    placed = (open_lines.join(roots, "seq", "left")
              .withColumn("root", F.coalesce("root", "seq")))
    sizes = placed.groupBy("root").agg(F.count(F.lit(1)).alias("_n")).filter(
        F.col("_n") <= group_lines)
    # Components do not touch each other: those of one task are replayed together, as a
    # group for each of them would cost more than its replay.
    n = open_lines.count()
    tasks = max(1, -(-n // TASK_LINES))
    return (placed.join(sizes.select("root"), "root", "left_semi")
            .withColumn("_task", F.pmod(F.xxhash64("root"), F.lit(tasks)))
            .select("_task", "seq", *res_keys, "qty", "free").groupBy("_task")
            .applyInPandas(_solve(res_keys), "seq long, _ok boolean"))


def _running(lines: DataFrame, res_keys: list[str], hot: DataFrame | None) -> DataFrame:
    """``lines`` with what the open ones (_run_open, the line included) and the accepted ones
    before it (_run_acc) ask of its resource."""
    lines = (lines.withColumn("_acc", F.when(F.col("taken"), F.col("qty")).otherwise(F.lit(0)))
             .withColumn("_open", F.when(F.col("taken"), F.lit(0)).otherwise(F.col("qty"))))

    def windowed(df: DataFrame) -> DataFrame:
        w = (Window.partitionBy(*res_keys).orderBy("seq")
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
        return (df.withColumn("_run_open", F.sum("_open").over(w))
                .withColumn("_run_acc", F.sum("_acc").over(w)))

    if hot is None:
        return windowed(lines)
    few = F.broadcast(hot)  # bounded: at most lines / group_lines rows
    spread = prefix_sum(lines.join(few, res_keys, "left_semi"), res_keys, [F.col("seq").asc()],
                        ["_open", "_acc"], ["_run_open", "_run_acc"])
    cold = windowed(lines.join(few, res_keys, "left_anti"))
    return cold.unionByName(spread.select(*cold.columns))


def allocate_in_order(lines: DataFrame, capacity: DataFrame | None, res_keys: list[str],
                      group_lines: int = GROUP_LINES) -> DataFrame:
    """Decide requests.

    ``lines``: req_id, seq, *res_keys, qty (qty > 0; ``seq`` unique per request).
    ``capacity``: *res_keys, cap (a missing resource has capacity 0). None: ``lines`` have a
    resource once per request, with its ``cap``, and are written already.
    Returns req_id, seq, accepted (bool), decided_round.
    """
    cap = F.coalesce(F.col("cap"), F.lit(0)).cast("long").alias("free")
    if capacity is None:
        live = lines.select("req_id", "seq", *res_keys, F.col("qty").cast("long").alias("qty"), cap,
                            F.lit(False).alias("taken"))
    else:
        live = stored(
            lines.groupBy("req_id", "seq", *res_keys).agg(F.sum("qty").cast("long").alias("qty"))
            .join(capacity.select(*res_keys, "cap"), res_keys, "left")
            .select("req_id", "seq", *res_keys, "qty", cap, F.lit(False).alias("taken")))
    hot: DataFrame | None = stored(live.groupBy(*res_keys).count().filter(
        F.col("count") > group_lines).select(*res_keys))
    if not hot.limit(1).count():
        hot = None
    done: list[DataFrame] = []
    rnd, left = 0, live.count()
    slow = False
    while left:
        rnd += 1
        own = Window.partitionBy("req_id")
        judged = (_running(live, res_keys, hot).filter(~F.col("taken"))
                  .withColumn("free", F.col("free") - F.col("_run_acc"))
                  .withColumn("_fit", F.min(F.col("_run_open") <= F.col("free")).over(own))
                  .withColumn("_over", F.max(F.col("qty") > F.col("free")).over(own)))
        keep = ["req_id", "seq", *res_keys, "qty", "free"]
        judged = stored(judged.select(
            *keep, F.when(F.col("_fit"), F.lit(ACCEPTED)).when(F.col("_over"), F.lit(REJECTED))
            .otherwise(F.lit(UNDECIDED)).alias("st")))
        before, left = left, judged.filter(F.col("st") == UNDECIDED).count()
        slow = left > SLOW * before
        if left and (slow or left <= group_lines):
            # With what this round accepts: it is not yet taken off ``free``.
            solved = _solved_components(judged.filter(F.col("st") != REJECTED), res_keys,
                                        group_lines)
            judged = stored(
                judged.join(solved, "seq", "left")
                .select(*keep, F.when(F.col("_ok"), F.lit(ACCEPTED)).when(~F.col("_ok"), F.lit(REJECTED))
                        .otherwise(F.col("st")).alias("st")))
            left = judged.filter(F.col("st") == UNDECIDED).count()
        done.append(judged.filter(F.col("st") != UNDECIDED).select(
            "req_id", "seq", (F.col("st") == ACCEPTED).alias("accepted"),
            F.lit(rnd).alias("decided_round")).distinct())
        live = judged.filter(F.col("st") != REJECTED).select(
            *keep, (F.col("st") == ACCEPTED).alias("taken"))
    if not done:
        return live.select("req_id", "seq", "taken", F.lit(None).cast("int").alias("decided_round")) \
            .withColumnRenamed("taken", "accepted")
    return stored(reduce(DataFrame.unionByName, done))
