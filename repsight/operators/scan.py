"""Skew-safe ordered scans over keyed sequences.

Every sequential rule of the analysed application (frame numbering, the
previous frame's form, the hysteresis latch, running counts, "as of the last
control message") is a *prefix scan* over a key (a session or a set) in frame
order.  A plain ``Window.partitionBy(key)`` would sort and buffer a whole key
in one task, so a key holding a third of all rows would become one task.

Instead every scan is a two-level (chunked) prefix scan:

1. rows carry a ``chunk`` column: a coarse, order-preserving bucket of the
   ordering key whose size is bounded (``seq >> 16`` for native frame
   streams; ``adaptive_chunk`` refines coarse buckets only where a key is hot);
2. a window over ``(key, chunk)`` computes the local, chunk-relative result;
3. a per-chunk summary (one row per chunk) is taken either from the same
   exchange as the window (input from a source: map-side work runs once) or
   from the checkpointed local result (derived inputs: chained scans keep a
   linear plan); running values need no aggregate, a chunk's last row has them;
4. a window over the small summary table, partitioned by ``key`` and ordered by
   ``chunk``, turns summaries into carries (what came before the chunk);
5. the carries are joined back on ``(key, chunk)``.  The big side is already
   hash-partitioned on ``(key, chunk)`` by step 2 (kept across checkpoints
   with ``keep_partitioning``), so only the summary side is exchanged, or
   broadcast by AQE when its runtime size is small.

The big input is shuffled once per key set; chained scans on the same keys
reuse the partitioning.  Scans that start anew inside a key (a session's
attempts) name these counters in ``within`` and stay on (key, chunk) too.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _cols(names: Sequence[str]) -> list[Column]:
    return [F.col(n) for n in names]


def order_struct(order: Sequence[str]) -> Column:
    return F.struct(*_cols(order))


def ensure_parallel(df: DataFrame) -> DataFrame:
    """Spread a few large input splits over the cluster before heavy map-side work.

    A no-op when the input already has at least ``defaultParallelism``
    partitions (the normal case at scale); otherwise one round-robin exchange.
    """
    target = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= target:
        return df
    return df.repartition(target)


def checkpoint(df: DataFrame, keep_partitioning: bool = False) -> DataFrame:
    """Cut lineage by a reliable checkpoint in the session's checkpoint folder.

    With ``keep_partitioning`` the checkpoint is computed without adaptive
    execution, so the plan's hash partitioning on (key, chunk) is recorded with
    the checkpoint and the following summary, window and carry join need no
    exchange of the big side.  Use it only when every join below the
    checkpoint is keyed on bounded chunks or broadcast (adaptive skew handling
    is off while it runs).
    """
    if not keep_partitioning:
        return df.checkpoint(eager=True)
    conf = df.sparkSession.conf
    prev = conf.get("spark.sql.adaptive.enabled", "true")
    conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return df.checkpoint(eager=True)
    finally:
        conf.set("spark.sql.adaptive.enabled", prev)


@dataclass(frozen=True)
class Scan:
    """One prefix-scan output.

    kind:
      ``sum``    running sum of ``expr``
      ``last``   last non-null ``expr`` so far (as-of value)
      ``count``  running count of rows (``expr`` ignored)
      ``first``  first non-null ``expr`` of the whole key (constant per key)
      ``held``   the value that the inclusive ``last`` scan named ``of`` (given before) had at the last
                 row so far where ``expr`` is true
    inclusive: include the current row (``False`` means "strictly before").
    default: value used when nothing precedes (``last``/``first``/``held``).
    """

    name: str
    expr: Column | None
    kind: str
    inclusive: bool = True
    default: object = None
    of: str | None = None


def prefix_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: str,
    scans: Sequence[Scan],
    materialize: bool = True,
    keep_partitioning: bool = False,
    within: Sequence[str] = (),
) -> DataFrame:
    """Add the prefix-scan columns ``scans`` to ``df``.

    ``order`` must be a total order within ``keys``; ``chunk`` must be
    non-decreasing in ``order`` within ``keys``.  With ``materialize`` (the
    default) the local result is checkpointed before it is read twice
    (summary and join), so chained scans keep a linear plan; without it both
    are computed from the input's exchange, which suits an input that is a
    cheap source scan.

    ``within``: counters that never fall in ``order`` within ``keys`` (and are never null);
    a scan starts anew where one rises.  The result is that of ``keys`` with these columns
    added, but the rows stay and are joined as (keys, chunk) deals them.
    """
    keys = [*keys, *within]
    part = keys + [chunk]
    by_name = {s.name: s for s in scans}
    tmp = df
    for s in scans:
        if s.kind != "held":
            v = F.lit(1).cast("bigint") if s.kind == "count" else s.expr
            tmp = tmp.withColumn(f"__v_{s.name}", v)
    if not materialize:
        tmp = tmp.repartition(*_cols(part))  # shared by window and summary

    w = Window.partitionBy(*part).orderBy(*_cols(order))
    incl = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    excl = w.rowsBetween(Window.unboundedPreceding, -1)

    running = {"__end": F.lead(F.lit(True)).over(w).isNull()}
    for s in scans:
        v = F.col(f"__v_{s.name}")
        if s.kind in ("sum", "count"):
            running[f"__l_{s.name}"] = F.sum(v).over(incl)
        elif s.kind == "last":
            running[f"__l_{s.name}"] = F.last(v, ignorenulls=True).over(incl if s.inclusive else excl)
        elif s.kind == "first":
            running[f"__l_{s.name}"] = F.first(v, ignorenulls=True).over(incl)
        elif s.kind != "held":
            raise ValueError(f"unknown scan kind {s.kind}")
    local = tmp.withColumns(running)
    # a struct: its value is null where it comes from an earlier chunk
    local = local.withColumns({
        f"__l_{s.name}": F.last(F.when(s.expr, F.struct(F.col(f"__l_{s.of}").alias("v"))), ignorenulls=True).over(incl)
        for s in scans if s.kind == "held"
    })
    # only what stands strictly before a row still needs the row's own value
    local = local.drop(*[f"__v_{s.name}" for s in scans if s.inclusive or s.kind == "first"])
    if materialize:
        local = checkpoint(local, keep_partitioning)

    # what a chunk adds is what its last row has
    def total(s: Scan) -> Column:
        here = F.col(f"__l_{s.name}")
        return here if s.kind != "last" or s.inclusive else F.coalesce(F.col(f"__v_{s.name}"), here)

    summary = local.where("__end").select(*part, *[total(s).alias(f"__t_{s.name}") for s in scans])

    cw = Window.partitionBy(*keys).orderBy(chunk)
    before = cw.rowsBetween(Window.unboundedPreceding, -1)
    whole = cw.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    carries = summary
    for s in scans:
        t = F.col(f"__t_{s.name}")
        if s.kind in ("sum", "count"):
            c = F.coalesce(F.sum(t).over(before), F.lit(0))
        elif s.kind == "last":
            c = F.last(t, ignorenulls=True).over(before)
        elif s.kind == "held":
            carried = F.coalesce(t["v"], F.col(f"__c_{s.of}"), F.lit(by_name[s.of].default))
            c = F.last(F.when(t.isNotNull(), F.struct(carried.alias("v"))), ignorenulls=True).over(before)["v"]
        else:
            c = F.first(t, ignorenulls=True).over(whole)
        carries = carries.withColumn(f"__c_{s.name}", c)
    out = join_carries(local, carries, keys, chunk, [f"__c_{s.name}" for s in scans], within)
    for s in scans:
        c = F.col(f"__c_{s.name}")
        if s.kind in ("sum", "count"):
            lv = F.col(f"__l_{s.name}")
            c = F.coalesce(c, F.lit(0)) if within else c
            val = c + lv if s.inclusive else c + lv - F.coalesce(F.col(f"__v_{s.name}"), F.lit(0))
            if s.kind == "count":
                val = val.cast("bigint")
        elif s.kind == "last":
            val = F.coalesce(F.col(f"__l_{s.name}"), c)
            if s.default is not None:
                val = F.coalesce(val, F.lit(s.default))
        elif s.kind == "held":
            here = F.col(f"__l_{s.name}")
            val = F.when(here.isNull(), c).otherwise(
                F.coalesce(here["v"], F.col(f"__c_{s.of}"), F.lit(by_name[s.of].default)))
            if s.default is not None:
                val = F.coalesce(val, F.lit(s.default))
        else:
            val = c if s.default is None else F.coalesce(c, F.lit(s.default))
        out = out.withColumn(s.name, val)
    drop = [c for c in out.columns if c.startswith("__")]
    return out.drop(*drop)


def join_carries(
    local: DataFrame, carries: DataFrame, keys: Sequence[str], chunk: str, values: Sequence[str], within: Sequence[str]
) -> DataFrame:
    """``local`` with the ``values`` carried into each row's chunk.

    With ``within`` (the last of ``keys``), only what runs on from an earlier chunk
    carries anything, and that is at most one of its values for (other keys, chunk):
    so the join needs no more keys than those.  Other rows get nulls.
    """
    if not within:
        return local.join(carries.select(*keys, chunk, *values), on=[*keys, chunk], how="left")
    outer = [k for k in keys if k not in within]
    earlier = F.row_number().over(Window.partitionBy(*keys).orderBy(chunk)) > 1
    on = carries.withColumn("__on", earlier).where("__on").select(
        *outer, chunk, F.struct(*within).alias("__of"), F.struct(*values).alias("__carried")
    )
    out = local.join(on, on=[*outer, chunk], how="left")
    same = F.col("__of") == F.struct(*within)
    return out.withColumns({v: F.when(same, F.col("__carried")[v]) for v in values}).drop("__of", "__carried")


def number_frames(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: str,
    frame_col: str = "frame",
    lags: dict[str, tuple[str, object]] | None = None,
    firsts: dict[str, str] | None = None,
    materialize: bool = False,
    keep_partitioning: bool = False,
) -> DataFrame:
    """Dense 0-based frame number within ``keys`` plus lagged and first values.

    ``lags``: output name -> (input column, default for the first frame); the
    value of the previous frame in order.  ``firsts``: output name -> input
    column; the value at the first frame of the key.  One exchange on
    ``(keys, chunk)``.  The per-chunk summary is a partial aggregate of the
    input, or, with ``materialize`` (for derived inputs), of the checkpointed
    local result.
    """
    lags = lags or {}
    firsts = firsts or {}
    keys = list(keys)
    part = keys + [chunk]
    ostruct = order_struct(order)
    w = Window.partitionBy(*part).orderBy(*_cols(order))

    source = df
    if not materialize:
        # one exchange on (keys, chunk) read by both the window and the
        # summary (ReusedExchange): map-side work runs once
        df = df.repartition(*_cols(part))
    local = df.withColumn("__rn", F.row_number().over(w))
    for name, (src, _default) in lags.items():
        local = local.withColumn(f"__lag_{name}", F.lag(F.col(src), 1).over(w))

    aggs = [F.count(F.lit(1)).alias("__n")]
    for name, (src, _default) in lags.items():
        aggs.append(F.max_by(F.col(src), ostruct).alias(f"__last_{name}"))
    for name, src in firsts.items():
        aggs.append(F.min_by(F.col(src), ostruct).alias(f"__first_{name}"))
    if materialize:
        local = checkpoint(local, keep_partitioning)
        summary = local.groupBy(*part).agg(*aggs)
    else:
        # a mere count reads the keys only: they are counted before any exchange
        summary = (df if lags or firsts else source).groupBy(*part).agg(*aggs)

    cw = Window.partitionBy(*keys).orderBy(chunk)
    before = cw.rowsBetween(Window.unboundedPreceding, -1)
    whole = cw.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    carries = summary.select(
        *part,
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"),
        *[F.lag(f"__last_{n}", 1).over(cw).alias(f"__prev_{n}") for n in lags],
        *[F.first(f"__first_{n}").over(whole).alias(n) for n in firsts],
    )
    out = local.join(carries, on=part, how="left")
    out = out.withColumn(frame_col, (F.col("__offset") + F.col("__rn") - 1).cast("bigint"))
    keep = {frame_col, *lags, *firsts}
    for name, (_src, default) in lags.items():
        val = F.coalesce(F.col(f"__lag_{name}"), F.col(f"__prev_{name}"))
        if default is not None:
            val = F.coalesce(val, F.lit(default))
        out = out.withColumn(name, val)
    return out.drop(*[c for c in out.columns if c.startswith("__") and c not in keep])


def hysteresis_latch(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: str,
    angle: str,
    prev_form_up: str,
    prev_form_down: str,
    low: float,
    high: float,
    within: Sequence[str] = (),
) -> DataFrame:
    """Gated down/up repetition latch as a chunked scan.

    Per frame ``i`` (state before the set's first frame: up, form not good):
    if the previous frame's form was good, an angle <= ``low`` sets *down*;
    otherwise an angle >= ``high`` clears *down* and counts one repetition if
    it was set.  The previous frame's form is ``prev_form_down`` when the
    latch was down and ``prev_form_up`` when it was up, so each frame's event
    is a function of its own angle and the previous frame's features:

        event = 1 (set)   if angle <= low  and prev_form_up
                0 (reset) if angle >= high and prev_form_down
                null      otherwise            (NaN angles never fire)

    ``down`` is the last non-null event, a repetition is a reset whose
    preceding non-null event was a set.  Adds ``event``, ``down``, ``rep``
    (boolean) and ``rep_count`` (bigint, running).  ``within``: as in ``prefix_scan``.
    """
    return hysteresis_latches(df, keys, order, chunk, {"": (angle, prev_form_up, prev_form_down)}, low, high, within)


def hysteresis_latches(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: str,
    latches: dict[str, tuple[str, str, str]],
    low: float,
    high: float,
    within: Sequence[str] = (),
) -> DataFrame:
    """Several latches of the same rows (``hysteresis_latch``) with one sort, one checkpoint and one join.

    ``latches``: suffix of the added columns -> (angle, prev_form_up, prev_form_down).
    """
    keys = [*keys, *within]
    part = keys + [chunk]
    w = Window.partitionBy(*part).orderBy(*_cols(order))
    incl = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    excl = w.rowsBetween(Window.unboundedPreceding, -1)
    c = lambda name, x: F.col(f"{name}{x}")

    def event(angle: str, up: str, down: str) -> Column:
        a = F.col(angle)
        valid = a.isNotNull() & ~F.isnan(a)
        return F.when(valid & (a <= F.lit(low)) & F.col(up), F.lit(1)).when(valid & (a >= F.lit(high)) & F.col(down), F.lit(0))

    local = df.withColumns({f"event{x}": event(*of) for x, of in latches.items()})
    local = local.withColumns(
        {f"__li{x}": F.last(f"event{x}", ignorenulls=True).over(incl) for x in latches}
        | {f"__le{x}": F.last(f"event{x}", ignorenulls=True).over(excl) for x in latches}
        | {f"__lf{x}": F.first(f"event{x}", ignorenulls=True).over(incl) for x in latches}
        | {"__end": F.lead(F.lit(True)).over(w).isNull()}
    )
    local = local.withColumns(
        {f"__lrep{x}": ((c("event", x) == 0) & (F.coalesce(c("__le", x), F.lit(-1)) == 1)).cast("bigint") for x in latches}
    )
    local = local.withColumns({f"__lrs{x}": F.sum(f"__lrep{x}").over(incl) for x in latches}).drop(*[f"__lrep{x}" for x in latches])
    # inputs of the latch come from scans keyed on (key, chunk): safe to keep partitioning
    local = checkpoint(local, keep_partitioning=True)

    summary = local.where("__end").select(
        *part, *[c(n, x).alias(f"{t}{x}") for x in latches
                 for n, t in (("__li", "__last_ev"), ("__lf", "__first_ev"), ("__lrs", "__tot"))]
    )
    cw = Window.partitionBy(*keys).orderBy(chunk)
    before = cw.rowsBetween(Window.unboundedPreceding, -1)
    carries = summary.withColumns({f"__carry_last{x}": F.last(f"__last_ev{x}", ignorenulls=True).over(before) for x in latches})
    carries = carries.withColumns({
        f"__fix{x}": ((c("__first_ev", x) == 0) & (F.coalesce(c("__carry_last", x), F.lit(-1)) == 1)).cast("bigint")
        for x in latches
    })
    carries = carries.withColumns({
        f"__carry_reps{x}": F.coalesce(F.sum(c("__tot", x) + c("__fix", x)).over(before), F.lit(0).cast("bigint"))
        for x in latches
    })
    names = [f"{n}{x}" for x in latches for n in ("__carry_last", "__fix", "__carry_reps")]
    out = join_carries(local, carries, keys, chunk, names, within)
    if within:
        out = out.withColumns({n: F.coalesce(n, F.lit(0)) for n in names if not n.startswith("__carry_last")})
    cols = {}
    for x in latches:
        prev = F.coalesce(F.coalesce(c("__le", x), c("__carry_last", x)) == 1, F.lit(False))
        cols[f"down{x}"] = F.coalesce(F.coalesce(c("__li", x), c("__carry_last", x)) == 1, F.lit(False))
        cols[f"rep_inc{x}"] = F.coalesce(c("event", x) == 0, F.lit(False)) & prev
        cols[f"rep_count{x}"] = (
            c("__carry_reps", x) + c("__lrs", x) + F.when(c("__li", x).isNotNull(), c("__fix", x)).otherwise(F.lit(0))
        ).cast("bigint")
    out = out.withColumns(cols)
    return out.drop(*[n for n in out.columns if n.startswith("__")])


def adaptive_chunk(
    df: DataFrame,
    keys: Sequence[str],
    coarse: Column,
    fine: Column,
    max_rows: int = 1 << 20,
    max_hot: int = 1 << 20,
    name: str = "chunk",
) -> DataFrame:
    """Add an order-preserving ``chunk``: the coarse bucket, refined by ``fine``
    only inside (key, coarse) groups holding more than ``max_rows`` rows.

    ``coarse`` must be non-decreasing in the scan order within a key and
    ``fine`` non-decreasing within a coarse bucket, with ``fine >= 0``.  The
    chunk is the pair of both, so neither can run into the other.
    Normal keys thus get few, full chunks (small summary tables), and a hot
    key is still split into bounded chunks.  The refined groups number at most
    rows / ``max_rows``; they are broadcast only below ``max_hot`` (checked
    with one count), and beyond that every row uses the fine chunk.
    """
    keys = list(keys)
    d = df.withColumn("__coarse", coarse.cast("bigint")).withColumn("__fine", fine.cast("bigint"))
    hot = (
        d.groupBy(*keys, "__coarse")
        .agg(F.count(F.lit(1)).alias("__n"))
        .where(F.col("__n") > max_rows)
        .select(*keys, "__coarse", F.lit(True).alias("__hot"))
    )
    n_hot = hot.count()

    def chunk(fine: Column) -> Column:
        return F.struct(F.col("__coarse").alias("coarse"), fine.alias("fine"))

    if n_hot == 0:
        out = d.withColumn(name, chunk(F.lit(0).cast("bigint")))
    elif n_hot <= max_hot:
        out = d.join(F.broadcast(hot), keys + ["__coarse"], "left").withColumn(
            name, chunk(F.when(F.col("__hot"), F.col("__fine")).otherwise(F.lit(0).cast("bigint")))
        )
    else:
        out = d.withColumn(name, chunk(F.col("__fine")))
    return out.drop("__coarse", "__fine", "__hot")
