"""What a host tells about the part of a clip it uses, and lookups that expire.

Both follow each key's rows in order. In a batch that is a window, or a group
where a row depends on what earlier rows led to; in a stream it is state.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: A change of the offset between time and source frame that means the clip is retimed,
#: and how far outside its range a frame may lie.
RETIMED, OUTSIDE = 0.01, 0.5
#: Fixed values in seconds: how long a lookup holds that found nothing, and a listing of files.
NOTHING_FOUND, LISTING, SLOW_LISTING = 20.0, 2.0, 10.0


def host_ranges(renders: DataFrame) -> DataFrame:
    """Each render with the range its clip is used in: adds offset, retimed, used_first, used_last, note.

    ``renders`` holds (instance, seq, time, source_frame, source, first, last);
    first and last are the host's range in its own time, null where it reports
    none. A clip whose offset changes while its source stays is retimed from
    then on. Frames count from 0; a range that is not to be used is 0 to null.
    """
    order = Window.partitionBy("instance").orderBy("seq")
    rows = renders.withColumn("offset", F.col("source_frame").cast("double") - F.col("time"))
    changed = F.coalesce(F.lag("source").over(order) != F.col("source"), F.lit(True))
    rows = rows.withColumn("__run", F.sum(changed.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    own = Window.partitionBy("instance", "__run").orderBy("seq")
    moved = F.coalesce(F.abs(F.col("offset") - F.lag("offset").over(own)) > RETIMED, F.lit(False))
    rows = rows.withColumn("__moved", moved).withColumn("retimed", F.max("__moved").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    return used(rows).drop("__run", "__moved")


def used(rows: DataFrame) -> DataFrame:
    """used_first, used_last and note from offset, retimed and the host's range."""
    known = F.coalesce((F.col("last") > F.col("first")) & F.col("time").between(F.col("first") - OUTSIDE, F.col("last") + OUTSIDE), F.lit(False))
    a, b = (F.round(F.col(c) + F.col("offset")).cast("bigint") for c in ("first", "last"))
    usable = known & ~F.col("retimed") & (b >= 0) & (b >= a)
    note = F.when(F.col("retimed"), "automatic: the clip is retimed, whole clip used").when(~known, "automatic: the host reports no clip range").otherwise(
        F.format_string("automatic: host clip range %.0f to %.0f, source frame = time %+.0f", F.col("first").cast("double"), F.col("last").cast("double"), F.col("offset") + 1))
    return rows.withColumns({"used_first": F.when(usable, F.greatest(a, F.lit(0))).otherwise(F.lit(0).cast("bigint")), "used_last": F.when(usable, b), "note": note})


STREAM = "instance string, seq bigint, time double, source_frame bigint, source string, first double, last double, offset double, retimed boolean"


def _follow(key: tuple, pieces: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    source, offset, retimed = state.get if state.exists else (None, None, False)
    rows = pd.concat(list(pieces)).sort_values("seq")
    offsets, flags = [], []
    for r in rows.itertuples(index=False):
        now = float(r.source_frame) - r.time
        if r.source != source:
            source, offset, retimed = r.source, None, False
        retimed = bool(retimed or offset is not None and abs(now - offset) > RETIMED)
        offset = now
        offsets.append(now)
        flags.append(retimed)
    state.update((source, offset, retimed))
    rows["offset"], rows["retimed"] = offsets, flags
    yield rows


def stream_ranges(renders: DataFrame) -> DataFrame:
    """`host_ranges` over a stream; an instance's renders are taken in ``seq`` order within each micro-batch."""
    rows = renders.select(
        F.col("instance").cast("string").alias("instance"), F.col("seq").cast("bigint").alias("seq"), F.col("time").cast("double").alias("time"), F.col("source_frame").cast("bigint").alias("source_frame"),
        F.col("source").cast("string").alias("source"), F.col("first").cast("double").alias("first"), F.col("last").cast("double").alias("last"))
    state = "source string, offset double, retimed boolean"
    return used(rows.groupBy("instance").applyInPandasWithState(_follow, STREAM, state, "append", GroupStateTimeout.NoTimeout))


def looked_up(at: np.ndarray, seconds: np.ndarray, last: float | None = None, until: float | None = None) -> tuple[np.ndarray, float | None, float | None]:
    """Which requests, in time order, need a new lookup: the first one, and each that comes after the last lookup expired.

    ``seconds`` is how long the lookup a request would make holds, infinite for
    one that found something. Also gives the last lookup and its expiry.
    """
    out = np.zeros(len(at), bool)
    for i, (t, hold) in enumerate(zip(at.tolist(), seconds.tolist())):
        if last is None or t > until:
            out[i], last, until = True, t, t + hold
    return out, last, until


def expiring_lookups(requests: DataFrame) -> DataFrame:
    """Requests (key, at, found) with ``again``: whether each makes a new lookup.

    ``found`` says what a lookup would give at that time; one that finds nothing
    holds for ``NOTHING_FOUND`` seconds. Equal times keep one order by ``found``.
    """
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("at", "ascending"), ("found", "descending")])
        hold = np.where(group.column("found").to_numpy(), np.inf, NOTHING_FOUND)
        return group.append_column("again", pa.array(looked_up(group.column("at").to_numpy(), hold)[0]))

    rows = requests.select(F.col("key").cast("string").alias("key"), F.col("at").cast("double").alias("at"), F.coalesce(F.col("found"), F.lit(False)).alias("found")).where("at IS NOT NULL")
    return rows.groupBy("key").applyInArrow(run, "key string, at double, found boolean, again boolean")
