"""Track building as blocks arrive.

A clip's blocks may come in any number of pieces and in any order: blocks wait
in the clip's state until every number before them has come, as a block or as
a row that says a frame has none, and are then taken in order, with the same
rule for missing samples as a finished clip. Where numbers stay missing, a
clip that is silent for a while takes what has waited. A block that comes after
its place was passed cannot be taken any more; rows count how many did.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "clip string, frame bigint, elapsed bigint, after bigint, gap bigint, broken boolean, skipped bigint"
STATE = (
    "number bigint, frame bigint, clock bigint, elapsed bigint, after bigint, started boolean, idle bigint, skipped bigint, "
    "w_number array<bigint>, w_frame array<bigint>, w_clock array<bigint>, w_n array<bigint>, w_lost array<bigint>")
CLOCK_SPAN = 1 << 32
#: A clip without a block for this long takes the blocks that wait.
SILENT_MS = 20_000
#: Silences after which a clip's state is given up; a clip that goes on within them continues its track.
MOST_IDLE = 90
NO_BLOCK = -1


def step(last: dict, block: tuple[int, int, int, int, int], rate: float) -> tuple[int, int, int, int, bool]:
    """(frame, elapsed, after, gap, broken) of the next block in order; ``last`` moves on to it."""
    number, frame, clock, n, lost = block
    gap, broken = 0, False
    if last["started"]:
        dt = (clock - last["clock"]) % CLOCK_SPAN
        extra = round(rate * dt / 1e6) - lost - n if rate > 0 else 0
        # The reported loss stops at 99; the clock tells the rest.
        more = extra > 50 or (lost >= 99 and extra > 0)
        gap, broken = lost + (extra if more else 0), extra > 50
        last["elapsed"] += dt
    last.update(frame=frame, clock=clock, started=True)
    last["after"] += gap + n
    return frame, last["elapsed"], last["after"], gap, broken


def advance(rate: float, first: int):
    """The state function of `tracks`."""
    columns = ["clip", "frame", "elapsed", "after", "gap", "broken", "skipped"]

    def run(key: tuple, pieces: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = {"number": first - 1, "frame": NO_BLOCK, "clock": 0, "elapsed": 0, "after": 0, "started": False, "idle": 0, "skipped": 0}
        waiting: dict[int, tuple[int, int, int, int, int]] = {}
        if state.exists:
            held = list(state.get)
            last = dict(zip(last, held[: len(last)]))
            waiting = {b[0]: tuple(int(v) for v in b) for b in zip(*held[len(last):])}
        out = []

        def take(number: int) -> None:
            block = waiting.pop(number)
            last["number"] = number
            if block[1] == NO_BLOCK:
                return
            # Frame counters rise within a take; a block with a lower one is no part of the track.
            if last["started"] and block[1] <= last["frame"]:
                last["skipped"] += 1
                return
            out.append((key[0], *step(last, block, rate), last["skipped"]))

        if state.hasTimedOut:
            last["idle"] += 1
            for number in sorted(waiting):
                take(number)
            if last["idle"] > MOST_IDLE:
                state.remove()
                yield pd.DataFrame(out, columns=columns)
                return
        else:
            last["idle"] = 0
            for piece in pieces:
                for r in piece.itertuples(index=False):
                    block = (int(r.number), int(r.frame), int(r.clock), int(r.n), int(r.lost))
                    if block[0] > last["number"]:
                        waiting.setdefault(block[0], block)
                    elif block[1] != NO_BLOCK:
                        last["skipped"] += 1
            while last["number"] + 1 in waiting:
                take(last["number"] + 1)
        rest = [waiting[k] for k in sorted(waiting)]
        state.update((*last.values(), *([b[k] for b in rest] for k in range(5))))
        state.setTimeoutDuration(SILENT_MS)
        yield pd.DataFrame(out, columns=columns)

    return run


def tracks(blocks: DataFrame, rate: float = 0.0, first: int = 0) -> DataFrame:
    """Streaming rows (clip, number, frame, clock, n, lost) to samples after each block and the unwrapped clock.

    ``number`` is the frame's place in the clip, counted from ``first``; without
    that column ``frame`` is taken for it. A frame without a block has a null
    ``n`` and gives no row. ``rate`` is the sample rate in Hz that tells
    missing samples from the clock; 0 leaves it at the reported loss.
    ``skipped`` counts the clip's blocks so far that came, or came again, after
    the track had passed their place.
    """
    number = F.col("number") if "number" in blocks.columns else F.col("frame")
    rows = blocks.select(
        F.col("clip").cast("string").alias("clip"), number.cast("bigint").alias("number"), F.when(F.col("n").isNull(), F.lit(NO_BLOCK)).otherwise(F.col("frame")).cast("bigint").alias("frame"),
        *[F.coalesce(F.col(c).cast("bigint"), F.lit(0)).alias(c) for c in ("clock", "n", "lost")]).where("number IS NOT NULL")
    return rows.groupBy("clip").applyInPandasWithState(advance(rate, first), OUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)
