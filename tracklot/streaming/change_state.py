"""Change events as a stream: the table of listings' states, and the events that wait for their turn.

Events come in any order within the watermark's delay. A micro-batch sets its events aside and gives out all that the
watermark has now passed, so nothing older can follow, in order of time: they meet their listings' states in one window, with
the rules of ``operators.changes``. A run of a catalog comes as one event, its end; it is a miss for the listings that it does
not hold, and stays with the turn before it, so no listing is sent its misses: turns are what is written, and the 0 to 4
changes of each event are made of them where they are read. What is kept is one state per listing and the parts of batches
within one delay, which no run may outlast. An event moves once, when its turn comes; the same event sent again within the
delay counts once, and one that comes after the watermark has passed it is left out. No Python runs per listing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklot.operators.changes import STREAMED, changes_of_turns, held_of, resumed_turns
from tracklot.streaming.streams import run_available
from tracklot.streaming.tables import Appends, Clock


def changes_available(log: DataFrame, path: str, delay: str) -> DataFrame:
    """Change events that the watermark has released after all that is available now; later calls add those that follow.

    The log has the columns of ``STREAMED``; one without the last two has the misses themselves and no runs.
    """
    spark, whole = log.sparkSession, {"catalog_id": "bigint", "since": "timestamp"}
    waiting, turns, states, clock = Appends(spark, f"{path}/waiting"), Appends(spark, f"{path}/turns"), Appends(spark, f"{path}/states"), Clock(spark, f"{path}/clock", "at", delay)

    def each(batch: DataFrame, number: int) -> None:
        past = clock.before(number)[1]
        waiting.write(batch.withColumns({c: F.lit(None).cast(t) for c, t in whole.items() if c not in batch.columns}).select(*STREAMED).where(clock.after(past)), number)
        held, now = clock.tick(waiting.some([number]), number)
        ready = waiting.some([*held] or [number]).where(clock.after(past) & ~clock.after(now))
        before = [n for n in states.numbers() if n < number][-1:]
        kept_after = None if now is None else F.timestamp_micros(F.lit(now)) - F.expr(f"INTERVAL '{delay}'")
        turns.write(resumed_turns(ready, states.some(before) if before else None, kept_after), number)
        states.write(held_of(turns.some([number])), number)  # all listings, as a run may tell any of them
        states.keep([*before, number])
        waiting.keep([number, *held])

    run_available(log, each, "append", "", f"{path}/checkpoint")
    return changes_of_turns(turns.read())
