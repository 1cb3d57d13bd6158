"""Events from a stream of hits: each is closed by the watermark and handed to track finding."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from trackframe.operators.reconstruct import Detector, found_tracks


def closed_events(hits: DataFrame, gap: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Hits (event_id, det_id, ts) as a stream -> (event_id, opened, closed, dets, late).

    An event is over when the watermark, ``late`` behind the latest hit, has
    passed its last hit by ``gap``; until then its fired nodes are state, kept
    by event, and then it is one row with ``late`` 0.  Hits behind the
    watermark are left out; each batch tells their number by event in a row
    without nodes.  Hits without an event, a node or a time belong to none.
    """
    own = hits.filter("event_id IS NOT NULL AND det_id IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", late)
    wait = int(pd.Timedelta(gap).total_seconds() * 1000)

    def row(event: int, first: int | None, last: int | None, dets: list[int] | None, n: int) -> pd.DataFrame:
        opened, closed = (pd.Series([x], dtype="datetime64[ms]") if x is None else pd.to_datetime(pd.Series([x]), unit="ms") for x in (first, last))
        return pd.DataFrame({"event_id": [event], "opened": opened, "closed": closed, "dets": [dets], "late": [n]})

    def collect(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        watermark, behind = state.getCurrentWatermarkMs(), 0
        dets, first, last = state.getOption or ([], None, None)
        found = set(dets)
        for part in parts:
            at = part["ts"].astype("datetime64[ms]").astype("int64")
            fresh = at >= watermark
            behind += int((~fresh).sum())
            if fresh.any():
                found.update(part["det_id"][fresh].tolist())
                first = int(at[fresh].min()) if first is None else min(first, int(at[fresh].min()))
                last = int(at[fresh].max()) if last is None else max(last, int(at[fresh].max()))
        if behind:
            yield row(key[0], None, None, None, behind)
        if last is None:
            return
        if state.hasTimedOut or last + wait <= watermark:
            if state.exists:
                state.remove()
            yield row(key[0], first, last, sorted(found), 0)
        else:
            state.update((sorted(found), first, last))
            state.setTimeoutTimestamp(last + wait)

    grouped = own.select("event_id", "det_id", "ts").groupBy("event_id")
    out = "event_id long, opened timestamp, closed timestamp, dets array<long>, late long"
    return grouped.applyInPandasWithState(collect, out, "dets array<long>, first long, last long", "append", GroupStateTimeout.EventTimeTimeout)


def find_tracks(hits: DataFrame, d: Detector, path: str, checkpoint: str, gap: str = "1 minute", late: str = "10 minutes", least_tubes: int = 5) -> StreamingQuery:
    """Writes the members of tracks of closed events, and the numbers of late hits, as Parquet under ``path``/tracks and ``path``/late; ends when all that is there is read.

    Every batch of closed events goes through the same steps as a table of
    hits does, and has folders of its own, which are written anew if the batch
    is repeated after a failure.
    """

    def find(events: DataFrame, batch: int) -> None:
        events.persist()
        active = events.filter("dets IS NOT NULL").select("event_id", F.explode("dets").alias("det_id"))
        found_tracks(active, d, least_tubes).write.mode("overwrite").parquet(f"{path}/tracks/batch={batch}")
        events.filter("late > 0").select("event_id", "late").write.mode("overwrite").parquet(f"{path}/late/batch={batch}")
        events.unpersist()

    return closed_events(hits, gap, late).writeStream.foreachBatch(find).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
