"""Lab events as streams: finished requests and layout-shift sessions with state by page, equal to what the batch operators give.

Events of a page are held until the watermark has passed them and are then taken in order, so within the watermark's delay their arrival does not matter.
State is what is open: a request leaves it when it ends, a session is four numbers."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "held string, kept string"


def _load(state: GroupState) -> tuple[list, dict]:
    held, kept = state.get if state.exists else ("[]", "{}")
    return json.loads(held), json.loads(kept)


def _ready(state: GroupState, held: list) -> list:
    """Takes out of held, whose entries begin with microseconds, what the watermark has passed, in order."""
    mark = state.getCurrentWatermarkMs()
    out = sorted(e for e in held if e[0] // 1000 <= mark)
    held[:] = [e for e in held if e[0] // 1000 > mark]
    return out


def _keep(state: GroupState, held: list, kept: dict, patience: int) -> None:
    """Holds what is left; what is open and hears nothing for `patience` milliseconds goes."""
    if not held and not kept:
        if state.exists:
            state.remove()
        return
    state.update((json.dumps(held), json.dumps(kept)))
    state.setTimeoutTimestamp(min((e[0] // 1000 for e in held), default=state.getCurrentWatermarkMs() + patience) + 1)


def _micros(times: pd.Series) -> list[int]:
    return times.astype("datetime64[us]").astype("int64").tolist()


def finished_requests(events: DataFrame, delay: str = "10 minutes", patience: int = 3_600_000) -> DataFrame:
    """page, request, url, type, bytes of requests that ended. events (a stream): page, request (long), at (timestamp), ended, url and type (of responses), bytes (of ends).

    An end takes the last response of its request before it that no earlier end took; ends without one go. Events of one request and time: responses come first. Events
    later than `delay` are dropped by the watermark; a response without an end is forgotten after `patience` milliseconds without any event of its page."""
    key = events.schema["page"].dataType.simpleString()

    def run(page: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, open_ = _load(state)
        if state.hasTimedOut and not held:
            open_ = {}
        for part in parts:
            none = part["bytes"].isna()
            held += [list(e) for e in zip(_micros(part["at"]), part["ended"].astype(int).tolist(), part["request"].tolist(), part["url"].fillna("").tolist(), part["type"].fillna("").tolist(), part["bytes"].where(~none, -1.0).astype(float).tolist())]
        out = []
        for _, ended, request, url, kind, size in _ready(state, held):
            if not ended:
                open_[str(request)] = [url, kind]
            elif (was := open_.pop(str(request), None)) is not None:
                out.append((page[0], request, *was, math.floor(size + 0.5) if size >= 0 else None))
        _keep(state, held, open_, patience)
        if out:
            yield pd.DataFrame(out, columns=["page", "request", "url", "type", "bytes"]).astype({"bytes": "Int64"})

    keyed = events.select("page", "request", "at", "ended", "url", "type", "bytes").withWatermark("at", delay).groupBy("page")
    return keyed.applyInPandasWithState(run, f"page {key}, request long, url string, type string, bytes long", STATE, "append", GroupStateTimeout.EventTimeTimeout)


def capped_sessions(shifts: DataFrame, gap: int, span: int, delay: str = "10 minutes", patience: int = 3_600_000) -> DataFrame:
    """page, worst each time that a page's largest session grows; the last row of a page is what the batch operator gives. shifts (a stream): page, at (timestamp), value.

    Sessions go on while each shift is less than `gap` milliseconds after the one before and less than `span` after the first."""
    key = shifts.schema["page"].dataType.simpleString()

    def run(page: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, s = _load(state)
        if state.hasTimedOut and not held:
            s = {}
        for part in parts:
            held += [list(e) for e in zip(_micros(part["at"]), part["value"].astype(float).tolist())]
        before = s.get("worst", 0.0)
        for at, value in _ready(state, held):
            on = bool(s) and at - s["last"] < gap * 1000 and at - s["first"] < span * 1000
            total = s["sum"] + value if on else value
            s = {"first": s["first"] if on else at, "last": at, "sum": total, "worst": max(s.get("worst", 0.0), total)}
        _keep(state, held, s, patience)
        if s.get("worst", 0.0) > before:
            yield pd.DataFrame({"page": [page[0]], "worst": [s["worst"]]})

    return shifts.select("page", "at", "value").withWatermark("at", delay).groupBy("page").applyInPandasWithState(run, f"page {key}, worst double", STATE, "update", GroupStateTimeout.EventTimeTimeout)
