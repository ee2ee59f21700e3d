"""Keyed state over event streams: held notes.

Rows are taken in the order of their sequence within a micro-batch. State is one small row per stream that holds a note; a
stream whose last note is released leaves none.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def held_notes(events: DataFrame) -> DataFrame:
    """(stream, seq, held) after each micro-batch of decoded events (stream, seq, kind, pitch): update mode."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pitches = set(state.get[0]) if state.exists else set()
        rows = pd.concat(list(frames)).sort_values("seq")
        for kind, pitch in zip(rows["kind"], rows["pitch"]):
            if kind == "on":
                pitches.add(int(pitch))
            elif kind == "off":
                pitches.discard(int(pitch))
        if pitches:
            state.update((sorted(pitches),))
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"stream": [key[0]], "seq": [int(rows["seq"].max())], "held": [sorted(pitches)]})

    return events.groupBy("stream").applyInPandasWithState(step, "stream long, seq long, held array<int>", "held array<int>", "update", GroupStateTimeout.NoTimeout)
