"""Broadcast bitmaps of sets of keys, sized by their count."""

from __future__ import annotations

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame

from .sketches import PART, Parts, share
from .textarrays import mix

#: Largest bitmap, as a power of two: 64 MB. A bitmap gets 16 bits a key up to that, and lets more through beyond it.
LOG_MOST = 29


def bitmap(keys: DataFrame) -> Broadcast:
    """A bitmap of the keys (one long column). It never denies a key that it was made of."""
    log_cells = min(max(10, (16 * max(1, keys.count())).bit_length()), LOG_MOST)

    def parts(batches):
        held = Parts(1, log_cells)
        for batch in batches:
            key = mix(batch.column(0).to_numpy().view(np.uint64))
            yield from held.add(key, key)
        yield from held.flush()

    return share(keys.mapInArrow(parts, PART), 1, log_cells, "seen")


def may_hold(shared: Broadcast, keys: np.ndarray) -> np.ndarray:
    key = mix(keys.view(np.uint64))
    return shared.value.may_hold(key, key)
