"""Content-selected anchors: places of texts that other documents may share.

Every run of ``window`` words chooses the run of ``k`` words in it with the smallest hash.
Equal runs choose equal anchors, so an anchor that no other document holds proves that its
runs are found nowhere else, at the cost of a few records for a hundred words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlake.llm.text import gram_hashes, many_word_hashes, minimisers, pieces, signed
from cohortlake.session import materialise


def chosen(texts: list[str], k: int, window: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per text the hashes of its anchors, their places, and for each run of words its anchor."""
    out = []
    for words in many_word_hashes([t.encode("utf-8", "replace") for t in texts]):
        grams = gram_hashes(words, k)
        places, of_run = minimisers(grams, window - k + 1)
        out.append((signed(grams[places]), places, of_run))
    return out


def _records(source: DataFrame, k: int, window: int, placed: bool) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in pieces(batches, 512):
            found = chosen(list(part["text"]), k, window)
            if placed:
                yield pd.DataFrame({
                    "anchor": np.concatenate([f[0] for f in found]),
                    "id": np.repeat(part["id"].to_numpy(), [len(f[0]) for f in found]),
                    "text_key": np.repeat(part["text_key"].to_numpy(), [len(f[0]) for f in found]),
                    "place": np.concatenate([f[1] for f in found]).astype(np.int32)})
            else:
                # within one document an anchor counts once
                once = [np.unique(f[0]) for f in found]
                yield pd.DataFrame({"anchor": np.concatenate(once),
                                    "id": np.repeat(part["id"].to_numpy(), [len(f) for f in once])})

    return source.mapInPandas(run, "anchor long, id long" + (", text_key long, place int" if placed else ""))


def repeated(source: DataFrame, k: int, window: int) -> DataFrame:
    """``id``, ``text_key``, ``places`` and ``firsts``: anchors that two ids hold, and the smallest such id of each.

    ``source`` has ``id`` (not null) and ``text``; ``text_key`` is the hash of the text, as an
    id may stand on several. Counting is a partial aggregate, so a
    frequent anchor is one record of a task; the join back can be split at a frequent anchor.
    A list is as long as its document at most.
    """
    first = materialise(_records(source, k, window, False).groupBy("anchor").agg(
        F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last").select("anchor", "first"))
    met = _records(source.withColumn("text_key", F.xxhash64("text")), k, window, True).join(first, "anchor")
    held = met.groupBy("id", "text_key").agg(F.collect_list(F.struct("place", "first")).alias("held"))
    return held.select("id", "text_key", F.col("held.place").alias("places"), F.col("held.first").alias("firsts"))
