"""The stateless operators on a stream of turns or labelled records, and a capped dedup by state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import audit, conversation, tasks


def cleaned_turns(stream: DataFrame) -> DataFrame:
    """Normalised turns without noise, with the intent of client turns."""
    return conversation.clean_sms(stream).withColumn("intent", F.when(F.col("role") == "client", tasks.intent(F.col("text"))))


def gated(stream: DataFrame) -> DataFrame:
    """Labelled records with their reject reason."""
    return audit.audited(stream)


def capped(stream: DataFrame, key: str, cap: int = 3) -> DataFrame:
    """At most ``cap`` rows of every key, in order of arrival; one number of state a key."""

    def take(k: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        seen = state.get[0] if state.exists else 0
        for f in frames:
            part = f.head(max(0, cap - seen))
            seen += len(part)
            if len(part):
                yield part
        state.update((seen,))

    return stream.groupBy(key).applyInPandasWithState(take, stream.schema.simpleString()[7:-1].replace(":", " "), "seen long", "append", "NoTimeout")
