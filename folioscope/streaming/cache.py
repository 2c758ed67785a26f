"""The answer cache as keyed state: each node keeps its own bounded list.

Lookups and stores alternate in question order, so whether a question hits
depends on what was stored before it. The state of a node is at most `capacity`
vectors and answers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from folioscope.constants import CACHE_CAPACITY, CACHE_SIMILARITY

OUTPUT = "node long, seq long, hit boolean, similarity double, answer string"
STATE = "vectors array<double>, answers array<string>"


def replay(stream: DataFrame, threshold: float = CACHE_SIMILARITY, capacity: int = CACHE_CAPACITY) -> DataFrame:
    """Serves `node, seq, answer, embedding` rows through one cache per node.

    `answer` is what the model would say; a hit returns the stored answer of the
    most similar earlier question instead and stores nothing.
    """

    def serve(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, answers = state.get if state.exists else ([], [])
        answers = list(answers)
        rows = pd.concat(list(batches)).sort_values("seq")
        width = len(rows["embedding"].iloc[0])
        vectors = list(np.asarray(held, dtype=float).reshape(-1, width))
        served = []
        for seq, answer, embedding in zip(rows["seq"], rows["answer"], rows["embedding"], strict=True):
            vector = np.asarray(embedding, dtype=float)
            similarity = np.round(np.stack(vectors) @ vector, 6) if vectors else np.zeros(0)
            best = int(similarity.argmax()) if vectors else -1
            score = float(similarity[best]) if vectors else 0.0
            hit = best >= 0 and score >= threshold
            served.append((key[0], seq, hit, score, answers[best] if hit else answer))
            if not hit:
                vectors.append(vector)
                answers.append(answer)
                vectors, answers = vectors[-capacity:], answers[-capacity:]
        state.update((np.concatenate(vectors).tolist() if vectors else [], answers))
        yield pd.DataFrame(served, columns=["node", "seq", "hit", "similarity", "answer"])

    return stream.groupBy("node").applyInPandasWithState(serve, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)
