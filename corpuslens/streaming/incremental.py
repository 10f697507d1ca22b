"""Streams: passages into the collection as they arrive, and dialogue sessions as keyed state."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import dialogue, vectors
from ..sources.store import Collection


def index_stream(chunks: DataFrame, collection: Collection, checkpoint: str, embed: Callable[[DataFrame], DataFrame] = vectors.hashed):
    """Every micro-batch: skip what is stored, embed the rest, append. A replayed batch writes nothing twice."""

    def batch(df: DataFrame, _: int) -> None:
        new = collection.pending(df)
        if not new.isEmpty():
            collection.upsert(new.join(embed(new), "chunk_id"))

    return chunks.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


SESSION = "sessao_id string, estado string, rodadas int, consulta string"


def sessions_stream(events: DataFrame, path: str, checkpoint: str):
    """Events (sessao_id, ordem, autor, texto, trechos) as they arrive: they are appended to a table by micro-batch, and sessions_now() folds it.

    Late events find their place by `ordem`; a replayed batch overwrites its own part, so nothing counts twice."""

    def batch(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/lote={number}")

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sessions_now(spark: SparkSession, path: str, rounds: int = 1, problematise: bool = True) -> DataFrame:
    """The state of every session whose events sessions_stream() has taken in."""
    return dialogue.sessions(spark.read.parquet(path).drop("lote"), rounds, problematise)


def live_sessions(events: DataFrame, rounds: int = 1, problematise: bool = True) -> DataFrame:
    """Keyed state on a stream: each micro-batch's events move their sessions on and give their new states. Within a batch events go by `ordem`."""

    def run(key: tuple[str], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else ("triagem", 0, "")
        for e in pd.concat(list(frames)).sort_values("ordem").itertuples():
            now = step(now, e.autor, e.texto, e.trechos, rounds, problematise)
        state.update(now)
        yield pd.DataFrame([(key[0], *now)], columns=["sessao_id", "estado", "rodadas", "consulta"])

    return events.groupBy("sessao_id").applyInPandasWithState(run, SESSION, "estado string, rodadas int, consulta string", "update", GroupStateTimeout.NoTimeout)


def step(now: tuple[str, int, str], author: str, text: str | None, passages: float | None, rounds: int, problematise: bool) -> tuple[str, int, str]:
    """dialogue.after() for one event outside of a plan; the tests hold the two equal."""
    state, done, query = now
    said = (text or "").strip()
    if author == "pessoa":
        if state == "triagem":
            return ("problematizacao" if problematise and not _factual(said) else "recuperacao", done, text or "")
        if state == "problematizacao":
            if not said or said.lower() in dialogue.ESCAPES:
                return "recuperacao", done, query
            return "recuperacao" if done >= rounds else state, done, f"{query}\n{said}"
        return now
    if state == "problematizacao":
        return (state, done + 1, query) if _asks(text or "") else ("recuperacao", done, query)
    if state == "recuperacao":
        return "resposta" if passages is not None and passages > 0 else "encerrada", done, query
    return ("encerrada", done, query) if state == "resposta" else now


def _factual(text: str) -> bool:
    t = text.lower()
    return not any(t.startswith(c) or f" {c}" in t for c in dialogue.PRODUCT_CUES) and t.startswith(dialogue.FACT_CUES)


def _asks(text: str) -> bool:
    """Whether a line is a question that dialogue.returned_questions() would return."""
    bare = (re.sub(r'^"+|"+$', "", re.sub(dialogue.MARKER, "", line).strip()).strip() for line in re.split(r"\r\n|\r|\n", text))
    return any("?" in x and 10 <= len(x) <= 300 for x in bare)
