"""Live text in segments, by keyed state (Structured Streaming).

Tokens of a key are taken in order of their start; one that begins a word begins with a blank or a line break. Open text of at
least ``least`` characters is closed at sentence punctuation, or where a word begins more than ``gap`` units after the end
before it; any open text above ``most`` characters is closed. A point after a digit waits for the next token: it
closes if that begins a word. What is open when the input ends is closed then.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GAP, LEAST, MOST = 900, 14, 220
#: The time of an end marker, which sorts after all tokens and closes what is open.
CLOSE = 2**62
MARKS = ".?!。！？"
Open = tuple[str, int, int, bool]


def fold(state: Open, tokens: Iterable[tuple[int, int, str]]) -> tuple[Open, list[tuple[int, str]]]:
    """(open text, end of its last token, number of the next segment, whether its last point is undecided) after tokens (start, end, text), and the segments closed."""
    text, last, n, undecided = state
    out: list[tuple[int, str]] = []

    def close() -> None:
        nonlocal text, n
        if text.strip():
            out.append((n, text.strip()))
            n += 1
        text = ""

    for start, end, token in tokens:
        if start == CLOSE:
            close()
            undecided = False
            continue
        word = token.startswith((" ", "\n"))
        if undecided and word:
            close()
        undecided = False
        if text and word and start - last > GAP and len(text.strip()) >= LEAST:
            close()
        text, last = text + token, end
        shown = text.strip()
        if shown and shown[-1] in MARKS and len(shown) >= LEAST:
            undecided = shown[-1] == "." and shown[-2].isdigit()
            if not undecided:
                close()
        elif len(shown) > MOST:
            close()
    return (text, last, n, undecided), out


def segment(stream: DataFrame) -> DataFrame:
    """key, n, text from a stream of key, start, end, token."""

    def run(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = tuple(state.get) if state.exists else ("", 0, 0, False)
        rows = sorted((int(a), int(z), t or "") for b in batches for a, z, t in zip(b["start"], b["end"], b["token"]))
        held, out = fold(held, rows)
        state.update(held)
        yield pd.DataFrame({"key": [key[0]] * len(out), "n": [n for n, _ in out], "text": [t for _, t in out]})

    return stream.groupBy("key").applyInPandasWithState(run, "key long, n long, text string", "text string, last long, n long, undecided boolean", "append", "NoTimeout")


def run_available(spark: SparkSession, path: str) -> DataFrame:
    """The closed segments of a conversations table, read as a stream until its end."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    folder = (named or tempfile.mkdtemp(prefix="spark-")).rstrip("/")
    run = f"{folder}/segments-{uuid.uuid4().hex}"
    schema = spark.read.parquet(path).schema
    # A stream reads a folder or a glob; this one matches the table's own name alone.
    source = spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")
    at = F.col("turn") * 1000
    tokens = source.select(F.col("conv_id").alias("key"), at.alias("start"), (at + F.least(F.char_length("text") * 50, F.lit(999))).alias("end"), F.concat(F.lit(" "), "text").alias("token"))
    # All that is there is one batch, so a key's markers come with its last tokens; those after the first close nothing.
    ends = source.select(F.col("conv_id").alias("key"), F.lit(CLOSE).cast("long").alias("start"), F.lit(CLOSE).cast("long").alias("end"), F.lit(None).cast("string").alias("token"))
    writer = segment(tokens.union(ends)).writeStream.format("parquet").option("path", f"{run}/out").option("checkpointLocation", f"{run}/state").trigger(availableNow=True)
    writer.start().awaitTermination()
    return spark.read.parquet(f"{run}/out")
