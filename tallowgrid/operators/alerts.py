"""Alert tables: thousands of literal patterns looked for in one pass over each text."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallowgrid.operators.ranks import global_row_number
from tallowgrid.session import settle

#: Patterns of an automaton: what a worker holds at once. More patterns are looked for in further passes.
BLOCK = 50_000
#: Findings that a worker holds before it gives them out.
PAIRS = 20_000


def find_patterns(texts: DataFrame, keys: list[str], text: str, patterns: DataFrame, pattern: str, block: int = BLOCK) -> DataFrame:
    """keys, pattern for every pattern that a text holds, once each; null texts hold none, empty patterns are none.

    Patterns are numbered in their order and cut into blocks of ``block``, so that each automaton has a bounded
    size however many patterns there are; a block is one pass over the texts. An automaton is built once a task.
    """
    known = patterns.select(F.col(pattern).alias("__p")).where(F.length("__p") > 0).distinct()
    numbered = settle(global_row_number(known, ["__p"], "__at").withColumn("__block", F.floor((F.col("__at") - 1) / block)), "patterns")
    blocks = [r[0] for r in numbered.select("__block").distinct().orderBy("__block").collect()]
    rows = texts.select(*keys, F.col(text).alias("__text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1])
    parts = []
    for b in blocks:
        words = [r["__p"] for r in numbered.where(F.col("__block") == b).collect()]  # ``block`` at most

        def run(batches, words=words):
            import ahocorasick

            machine = ahocorasick.Automaton()
            for w in words:
                machine.add_word(w, w)
            machine.make_automaton()
            for batch in batches:
                held, found = [], []

                def flush(batch=batch, held=held, found=found):
                    taken = batch.select(range(len(keys))).take(pa.array(held, pa.int64()))
                    out = pa.RecordBatch.from_arrays([*taken.columns, pa.array(found, pa.string())], names=[*keys, "pattern"])
                    held.clear()
                    found.clear()
                    return out

                for i, content in enumerate(batch.column(len(keys))):
                    own = sorted({w for _, w in machine.iter(content.as_py())}) if content.is_valid and len(content.as_py()) else []
                    for at in range(0, len(own), PAIRS):
                        held += [i] * len(own[at : at + PAIRS])
                        found += own[at : at + PAIRS]
                        if len(found) >= PAIRS:
                            yield flush()
                if found:
                    yield flush()

        parts.append(rows.mapInArrow(run, f"{kinds}, pattern string"))
    if not parts:
        return rows.select(*keys, F.lit("").alias("pattern")).limit(0)
    return reduce(DataFrame.unionByName, parts)
