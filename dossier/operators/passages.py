"""Passages contained in texts, by automata over blocks of passages."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of passages that one automaton holds; more are taken in several blocks, each against all texts.
PASSAGE_BYTES = 1 << 24


def passages(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Pairs (doc_id, item_id) where the item's norm is contained in the document's body; docs has doc_id and body, items item_id and norm.

    Equal passages are looked for once.  Blocks of passages, of PASSAGE_BYTES on
    average, go to the tasks as automata that read each text once.  Null and
    empty passages are in no text.
    """
    kinds = items.where("norm <> ''").groupBy("norm").agg(F.min("item_id").alias("rep")).persist()
    blocks = max(1, -(-(kinds.agg(F.sum(F.octet_length("norm"))).first()[0] or 0) // PASSAGE_BYTES))
    found = None
    for block in range(blocks):
        some = kinds.where(F.pmod(F.xxhash64("norm"), F.lit(blocks)) == block).toArrow()
        known = docs.sparkSession.sparkContext.broadcast((some["norm"].to_pylist(), some["rep"].to_pylist()))

        def task(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for norm, rep in zip(*known.value):
                automaton.add_word(norm, rep)
            if not len(automaton):
                return
            automaton.make_automaton()
            for batch in batches:
                rows = [(doc, rep) for doc, body in zip(batch.column("doc_id").to_pylist(), batch.column("body").to_pylist()) if body for rep in {r for _, r in automaton.iter(body)}]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(2)], names=["doc_id", "rep"])

        hits = docs.select(F.col("doc_id").cast("bigint"), "body").mapInArrow(task, "doc_id bigint, rep bigint")
        found = hits if found is None else found.unionByName(hits)
    return found.join(items.join(kinds, "norm").select("rep", "item_id"), "rep").select("doc_id", "item_id")
