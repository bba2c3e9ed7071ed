"""Hashes of documents too large to be built: each is a head, then slices of rows it shares with others.

The rows of a scope stream through a task in order, once for all documents there: a document's part of a batch is
one piece of the batch's own buffer, so nothing is unrolled, gathered or joined.  Held are a batch, and a hash and a
few numbers for each document of a block.  Only the hashing itself grows with the bytes of all documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Documents of one scope whose hashes are held in one task.
BLOCK = 20_000
NEVER, ALWAYS = 2**63 - 1, -(2**63)


class Section(NamedTuple):
    """A list of the document: its first ``most`` rows (all, if None) from the window's start, or from the very first row on."""

    name: str
    most: int | None
    from_first: bool = False


class _Block:
    """The documents of one block while the rows of their scope pass."""

    def __init__(self, sections: Sequence[Section]) -> None:
        self.sections, self.open = sections, 0
        self.ids, self.hashes = [], []
        self.since = self.until = self.size = np.zeros(0, dtype=np.int64)

    def add(self, rows: pa.RecordBatch) -> None:
        heads = [head.encode() for head in rows["entry"].to_pylist()]
        self.ids.append(rows["doc"])
        self.hashes += [hashlib.sha256(head) for head in heads]
        self.since, self.until = (np.concatenate([old, rows[c].to_numpy()]) for old, c in ((self.since, "since"), (self.until, "until")))
        self.size = np.concatenate([self.size, np.array([len(head) for head in heads], dtype=np.int64)])

    def _put(self, text: bytes) -> None:
        for one in self.hashes:
            one.update(text)
        self.size += len(text)

    def move_to(self, section: int) -> None:
        """Ends the open section and opens what follows up to ``section``, counted from 1."""
        while self.open < section:
            self.open += 1
            name, most, _ = self.sections[self.open - 1]
            self._put((b"]" if self.open > 1 else b"") + f',"{name}":['.encode())
            self.left = np.full(len(self.hashes), NEVER if most is None else most)
            self.bare = np.ones(len(self.hashes), dtype=bool)

    def feed(self, rows: pa.RecordBatch) -> None:
        """Rows of the open section, each a comma and its text."""
        texts, at = rows["entry"].cast(pa.string()), rows["at"].to_numpy()
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        view = memoryview(texts.buffers()[2])
        low = np.zeros(len(self.hashes), dtype=np.int64) if self.sections[self.open - 1].from_first else np.searchsorted(at, self.since, "left")
        held = np.clip(np.searchsorted(at, self.until, "right") - low, 0, self.left)
        some = np.flatnonzero(held)
        first, end = offsets[low[some]] + self.bare[some], offsets[low[some] + held[some]]
        for i, begin, stop in zip(some.tolist(), first.tolist(), end.tolist()):
            self.hashes[i].update(view[begin:stop])
        self.size[some] += end - first
        self.bare[some] = False
        self.left -= held

    def digests(self) -> pa.RecordBatch:
        self.move_to(len(self.sections))
        self._put(b"]}")
        return pa.RecordBatch.from_arrays(
            [pa.concat_arrays(self.ids), pa.array(self.size), pa.array([one.hexdigest() for one in self.hashes])], names=["doc", "bytes", "hash"]
        )


def _changes(batch: pa.RecordBatch, names: Sequence[str]) -> list[int]:
    """Where a value of these columns differs from the row before, and the first row."""
    if len(batch) < 2:
        return [0][: len(batch)]
    differ = [pc.not_equal(batch[c][1:], batch[c][:-1]).to_numpy(zero_copy_only=False) for c in names]
    return [0, *(np.flatnonzero(np.logical_or.reduce(differ)) + 1).tolist()]


def document_digests(documents: DataFrame, rows: DataFrame, sections: Sequence[Section], block: int = BLOCK) -> DataFrame:
    """(doc, bytes, hash): size and SHA-256 of ``head``, the sections and a closing brace, for each row of ``documents``.

    Documents: doc, scope, head (JSON without its closing brace), since, until.  Rows: scope, section (its name), at, id, entry
    (JSON).  A section holds the rows of its scope within [since, until], ordered by (at, id, entry); a null bound or scope holds none.
    """
    blocks = documents.groupBy("scope").agg(F.ceil(F.count("*") / block).cast("int").alias("_blocks"))
    number = F.coalesce(*[F.when(F.col("section") == s.name, k) for k, s in enumerate(sections, 1)])
    none = lambda frame, c: F.lit(None).cast(frame.schema[c].dataType).alias(c)
    asks = documents.join(blocks.withColumnRenamed("scope", "_scope"), F.col("scope").eqNullSafe(F.col("_scope"))).select(
        "scope", F.pmod(F.xxhash64("doc", "head", "since", "until"), F.col("_blocks")).cast("int").alias("block"), F.lit(0).alias("kind"),
        F.lit(0).cast("bigint").alias("at"), none(rows, "id"), F.col("head").alias("entry"), "doc",
        F.coalesce(F.unix_micros("since"), F.lit(NEVER)).alias("since"), F.coalesce(F.unix_micros("until"), F.lit(ALWAYS)).alias("until"),
    )
    facts = rows.where(F.col("at").isNotNull()).join(blocks, "scope").select(
        "scope", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("block"), number.alias("kind"), F.unix_micros("at").alias("at"), "id",
        F.concat(F.lit(","), "entry").alias("entry"), none(documents, "doc"), F.lit(0).cast("bigint").alias("since"), F.lit(0).cast("bigint").alias("until"),
    )
    stream = asks.unionByName(facts).repartition("scope", "block").sortWithinPartitions("scope", "block", "kind", "at", "id", "entry")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, None
        for batch in batches:
            places = _changes(batch, ["group", "kind"])
            for begin, end in zip(places, [*places[1:], len(batch)]):
                part = batch.slice(begin, end - begin)
                at, kind = part["group"][0].as_py(), part["kind"][0].as_py()
                if held is None or at != group:
                    if held is not None and held.hashes:
                        yield held.digests()
                    group, held = at, _Block(sections)
                if kind == 0:
                    held.add(part)
                elif held.hashes:  # no document may have fallen into a block
                    held.move_to(kind)
                    held.feed(part)
        if held is not None and held.hashes:
            yield held.digests()

    # A null scope makes a group as well; the JSON text of scope and block names it whatever their types.
    stream = stream.select(F.to_json(F.struct("scope", "block")).alias("group"), "kind", "at", "entry", "doc", "since", "until")
    return stream.mapInArrow(run, f"doc {documents.schema['doc'].dataType.simpleString()}, bytes BIGINT, hash STRING")
