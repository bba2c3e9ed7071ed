"""Alignment of two tokenizers by the byte offsets at which both end a token.

Each Arrow batch of texts is one chunk and stays in Arrow: both encodings are flattened with the documents' indices as
parents, byte lengths are looked up and summed per document (a running sum minus the sum before the document), and an Acero
hash join on (document, end) gives the links. Table.group_by counts the chunk's id pairs; Spark merges these partial
counts, finds each B id's best partners, and sends every chunk the figures of its own pairs only, so what
a task holds is bounded by a chunk and no table of pairs is broadcast.
"""

from __future__ import annotations

import hashlib
import json
import os
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import BATCH_BOUNDS, stored

SHIFT = 20
FIGURES = "doc_id long, n_a long, n_b long, n_groups long, n_links long, "
CHUNK = f"chunk long, {FIGURES}groups_sha256 string, groups string, pairs array<long>, counts array<long>, summary boolean"
RESULT = f"{FIGURES}n_best long, count_sum long, groups_sha256 string, groups string"


class Vocabulary(NamedTuple):
    """An encoder and, by id, the bytes of its tokens."""

    encode: object
    token_bytes: pa.Array
    lengths: pa.Array
    decimals: pa.Array


def _vocabulary(encode, pieces: list[bytes]) -> Vocabulary:
    held = pa.array(pieces, pa.large_binary())
    return Vocabulary(encode, held, pc.cast(pc.binary_length(held), pa.int64()), pa.array([str(k) for k in range(len(pieces))], pa.large_string()))


def _byte_of() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies: itself, or one from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


@cache
def byte_level(path: str) -> Vocabulary:
    """A byte-level BPE file of the tokenizers library, special tokens being plain text.

    Where its merges are numbered in order, ids are ranks and the tiktoken library encodes alike in a fifth of the time;
    any other file is encoded by the tokenizers library itself.
    """
    with open(path, encoding="utf-8") as file:
        loaded = json.load(file)
    model, special = loaded["model"], {t["id"] for t in loaded["added_tokens"]}
    table = _byte_of()
    size = 1 + max(max(model["vocab"].values()), *special, 0)
    pieces = [b""] * size
    for token, k in model["vocab"].items():
        pieces[k] = token.encode() if k in special else bytes(table[c] for c in token)
    pair = lambda m: m.split(" ") if isinstance(m, str) else m
    ordered = all(model["vocab"].get("".join(pair(m))) == 256 + k for k, m in enumerate(model["merges"]))
    step = loaded.get("pre_tokenizer") or {}
    plain = step.get("type") == "ByteLevel" and step.get("use_regex") and not step.get("add_prefix_space") and not loaded.get("normalizer")
    if ordered and plain and not model.get("unk_token"):
        import public_tokenizers
        import tiktoken

        ranks = {p: k for k, p in enumerate(pieces) if k not in special}
        encoding = tiktoken.Encoding(os.path.basename(path), pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        return _vocabulary(lambda texts: [encoding.encode_ordinary(t) for t in texts], pieces)
    return _vocabulary(_library_encoder(path), pieces)


def _library_encoder(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return lambda texts: [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


@cache
def pieces(path: str) -> Vocabulary:
    """A sentencepiece model; U+2581 is a space, byte pieces are their byte."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    named = [model.id_to_piece(k) for k in range(model.get_piece_size())]
    held = [bytes([int(p[3:5], 16)]) if model.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(named)]
    return _vocabulary(lambda texts: model.encode(texts, num_threads=1), held)


def _lists(encoded: list[list[int]]) -> pa.LargeListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in encoded])]).astype(np.int64)
    flat = np.fromiter((t for x in encoded for t in x), np.int64, offsets[-1])
    return pa.LargeListArray.from_arrays(offsets, flat)


def _joined(ids: pa.LargeListArray, vocabulary: Vocabulary) -> pa.Array:
    """The bytes of each document's tokens."""
    parts = pa.LargeListArray.from_arrays(ids.offsets, pc.take(vocabulary.token_bytes, ids.values))
    return pc.binary_join(parts, pa.scalar(b"", pa.large_binary()))


def _ends(ids: pa.LargeListArray, vocabulary: Vocabulary) -> pa.Table:
    """(doc, end, at, id) of every token: the running sum of lengths, started anew with each document."""
    flat, doc = pc.list_flatten(ids), pc.list_parent_indices(ids)
    sums = pc.cumulative_sum(pc.take(vocabulary.lengths, flat))
    before = pc.take(pa.concat_arrays([pa.array([0], pa.int64()), sums]), ids.offsets)
    end = pc.subtract(sums, pc.take(before, doc))
    return pa.table({"doc": doc, "end": end, "at": pa.array(np.arange(len(flat))), "id": flat})


def _strings(flat: pa.Array, offsets: np.ndarray, vocabulary: Vocabulary) -> pa.Array:
    return pc.binary_join(pa.LargeListArray.from_arrays(offsets, pc.take(vocabulary.decimals, flat)), pa.scalar(",", pa.large_string()))


def align(texts: list[str], a: Vocabulary, b: Vocabulary) -> tuple[dict[str, np.ndarray], list[bytes], pa.Table]:
    """Figures of each text, its groups as ids ("a1,a2|b1;a3|b2"), and (doc, pair, count) of its links.

    A text without tokens (empty, or bytes that either side does not give back) has zeros and no groups.
    """
    spaced = [" " + t for t in texts]
    ids_a, ids_b = _lists(a.encode(spaced)), _lists(b.encode(texts))
    wanted = pa.array([s.encode() for s in spaced], pa.large_binary())
    whole = pc.and_(pc.equal(_joined(ids_a, a), wanted), pc.equal(_joined(ids_b, b), wanted)).to_numpy(zero_copy_only=False)
    whole &= np.array([bool(t) for t in texts], bool)
    kept = pa.array(np.flatnonzero(whole))
    ids_a, ids_b = pc.take(ids_a, kept), pc.take(ids_b, kept)
    left, right = _ends(ids_a, a), _ends(ids_b, b)
    links = left.join(right, ["doc", "end"], right_suffix="_b", join_type="inner", use_threads=False)
    links = links.append_column("pair", pc.add(pc.shift_left(links["id"], pa.scalar(SHIFT, pa.int64())), links["id_b"])).combine_chunks()
    per_doc = links.select(["doc", "pair"]).group_by(["doc", "pair"], use_threads=False).aggregate([([], "count_all")])
    order = np.lexsort((links["at_b"].to_numpy(), links["at"].to_numpy()))
    last_a, last_b = links["at"].to_numpy()[order], links["at_b"].to_numpy()[order]
    cut = np.append(last_a[1:] != last_a[:-1], True) if len(last_a) else np.zeros(0, bool)
    cuts_a, cuts_b = np.append(0, last_a[cut] + 1), np.append(0, last_b[cut] + 1)
    pairs = pc.binary_join_element_wise(_strings(ids_a.values, cuts_a, a), _strings(ids_b.values, cuts_b, b), pa.scalar("|", pa.large_string()))
    docs = links["doc"].to_numpy()
    n_groups = np.bincount(docs[order][cut], minlength=len(kept))
    lines = pc.binary_join(pa.LargeListArray.from_arrays(np.append(0, np.cumsum(n_groups)), pairs), pa.scalar(";", pa.large_string()))
    figures = {"n_a": np.diff(ids_a.offsets), "n_b": np.diff(ids_b.offsets), "n_groups": n_groups, "n_links": np.bincount(docs, minlength=len(kept))}
    out = {name: np.zeros(len(texts), np.int64) for name in figures}
    for name, found in figures.items():
        out[name][whole] = found
    groups = [b""] * len(texts)
    for at, line in zip(kept.to_pylist(), lines):
        groups[at] = line.as_buffer().to_pybytes()
    return out, groups, per_doc.set_column(0, "doc", pc.take(kept, per_doc["doc"]))


def _pair_lists(found: pa.Table, size: int) -> tuple[pa.Array, pa.Array]:
    """The pairs and counts of each document, as lists."""
    found = found.sort_by([("doc", "ascending"), ("pair", "ascending")]).combine_chunks()
    offsets = np.searchsorted(found["doc"].to_numpy(), np.arange(size + 1)).astype(np.int32)
    make = lambda name: pa.ListArray.from_arrays(offsets, found[name].chunk(0) if found[name].num_chunks else pa.array([], pa.int64()))
    return make("pair"), make("count_all")


def _schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(ddl), prefers_large_types=False)


def _encode_pass(path_a: str, path_b: str, schema: pa.Schema, with_groups: bool):
    def run(batches):
        from pyspark import TaskContext

        pa.set_cpu_count(1)
        a, b = byte_level(path_a), pieces(path_b)
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = [t or "" for t in batch.column(1).to_pylist()]
            figures, groups, found = align(texts, a, b)
            pairs, counts = _pair_lists(found, len(texts))
            own = found.select(["pair", "count_all"]).group_by(["pair"], use_threads=False).aggregate([("count_all", "sum")])
            docs = {"chunk": [chunk] * len(texts), "doc_id": batch.column(0), **figures, "groups_sha256": [hashlib.sha256(g).hexdigest() if g else "" for g in groups], "groups": [g.decode() if with_groups else None for g in groups], "pairs": pairs, "counts": counts, "summary": [False] * len(texts)}
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) if not isinstance(v, pa.Array) else v.cast(f.type) for v, f in zip(docs.values(), schema)], schema=schema)
            whole = [[chunk], [None], [0], [0], [0], [0], [""], [None], [own["pair"].to_pylist()], [own["count_all_sum"].to_pylist()], [True]]
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(whole, schema)], schema=schema)
            chunk += 1

    return run


def _score_pass(schema: pa.Schema):
    """Looks every document's pairs up among the figures of its chunk."""

    def run(docs: pa.Table, held: pa.Table) -> pa.Table:
        order = np.argsort(held["pair"].to_numpy(), kind="stable")
        pair, total, best = (held[c].to_numpy()[order] for c in ("pair", "total", "best"))
        lists = docs["pairs"].combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        counts = pc.list_flatten(docs["counts"]).to_numpy()
        parent = pc.list_parent_indices(lists).to_numpy()
        at = np.searchsorted(pair, pc.list_flatten(lists).to_numpy())
        sums = np.zeros((2, docs.num_rows), np.int64)
        if len(at):
            np.add.at(sums[0], parent, counts * best[at])
            np.add.at(sums[1], parent, counts * total[at])
        columns = {"n_best": pa.array(sums[0]), "count_sum": pa.array(sums[1])}
        return pa.table([columns[f.name] if f.name in columns else docs[f.name] for f in schema], schema=schema)

    return run


def in_arrow_batches(frame: DataFrame, function, schema: str) -> DataFrame:
    """mapInArrow in batches small enough for whole texts, as common.in_batches does for pandas."""
    conf = frame.sparkSession.conf
    for key, most in BATCH_BOUNDS.items():
        if conf.get(key, None) is None:
            conf.set(key, str(most))
    return frame.mapInArrow(function, schema)


def pair_counts(chunks: DataFrame) -> DataFrame:
    """(pair, total, best) over all chunks; best is 1 where no other A id is linked more often to the B id."""
    rows = chunks.where("summary").select(F.explode(F.arrays_zip("pairs", "counts")).alias("x"))
    totals = rows.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.counts").alias("total"))
    by_b = F.col("pair").bitwiseAND(F.lit((1 << SHIFT) - 1)).alias("b")
    highest = totals.groupBy(by_b).agg(F.max("total").alias("highest"))
    joined = totals.join(highest, totals["pair"].bitwiseAND(F.lit((1 << SHIFT) - 1)) == highest["b"])
    return joined.select("pair", "total", (F.col("total") == F.col("highest")).cast("long").alias("best"))


def aligned_chunks(spark: SparkSession, docs: DataFrame, path_a: str, path_b: str, with_groups: bool = False) -> DataFrame:
    """The written table of aligned documents and of each chunk's pair counts (rows with summary)."""
    columns = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return stored(spark, in_arrow_batches(columns, _encode_pass(path_a, path_b, _schema(spark, CHUNK), with_groups), CHUNK), "aligned")


def alignment(spark: SparkSession, docs: DataFrame, path_a: str, path_b: str, with_groups: bool = False) -> DataFrame:
    """The figures of every row of docs, and on request its groups of ids.

    Null and empty texts, and texts that either tokenizer does not give back byte for byte, have zeros and an empty
    hash and no groups. Repeated rows and rows that share an id are rows and links of their own; pairs that tie for the highest count are
    all best; an empty table gives no rows; texts are encoded whole, a very long one being a chunk by itself. Other columns
    of docs are ignored, whatever their names.
    """
    chunks = aligned_chunks(spark, docs, path_a, path_b, with_groups)
    verdicts = stored(spark, pair_counts(chunks), "pair-counts")
    back = chunks.where("summary").select(F.col("chunk").alias("of"), F.explode("pairs").alias("pair")).join(verdicts, "pair")
    rows = chunks.where("NOT summary")
    return rows.groupBy("chunk").cogroup(back.groupBy("of")).applyInArrow(_score_pass(_schema(spark, RESULT)), RESULT)
