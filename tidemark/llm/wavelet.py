"""Token ids in wavelet-matrix shards: one compressed file answers access, rank, select and counts.

A shard file is the little-endian bytes of: magic, version, token count, document count and plane count; the
documents' token counts; per plane the number of zeros and its packed bits; rank directories are rebuilt on reading
with one 64-bit popcount pass. The table of shards holds one file per row in a binary column, so that it can
be written to and read from any store that Spark reaches.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import in_batches, stored

MAGIC = b"TWM1"
END_ID = 1
SHARD_TOKENS = 1 << 19
HEAD = struct.Struct("<4sIQQI")
MARKS = ".,;:!?#$%&*)"
# Latin letters and the marks behind them, on a line of their own; other lines give two empty strings.
PLAIN = re.compile(rf"(?m)^(?:([A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+)([{MARKS}]*)|.*)$")


class WaveletMatrix:
    """Sequence of unsigned ids as bit planes, most significant first, zeros moved to the front at each plane."""

    def __init__(self, planes: list[np.ndarray], n: int, doc_lengths: np.ndarray):
        self.n, self.doc_lengths = n, doc_lengths
        self.words = planes
        self.ranks = []
        for words in planes:
            ones = np.bitwise_count(words).astype(np.int64)
            self.ranks.append(np.concatenate([[0], np.cumsum(ones)]))
        self.zeros = [n - int(r[-1]) for r in self.ranks]

    @classmethod
    def of(cls, ids: np.ndarray, doc_lengths: np.ndarray) -> WaveletMatrix:
        ids = np.asarray(ids, np.uint32)
        depth = max(1, int(ids.max()).bit_length()) if len(ids) else 1
        ids = ids.astype(np.uint16) if depth <= 16 else ids
        planes = []
        for k in range(depth - 1, -1, -1):
            bits = (ids & ids.dtype.type(1 << k)) != 0
            packed = np.packbits(np.pad(bits, (0, -len(bits) % 64)), bitorder="little")
            planes.append(packed.view(np.uint64))
            ids = np.concatenate([ids[~bits], ids[bits]])
        return cls(planes, len(ids), np.asarray(doc_lengths, np.int64))

    def to_bytes(self) -> bytes:
        head = HEAD.pack(MAGIC, 2, self.n, len(self.doc_lengths), len(self.words))
        body = self.doc_lengths.astype("<i8").tobytes() + b"".join(w.astype("<u8").tobytes() for w in self.words)
        return head + zstandard.ZstdCompressor(1).compress(body)

    @classmethod
    def from_bytes(cls, data: bytes) -> WaveletMatrix:
        magic, version, n, docs, depth = HEAD.unpack_from(data)
        if magic != MAGIC or version != 2:
            raise ValueError("not a wavelet-matrix shard")
        body = zstandard.ZstdDecompressor().decompress(data[HEAD.size :])
        lengths = np.frombuffer(body, "<i8", docs)
        size = (n + 63) // 64
        planes = [np.frombuffer(body, "<u8", size, docs * 8 + k * size * 8) for k in range(depth)]
        return cls(planes, n, lengths)

    def _ones(self, plane: int, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        padded = np.append(self.words[plane], np.uint64(0))
        part = padded[word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.ranks[plane][word] + np.bitwise_count(part)

    def access(self, at) -> np.ndarray:
        """Ids at positions."""
        at = np.atleast_1d(np.asarray(at, np.int64))
        out = np.zeros(len(at), np.uint32)
        for plane in range(len(self.words)):
            bit = ((self.words[plane][at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)
            ones = self._ones(plane, at)
            at = np.where(bit, self.zeros[plane] + ones, at - ones)
            out = (out << np.uint32(1)) | bit
        return out

    def all_ids(self) -> np.ndarray:
        """The whole sequence: each plane's stable partition is undone from the last plane up."""
        kind = np.uint16 if len(self.words) <= 16 else np.uint32
        ids = np.zeros(self.n, kind)
        for k, plane in enumerate(reversed(range(len(self.words)))):
            bits = np.unpackbits(self.words[plane].view(np.uint8), bitorder="little")[: self.n].view(bool)
            back = np.empty(self.n, kind)
            back[~bits] = ids[: self.zeros[plane]]
            back[bits] = ids[self.zeros[plane] :] | kind(1 << k)
            ids = back
        return ids.astype(np.uint32)

    def _interval(self, token: int, start: int, stop: int) -> tuple[int, int, list[tuple[bool, int]]]:
        depth = len(self.words)
        if token >> depth:
            return 0, 0, []
        span, path = np.array([start, stop]), []
        for plane in range(depth):
            bit = bool((token >> (depth - 1 - plane)) & 1)
            ones = self._ones(plane, span)
            span = self.zeros[plane] + ones if bit else span - ones
            path.append((bit, plane))
        return int(span[0]), int(span[1]), path

    def count(self, token: int, start: int = 0, stop: int | None = None) -> int:
        """Occurrences of a token in [start, stop)."""
        a, b, _ = self._interval(token, start, self.n if stop is None else stop)
        return b - a

    def select(self, token: int, k: int) -> int:
        """Position of the k-th occurrence (from 0); -1 if there are fewer."""
        a, b, path = self._interval(token, 0, self.n)
        if k < 0 or a + k >= b:
            return -1
        at = a + k
        for bit, plane in reversed(path):
            at = self._find(plane, at - self.zeros[plane] if bit else at, bit)
        return at

    def _find(self, plane: int, k: int, bit: bool) -> int:
        ranks = self.ranks[plane]
        if not bit:
            ranks = np.arange(len(ranks)) * 64 - ranks
        word = int(np.searchsorted(ranks, k, side="right")) - 1
        bits = np.unpackbits(self.words[plane][word : word + 1].view(np.uint8), bitorder="little")
        return word * 64 + int(np.flatnonzero(bits == bit)[k - int(ranks[word])])


class PieceEncoder:
    """Ids of texts, each piece between spaces, tabs and line breaks encoded once while it is remembered.

    Where the tokenizer drops white space and never looks across it, a text's ids are its pieces' ids in a row. New pieces are
    encoded many at a time: those of Latin letters, with marks behind them or without, are told apart by the last tokens of
    words, where the model marks these; between others stands a special token that none of them holds. Where the tokenizer
    ignores case and cuts marks off, such a piece is put together from its letters in lower case and its marks, each a piece
    itself. Any other tokenizer encodes whole texts.
    """

    PIECES = 1_200_000
    # Texts whose pieces are looked up together, each different one once.
    TEXTS = 1024

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # Ids as bytes: a text's ids are then one join of them.
        self.known: dict[str, bytes] = {}
        special = [(t.content, k) for k, t in self.tokenizer.get_added_tokens_decoder().items() if t.special and t.content.startswith("<")]
        self.mark = special[-1] if special else None
        self.by_piece = self.mark is not None and self._drops_blanks()
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        vocabulary = self.tokenizer.get_vocab() if suffix else {}
        self.last = np.zeros(max(vocabulary.values(), default=-1) + 1, bool)
        self.last[[k for token, k in vocabulary.items() if token.endswith(suffix)]] = True
        probe = ("ab", "Ab", "ab.", "ab?!#", "\u00c9t\u00e9", "\u00e9.,", "a", "aBaB*)")
        if len(self.last) and any(self.last[ids].sum() != self._words(p) for p, ids in zip(probe, self.plain(list(probe)))):
            self.last = self.last[:0]
        parts = (("Ab", "."), ("ABC", "?!#"), ("\u00c9T\u00c9", ".,"), ("aBaB", "*)"), ("\u0141\u00f3D\u0179", ";:"), ("tHe", ""), ("I", "$%&"))
        plain_names = all("<" in t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.folds = plain_names and all(self.plain([a + b])[0] == sum(self.plain([a.lower(), b]), []) for a, b in parts)

    def _drops_blanks(self) -> bool:
        probe = ("a b", "A, b's <|x|> 12", "é e\u0301 ß", "…a -- b")
        whole = [self.plain([t, " ".join(reversed(t.split(" ")))]) for t in probe]
        parts = [[sum((self.plain([p])[0] for p in ps), []) for ps in (t.split(" "), t.split(" ")[::-1])] for t in probe]
        return whole == parts and self.plain(["a b"]) == self.plain([" a  \t\n\r b "])

    def plain(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    @staticmethod
    def _words(piece: str) -> int:
        """Words of a piece where that is plain: Latin letters (1), or those and marks behind them (2); otherwise 0."""
        core = piece.rstrip(MARKS)
        if core.isalpha() and (core.isascii() or (max(core) < "\u0250" and "\u0130" not in core)):
            return 1 if len(core) == len(piece) else 2
        return 0

    def _learn_words(self, words: list[str], counts: list[int]) -> list[str]:
        """Learn pieces of known numbers of words; returns those whose tokens do not tell where words end."""
        unclear = []
        parts = [words[a : a + 512] for a in range(0, len(words), 512)]
        for k, (part, ids) in enumerate(zip(parts, self.plain([" ".join(p) for p in parts]))):
            found, upto = np.array(ids, "<u4"), np.cumsum(counts[k * 512 : k * 512 + 512])
            ends, data = np.flatnonzero(self.last[found]) + 1, found.tobytes()
            if len(ends) == upto[-1] and ends[-1] == len(found):
                cuts = (ends[upto - 1] * 4).tolist()
                self.known.update((word, data[i:j]) for word, i, j in zip(part, [0, *cuts], cuts))
            else:
                unclear += part
        return unclear

    def _learn(self, pieces: list[str]) -> None:
        if not self.folds:
            return self._learn_apart(pieces)
        parts = PLAIN.findall("\n".join(pieces))
        forms = [(p, core, marks) for p, (core, marks) in zip(pieces, parts) if core]
        cores = "\n".join(core for _, core, _ in forms).lower().split("\n") if forms else []
        known = self.known
        others = {p for p, (core, _) in zip(pieces, parts) if not core}.union(marks for _, _, marks in forms)
        self._learn_apart(list(others.difference(known)), list(set(cores).difference(known)))
        known.update((p, known[core] + known[marks]) for (p, _, marks), core in zip(forms, cores))

    def _learn_apart(self, pieces: list[str], words: list[str] | None = None) -> None:
        """Learn pieces from texts made of many; the second list holds those of letters alone."""
        words = words or []
        mark, number = self.mark
        if len(self.last):
            counts = [self._words(p) for p in pieces]
            unclear = self._learn_words([p for p, n in zip(pieces, counts) if n] + words, [n for n in counts if n] + [1] * len(words))
            pieces = [p for p, n in zip(pieces, counts) if not n] + unclear
        else:
            pieces = pieces + words
        alone = [p for p in pieces if "<" in p]
        self.known.update((p, np.array(ids, "<u4").tobytes()) for p, ids in zip(alone, self.plain(alone)))
        rest = [p for p in pieces if "<" not in p]
        parts = [rest[a : a + 512] for a in range(0, len(rest), 512)]
        for part, ids in zip(parts, self.plain([f" {mark} ".join(p) for p in parts])):
            found = np.array([*ids, number], "<u4")
            cuts, data = (np.flatnonzero(found == number) * 4).tolist(), found.tobytes()
            self.known.update((piece, data[i + 4 : j]) for piece, i, j in zip(part, [-4, *cuts], cuts))

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        if not self.by_piece:
            return [np.array(ids, np.uint32) for ids in self.plain(texts)]
        return [ids for a in range(0, len(texts), self.TEXTS) for ids in self._joined(texts[a : a + self.TEXTS])]

    def _joined(self, texts: list[str]) -> list[np.ndarray]:
        blanks = pa.array(texts, pa.large_string())
        for blank in "\t\n\r":
            blanks = pc.replace_substring(blanks, blank, " ")
        split = pc.split_pattern(blanks, " ")
        coded = split.flatten().dictionary_encode()
        pieces, which = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        if len(self.known) > self.PIECES:
            self.known.clear()
        self.known[""] = b""
        found = list(map(self.known.get, pieces))
        gaps = [k for k, ids in enumerate(found) if ids is None]
        self._learn([pieces[k] for k in gaps])
        for k in gaps:
            found[k] = self.known[pieces[k]]
        sizes, data = np.fromiter(map(len, found), np.int64, len(found)) // 4, np.frombuffer(b"".join(found), "<u4")
        # Each place takes its piece's ids: from where they start in data, moved to where the place starts in the result.
        lengths = sizes[which]
        ends = np.append(0, np.cumsum(lengths))
        ids = data[np.repeat((np.cumsum(sizes) - sizes)[which] - ends[:-1], lengths) + np.arange(ends[-1])]
        cuts = ends[split.offsets.to_numpy()].tolist()
        return [ids[i:j] for i, j in zip(cuts, cuts[1:])]


@cache
def _encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


def write_shards(spark: SparkSession, docs: DataFrame, tokenizer_path: str, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Table (part, seq, n_tokens, doc_ids, payload) of shard files in ascending doc_id order.

    Texts are encoded whole; null texts are empty documents with the end id alone. Null ids come first, equal ids in
    order of their texts. A shard closes after the document that reaches shard_tokens; other columns are ignored.
    """

    def shards(frames):
        from pyspark import TaskContext

        encode = _encoder(tokenizer_path)
        part, seq, ids, names, lengths, held = TaskContext.get().partitionId(), 0, [], [], [], 0

        def close():
            payload = WaveletMatrix.of(np.concatenate(ids), np.array(lengths)).to_bytes()
            return pd.DataFrame({"part": [part], "seq": [seq], "n_tokens": [held], "doc_ids": [list(names)], "payload": [payload]})

        for frame in frames:
            texts, doc_ids = frame["text"].fillna("").tolist(), frame["doc_id"].tolist()
            for a in range(0, len(texts), encode.TEXTS):
                for doc_id, found in zip(doc_ids[a : a + encode.TEXTS], encode(texts[a : a + encode.TEXTS])):
                    found = np.append(found, np.uint32(END_ID))
                    ids.append(found)
                    names.append(None if pd.isna(doc_id) else int(doc_id))
                    lengths.append(len(found))
                    held += len(found)
                    if held >= shard_tokens:
                        yield close()
                        seq, ids, names, lengths, held = seq + 1, [], [], [], 0
        if ids:
            yield close()

    columns = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    ordered = columns.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    made = in_batches(ordered, shards, "part long, seq long, n_tokens long, doc_ids array<long>, payload binary")
    return stored(spark, made, "token-shards")


def read_shards(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # One row per range partition of the writer, however many documents there are.
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))
    within = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_tokens")
    index = shards.select("part", "seq", within.alias("shard_start")).join(parts, "part")
    index = index.select("part", "seq", (F.col("part_start") + F.col("shard_start")).alias("base"))

    def documents(frames):
        for frame in frames:
            for base, doc_ids, payload in zip(frame["base"], frame["doc_ids"], frame["payload"]):
                matrix = WaveletMatrix.from_bytes(payload)
                ids, ends = matrix.all_ids().astype("<u4"), np.cumsum(matrix.doc_lengths)
                starts = ends - matrix.doc_lengths
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, ends)]
                yield pd.DataFrame(
                    {"doc_id": pd.array([None if pd.isna(x) else int(x) for x in doc_ids], "Int64"), "start": base + starts, "n_tokens": matrix.doc_lengths, "ids_crc32": crc}
                )

    joined = shards.select("part", "seq", "doc_ids", "payload").join(index, ["part", "seq"])
    return in_batches(joined.select("base", "doc_ids", "payload"), documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_documents(spark: SparkSession, docs: DataFrame, tokenizer_path: str, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Write the shard files and return what is read back from them; an empty table gives no rows."""
    return read_shards(write_shards(spark, docs, tokenizer_path, shard_tokens))
