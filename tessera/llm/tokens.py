"""Token ids in ORC files.

Documents are range-partitioned and sorted by id, encoded, and written as ORC: integer
run-length encoding for the ids, row indexes, and Bloom filters on ``doc_id``, so that
stripes are read in parallel and a search for a few documents skips the rest by metadata.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch_path, text_key

END_ID = 2
ORC_OPTIONS = {
    "compression": "lz4",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.create.index": "true",
    "orc.row.index.stride": "1000",
    "orc.stripe.size": str(32 << 20),
}
#: Encoded units that a Python worker remembers, in each of two generations.
MEMO = 200_000
#: Documents that are encoded together at most, and UTF-8 bytes unless one text is longer.
BATCH, BATCH_BYTES = 3072, 4 << 20

# A single space between two non-spaces starts a token of its own, whatever surrounds it.
_UNIT = re.compile(r"(?<=\S) (?=\S)")
_SPACES = [c for c in map(chr, range(0x3001)) if c.isspace() and c != " "]
_PUNCTUATION = ".,;:!?"


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write printable bytes as themselves and the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(0x100 + n) for n, b in enumerate(others)}


_LETTERS = _byte_letters()


# Marks of units: rest of a word from its comma or full stop on, line break, word at the start of a line,
# start of a text, end of a text, and a whole text; and what separates units.
_STOP, _BREAK, _FIRST, _HEAD, _END, _WHOLE, _NEXT = map(chr, range(1, 8))
_MARKS = (_STOP, _BREAK, _FIRST, _HEAD, _END, _WHOLE, _NEXT)
_CLASH = re.compile(r"[,.](?<![^\W_][,.])")


def units(text: str) -> str:
    """A text with ``_NEXT`` where no token can lie across: for single spaces between non-spaces, which all units but the first lose.

    Where that is safe, commas and full stops after letters and digits, and single line breaks, start units too.
    """
    spaces = [c for c in _SPACES if c in text]
    if text[:1] == " " or text[-1:] == " " or "  " in text or any(f" {c}" in text or f"{c} " in text for c in spaces):
        return _NEXT.join(_UNIT.split(text))
    text = text.replace(" ", _NEXT)
    if not _CLASH.search(text):
        text = text.replace(",", f"{_NEXT}{_STOP},").replace(".", f"{_NEXT}{_STOP}.")
        if spaces == ["\n"] and not ("\n\n" in text or text[:1] == "\n" or text[-1:] == "\n"):
            text = text.replace("\n", f"{_NEXT}{_BREAK}{_NEXT}{_FIRST}")
    return text


class _Memo(dict):
    """Ids by unit; what is missing comes from the generation before, or else is made."""

    def __init__(self, make: Callable[[str], bytes], older: dict[str, bytes]):
        self.make, self.older = make, older

    def __missing__(self, unit: str) -> bytes:
        ids = self.older.get(unit)
        if ids is None:
            ids = self.make(unit)
        self[unit] = ids
        return ids


class Encoder:
    """Encodes texts with a byte-level ``tokenizers`` file, and remembers the ids of what lies between spaces.

    Byte-level pre-tokenization never joins text across a single space between two
    non-spaces, nor from letters to punctuation, nor over the ends of a line break between non-spaces, so the ids
    of a text are those of its :func:`units`.  A unit of letters alone is one word to the model.
    The strings of special tokens in a text become these tokens, as is the library's default; with ``plain`` they are ordinary text.
    """

    def __init__(self, file: str, end_id: int = END_ID, plain: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.tokenizer.encode_special_tokens = plain
        # a text that holds the string of an added token goes to the library whole, which cuts it there
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.added = re.compile("|".join(added) if added and not plain else r"(?!)")
        self.little = [n.to_bytes(4, "little") for n in range(self.tokenizer.get_vocab_size())]
        self.tokenize = self.tokenizer.model.tokenize
        self.end = array("I", [end_id]).tobytes()
        self.memo = _Memo(self._unit, {})
        self.line_break = self._whole("\n")

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _word(self, text: str, space: str) -> bytes:
        """The ids of a text after ``space``, which is a space or nothing."""
        if not text.isalpha():
            core = text.rstrip(_PUNCTUATION)
            if len(core) == len(text) or not core.isalpha():
                return self._whole(space + text)
            return self._word(core, space) + self._whole(text[len(core) :])
        letters = text if text.isascii() else "".join(map(_LETTERS.__getitem__, text.encode()))
        return b"".join([self.little[t.id] for t in self.tokenize(f"\u0120{letters}" if space else letters)])

    def _unit(self, unit: str) -> bytes:
        mark = unit[:1]
        if mark > _WHOLE or not mark:
            return self._word(unit, " ")
        if mark == _BREAK:
            return self.line_break
        if mark == _END:
            return self.end
        return self._word(unit[1:], "") if mark == _FIRST else self._whole(unit[1:])

    def encode(self, texts: list[str]) -> pa.ListArray:
        """The ids of each text, with the end id.

        Units are told apart and put together again in columns; Python sees each different unit of the texts once.
        """
        odd: dict[str, bytes] = {}
        rows = []
        for n, text in enumerate(texts):
            if any(m in text for m in _MARKS) or self.added.search(text):  # such a text is one unit, named by its place
                odd[f"{_WHOLE}{n}"] = self._whole(text)
                rows.append(f"{_WHOLE}{n}{_NEXT}{_END}")
            else:
                rows.append(f"{_HEAD}{units(text)}{_NEXT}{_END}")
        lists = pc.split_pattern(pa.array(rows, pa.string()), _NEXT)
        coded = lists.flatten().dictionary_encode()
        if len(self.memo) > MEMO:
            self.memo.older = {}
            self.memo = _Memo(self._unit, self.memo)
        different, memo = coded.dictionary.to_pylist(), self.memo
        ids = [odd[u] if u[:1] == _WHOLE else memo[u] for u in different] if odd else list(map(memo.__getitem__, different))
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        table = _lists(sizes, b"".join(ids))
        each = np.add.reduceat(sizes[coded.indices.to_numpy()], lists.offsets.to_numpy()[:-1]) if len(texts) else np.empty(0, np.int64)
        return _lists(each, table.take(coded.indices).flatten())


def _lists(sizes: np.ndarray, values: bytes | pa.Array) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(values, np.int32)) if isinstance(values, bytes) else values)


_encoders: dict[tuple[str, int, bool], Encoder] = {}


def encoder(file: str, end_id: int, plain: bool = False) -> Encoder:
    """One encoder for each Python worker and file."""
    key = (file, end_id, plain)
    if key not in _encoders:
        _encoders[key] = Encoder(*key)
    return _encoders[key]


def batched(batch: pa.RecordBatch, rows: int = BATCH, size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``rows`` rows and ``size`` bytes of ``text``; a longer text is one of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(batch):
        done = ends[at - 1] if at else 0
        cut = max(at + 1, min(at + rows, int(np.searchsorted(ends, done + size, "right"))))
        yield batch.slice(at, cut - at)
        at = cut


def write_tokens(docs: DataFrame, path: str, file: str, end_id: int = END_ID, plain: bool = False) -> None:
    """Write ``shard, doc_id, k, n_tokens, ids`` in ascending order of doc_id, nulls first.

    ``shard`` numbers the files by their range.  Rows with one doc_id follow in the order
    of ``k``, a hash of their texts; null texts are empty, repeated rows are written each, an empty table
    gives files without rows.  A very long text is encoded on its own; its ids are one list.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in batched(whole):
                ids = encoder(file, end_id, plain).encode([x or "" for x in b.column("text").to_pylist()])
                yield pa.record_batch([b.column("doc_id"), b.column("k"), ids.value_lengths().cast(pa.int64()), ids], ["doc_id", "k", "n_tokens", "ids"])

    rows = docs.select("doc_id", text_key().alias("k"), "text")
    ordered = rows.repartitionByRange("doc_id", "k").sortWithinPartitions("doc_id", "k")
    encoded = ordered.mapInArrow(encode, "doc_id long, k long, n_tokens long, ids array<int>")
    encoded.select(F.spark_partition_id().alias("shard"), "*").write.options(**ORC_OPTIONS).orc(path)


SCHEMA = "shard int, doc_id long, k long, n_tokens long, ids array<int>"


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).orc(path)


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The tokens of a few documents; stripes and row groups without them are skipped."""
    return read_tokens(spark, path).where(F.col("doc_id").isin(doc_ids))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts and unsigned CRC-32s of lists of ids as little-endian 32-bit integers."""
    for b in batches:
        ids = b.column("ids")
        values = memoryview(ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)).cast("B")
        ends = ids.offsets.to_numpy().astype(np.int64) * 4
        crcs = [zlib.crc32(values[x:y]) for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        yield pa.record_batch([b.column("shard"), b.column("doc_id"), b.column("k"), pa.array(np.diff(ends) // 4), pa.array(crcs, pa.int64())], ["shard", "doc_id", "k", "n_tokens", "ids_crc32"])


def digests(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` from the files: one row for each that was written.

    ``start`` adds up the shards before, by their token counts alone, and the documents before in the shard.
    """
    files = read_tokens(spark, path)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = files.groupBy("shard").agg(F.sum("n_tokens").alias("n")).select(
        F.col("shard").alias("_shard"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")
    )
    rows = files.select("shard", "doc_id", "k", "ids").mapInArrow(_digest, "shard int, doc_id long, k long, n_tokens long, ids_crc32 long")
    ahead = Window.partitionBy("shard").orderBy("doc_id", "k").rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.withColumn("ahead", F.coalesce(F.sum("n_tokens").over(ahead), F.lit(0)))
        .join(shards, F.col("shard") == F.col("_shard"))
        .select("doc_id", (F.col("base") + F.col("ahead")).alias("start"), "n_tokens", "ids_crc32")
    )


def op2_tokens(docs: DataFrame, file: str, end_id: int = END_ID) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of each row: encode, write to the shared folder, and digest what is read back.

    Nulls, repeated rows, long texts and empty tables as in :func:`write_tokens`; other columns are ignored.
    """
    path = scratch_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, file, end_id)
    return digests(docs.sparkSession, path)
