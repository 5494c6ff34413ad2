"""Token ids of whole documents in Simple-8b files, in order of document id."""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import simple8b
from .common import quoted, small_batches, written

END_ID, FILE_IDS, CACHE, SMALL_ROWS = 2, 1 << 21, 800_000, 200_000
# fixed values: the steps of a tokenizer file after which a text's ids are those of its parts between spaces, one after another
BY_PARTS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


# plain text, which such steps lower letter by letter and cut between letters, digits and signs: no apostrophe, which may
# belong to the letters after it, and no sign under 33 but space and newline
_LETTERS, _SIGNS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff", re.escape("!\"#$%&()*+,-./:;=?@[\\]^_`{|}~")
_ODD = re.compile(f"[^ \n0-9{_LETTERS}{_SIGNS}]")
_ODD_PART = re.compile(f"(?<![^ \n])[^ \n]*{_ODD.pattern}[^ \n]*")
_TOKENS = re.compile(f"[{_LETTERS}]+|[0-9]+|[{_SIGNS}]+")
_WORD = re.compile(f"[{_LETTERS}]+")


class Encoder:
    """The library's encoder of one tokenizer file. Texts are encoded whole, or, where the file's own steps
    drop white space and cut there, piece by piece, each different piece once: plain parts between
    spaces in words, digits and signs, others as they are. Words are encoded many in a text: of a
    vocabulary that marks the ends of words, the ids tell where each one ends."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        steps = json.loads(self.library.to_str())
        mark = steps["model"].get("end_of_word_suffix")
        held = [t for t in steps["added_tokens"] if t["lstrip"] or t["rstrip"] or t["single_word"] or " " in t["content"] or "\n" in t["content"] or not _ODD.search(t["content"])]
        self.by_parts = bool(mark) and not held and all(steps[k] == v for k, v in BY_PARTS.items())
        self.known: dict[str, bytes] = {}
        if self.by_parts:
            vocabulary = self.library.get_vocab(with_added_tokens=False)
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[i for t, i in vocabulary.items() if t.endswith(mark)]] = True

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array("I", x.ids).tobytes() for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: set[str]) -> None:
        words = list(filter(_WORD.fullmatch, pieces))
        if words:
            ids = self._ids([" ".join(words)])[0]
            ends = (4 * np.flatnonzero(self.ends[np.frombuffer(ids, "<u4")]) + 4).tolist()
            self.known.update(zip(words, [ids[a:z] for a, z in zip([0, *ends[:-1]], ends, strict=True)], strict=True))
        rest = list(pieces.difference(words))
        self.known.update(zip(rest, self._ids(rest), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if not self.by_parts:
            return self._ids(texts)
        if len(self.known) > CACHE:
            self.known = {}
        cut = [pieces(t) for t in texts]
        self._learn(set().union(*cut).difference(self.known))
        of = self.known.__getitem__
        return [b"".join(map(of, c)) for c in cut]


def pieces(text: str) -> list[str]:
    """The text without white space, in lower case but for parts that aren't plain."""
    if not _ODD.search(text):
        return _TOKENS.findall(text.lower())
    out, at = [], 0
    for m in _ODD_PART.finditer(text):
        out += _TOKENS.findall(text[at : m.start()].lower())
        out.append(m[0])
        at = m.end()
    return out + _TOKENS.findall(text[at:].lower())


_ENCODERS: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """One encoder for each worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def write_id_files(docs: DataFrame, tokenizer: str, text: str = "text", doc_id: str = "doc_id", end: int = END_ID) -> DataFrame:
    """A written table of id files: (file_no, n, data): its number of ids and its bytes, file_no ascending with the document id.

    Null text is empty: the end id alone. Equal document ids stay separate documents, ordered by their texts' hash
    and then by text, so that a third of all rows under one id still spread; a null document id comes first. An empty table gives no file. Only the two columns named are read.
    Ids are whole numbers. A file holds whole documents, FILE_IDS ids or one document more. Files are rows of a Parquet
    table in the shared folder: Spark's commit keeps a lost executor's half-written files out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder, part, k = encoder_of(tokenizer), TaskContext.get().partitionId(), 0
        last = np.array([end], "<u4").tobytes()
        ids: list[bytes] = []
        owners: list[int] = []
        held = 0

        def flush() -> pa.RecordBatch:
            counts = np.array([len(x) // 4 for x in ids], np.int64)
            data = simple8b.pack_file(np.frombuffer(b"".join(ids), "<u4"), np.array(owners, np.int64), counts)
            return pa.RecordBatch.from_arrays([pa.array([(part << 32) + k], pa.int64()), pa.array([counts.sum()], pa.int64()), pa.array([data], pa.binary())], ["file_no", "n", "data"])

        for b in small_batches(batches, 256):
            names = b.column(0).fill_null(int(simple8b.NO_ID)).to_pylist()
            for o, x in zip(names, coder.encode([t or "" for t in b.column(1).to_pylist()]), strict=True):
                ids.append(x + last)
                owners.append(o)
                held += len(x) // 4 + 1
                if held >= FILE_IDS:
                    yield flush()
                    k, held = k + 1, 0
                    ids.clear()
                    owners.clear()
        if ids:
            yield flush()

    rows = docs.select(quoted(doc_id).cast("long").alias("d"), quoted(text).alias("x")).withColumn("h", F.xxhash64("x"))
    rows = rows.repartitionByRange("d", "h").sortWithinPartitions("d", "h", "x").select("d", "x")
    return written(rows.mapInArrow(run, "file_no long, n long, data binary"), "id-files")


def read_id_files(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): every document of the files; start counts all ids before it."""

    def run(batches):
        for b in batches:
            for no, data, base in zip(*(b.column(i) for i in range(3)), strict=True):
                ids, docs, counts = simple8b.unpack_file(data.as_py())
                ids, ends = ids.astype("<u4"), np.cumsum(counts)
                starts = ends - counts
                crc = [zlib.crc32(ids[s:e]) for s, e in zip(starts, ends, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs, pa.int64(), mask=docs == simple8b.NO_ID), pa.array(starts + base.as_py(), pa.int64()), pa.array(counts, pa.int64()), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    # files are counted within each writing task first, then the tasks
    sizes = files.select("file_no", F.shiftright("file_no", 32).alias("part"), "n")
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n")).select("part", F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.sum("n").over(Window.partitionBy("part").orderBy("file_no")) - F.col("n")
    start = written(sizes.withColumn("inside", inside).join(parts, "part").select("file_no", (F.col("before") + F.col("inside")).alias("base")), "file-starts")
    return files.join(F.broadcast(start) if start.count() <= SMALL_ROWS else start, "file_no").select("file_no", "data", "base").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
