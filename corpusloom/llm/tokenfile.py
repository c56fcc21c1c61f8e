"""Token ids in Arrow stream files of fixed-size lists.

Documents are tokenised, ended with an end id, and packed in ascending id order into sequences of
equal length. Every file is an Arrow IPC file with record batches of two columns: ``ids``, a
fixed-size list of uint16 (uint32 for vocabularies over 65,536), and ``mask``, a fixed-size list of
bools that is false on the padding after a file's last token. Batches are uncompressed and all but
the last have ``rows`` sequences, so sequence k is found by division and read without copying.
Beside each file stands an index, another Arrow file with doc_id, start (in the file) and n_tokens.

Files have names of the attempt that wrote them, and only the manifest, one row per file, tells which
count; so a task may be lost and run again on any file system, and nothing is renamed. Nulls and empty texts have the end id only. Null ids come
first; equal ids keep all their rows. Other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, small_batches, trim

SEQ_LEN = 2048
ROWS = 256
#: Words whose ids one Python worker remembers before it starts anew.
CACHE_WORDS = 300_000
_cache: dict[str, _Known] = {}
#: Words of lower-case Latin letters: one run for any tokenizer here, and unchanged by its normaliser.
_LETTERS = re.compile(r"[a-zß-öø-ÿ]+")
_LAST_LETTER = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])\Z")


class _Known(dict):
    """Ids by word; a word that isn't there is encoded and stays."""

    encoder: WordEncoder

    def __missing__(self, word: bytes) -> bytes:
        ids = self[word] = self.encoder.word(word)
        return ids


def _byte_letters() -> dict[int, str]:
    """The letters of byte-level vocabularies: printable bytes are themselves, the others follow from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in set(own))}


def _steps(part: dict | None, kind: str) -> list[dict]:
    return [] if part is None else part[kind] if part["type"] == "Sequence" else [part]


def separable(spec: dict) -> tuple[bool, bool]:
    """From a tokenizer's own description: whether words can be encoded apart, and whether letters go to its BPE model in lower case.

    Words can if the first splitter drops white space, no later one adds any, and the normaliser changes
    characters whatever stands around a white space.
    """
    splits, forms, model = _steps(spec.get("pre_tokenizer"), "pretokenizers"), _steps(spec.get("normalizer"), "normalizers"), spec["model"]
    first = splits[0] if splits else {"type": None}
    pattern = (first.get("pattern") or {}).get("Regex", r"\s")
    kept = pattern.replace(r"[^\s", "[^")  # white space in a negated class is none that the pieces have
    runs = first["type"] == "Split" and first.get("behavior") == "Removed" and first.get("invert") is True and not re.search(r"\\s|\s|\.", kept)
    drops = runs or first["type"] in ("WhitespaceSplit", "Whitespace", "BertPreTokenizer")
    space = lambda f: f["type"] == "Replace" and (f.get("pattern") or {}).get("Regex") == r"\s+" and f.get("content") == " "
    local = all(f["type"] in ("NFC", "NFD", "NFKC", "NFKD", "Lowercase") or space(f) for f in forms)
    apart = bool(drops and local and not any(s.get("add_prefix_space") for s in splits) and not model.get("dropout"))
    letters = (
        apart and runs and "[\\p{L}]+" in pattern and "[^\\s\\p{L}\\p{N}]+" in pattern and model["type"] == "BPE" and any(f["type"] == "Lowercase" for f in forms)
        and [s["type"] for s in splits[1:]] == ["ByteLevel"] and splits[1].get("use_regex") is False
    )
    return apart, bool(letters)


class WordEncoder:
    """Ids of whole texts from the tokenizers library, asked once per distinct word while it is remembered.

    Whether a text's ids are those of its words in order is read from the tokenizer's own normaliser and
    splitters; of other tokenizers, or with ``by_words=False``, and where a special token's string
    occurs, whole texts are encoded as they are. Where the tokenizer hands lower-case letters to its BPE
    model as they are, words of Latin letters go there at once.
    """

    def __init__(self, path: str, width: np.dtype, by_words: bool = True) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer, self.width = Tokenizer.from_file(path), width
        spec = json.loads(self.tokenizer.to_str())
        self.by_words, self.by_letters = separable(spec) if by_words else (False, False)
        self.lowers = any(f["type"] == "Lowercase" for f in _steps(spec.get("normalizer"), "normalizers"))
        self.special = [a["content"].lower().encode() for a in spec.get("added_tokens", [])]
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.known = _cache.setdefault(f"{path}:{width}", _Known())
        self.known.encoder = self
        self.stops = {c: self._ids(c.decode()) for c in (b".", b",")} if self.by_letters else {}

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.width).tobytes()

    def word(self, word: bytes) -> bytes:
        # a lone full stop or comma behind a letter is a token of its own: the word without it recurs more
        if (stop := self.stops.get(word[-1:])) is not None and _LAST_LETTER.search(word, 0, len(word) - 1):
            return self.known[word[:-1]] + stop
        text = word.decode()
        if not self.by_letters or not _LETTERS.fullmatch(text):
            return self._ids(text)
        ids = [t.id for t in self.model.tokenize(text if text.isascii() else "".join(map(self.letters.__getitem__, word)))]
        return struct.pack(f"<{len(ids)}{self.width.char}", *ids)

    def __call__(self, text: bytes | None) -> bytes:
        """Ids of a UTF-8 text."""
        if not text:
            return b""
        low = text.lower()  # A-Z only
        if not self.by_words or any(s in low for s in self.special):
            return self._ids(text.decode())
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        return b"".join(map(self.known.__getitem__, (low if self.lowers else text).split()))


def id_type(path: str, end_id: int) -> np.dtype:
    """Unsigned 16-bit integers where the vocabulary fits, else 32-bit ones."""
    from tokenizers import Tokenizer

    return np.dtype("<u2" if max(Tokenizer.from_file(path).get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4")


def _fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class _Packer:
    """Writes a stream of ids as fixed-size lists, a batch at a time."""

    def __init__(self, sink: pa.NativeFile, dtype: np.dtype, seq_len: int, rows: int) -> None:
        self.dtype, self.seq_len, self.size = dtype, seq_len, seq_len * rows
        item = pa.from_numpy_dtype(dtype)
        self.schema = pa.schema([("ids", pa.list_(item, seq_len)), ("mask", pa.list_(pa.bool_(), seq_len))])
        self.out = pa.ipc.new_file(sink, self.schema)
        self.parts: list[bytes] = []
        self.held = 0
        self.all = pa.FixedSizeListArray.from_arrays(pa.array(np.ones(self.size, bool)), seq_len)

    def add(self, ids: bytes) -> None:
        self.parts.append(ids)
        self.held += len(ids) // self.dtype.itemsize
        if self.held >= self.size:
            flat = np.frombuffer(b"".join(self.parts), self.dtype)
            whole = len(flat) // self.size * self.size
            for at in range(0, whole, self.size):
                self._batch(flat[at : at + self.size], self.size)
            self.parts, self.held = [flat[whole:].tobytes()], len(flat) - whole

    def _batch(self, flat: np.ndarray, real: int) -> None:
        ids = pa.FixedSizeListArray.from_arrays(pa.array(flat), self.seq_len)
        mask = self.all if real == self.size else pa.FixedSizeListArray.from_arrays(pa.array(np.arange(len(flat)) < real), self.seq_len)
        self.out.write_batch(pa.record_batch([ids, mask], schema=self.schema))

    def close(self) -> None:
        flat = np.frombuffer(b"".join(self.parts), self.dtype)
        if len(flat):
            padded = np.zeros(-(-len(flat) // self.seq_len) * self.seq_len, self.dtype)
            padded[: len(flat)] = flat
            self._batch(padded, len(flat))
        self.out.close()


INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def write_tokens(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str, seq_len: int = SEQ_LEN, rows: int = ROWS, by_words: bool = True) -> DataFrame:
    """Writes the files; a manifest comes back: part, path, first_id order by part, n_docs, n_tokens.

    ``docs`` are range-partitioned by doc_id, each partition is sorted and becomes one file.
    """
    spark = docs.sparkSession
    small_batches(spark)
    dtype = id_type(tokenizer_path, end_id)
    fs, base = _fs(folder)
    fs.create_dir(base, recursive=True)
    ordered = docs.select("doc_id", "text").repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        part = TaskContext.get().partitionId()
        encode = WordEncoder(tokenizer_path, dtype, by_words)
        end = np.array([end_id], dtype).tobytes()
        out, top = _fs(folder)
        name = f"part-{part:06d}-{uuid.uuid4().hex}"
        own = f"{top}/{name}"
        at = n_docs = 0
        with out.open_output_stream(f"{own}.arrow") as sink, out.open_output_stream(f"{own}.index") as listed:
            packer, index = _Packer(sink, dtype, seq_len, rows), pa.ipc.new_file(listed, INDEX)
            while first is not None:
                sizes = []
                for text in first.column(1).cast(pa.binary()).to_pylist():
                    ids = encode(text)
                    packer.add(ids)
                    packer.add(end)
                    sizes.append(len(ids) // dtype.itemsize + 1)
                ends = at + np.cumsum(sizes, dtype=np.int64)
                index.write_batch(pa.record_batch([first.column(0).cast(pa.int64()), pa.array(ends - sizes), pa.array(sizes, pa.int64())], schema=INDEX))
                at, n_docs = int(ends[-1]), n_docs + len(sizes)
                first = next((b for b in batches if b.num_rows), None)
            packer.close()
            index.close()
        trim()
        yield pa.record_batch([pa.array([part], pa.int64()), pa.array([name]), pa.array([n_docs], pa.int64()), pa.array([at], pa.int64())], names=["part", "file", "n_docs", "n_tokens"])

    return ordered.mapInArrow(write, "part long, file string, n_docs long, n_tokens long")


class TokenFile:
    """Random access to one written file; local files are mapped into memory."""

    def __init__(self, folder: str, file: str) -> None:
        fs, base = _fs(folder)
        local = isinstance(fs, pafs.LocalFileSystem)
        self._open = (lambda p: pa.memory_map(p)) if local else fs.open_input_file
        self.data = pa.ipc.open_file(self._open(f"{base}/{file}.arrow"))
        self.index = pa.ipc.open_file(self._open(f"{base}/{file}.index"))
        self.seq_len = self.data.schema.field("ids").type.list_size
        self.rows = self.data.get_batch(0).num_rows if self.data.num_record_batches else 0
        self._held: tuple[int, np.ndarray] = (-1, np.empty(0))

    def batch(self, k: int) -> np.ndarray:
        """The ids of batch k as one flat array, without a copy of mapped files."""
        if self._held[0] != k:
            self._held = k, self.data.get_batch(k).column(0).values.to_numpy(zero_copy_only=True)
        return self._held[1]

    def sequence(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of the k-th sequence."""
        b, row = divmod(k, self.rows)
        mask = self.data.get_batch(b).column(1).values.slice(row * self.seq_len, self.seq_len)
        return self.batch(b)[row * self.seq_len : (row + 1) * self.seq_len], mask.to_numpy(zero_copy_only=False)

    def pieces(self, start: int, n: int) -> Iterator[np.ndarray]:
        """The ids from start on, cut at batch borders."""
        size = self.rows * self.seq_len
        while n > 0:
            b, at = divmod(start, size)
            piece = self.batch(b)[at : at + n]
            yield piece
            start, n = start + len(piece), n - len(piece)


def read_tokens(spark, manifest: list[tuple[int, str, int, int]], folder: str) -> DataFrame:  # noqa: ANN001
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32. The manifest has one row per file."""
    base, rows = 0, []
    for _, file, _, n_tokens in sorted(manifest):
        rows.append((file, base))
        base += n_tokens
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not rows:
        return spark.createDataFrame([], schema)
    files = spark.createDataFrame(rows, "file string, base long").repartition(len(rows))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = TokenFile(folder, file)
                for k in range(own.index.num_record_batches):
                    part = own.index.get_batch(k)
                    starts, sizes = part.column(1).to_numpy(), part.column(2).to_numpy()
                    crcs = []
                    for start, n in zip(starts.tolist(), sizes.tolist()):
                        crc = 0
                        for piece in own.pieces(start, n):
                            crc = zlib.crc32(piece.astype("<u4"), crc)
                        crcs.append(crc)
                    yield pa.record_batch([part.column(0), pa.array(starts + first), part.column(2), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.mapInArrow(read, schema)


def token_files(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str | None = None, **options) -> DataFrame:  # noqa: ANN003
    """Writes the files and returns what is read back from them."""
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    # one row per file: the driver needs their order and lengths, nothing of the documents
    manifest = [tuple(r) for r in write_tokens(docs, tokenizer_path, end_id, folder, **options).collect()]
    return read_tokens(spark, manifest, folder)
