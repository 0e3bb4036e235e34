"""Token ids in Arrow files of equal-length sequences, for zero-copy random access.

Documents are dealt out by ranges of doc_id and sorted (ties: by text), encoded,
each closed by an end id, and the ids of a range are cut into sequences of
`length`, which one task writes to one Arrow file: record batches of two
fixed-size-list columns, `ids` (uint16 where the vocabulary allows it) and
`mask` (True for real ids; only the file's last sequence is padded). A second
small file lists its documents: doc_id, start in the file, n_tokens. Files are
written under a temporary name and moved, so a task that is run again leaves
the same file. TokenFile maps a file into memory and gives sequences, masks and
the ids of any range as views.

The driver only sees one row per file. Defined results: null and empty texts
have the end id alone; a null doc_id sorts first; repeated rows follow each
other; an empty table gives no files; extra columns are ignored.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, vec

#: Text that goes to one file, about; and ids per sequence, sequences per record batch.
FILE_BYTES, LENGTH, BATCH = 24 << 20, 1024, 256
#: Distinct words in a generation of a worker's cache.
CACHE_WORDS = 300_000
#: Longer words aren't kept.
LONG = 64
#: Text whose distinct words are looked up together.
SLICE_BYTES = 8 << 20
MANIFEST = "part int, path string, n_docs long, n_tokens long, n_sequences long"


def _offsets(x: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(x)))


def _gather(flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    return flat[vec.ranges(begin, size)]


class Kept:
    """Ids of strings in arrays: those of the last call, then what is left of earlier ones, up to `most`."""

    def __init__(self, most: int, dtype: np.dtype):
        self.most = most
        self.values, self.flat = pa.array([], pa.large_string()), np.zeros(0, dtype)
        self.begin = self.size = np.zeros(0, np.int64)

    def get(self, keys: pa.LargeStringArray, make: Callable) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, begin, size) of distinct strings; make() gives the ids and sizes of those that aren't there, of which strings beyond LONG bytes aren't kept."""
        at = pc.index_in(keys, value_set=self.values).fill_null(-1).to_numpy(zero_copy_only=False)
        lack = np.flatnonzero(at < 0)
        begin, size = np.empty(len(keys), np.int64), np.empty(len(keys), np.int64)
        there = at >= 0
        begin[there], size[there] = self.begin[at[there]], self.size[at[there]]
        flat = self.flat
        if len(lack):
            more, n = make(keys.take(pa.array(lack)))
            begin[lack], size[lack] = len(flat) + np.cumsum(n) - n, n
            flat = np.concatenate([flat, more])
        short = np.flatnonzero(pc.binary_length(keys).to_numpy(zero_copy_only=False) <= LONG)[: self.most]
        left = np.ones(len(self.values), bool)
        left[at[there]] = False
        left = np.flatnonzero(left)[: self.most - len(short)]
        self.values = pa.concat_arrays([keys.take(pa.array(short)), self.values.take(pa.array(left))])
        b, n = np.concatenate([begin[short], self.begin[left]]), np.concatenate([size[short], self.size[left]])
        self.flat, self.begin, self.size = _gather(flat, b, n), np.cumsum(n) - n, n
        return flat, begin, size


class WordEncoder:
    """The library's encoding, kept by word. White space is dropped before anything else looks at it, so texts can be cut at it; each distinct word of a slice is looked up once.

    Words of ASCII letters with marks after them, which most are, are taken apart by Arrow and go to the library's model
    without its normalizer and pattern, which change and cut nothing in lower-case letters between spaces.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tok, self.bare = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.bare.normalizer = normalizers.Sequence([])
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        n = self.tok.get_vocab_size()
        self.type = np.dtype("<u2" if n <= 1 << 16 else "<u4")
        self.words, self.heads, self.parts = Kept(CACHE_WORDS, self.type), Kept(CACHE_WORDS, self.type), common.Memo(CACHE_WORDS)
        self.ends = np.array([(self.tok.id_to_token(i) or "").endswith("</w>") for i in range(n)], bool)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of the texts in them)"""
        raw, off = vec.buffers(texts)
        starts, ends, first = vec.words(raw, off)
        at = _offsets(ends - starts)
        words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(at), pa.py_buffer(raw[vec.NON_SPACE[raw]].tobytes())).dictionary_encode()
        flat, begin, size = self.words.get(words.dictionary, self._fresh)
        of = words.indices.to_numpy()
        size = size[of]
        return _gather(flat, begin[of], size), _offsets(size)[first]

    def _fresh(self, words: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids and sizes of distinct words."""
        core = pc.ascii_rtrim(words, ".,;:!?")
        plain = pc.ascii_is_alpha(core).to_numpy(zero_copy_only=False)
        some, rest = np.flatnonzero(plain), np.flatnonzero(~plain)
        slow = self._apart(words.take(pa.array(rest)).to_pylist())
        core = core.take(pa.array(some))
        heads = pc.ascii_lower(core).dictionary_encode()
        raw, off = vec.buffers(words)
        n = pc.binary_length(core).to_numpy(zero_copy_only=False)
        start, size = off[some] + n, off[some + 1] - off[some] - n
        tails = pa.LargeStringArray.from_buffers(len(some), pa.py_buffer(_offsets(size)), pa.py_buffer(_gather(raw, start, size).tobytes())).dictionary_encode()
        marks = self.parts.values(tails.dictionary.to_pylist(), self._parts, LONG)
        flat, begin, size = self.heads.get(heads.dictionary, self._letters)
        more = [len(x) // self.type.itemsize for x in marks], [len(x) // self.type.itemsize for x in slow]
        begin, size = np.concatenate([begin, len(flat) + _offsets(np.concatenate(more))[:-1]]).astype(np.int64), np.concatenate([size, *more]).astype(np.int64)
        flat = np.concatenate([flat, np.frombuffer(b"".join([*marks, *slow]), self.type)])
        k = len(heads.dictionary)
        which = np.full((len(words), 2), len(size))  # of each word: a head and its marks, or all of it
        which[some, 0], which[some, 1] = heads.indices.to_numpy(), k + tails.indices.to_numpy()
        which[rest, 0] = k + len(marks) + np.arange(len(rest))
        begin, size = np.append(begin, 0), np.append(size, 0)
        return _gather(flat, begin[which].ravel(), size[which].ravel()), size[which].sum(axis=1)

    def _letters(self, words: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids and sizes of words of lower-case ASCII letters: each one's last id has the mark of a word's end."""
        words, ids = words.to_pylist(), [np.zeros(0, self.type)]
        groups = [" ".join(words[at : at + 2000]) for at in range(0, len(words), 2000)]
        for at in range(0, len(groups), 16):
            ids += [np.array(e.ids, self.type) for e in self.bare.encode_batch_fast(groups[at : at + 16], add_special_tokens=False)]
        flat = np.concatenate(ids)
        stop = np.flatnonzero(self.ends[flat]) + 1
        if len(stop) != len(words):
            each = list(self._each(words))
            return np.frombuffer(b"".join(each), self.type), np.array([len(x) // self.type.itemsize for x in each], np.int64)
        return flat, np.diff(stop, prepend=0)

    def _apart(self, words: list[str]) -> list[bytes]:
        """The ids of distinct words, of at most two parts each: letters and the marks after them are always separate for the library; ASCII letters count as their lower case."""
        heads, tails = [], []
        for w in words:
            core = w.rstrip(".,;:!?")
            if core.isalpha():
                heads.append(core.lower() if core.isascii() else core)
                tails.append(w[len(core) :])
            else:
                heads.append(w)
                tails.append("")
        parts = list({*heads, *tails})
        part = dict(zip(parts, self.parts.values(parts, self._parts, LONG), strict=True))
        return [part[h] + part[t] if t else part[h] for h, t in zip(heads, tails, strict=True)]

    def _parts(self, parts: list[str]) -> list[bytes]:
        plain = [x for x in parts if x.isalpha() and "\u0130" not in x]
        got = dict(zip(plain, self._joined(plain), strict=True))
        rest = [x for x in parts if x not in got]
        got.update(zip(rest, self._each(rest), strict=True))
        return [got[x] for x in parts]

    def _joined(self, words: list[str]) -> Iterator[bytes]:
        """Words of letters alone are one piece each for the library, whose last id has the mark of a word's end: many go into one text, whose ids are cut there."""
        groups = [words[at : at + 2000] for at in range(0, len(words), 2000)]
        for at in range(0, len(groups), 16):
            texts = self.tok.encode_batch_fast([" ".join(g) for g in groups[at : at + 16]], add_special_tokens=False)
            for some, e in zip(groups[at : at + 16], texts, strict=True):
                ids = np.array(e.ids, self.type)
                stop = np.flatnonzero(self.ends[ids]) + 1
                if len(stop) != len(some):
                    yield from self._each(some)
                    continue
                raw, cut = ids.tobytes(), (stop * self.type.itemsize).tolist()
                yield from (raw[i:j] for i, j in zip([0, *cut], cut, strict=False))

    def _each(self, words: list[str]) -> Iterator[bytes]:
        for at in range(0, len(words), 10_000):
            for e in self.tok.encode_batch_fast(words[at : at + 10_000], add_special_tokens=False):
                yield np.array(e.ids, self.type).tobytes()


@lru_cache(1)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


class Writer:
    """Packs ids into sequences and writes full record batches."""

    def __init__(self, sink, dtype: np.dtype, length: int, batch: int):
        self.length, self.rows, self.type = length, batch, dtype
        kind = pa.from_numpy_dtype(dtype)
        self.schema = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))], metadata={"length": str(length)})
        self.out = pa.ipc.new_file(sink, self.schema)
        self.wait: list[np.ndarray] = []
        self.held = self.total = self.sequences = 0

    def add(self, ids: np.ndarray) -> None:
        self.wait.append(ids)
        self.held += len(ids)
        self.total += len(ids)
        if self.held >= self.length * self.rows:
            self._flush(self.held // self.length // self.rows * self.rows)

    def _flush(self, n: int, pad: bool = False) -> None:
        flat = np.concatenate(self.wait) if self.wait else np.zeros(0, self.type)
        real = min(len(flat), n * self.length)
        full, rest = flat[:real], flat[real:]
        if pad:
            full = np.concatenate([full, np.zeros(n * self.length - real, self.type)])
        mask = np.arange(n * self.length) < real
        for at in range(0, n, self.rows):
            to = min(n, at + self.rows) * self.length
            cols = [pa.FixedSizeListArray.from_arrays(pa.array(x[at * self.length : to]), self.length) for x in (full, mask)]
            self.out.write_batch(pa.RecordBatch.from_arrays(cols, schema=self.schema))
        self.sequences += n
        self.wait, self.held = [rest] if len(rest) else [], len(rest)

    def close(self) -> None:
        if self.held:
            self._flush(-(-self.held // self.length), pad=True)
        self.out.close()


class TokenFile:
    """A file of sequences, mapped into memory where the file system is local."""

    def __init__(self, uri: str):
        fs, path = filesystem(uri)
        self.source = pa.memory_map(path) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path)
        self.file = pa.ipc.open_file(self.source)
        self.length = self.file.schema.field("ids").type.list_size
        self.rows = np.cumsum([0] + [self.file.get_batch(i).num_rows for i in range(self.file.num_record_batches)])

    def __len__(self) -> int:
        return int(self.rows[-1])

    def _at(self, k: int) -> tuple[pa.RecordBatch, int]:
        b = int(np.searchsorted(self.rows, k, side="right")) - 1
        return self.file.get_batch(b), k - int(self.rows[b])

    def sequence(self, k: int) -> np.ndarray:
        """The k-th sequence, a view of the file."""
        batch, i = self._at(k)
        return batch.column(0).flatten().to_numpy()[i * self.length : (i + 1) * self.length]

    def mask(self, k: int) -> pa.Array:
        batch, i = self._at(k)
        return batch.column(1)[i].values

    def tokens(self, start: int, n: int) -> np.ndarray:
        """n ids from `start` on: a view if they lie in one record batch."""
        parts, end = [], start + n
        while start < end:
            batch, i = self._at(start // self.length)
            lo = i * self.length + start % self.length
            part = batch.column(0).flatten().to_numpy()[lo : lo + end - start]
            parts.append(part)
            start += len(part)
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.uint16)


def write(docs: DataFrame, path: str, end_id: int, target: str, length: int = LENGTH, batch: int = BATCH) -> list[tuple[int, str, int, int, int, int]]:
    """Writes the files below the folder `target`; returns (part, path, n_docs, n_tokens, n_sequences, start) per file, in order."""
    common.batches(docs.sparkSession)
    n = common.chunk_count(docs.select("doc_id", "text"), FILE_BYTES)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        enc = encoder(path)
        writer = docs_out = None
        n_docs = 0
        name = f"{target}/part-{part:06d}"
        fs, base = filesystem(name)
        for record in it:
            for piece in vec.slices(record, SLICE_BYTES):
                if not writer:
                    fs.create_dir(base.rpartition("/")[0], recursive=True)
                    sinks = [fs.open_output_stream(f"{base}.{kind}.{attempt}") for kind in ("arrow", "docs")]
                    writer = Writer(sinks[0], enc.type, length, batch)
                    docs_out = pa.ipc.new_file(sinks[1], docs_out_schema)
                ids, off = enc.encode(piece.column(1))
                sizes = np.diff(off) + 1
                starts = writer.total + np.cumsum(sizes) - sizes
                writer.add(np.insert(ids, off[1:], end_id))
                docs_out.write_batch(pa.RecordBatch.from_arrays([piece.column(0), pa.array(starts), pa.array(sizes)], schema=docs_out_schema))
                n_docs += piece.num_rows
        if writer:
            writer.close()
            docs_out.close()
            for s in sinks:
                s.close()
            for kind in ("arrow", "docs"):
                fs.move(f"{base}.{kind}.{attempt}", f"{base}.{kind}")
            yield pa.RecordBatch.from_pylist([{"part": part, "path": name, "n_docs": n_docs, "n_tokens": writer.total, "n_sequences": writer.sequences}], schema=manifest)

    docs_out_schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
    manifest = pa.schema([("part", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("n_sequences", pa.int64())])
    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    files, at = [], 0
    for r in sorted(ordered.mapInArrow(run, MANIFEST).collect()):
        files.append((r.part, r.path, r.n_docs, r.n_tokens, r.n_sequences, at))
        at += r.n_tokens
    fs, base = filesystem(f"{target}/manifest.json")
    fs.create_dir(base.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(base) as f:
        f.write(json.dumps({"length": length, "end_id": end_id, "files": files}).encode())
    return files


def read(spark, files: list[tuple]) -> DataFrame:
    """The documents of the files: doc_id, start (ids of all documents before), ids."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for record in it:
            for row in record.to_pylist():
                fs, base = filesystem(row["path"] + ".docs")
                tokens = TokenFile(row["path"] + ".arrow")
                with fs.open_input_file(base) as f:
                    index = pa.ipc.open_file(f)
                    for i in range(index.num_record_batches):
                        b = index.get_batch(i)
                        ids = [tokens.tokens(s, n) for s, n in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
                        off = np.concatenate(([0], np.cumsum([len(x) for x in ids])))
                        flat = np.concatenate(ids).astype("<u4")
                        start = pa.array(b.column(1).to_numpy() + row["start"])
                        raw = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer((off * 4).astype(np.int32).tobytes()), pa.py_buffer(flat.tobytes())])
                        yield pa.RecordBatch.from_arrays([b.column(0), start, b.column(2), raw], names=["doc_id", "start", "n_tokens", "ids"])

    schema = "doc_id long, start long, n_tokens long, ids binary"
    if not files:
        return spark.createDataFrame([], schema)
    rows = spark.createDataFrame([(f[1], f[5]) for f in files], "path string, start long").repartition(len(files))
    return rows.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    files = write(common.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 1, common.shared_dir(spark))
    return read(spark, files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
