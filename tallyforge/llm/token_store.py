"""Token ids as Arrow stream files of fixed-size sequences, written and read by Spark tasks."""

from __future__ import annotations

import json
import uuid
import zlib
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.llm.batches import slices
from tallyforge.llm.tokens import MEMO, _workers, load
from tallyforge.session import ensure_checkpoint_dir, ship_package

#: Ids of one sequence, sequences of one record batch.
SEQUENCE, BATCH_ROWS = 2048, 256
#: A control character that is one token, and how many words are encoded at once with it between them.
MARK, TOGETHER = "\x01", 64
#: Marks before which a word is cut, so that it is looked up without them.
MARKS = ".,;:!?"
#: Documents of one file, about.
DOCS_PER_FILE = 20_000
MANIFEST = "file_no int, path string, n_docs long, n_tokens long, index binary"


#: What letters and marks are told apart by: steps of a tokenizer for which _plain() holds.
NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
PIECES = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def _plain(tokenizer) -> bool:
    """Whether a run of ASCII letters is one piece, lower-cased and else as it is, and ends where a mark of MARKS follows."""
    steps = [json.loads(x.__getstate__()) if x is not None else {} for x in (tokenizer.normalizer, tokenizer.pre_tokenizer)]
    pieces = steps[1].get("pretokenizers", [])
    split = [{"type": "Split", "pattern": {"Regex": PIECES}, "behavior": "Removed", "invert": True}]
    bytewise = len(pieces) == 2 and pieces[1].get("type") == "ByteLevel" and not pieces[1].get("add_prefix_space")
    added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    return steps[0].get("normalizers") == NORMAL and pieces[:1] == split and bytewise and not any(t.isalpha() or set(t) & set(MARKS) for t in added)


class PieceEncoder:
    """Ids of texts through the ids of their white-space pieces, as little-endian bytes."""

    def __init__(self, path: str):
        self.tokenizer = load(path)
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.memo = _workers.setdefault(("ids", path), {"": b""})
        alone = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.mark = alone[0] if len(alone) == 1 else None
        self.plain, self.model = _plain(self.tokenizer), self.tokenizer.model

    def _ids(self, words: list[str]) -> list[bytes]:
        """Ids of words, which are encoded TOGETHER at a time, with a mark between them that none of them holds.

        Where a word of ASCII letters is one piece, the library's model gets it as it is, without the steps before it.
        """
        out: list = [None] * len(words)
        if self.plain:
            letters = [k for k, w in enumerate(words) if w.isascii() and w.isalpha()]
            found = [[t.id for t in self.model.tokenize(words[k].lower())] for k in letters]
            ids, cuts = np.fromiter(chain.from_iterable(found), self.dtype), np.cumsum([0, *map(len, found)])
            for k, (a, b) in zip(letters, pairwise(cuts.tolist()), strict=True):
                out[k] = ids[a:b].tobytes()
        plain = [k for k, w in enumerate(words) if out[k] is None and MARK not in w and len(w) <= 128] if self.mark is not None else []
        groups = [plain[i : i + TOGETHER] for i in range(0, len(plain), TOGETHER)]
        joined = [f" {MARK} ".join(words[k] for k in g) for g in groups]
        for g, e in zip(groups, self.tokenizer.encode_batch_fast(joined, add_special_tokens=False), strict=True):
            ids = np.array(e.ids, dtype=self.dtype)
            marks = np.flatnonzero(ids == self.mark)
            if len(marks) == len(g) - 1:
                for k, a, b in zip(g, np.r_[0, marks + 1], np.r_[marks, len(ids)], strict=True):
                    out[k] = ids[a:b].tobytes()
        alone = [k for k, x in enumerate(out) if x is None]
        for k, e in zip(alone, self.tokenizer.encode_batch_fast([words[k] for k in alone], add_special_tokens=False), strict=True):
            out[k] = np.array(e.ids, dtype=self.dtype).tobytes()
        return out

    def _found(self, words: list[str]) -> list[bytes]:
        """Ids of different words; those that are kept, and the others' by the library."""
        memo = self.memo
        out = list(map(memo.get, words))
        if len(memo) > MEMO:
            memo.clear()
            memo.update((w, ids) for w, ids in zip(words, out, strict=True) if ids is not None)
            memo[""] = b""
        new = [k for k, ids in enumerate(out) if ids is None]
        for i in range(0, len(new), 4096):
            some = new[i : i + 4096]
            for k, ids in zip(some, self._ids([words[k] for k in some]), strict=True):
                out[k] = ids
                if len(words[k]) <= 128:
                    memo[words[k]] = ids
        return out

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, cuts): the ids of all texts, of which text k has those from cuts[k] to cuts[k + 1].

        Arrow splits the texts at spaces and line ends, as a tokenizer that drops white space encodes what is between on its
        own, and tells the different words; Python only sees each of those once.
        """
        texts = pc.replace_substring(texts, pattern="\n", replacement=" ")
        if self.plain:
            texts = pc.replace_substring_regex(texts, pattern=f"([A-Za-z])([{MARKS}])", replacement=r"\1 \2")
        split = pc.split_pattern(texts, pattern=" ")
        first = split.offsets.to_numpy()
        coded = split.flatten().dictionary_encode()
        found = self._found(coded.dictionary.to_pylist())
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // self.dtype.itemsize
        starts, code = np.cumsum(sizes) - sizes, coded.indices.to_numpy()
        held, n = np.frombuffer(b"".join(found), self.dtype), sizes[code]
        ends = np.r_[0, np.cumsum(n)]
        ids = held[np.repeat(starts[code] - ends[:-1], n) + np.arange(ends[-1])]
        return ids, ends[first - first[0]]

    def encode(self, texts: list[str]) -> list[bytes]:
        ids, cuts = self.encode_column(pa.array(texts, pa.string()))
        return [ids[a:b].tobytes() for a, b in pairwise(cuts)]


def sequence_schema(dtype: np.dtype, length: int) -> pa.Schema:
    """tokens: fixed_size_list of the id type; mask: fixed_size_list of 0/1, 0 only in the padding that ends a file."""
    return pa.schema([("tokens", pa.list_(pa.from_numpy_dtype(dtype), length)), ("mask", pa.list_(pa.uint8(), length))])


class StreamFileWriter:
    """Cuts a stream of ids into equal sequences and writes them as an Arrow stream file."""

    def __init__(self, sink, dtype: np.dtype, length: int = SEQUENCE, rows: int = BATCH_ROWS):
        self.length, self.rows, self.dtype = length, rows, dtype
        self.schema = sequence_schema(dtype, length)
        self.out = pa.ipc.new_stream(sink, self.schema)
        self.held: list[bytes] = []
        self.size = 0

    def add(self, ids: bytes) -> None:
        self.held.append(ids)
        self.size += len(ids)
        if self.size >= self.length * self.rows * self.dtype.itemsize:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.held), dtype=self.dtype)
        step = self.length * self.rows
        stop = len(ids) if last else len(ids) // step * step
        for i in range(0, stop, step):
            part = ids[i : min(i + step, stop)]
            n = -(-len(part) // self.length) * self.length
            mask = np.zeros(n, np.uint8)
            mask[: len(part)] = 1
            tokens = np.concatenate([part, np.zeros(n - len(part), self.dtype)]) if n > len(part) else part
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (tokens, mask)]
            self.out.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))
        rest = ids[stop:].tobytes()
        self.held, self.size = [rest] * bool(rest), len(rest)

    def close(self) -> None:
        self._flush(True)
        self.out.close()


class StreamFile:
    """Random access to the sequences of one file; over a memory map or buffer no id is copied."""

    def __init__(self, source):
        reader = pa.ipc.open_stream(source)
        self.batches = list(reader)
        self.length = reader.schema.field("tokens").type.list_size
        self.starts = np.cumsum([0, *(b.num_rows for b in self.batches)])
        self.n_sequences = int(self.starts[-1])

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, mask) of sequence i, as views of the file."""
        k = int(np.searchsorted(self.starts, i, "right")) - 1
        row = i - int(self.starts[k])
        b = self.batches[k]
        return tuple(b.column(c).values.to_numpy(zero_copy_only=True)[(b.column(c).offset + row) * self.length :][: self.length] for c in (0, 1))

    def ids(self, start: int, n: int) -> np.ndarray:
        """n ids from position ``start`` of the file's stream."""
        parts = []
        per = self.length
        while n > 0:
            k = int(np.searchsorted(self.starts, start // per, "right")) - 1
            values = self.batches[k].column(0).values.to_numpy(zero_copy_only=True)
            at = start - int(self.starts[k]) * per
            parts.append(values[at : at + n])
            got = len(parts[-1])
            start, n = start + got, n - got
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.uint16)


def write_token_files(
    docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text",
    sequence: int = SEQUENCE, per_file: int = DOCS_PER_FILE,
) -> DataFrame:
    """Encode every whole text, append ``end_id``, and write the ids in ascending id order below ``folder``.

    Each file holds a range of ids, so that files and tasks grow with the input. A task writes under a
    name of its own attempt; the manifest row names the file that counts, so a task that runs again
    does no harm. Returns the manifest (file_no, path, n_docs, n_tokens, index); index is an Arrow
    table of doc id and number of tokens. Null texts are empty (only the end id); null ids come
    first, repeated ids by text; an empty input writes no file. Ids must be integers.
    """
    ship_package(docs.sparkSession)
    kept = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    files = max(1, -(-kept.select("id").count() // per_file))
    # Ranges of ids ascend with the partition; equal ids share one, nulls are in the first.
    dealt = kept.repartitionByRange(files, F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), "text")
    dealt = dealt.withColumn("file_no", F.spark_partition_id())

    def run(batches):
        from pyarrow import fs

        encoder = PieceEncoder(tokenizer_path)
        writer = store = None
        for batch in batches:
            for some in slices([batch], 1024):
                if writer is None:
                    where, top = fs.FileSystem.from_uri(folder)
                    no = some.column("file_no")[0].as_py()
                    path = f"{top}/tokens-{no:06d}-{uuid.uuid4().hex}.arrows"
                    where.create_dir(top, recursive=True)
                    store = where.open_output_stream(path)
                    writer = StreamFileWriter(store, encoder.dtype, sequence)
                    ids, sizes = [], []
                found, cuts = encoder.encode_column(some.column("text"))
                writer.add(np.insert(found, cuts[1:], end_id).tobytes())
                sizes.extend((np.diff(cuts) + 1).tolist())
                ids.append(some.column("id"))
        if writer is not None:
            writer.close()
            store.close()
            index = pa.table({"id": pa.chunked_array(ids, pa.int64()), "n": pa.array(sizes, pa.int64())})
            buf = pa.BufferOutputStream()
            with pa.ipc.new_stream(buf, index.schema) as out:
                out.write_table(index)
            yield pa.RecordBatch.from_pylist(
                [{"file_no": no, "path": path, "n_docs": len(sizes), "n_tokens": sum(sizes), "index": buf.getvalue().to_pybytes()}],
                schema=pa.schema([("file_no", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("index", pa.binary())]),
            )

    return dealt.select("file_no", "id", "text").mapInArrow(run, MANIFEST)


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document, from the files that the manifest names.

    A file's start is the sum over the files before it; those are rows of the manifest, one a file.
    """
    ship_package(manifest.sparkSession)
    before = T.StructType([*manifest.schema.fields, T.StructField("before", T.LongType())])
    w = "coalesce(sum(n_tokens) over (order by file_no rows between unbounded preceding and 1 preceding), 0L)"
    starts = manifest.select("file_no", "n_tokens").select("file_no", F.expr(w).alias("before"))
    spread = manifest.join(starts, "file_no").select(*before.names)
    spread = spread.repartition(max(1, manifest.count()), "file_no")

    def run(batches):
        from pyarrow import fs

        where, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                index = pa.ipc.open_stream(row["index"]).read_all()
                source = pa.memory_map(row["path"]) if where.type_name == "local" else where.open_input_stream(row["path"])
                file = StreamFile(source)
                sizes = index["n"].to_numpy()
                at = np.cumsum(sizes) - sizes
                crc = [zlib.crc32(file.ids(int(a), int(n)).astype("<u4").tobytes()) for a, n in zip(at, sizes, strict=True)]
                for i in range(0, len(sizes), 10_000):
                    s = slice(i, i + 10_000)
                    yield pa.RecordBatch.from_arrays(
                        [index["id"].slice(i, 10_000).combine_chunks(), pa.array(at[s] + row["before"]), pa.array(sizes[s]), pa.array(crc[s], pa.int64())],
                        ["id", "start", "n_tokens", "ids_crc32"],
                    )

    return spread.mapInArrow(run, "id long, start long, n_tokens long, ids_crc32 long")


def token_store(
    docs: DataFrame, tokenizer_path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text",
    folder: str | None = None, sequence: int = SEQUENCE, per_file: int = DOCS_PER_FILE,
) -> DataFrame:
    """Write the token files, read them back, and return (id, start, n_tokens, ids_crc32) of every document."""
    spark: SparkSession = docs.sparkSession
    folder = folder or f"{ensure_checkpoint_dir(spark)}/tokens-{uuid.uuid4().hex}"
    manifest = write_token_files(docs, tokenizer_path, folder, end_id, id_col, text_col, sequence, per_file).checkpoint()
    return read_token_files(manifest, folder).withColumnRenamed("id", id_col)
