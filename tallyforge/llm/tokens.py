"""Token counts: chunked encoding of huge texts with overlap resynchronisation."""

from __future__ import annotations

import re
from collections import ChainMap
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.batches import slices
from tallyforge.session import ship_package

#: Characters of a chunk, and of the overlap of two chunks at first.
CHUNK, OVERLAP = 1 << 13, 1 << 9
#: A boundary counts as stable if its chunk goes on for so many characters beyond it. A
#: pre-tokenizer decides on a boundary with a few characters of look-ahead, and an added token in
#: a text (such as an end mark) is shorter.
MARGIN = 64
#: Words whose ids one worker keeps; beyond it those of the rows at hand stay.
MEMO = 700_000
_workers: dict = {}
_lengths: dict = {}


def load(path: str):
    """The tokenizer of a file, once a worker; single-threaded, as Spark deals out the work."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    if path not in _workers:
        _workers[path] = Tokenizer.from_file(path)
    return _workers[path]


def _byte_lengths(tokenizer) -> np.ndarray | None:
    """Bytes of each id's token if tokens tile a text (byte-level, nothing normalized or added in front), else None."""
    import json

    if id(tokenizer) not in _lengths:
        kind = json.loads(tokenizer.pre_tokenizer.__getstate__()) if tokenizer.pre_tokenizer is not None else {}
        sizes = None
        if tokenizer.normalizer is None and kind.get("type") == "ByteLevel" and not kind.get("add_prefix_space"):
            added = tokenizer.get_added_tokens_decoder()
            sizes = np.zeros(max([*tokenizer.get_vocab().values(), -1]) + 1, np.int64)
            for token, k in tokenizer.get_vocab().items():
                # A byte is one character of the byte-level alphabet.
                sizes[k] = len(added[k].content.encode()) if k in added else len(token)
        _lengths[id(tokenizer)] = (tokenizer, sizes)
    return _lengths[id(tokenizer)][1]


def _cuts(tokenizer) -> bool:
    """Whether a space between two other characters always starts a word: the byte-level expression, and no added token that takes or holds one."""
    import json

    if _byte_lengths(tokenizer) is None or not json.loads(tokenizer.pre_tokenizer.__getstate__()).get("use_regex"):
        return False
    return not any(t.lstrip or t.rstrip or t.single_word or " " in t.content for t in tokenizer.get_added_tokens_decoder().values())


class PieceCounter:
    """Tokens of short texts by their pieces, each with the space before it; a piece is encoded once while it is kept."""

    def __init__(self, path: str):
        self.tokenizer = load(path)
        self.split = re.compile(r"(?<=\S) (?=\S)").split if _cuts(self.tokenizer) else lambda t: [t]
        self.memo, self.first = _workers.setdefault(("counts", path), ({}, {}))

    def _fill(self, memo: dict, pieces: set, before: str) -> dict:
        """The table with all pieces; longer ones are not kept."""
        if len(memo) > MEMO:
            kept = {p: memo[p] for p in pieces if p in memo}
            memo.clear()
            memo.update(kept)
        new = list(pieces - memo.keys())
        more = {}
        for i in range(0, len(new), 4096):
            some = new[i : i + 4096]
            for p, e in zip(some, self.tokenizer.encode_batch_fast([before + p for p in some], add_special_tokens=False), strict=True):
                (memo if len(p) <= 128 else more)[p] = len(e)
        return ChainMap(memo, more) if more else memo

    def count(self, texts: list[str]) -> list[int]:
        parts = [self.split(t) for t in texts]
        first = self._fill(self.first, {p[0] for p in parts}, "")
        rest = self._fill(self.memo, set(chain.from_iterable(p[1:] for p in parts)), " ")
        return [first[p[0]] + sum(map(rest.__getitem__, p[1:])) for p in parts]


def boundaries(tokenizer, text: str) -> tuple[np.ndarray, int]:
    """Offsets where words start in the encoded text, each with the number of tokens before it; and all tokens.

    Where tokens tile the text their bytes give the offsets, which takes less time than to list the library's.
    """
    e = tokenizer.encode(text, add_special_tokens=False)
    sizes = _byte_lengths(tokenizer)
    if sizes is not None:
        ends = np.cumsum(sizes[np.array(e.ids, dtype=np.int64)])
        data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        if len(data) == (ends[-1] if len(ends) else 0):
            starts = np.r_[0, ends[:-1]]
            if len(data) != len(text):
                starts = np.cumsum((data & 0xC0) != 0x80)[starts] - 1
        else:
            sizes = None
    if sizes is None:
        starts = np.array([s for s, _ in e.offsets], dtype=np.int64)
    words = np.nan_to_num(np.array(e.word_ids, dtype=np.float64), nan=-1)
    first = np.flatnonzero(np.r_[True, words[1:] != words[:-1]]) if len(words) else np.zeros(0, np.int64)
    return np.stack([starts[first], first], 1) if len(first) else np.zeros((0, 2), np.int64), len(e)


def count_long(tokenizer, text: str, chunk: int = CHUNK, overlap: int = OVERLAP, seen: list | None = None) -> int:
    """Tokens of a text, encoded in overlapping chunks, each once and with offsets.

    A chunk's counting starts at a proven word boundary of the whole text. The next chunk starts inside
    its end. A place where both start a word, with MARGIN characters of the earlier chunk beyond it, is a
    boundary of the whole text as well: the earlier chunk has seen all that decides on it, and from a
    common boundary on, both see the same text. There the counts are spliced, by the number of tokens
    that each has before it. If there is no such place, the overlap doubles, and with it the chunk; in the
    end it takes the rest of the text. ``seen`` gets the overlap that each seam took.
    """
    begin, size, total, lead, proven = 0, chunk, 0, 0, 0
    mine, n = boundaries(tokenizer, text[:size])
    while begin + size < len(text):
        width = overlap
        while True:
            end = begin + size
            if end >= len(text):
                return total + n - lead
            seam = max(begin, end - width)
            other, m = boundaries(tokenizer, text[seam : seam + size])
            own = mine[:, 0] + begin
            common = np.intersect1d(own[(own <= end - MARGIN) & (own > proven)], other[1:, 0] + seam)
            if len(common):
                break
            width *= 2
            if width > size // 2:
                size *= 2
                mine, n = boundaries(tokenizer, text[begin : begin + size])
        if seen is not None:
            seen.append(width)
        proven = int(common[-1])
        total += int(mine[np.searchsorted(own, proven), 1]) - lead
        lead = int(other[np.searchsorted(other[:, 0], proven - seam), 1])
        begin, mine, n = seam, other, m
    return total + n - lead


def token_counts(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024,
    chunk: int = CHUNK, overlap: int = OVERLAP,
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every whole text.

    Counts equal those of the tokenizer over the whole text, without added marks. A null text counts
    as empty (0 bytes, 0 tokens). Every input row gives one row, null and repeated ids included;
    extra columns are ignored. The file must be readable on every executor.
    """
    ship_package(docs.sparkSession)
    kept = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches):
        tokenizer, counter = load(tokenizer_path), PieceCounter(tokenizer_path)
        for some in slices(batches):
            texts = some.column(1).to_pylist()
            short = [k for k, t in enumerate(texts) if len(t) <= chunk]
            n = [0] * len(texts)
            for k, found in zip(short, counter.count([texts[k] for k in short]), strict=True):
                n[k] = found
            for k in set(range(len(texts))) - set(short):
                n[k] = count_long(tokenizer, texts[k], chunk, overlap)
            size = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64())], ["id", "n_bytes", "n_tokens"])

    kind = kept.schema["id"].dataType.simpleString()
    counted = kept.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
