"""Pieces of long texts, cut at natural boundaries, within a limit of tokens."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.tokens import FOLDER, LONG, WHITE, code_points, encode_cut, encode_texts, ranks
from quern.plans.staging import spread

#: Characters that end a sentence before white space, and those that end one anywhere.
ENDS, FULL_ENDS = [ord(c) for c in ".!?…;:"], [ord(c) for c in "。！？"]
LEVELS = ["hard", "char", "word", "sentence", "line", "paragraph"]
HARD, CHAR, WORD, SENTENCE, LINE, PARAGRAPH = range(6)


NEWLINE = [10, 13, 0x85, 0x2028, 0x2029]


@lru_cache(maxsize=1)
def kinds() -> np.ndarray:
    """Flags by code point up to 0xFFFF: 1 white space, 2 line end, 4 sentence end before white space, 8 sentence end anywhere."""
    out = np.zeros(1 << 16, np.uint8)
    for flag, points in ((1, WHITE), (2, NEWLINE), (4, ENDS), (8, FULL_ENDS)):
        out[points] |= flag
    return out


@lru_cache(maxsize=1)
def pair_levels() -> np.ndarray:
    """The kind of boundary between two characters, by the flags of the first (upper four bits) and of the second."""
    a, b = np.divmod(np.arange(256), 16)
    out = np.full(256, CHAR, np.int8)
    out[((b & 1) > 0) & ((a & 1) == 0)] = WORD
    out[(((a & 4) > 0) & ((b & 1) > 0)) | ((a & 8) > 0)] = SENTENCE
    out[((a & 2) > 0) & ((b & 2) == 0)] = LINE
    return out


def boundary_levels(text: str) -> np.ndarray:
    """For each byte offset of text in UTF-8, its end included, the strongest kind of boundary there (index into LEVELS)."""
    plain = text.isascii()
    c = np.frombuffer(text.encode(), np.uint8) if plain else code_points(text)
    level = np.full(len(c) + 1, CHAR, np.int8)
    if len(c) > 1:
        flags = kinds()[c if plain else np.minimum(c, 0xFFFF)]
        level[1:-1] = pair_levels()[(flags[:-1] << 4) | flags[1:]]
        breaks = np.flatnonzero(flags & 2)
        if len(breaks):
            gaps = np.flatnonzero(breaks[1:] != breaks[:-1] + 1)
            first, ends = np.concatenate([[0], gaps + 1]), breaks[np.concatenate([gaps, [len(breaks) - 1]])]
            level[ends[np.add.reduceat(c[breaks] == 10, first, dtype=np.int64) >= 2] + 1] = PARAGRAPH  # two line feeds in a run of line ends
    level[0] = level[-1] = PARAGRAPH
    if plain:
        return level
    raw = np.frombuffer(text.encode(), np.uint8)
    out = np.full(len(raw) + 1, HARD, np.int8)
    out[np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))] = level
    return out


def token_levels(texts: list[str], ids: list[np.ndarray], size: np.ndarray) -> tuple[bytes, list[tuple[np.ndarray, np.ndarray]]]:
    """The texts' bytes one after another, and for each text the offset there and the boundary level before each of its tokens
    and after the last. The texts are parted by a character that is no boundary, and looked at all at once."""
    joined = "\0".join(texts)
    n = np.array([len(x) for x in ids])
    first = np.concatenate([[0], np.cumsum(n + 1)])
    steps = np.ones(first[-1], np.int64)
    inner = np.ones(first[-1], bool)
    inner[first[:-1]] = False
    steps[inner] = size[np.concatenate(ids)]
    steps[0] = 0
    at = np.cumsum(steps)
    levels = boundary_levels(joined)[at]
    levels[first[:-1]] = levels[first[1:] - 1] = PARAGRAPH
    return joined.encode(), [(at[a:b], levels[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist())]


class boundaries(dict):
    """Sorted places of the boundaries of each kind or a stronger one; made when first asked for."""

    def __init__(self, levels: np.ndarray) -> None:
        self.levels = levels

    def __missing__(self, kind: int) -> list[int]:
        self[kind] = np.flatnonzero(self.levels >= kind).tolist()
        return self[kind]


def cut_points(levels: np.ndarray, limit: int, overlap: int, sorted_at: boundaries | None = None) -> list[tuple[int, int, str]]:
    """(start, end, kind of its end) of each piece; levels: the boundary level before each token and after the last.

    The end is the last paragraph end in the second half of the window of ``limit`` tokens, else the last line end there,
    sentence end, or word end; else the last of any of these after the overlap; else the last whole character; else the
    limit itself. The next piece starts ``overlap`` tokens before that end. Each is found by binary search.
    """
    n, start, out = len(levels) - 1, 0, []
    sorted_at = sorted_at or boundaries(levels)
    while n - start > limit:
        upto, half, least = start + limit, start + max(limit // 2, overlap), start + overlap
        for kind, after in ((PARAGRAPH, half), (LINE, half), (SENTENCE, half), (WORD, half), (WORD, least), (CHAR, least)):
            x = sorted_at[kind]
            i = bisect_right(x, upto)
            if i and x[i - 1] > after:
                end = x[i - 1]
                break
        else:
            end = upto
        out.append((start, end, LEVELS[levels[end]]))
        start = end - overlap
    return [*out, (start, n, "end")]


def split_long(df: DataFrame, limits: list[tuple[int, int, int]], key: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k", folder: str = FOLDER) -> DataFrame:
    """Pieces of the texts of more tokens than a limit; limits: (limit_id, max_tokens, overlap_tokens), each a task of its own.

    Gives limit_id, key, piece_no from 0, token_start, token_end, n_tokens, cut (what its end is), ids and piece_text. Every
    piece has at most max_tokens tokens; each but the first repeats exactly the last overlap_tokens tokens of the one before;
    without these repeats the ids of a text's pieces are its ids. Token offsets are prefix sums of the tokens' byte lengths;
    boundaries that fall between tokens form sorted arrays, searched as cut_points says. Where a hard cut parts the bytes of
    a character, piece_text shows U+FFFD for it; ids are always exact.

    Texts within the limit, empty and null texts give no piece. A repeated row gives its pieces again. A limit with a null
    or with overlap >= max_tokens is an error.
    """
    for i, most, over in limits:
        if most is None or over is None or not 0 <= over < most:
            raise ValueError(f"limit {i}: overlap {over} of {most} tokens")
    path = f"{folder}/{tokenizer}.tiktoken"
    texts = spread(df.where(F.length(text) > 0).select(F.col(key).alias("key"), F.col(text).alias("text")))
    short = texts.where(F.length("text") <= LONG).withColumn("ids", F.lit(None).cast("array<int>"))  # encoded where they are cut
    coded = short.unionByName(encode_texts(texts.where(F.length("text") > LONG), "text", "ids", tokenizer, folder))
    kind, least = df.schema[key].dataType.simpleString(), min((most for _, most, _ in limits), default=1 << 62)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = np.zeros(max(ranks(path).values()) + 1, np.int64)
        for t, i in ranks(path).items():
            size[i] = len(t)
        def cut(group: list[tuple[int, str, np.ndarray]], made: Pieces) -> None:
            raw, seen = token_levels([t for _, t, _ in group], [ids for _, _, ids in group], size)
            for (row, _, ids), (at, levels) in zip(group, seen):
                places = boundaries(levels)
                for lid, most, over in limits:
                    if len(ids) > most:
                        made.add(lid, row, ids, raw, at, levels, cut_points(levels, most, over, places))

        for batch in it:
            keys, made, group, waiting = batch.column("key"), Pieces(), [], 0
            for row, (t, given) in enumerate(zip(batch.column("text").to_pylist(), batch.column("ids"))):
                ids = np.asarray(given.values if given.is_valid else encode_cut(t, path), np.int32)
                if len(ids) > least:
                    group.append((row, t, ids))
                    waiting += len(ids)
                if waiting > 1 << 18 or group and row == len(keys) - 1:
                    cut(group, made)
                    group, waiting = [], 0
                if made.tokens > 1 << 20:
                    yield made.batch(keys)
                    made = Pieces()
            if made.tokens:
                yield made.batch(keys)

    return coded.mapInArrow(run, f"limit_id int, key {kind}, piece_no int, token_start int, token_end int, n_tokens int, cut string, ids array<int>, piece_text string").withColumnRenamed("key", key)


class Pieces:
    """Pieces of several texts as columns: no object for each of their tokens or characters."""

    def __init__(self) -> None:
        self.tokens, self.numbers, self.cuts, self.ids, self.texts = 0, [], [], [], []

    def add(self, limit: int, row: int, ids: np.ndarray, raw: bytes, at: np.ndarray, levels: np.ndarray, points: list[tuple[int, int, str]]) -> None:
        start, end = np.array([(a, b) for a, b, _ in points]).T
        torn = ((levels[start] == HARD) | (levels[end] == HARD)).tolist()
        for no, ((a, b, cut), x, y, hard) in enumerate(zip(points, at[start].tolist(), at[end].tolist(), torn)):
            self.numbers.append((limit, row, no, a, b))
            self.cuts.append(cut)
            self.ids.append(ids[a:b])
            part = raw[x:y]
            self.texts.append(part.decode(errors="replace").encode() if hard else part)
        self.tokens += int((end - start).sum())

    def batch(self, keys: pa.Array) -> pa.RecordBatch:
        limit, row, no, start, end = (pa.array(c) for c in np.array(self.numbers, np.int32).T.copy())
        n = np.concatenate([[0], np.cumsum([len(x) for x in self.ids])]).astype(np.int32)
        chars = np.concatenate([[0], np.cumsum([len(x) for x in self.texts])]).astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(n), pa.array(np.concatenate(self.ids)))
        texts = pa.StringArray.from_buffers(len(self.texts), pa.py_buffer(chars), pa.py_buffer(b"".join(self.texts)))
        columns = {"limit_id": limit, "key": keys.take(row), "piece_no": no, "token_start": start, "token_end": end, "n_tokens": pa.array(np.diff(n)), "cut": pa.array(self.cuts), "ids": ids, "piece_text": texts}
        return pa.RecordBatch.from_pydict(columns)
