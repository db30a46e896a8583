"""Token ids of texts by a public byte-level BPE, cut at boundaries that no token crosses."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.plans.staging import free_name, spread

FOLDER = "/opt/tokenizers"
#: Fixed value: the pattern by which the rank files' texts are split before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Fixed value: the code points of Unicode white space.
WHITE = [*range(9, 14), 0x1C, 0x1D, 0x1E, 0x1F, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
APOSTROPHE = 0x27
_WHITE = frozenset(WHITE)


@lru_cache(maxsize=4)
def ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> id of a rank file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=4)
def encoder(path: str):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks(path), special_tokens={})


@lru_cache(maxsize=4)
def joined_bytes(path: str) -> np.ndarray:
    """256 x 256: whether some token holds the two bytes one after the other."""
    seen = np.zeros((256, 256), bool)
    for t in ranks(path):
        b = np.frombuffer(t, np.uint8)
        seen[b[:-1], b[1:]] = True
    return seen


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def certain_cuts(text: str, path: str) -> np.ndarray:
    """Positions p of text where encode(text) == encode(text[:p]) + encode(text[p:]) for sure.

    The bytes on both sides of p follow each other in no token, so no merge can cross p. The pattern splits the two parts as
    it splits the whole: before p stands no white space (whose runs look ahead), p starts with no apostrophe, and none of
    the two characters before p is one, so that contractions stay what they are.
    """
    c = code_points(text)
    if len(c) < 2:
        return np.zeros(0, np.int64)
    last = np.where(c < 0x80, c, 0x80 | (c & 0x3F))
    first = np.where(c < 0x80, c, np.where(c < 0x800, 0xC0 | (c >> 6), np.where(c < 0x10000, 0xE0 | (c >> 12), 0xF0 | (c >> 18))))
    quote = c == APOSTROPHE
    near = quote[:-1] | quote[1:]
    near[1:] |= quote[:-2]
    free = ~joined_bytes(path)[last[:-1], first[1:]] & ~np.isin(c[:-1], WHITE) & ~near
    return np.flatnonzero(free) + 1


#: Characters from which on a certain cut is looked for, and characters of a text whose parts are encoded by several tasks.
FRAGMENT, LONG = 512, 8192


@lru_cache(maxsize=4)
def _table(path: str) -> bytes:
    return joined_bytes(path).tobytes()


def next_cut(text: str, at: int, path: str) -> int:
    """The first of certain_cuts at or after position at > 0; the length of text if none comes. It looks no further than it must."""
    table, before = _table(path), ord(text[at - 1])
    for p in range(at, len(text)):
        c, a = ord(text[p]), before
        before = c
        last = a if a < 0x80 else 0x80 | (a & 0x3F)
        first = c if c < 0x80 else 0xC0 | (c >> 6) if c < 0x800 else 0xE0 | (c >> 12) if c < 0x10000 else 0xF0 | (c >> 18)
        if not table[last << 8 | first] and a not in _WHITE and a != APOSTROPHE != c and (p < 2 or text[p - 2] != "'"):
            return p
    return len(text)


def fragments(text: str, path: str, size: int = FRAGMENT) -> list[str]:
    """text cut at the first certain cut after each ``size`` characters: longer parts where none comes, whole if there is none."""
    out, at = [], 0
    while len(text) - at > size:
        cut = next_cut(text, at + size, path)
        out.append(text[at:cut])
        at = cut
    return [*out, text[at:]] if at < len(text) or not out else out


def encode_cut(text: str, path: str) -> list[int]:
    """Ids of text: of its fragments, one after another."""
    encode, ids = encoder(path).encode_ordinary, []
    for f in fragments(text, path):
        ids += encode(f)
    return ids


def _encode(path: str):
    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in it:
            yield pd.Series([encode_cut(t, path) if t else [] for t in texts])

    return F.pandas_udf(run, "array<int>").asNondeterministic()  # else a filter on the ids would encode once more


def encode_texts(df: DataFrame, text: str = "text", ids: str = "ids", tokenizer: str = "byte_bpe_50k", folder: str = FOLDER, size: int = LONG) -> DataFrame:
    """df with a column ids: the token ids of text, without special tokens (their strings are ordinary text).

    Forced-boundary splitting: two bytes that follow each other in no token of the vocabulary mark a certain cut. Every text
    is cut at the first certain cut after each FRAGMENT characters, the fragments are encoded one by one, and their ids put
    together: exactly those of the whole text. Of texts of more than ``size`` characters, parts of about that length (cut at
    certain cuts too) are spread over all tasks; equal ones are encoded once. A stretch without a certain cut stays in one
    fragment, whatever its length.

    An empty or null text gives an empty list. Rows, other columns and repeated rows stay as they are; a column already
    named like ids is replaced. folder holds the rank file <tokenizer>.tiktoken on every executor.
    """
    path = f"{folder}/{tokenizer}.tiktoken"
    base = spread(df.drop(ids))
    sha = free_name("_sha", df)
    is_long = F.length(text) > size
    short = base.where(F.coalesce(~is_long, F.lit(True))).withColumn(ids, _encode(path)(F.col(text)))
    keyed = base.where(is_long).withColumn(sha, F.sha2(F.col(text), 256))

    def cut(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for key, t in zip(pdf["__sha"], pdf["__t"]):
                parts = fragments(t, path, size)
                yield pd.DataFrame({"__sha": [key] * len(parts), "__no": range(len(parts)), "__part": parts})

    texts = keyed.groupBy(F.col(sha).alias("__sha")).agg(F.any_value(F.col(text)).alias("__t"))
    parts = texts.mapInPandas(cut, "__sha string, __no int, __part string").repartition("__sha", "__no")
    coded = parts.select("__sha", "__no", _encode(path)(F.col("__part")).alias("__ids"))
    whole = coded.groupBy("__sha").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("__no", "__ids"))), lambda x: x["__ids"])).alias(ids))
    return short.unionByName(keyed.join(whole.withColumnRenamed("__sha", sha), sha).drop(sha))
