"""Byte-level BPE encoding and decoding with tiktoken and a local rank file."""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsgrain.llm.common import lean, rank_file, slices, texts

#: Fixed value: the public pattern that splits text before merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Code points from which a text is encoded in parts, and from which a run of white space is one of its own.
PART, RUN = 1 << 16, 1 << 14
#: Fixed value: what the pattern's \\s matches (Unicode White_Space).
WHITE = "\t\n\v\f\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# White space can only begin a match of PATTERN, and no match has letters and ASCII digits together, so a match
# ends wherever one of these does; nothing in PATTERN looks behind.
_SAFE = re.compile(r"(?<=\S)(?=[ \n\r\t])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")


@functools.lru_cache(maxsize=4)
def encoding(path: str, pattern: str = PATTERN) -> tiktoken.Encoding:
    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, file))}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def parts(text: str, most: int = PART) -> Iterator[str]:
    """The text in parts of about `most` code points, cut only where a match ends; without such a place a part is longer."""
    at = 0
    while len(text) - at > most:
        cut = _SAFE.search(text, at + most)
        if not cut or cut.start() >= len(text):
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


@functools.lru_cache(maxsize=8)
def _long_run(least: int) -> re.Pattern:
    return re.compile(f"[{WHITE}]{{{least},}}")


def _whole(text: str, enc: tiktoken.Encoding) -> np.ndarray:
    return np.asarray(enc.encode_to_numpy(text, disallowed_special=()), np.uint32)


def encode(text: str, enc: tiktoken.Encoding, most: int = PART, run: int = RUN) -> np.ndarray:
    """Token ids, the same as encoding the whole text at once.

    A long run of white space never reaches the pattern, whose look-ahead would track back over all of it: a match begins
    where the run does and covers it but for its last character, or all of it at the end of the text. That match is merged
    as one piece.
    """
    if len(text) <= most:
        return _whole(text, enc)
    out, at = [], 0
    for found in _long_run(max(run, 2)).finditer(text):
        start, end = found.span()
        stop = end if end == len(text) else end - 1
        if at < start:
            out += [_whole(x, enc) for x in parts(text[at:start], most)]
        out.append(np.asarray(enc._core_bpe.encode_single_piece(text[start:stop].encode()), np.uint32))
        at = stop
    if at < len(text):
        out += [_whole(x, enc) for x in parts(text[at:], most)]
    return np.concatenate(out)


@functools.lru_cache(maxsize=1)
def _decimals(n: int) -> tuple[np.ndarray, np.ndarray]:
    width = len(str(n)) + 1
    table = np.frombuffer(b"".join(f"{i} ".encode().ljust(width, b"\0") for i in range(n)), np.uint8).reshape(n, width)
    return table, table != 0


def joined(ids: np.ndarray, n: int) -> bytes:
    """Decimal ids joined by one space."""
    table, used = _decimals(n)
    return table[ids][used[ids]].tobytes()[:-1]


def bpe(docs: DataFrame, path: str | None = None, with_ids: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Encodes every whole text and decodes it again; one row per row of docs, no shuffle.

    Columns: doc_id, n_tokens, ids_sha256, decoded_sha256, n_bytes, round_trip (the decoded bytes are the text's), if
    with_ids, ids array<int>, and the columns of docs named in keep. A null or empty text has no tokens and both digests of
    nothing; a null doc_id stays null; repeated rows give repeated rows; a table without rows gives none; other columns of
    docs are not read. A very long text is encoded in parts, whatever it consists of; it is held in memory as a whole, with
    its ids. The rank file is opened by each task, so it must lie at the same path on all machines.
    """
    path = path or rank_file()
    fields = ["doc_id long", "n_tokens long", "ids_sha256 string", "decoded_sha256 string", "n_bytes long", "round_trip boolean", *(["ids array<int>"] if with_ids else [])]
    rows = texts(docs, F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).alias(f"__{c}") for c in keep])
    kept = {c: rows.schema[f"__{c}"].dataType.simpleString() for c in keep}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        sha = lambda raw: hashlib.sha256(raw).hexdigest()
        for batch in batches:
            for part in slices(batch, 1 << 19):
                rows = []
                for text in part.column("text").to_pylist():
                    ids, raw = encode(text, enc), text.encode()
                    back = enc.decode_bytes(ids.tolist())
                    rows.append((len(ids), sha(joined(ids, enc.n_vocab)), sha(back), len(raw), back == raw, *([ids.astype(np.int32)] if with_ids else [])))
                columns = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.list_(pa.int32())]
                arrays = [pa.array(list(c), kind) for c, kind in zip(columns, kinds, strict=False)]
                own = [part.column(f"__{c}") for c in kept]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), *arrays, *own], [*(x.split()[0] for x in fields), *kept])
        encoding.cache_clear()  # quickly made again; idle workers do not hold it

    return rows.mapInArrow(lean(run), ", ".join([*fields, *(f"`{c}` {kind}" for c, kind in kept.items())]))


def decode(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """Raw bytes of each row's `ids`, and the text where they are UTF-8 (else null). Null ids give null."""
    path = path or rank_file()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for batch in batches:
            raws = [None if ids is None else enc.decode_bytes(ids) for ids in batch.column("ids").to_pylist()]
            said = []
            for raw in raws:
                try:
                    said.append(None if raw is None else raw.decode())
                except UnicodeDecodeError:
                    said.append(None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(raws, pa.binary()), pa.array(said, pa.string())], ["doc_id", "raw", "text"])

    return tokens.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(lean(run), "doc_id long, raw binary, text string")
