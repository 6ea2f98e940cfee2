"""BPE encoding and decoding by tree concatenation.

A text longer than ``LEAF`` characters is cut into leaves, which are encoded
in parallel as rows of their own and dealt over all tasks.  The leaves of a
text are then joined in pairs, and the results in pairs, up a binary tree.  At
each join a window of words on both sides is encoded again.  Scanning for
words is memoryless at a word's start, so the window, which begins at the
start of a word that the left side found well before the join, finds the words
of the whole text; from the first of its word ends that the right side has as
well (and that lies well before the window's end) both go on alike.  If there
is none, the window doubles, up to both sides whole, so the result is exactly
that of the text encoded in one piece.

Ids, byte lengths and word starts are all that travels up the tree.  Short
texts are encoded where they are read and never shuffled, by the same fact: a
word never reaches over the place where white space follows other characters,
so a text is cut there, and each distinct part of a batch is encoded once (all
new ones as one text, told apart by their bytes).  That holds for a byte-level
tokenizer that finds words by its own pattern; others encode texts whole.
Ids are decoded by gathering the bytes of all tokens of a batch at once.  A
task has one thread, as its tokenizer's own threads would take other tasks'.

Rows: null texts count as empty and have no ids; repeated rows each give a
row; special tokens that stand in a text are encoded as the tokenizer file
says, as the library does by default.  Null doc_ids stay null.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, shuffle_partitions, text_or_empty

LEAF = 65_536
WINDOW = 64
MARGIN = 4
BATCH = 256
# parts of texts whose ids a task keeps, and characters of the longest of them
KNOWN = 500_000
KNOWN_CHARS = 64
# Unicode white space.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
parts_of = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+").findall
WHITE = frozenset(re.findall(f"[{SPACE}]", "".join(map(chr, range(0x3001)))))


@lru_cache(maxsize=2)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    out = Tokenizer.from_file(path)
    out.no_truncation()
    out.no_padding()
    return out


@lru_cache(maxsize=2)
def byte_lengths(path: str) -> np.ndarray:
    """Bytes of each id.  In a byte-level vocabulary each character of a token is one byte."""
    t = tokenizer(path)
    out = np.zeros(t.get_vocab_size(with_added_tokens=True), dtype=np.int64)
    for token, i in t.get_vocab(with_added_tokens=False).items():
        out[i] = len(token)
    for i, token in t.get_added_tokens_decoder().items():
        out[i] = len(token.content.encode())
    return out


@lru_cache(maxsize=2)
def token_bytes(path: str) -> list[bytes]:
    """The bytes of each id.  Byte-level vocabularies write each byte as one letter, printable ones as themselves."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
    t = tokenizer(path)
    out = [b""] * t.get_vocab_size(with_added_tokens=True)
    for token, i in t.get_vocab(with_added_tokens=True).items():
        out[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
    return out


@lru_cache(maxsize=2)
def token_table(path: str) -> pa.Array:
    return pa.array(token_bytes(path), pa.large_binary())


def decoded(ids: np.ndarray, starts: np.ndarray, path: str) -> list[bytes]:
    """UTF-8 of what the library's byte-level decoder gives with skip_special_tokens=False, of the ids from each start to the next."""
    taken = token_table(path).take(pa.array(ids, pa.int64()))
    _, offsets, data = taken.buffers()
    if data is None:
        return [b""] * (len(starts) - 1)
    cuts = np.frombuffer(offsets, dtype=np.int64)[np.asarray(starts) + taken.offset].tolist()
    data = memoryview(data)
    return [str(data[a:b], "utf-8", "replace").encode() for a, b in zip(cuts, cuts[1:])]


def encode(text: str, path: str) -> list[int]:
    return tokenizer(path).encode(text, add_special_tokens=False).ids


@lru_cache(maxsize=2)
def cut_at_space(path: str) -> tuple[str, ...] | None:
    """The added tokens of a tokenizer whose words end where white space begins; None for any other tokenizer."""
    given = json.loads(tokenizer(path).to_str())
    words = given["pre_tokenizer"] or {}
    plain = words.get("type") == "ByteLevel" and words["use_regex"] and not words["add_prefix_space"]
    model = given["model"]
    if not plain or given["normalizer"] or model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "unk_token")):
        return None
    added = given["added_tokens"] or []
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(f"[{SPACE}]", t["content"]) for t in added):
        return None
    return tuple(t["content"] for t in added)


def encoded_texts(texts: list[str], path: str, known: dict[str, bytes]) -> list[bytes]:
    """The ids of each text as little-endian unsigned 32-bit integers.  ``known``: the ids of parts that came before."""
    added = cut_at_space(path)
    whole = [i for i, t in enumerate(texts) if added is None or any(a in t for a in added)]
    out = [b""] * len(texts)
    for i, e in zip(whole, tokenizer(path).encode_batch_fast([texts[i] for i in whole], add_special_tokens=False) if whole else ()):
        out[i] = np.array(e.ids, dtype="<u4").tobytes()
    if len(whole) == len(texts):
        return out
    if len(known) > KNOWN:
        known.clear()
    cut = {i: parts_of(t) for i, t in enumerate(texts)}
    for i in whole:
        del cut[i]
    new = set().union(*cut.values()).difference(known)
    # white space, then something else: one after the other these stay apart
    rest = [p for p in new if p[0] in WHITE and p[-1] not in WHITE]
    first = list(new.difference(rest))
    if first:
        known.update(zip(first, (np.array(e.ids, dtype="<u4").tobytes() for e in tokenizer(path).encode_batch_fast(first, add_special_tokens=False))))
    if rest:
        ids = np.array(tokenizer(path).encode_batch_fast(["".join(rest)], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = np.cumsum(byte_lengths(path)[ids])
        cuts = np.searchsorted(ends, np.cumsum([len(p.encode()) for p in rest])) + 1
        data, cuts = ids.tobytes(), (4 * cuts).tolist()
        known.update(zip(rest, [data[a:b] for a, b in zip([0, *cuts], cuts)]))
    for i, parts in cut.items():
        out[i] = b"".join(map(known.__getitem__, parts))
    for p in new:
        if len(p) > KNOWN_CHARS:
            del known[p]
    return out


@lru_cache(maxsize=2)
def known_parts(path: str) -> dict[str, bytes]:
    """What a worker knows of a tokenizer, from one task to the next."""
    return {}


class Piece:
    """A text with its ids, and for every word its first byte and its first id."""

    def __init__(self, data: bytes, ids: np.ndarray, starts: np.ndarray, firsts: np.ndarray):
        self.data, self.ids, self.starts, self.firsts = data, ids, starts, firsts


def encoded_piece(data: bytes, path: str) -> Piece:
    got = tokenizer(path).encode(data.decode("utf-8", "replace"), add_special_tokens=False)
    ids = np.array(got.ids, dtype=np.int64)
    ends = np.cumsum(byte_lengths(path)[ids])
    words = np.array([-1 if w is None else w for w in got.word_ids], dtype=np.int64)
    # a special token has no word of its own; it is a word here
    new = np.ones(len(ids), dtype=bool)
    new[1:] = (words[1:] != words[:-1]) | (words[1:] < 0)
    firsts = np.nonzero(new)[0]
    starts = np.concatenate(([0], ends))[firsts] if len(ids) else firsts
    return Piece(data, ids, starts, firsts)


def joined(a: Piece, b: Piece, path: str, window: int = WINDOW) -> Piece:
    """The piece of the two texts together, exactly as if it had been encoded whole."""
    if not len(a.data):
        return b
    if not len(b.data):
        return a
    data, cut = a.data + b.data, len(a.data)
    while True:
        left, right = len(a.starts) - window, window
        if left <= 0 or right >= len(b.starts):
            return encoded_piece(data, path) if left <= 0 and right >= len(b.starts) else _spliced(a, b, data, cut, max(0, left), min(right, len(b.starts)), path) or encoded_piece(data, path)
        if (got := _spliced(a, b, data, cut, left, right, path)) is not None:
            return got
        window *= 2


def _spliced(a: Piece, b: Piece, data: bytes, cut: int, left: int, right: int, path: str) -> Piece | None:
    """a up to its word ``left``, a window encoded anew, and b from a word that the window has too; else None."""
    begin = int(a.starts[left])
    end = cut + int(b.starts[right]) if right < len(b.starts) else len(data)
    mid = encoded_piece(data[begin:end], path)
    # the window itself must find a's words again before it leaves a
    again = mid.starts[: MARGIN + 1] + begin
    if left and not (len(again) > MARGIN and np.array_equal(again, a.starts[left : left + MARGIN + 1])):
        return None
    theirs = b.starts[:right] + cut
    last = len(mid.starts) - MARGIN if end < len(data) else len(mid.starts)
    for i in range(last):
        at = int(mid.starts[i]) + begin
        if at <= cut:
            continue
        j = bisect_left(theirs, at)
        if j < len(theirs) and theirs[j] == at:
            break
    else:
        return mid_to_end(a, mid, data, begin, left) if end == len(data) else None
    cut_a, cut_m, cut_b = int(a.firsts[left]), int(mid.firsts[i]), int(b.firsts[j])
    ids = np.concatenate((a.ids[:cut_a], mid.ids[:cut_m], b.ids[cut_b:]))
    starts = np.concatenate((a.starts[:left], mid.starts[:i] + begin, b.starts[j:] + cut))
    firsts = np.concatenate((a.firsts[:left], mid.firsts[:i] + cut_a, b.firsts[j:] - cut_b + cut_a + cut_m))
    return Piece(data, ids, starts, firsts)


def mid_to_end(a: Piece, mid: Piece, data: bytes, begin: int, left: int) -> Piece:
    """a up to its word ``left`` and the window, which reaches the end."""
    cut_a = int(a.firsts[left])
    return Piece(data, np.concatenate((a.ids[:cut_a], mid.ids)), np.concatenate((a.starts[:left], mid.starts + begin)), np.concatenate((a.firsts[:left], mid.firsts + cut_a)))


def tree(pieces: list[Piece], path: str) -> Piece:
    """All pieces joined in order, in pairs."""
    while len(pieces) > 1:
        pieces = [joined(pieces[i], pieces[i + 1], path) if i + 1 < len(pieces) else pieces[i] for i in range(0, len(pieces), 2)]
    return pieces[0]


def encode_by_tree(text: str, path: str, leaf: int = LEAF) -> list[int]:
    """Ids of a whole text, as the operator finds them."""
    if len(text) <= leaf:
        return encode(text, path)
    return tree([encoded_piece(text[i : i + leaf].encode(), path) for i in range(0, len(text), leaf)], path).ids.tolist()


def _digests(texts: list[bytes], path: str) -> tuple[list[int], list[str], list[str], np.ndarray, np.ndarray]:
    """Of texts given as ids in bytes: their numbers of ids, the digests of ids and of decoded texts, all ids, where each text's begin."""
    ids = np.frombuffer(b"".join(texts), dtype="<u4")
    n = [len(x) // 4 for x in texts]
    starts = np.concatenate(([0], np.cumsum(n, dtype=np.int64)))
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return n, [sha(x) for x in texts], [sha(x) for x in decoded(ids, starts, path)], ids, starts


def encoded(docs: DataFrame, path: str, leaf: int = LEAF, with_ids: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids]) of every row of ``docs``."""
    fields = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    names = [f.split()[0] for f in fields.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32())][: len(names)]

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = known_parts(path)
        for whole in batches:
            for start in range(0, whole.num_rows, BATCH):
                batch = whole.slice(start, BATCH)
                *found, ids, starts = _digests(encoded_texts(batch.column(1).to_pylist(), path, known), path)
                columns = [batch.column(0), *(pa.array(c, k) for c, k in zip(found, types[1:]))]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids.view("<i4"))))
                yield pa.record_batch(columns, names=names)

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, doc_id, at, n, text in zip(*(batch.column(i).to_pylist() for i in range(5))):
                p = encoded_piece(text.encode(), path)
                yield pa.record_batch(
                    [pa.array([row]), pa.array([doc_id], pa.int64()), pa.array([at], pa.int32()), pa.array([n], pa.int32()), pa.array([p.data], pa.binary())]
                    + [pa.array([x.astype(np.int32)], pa.list_(pa.int32())) for x in (p.ids, p.starts, p.firsts)],
                    names=["row", "doc_id", "leaf", "leaves", "data", "ids", "starts", "firsts"],
                )

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("leaf", kind="stable")
        pieces = [Piece(bytes(d), *(np.asarray(x, dtype=np.int64) for x in xs)) for d, *xs in zip(pdf["data"], pdf["ids"], pdf["starts"], pdf["firsts"])]
        ids = tree(pieces, path).ids
        n, own, back, *_ = _digests([ids.astype("<u4").tobytes()], path)
        return pd.DataFrame([[pdf["doc_id"].iloc[0], n[0], own[0], back[0]] + [ids.tolist()] * with_ids], columns=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("string").alias("text"))
    long = F.char_length("text") > leaf
    small = rows.where(~long).mapInArrow(short, fields)
    # a number for each long row; it is kept, so a lost executor can't deal it anew
    big = checkpointed(rows.where(long).withColumn("row", F.monotonically_increasing_id()))
    n = F.ceil(F.char_length("text") / leaf).cast("int")
    cut = big.select("row", "doc_id", "text", n.alias("leaves"), F.explode(F.sequence(F.lit(0), n - 1)).alias("leaf"))
    cut = cut.select("row", "doc_id", "leaf", "leaves", F.substring("text", F.col("leaf") * leaf + 1, F.lit(leaf)).alias("text"))
    cut = cut.repartition(shuffle_partitions(docs.sparkSession), "row", "leaf")
    pieces = cut.mapInArrow(leaves, "row long, doc_id long, leaf int, leaves int, data binary, ids array<int>, starts array<int>, firsts array<int>")
    return small.unionByName(pieces.groupBy("row").applyInPandas(merge, fields))


def query(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return encoded(docs, path, with_ids=False)
