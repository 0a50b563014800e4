"""Encoding of a whole corpus with a public byte-level BPE, every distinct word once.

Method: texts are split into pre-tokens with their positions; the distinct words are shuffled and encoded once each, and
their ids are joined back and put together by position. Two things keep this small: a block of documents (a few MB of
text in one task) numbers its distinct words and keeps the positions as a sequence of these numbers, so a word crosses
the network once per block and not once per occurrence; and the occurrences of all blocks meet the word's ids in one
sort by word. The numbered blocks are written to the shared folder once.

The split follows the vocabulary's pattern, computed on arrays of character classes instead of by a regex engine:
``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``.
"""

from __future__ import annotations

import base64
import functools
import sys
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.session import written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes of text in a block, and in one step of the split.
BLOCK_BYTES = 8 << 20
STEP_BYTES = 1 << 20
OTHER, LETTER, NUMBER, SPACE, NONE = range(5)

# The characters with the Unicode property White_Space.
WHITE_SPACE = [*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@functools.cache
def class_runs() -> tuple[bytes, bytes]:
    """Runs of code points of one class, as lengths and classes; small enough to travel with a task."""
    space = set(WHITE_SPACE)
    kinds = {"L": LETTER, "N": NUMBER}
    cls = np.array([SPACE if i in space else kinds.get(unicodedata.category(chr(i))[0], OTHER) for i in range(0x110000)], np.uint8)
    at = np.flatnonzero(np.diff(cls, prepend=255))
    return np.diff(np.append(at, len(cls))).astype(np.int32).tobytes(), cls[at].tobytes()


def class_table(runs: tuple[bytes, bytes]) -> np.ndarray:
    return np.repeat(np.frombuffer(runs[1], np.uint8), np.frombuffer(runs[0], np.int32))


def _starts(cp: np.ndarray, first: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Where pre-tokens start, for the code points of texts that follow each other; ``first`` marks their first ones."""
    n = len(cp)
    cls = table[cp]
    before = np.empty(n, np.uint8)
    before[1:] = cls[:-1]
    before[first] = NONE
    last = np.append(first[1:], True)
    after = np.empty(n, np.uint8)
    after[:-1] = cls[1:]
    after[last] = NONE
    space = cls == SPACE
    follows_blank = np.zeros(n, bool)
    follows_blank[1:] = cp[:-1] == 0x20
    follows_blank &= ~first
    start = np.where(space, (before != SPACE) | ((after != SPACE) & (after != NONE)), (cls != before) & ~follows_blank)
    quote = np.flatnonzero(start & (cp == 0x27) & (after == LETTER))
    if len(quote):  # clitics: 's 't 'm 'd and 're 've 'll
        one = cp[quote + 1]
        short = np.isin(one, [ord(c) for c in "stmd"])
        two = np.where(after[quote + 1] == LETTER, cp[np.minimum(quote + 2, n - 1)], 0)
        long = ~short & (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")))
        start[quote[short | long] + 1] = False
        end = np.concatenate([quote[short] + 2, quote[long] + 3])
        end = end[end < n]
        start[end[~first[end]]] = True
    return start


def _steps(data: np.ndarray, offsets: np.ndarray) -> list[int]:
    """Byte positions that cut the data into steps: between texts, and in a very long text before white space that
    follows a printing ASCII character, where a pre-token ends whatever comes before."""
    cuts, at = [0], 0
    end = int(offsets[-1])
    while end - at > STEP_BYTES:
        want = at + STEP_BYTES
        k = int(offsets[np.searchsorted(offsets, want, "right") - 1])
        if k <= at:
            stop = int(offsets[np.searchsorted(offsets, want, "left")])
            piece = data[want - 1 : stop]
            ok = np.flatnonzero(((piece[1:] == 0x20) | (piece[1:] == 0x0A)) & (piece[:-1] > 0x20) & (piece[:-1] < 0x7F))
            k = want + int(ok[0]) if len(ok) else stop
        cuts.append(k)
        at = k
    return [*cuts, end] if end > cuts[-1] else cuts


def word_starts(cp: np.ndarray, first: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Where runs of letters and numbers, and the runs between them, start."""
    word = (table[cp] == LETTER) | (table[cp] == NUMBER)
    start = first.copy()
    start[1:] |= word[1:] != word[:-1]
    return start


def split(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, starts=_starts) -> np.ndarray:
    """Byte positions at which pre-tokens start, for UTF-8 texts that lie at ``offsets`` in ``data``."""
    out = []
    cuts = _steps(data, offsets)
    for a, b in zip(cuts, cuts[1:]):
        part = data[a:b]
        cp = np.frombuffer(part.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        at = np.flatnonzero((part & 0xC0) != 0x80)
        first = np.zeros(len(cp), bool)
        docs = offsets[np.searchsorted(offsets, a) : np.searchsorted(offsets, b)] - a
        first[np.searchsorted(at, docs)] = True
        first[0] = True
        out.append(at[starts(cp, first, table)] + a)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its offsets from 0; nulls are empty."""
    s = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(s.buffers()[1], np.int64)[s.offset : s.offset + len(s) + 1]
    data = np.frombuffer(s.buffers()[2], np.uint8) if s.buffers()[2] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(data: np.ndarray, starts: np.ndarray) -> pa.DictionaryArray:
    """The pieces of the data between starts, each distinct one once and their numbers in order."""
    bounds = np.append(starts, len(data)).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data)]).dictionary_encode()


def _numbered(runs, id_type: pa.DataType):
    """Batches of (id, text) -> word rows and text rows of blocks."""

    def block(name: int, ids: pa.Array, text: pa.Array, table: np.ndarray):
        data, offsets = texts_of(text)
        starts = split(data, offsets, table)
        words = pieces(data, starts)
        numbers, n_words, n = words.indices.to_numpy(), len(words.dictionary), len(ids)
        width = 2 if n_words <= 1 << 16 else 4
        coded = numbers.astype(np.uint16 if width == 2 else np.uint32)
        at = (np.searchsorted(starts, offsets) * width).astype(np.int32)
        codes = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(at), pa.py_buffer(coded)])
        yield rows(name, 0, np.arange(n_words), pa.nulls(n_words, id_type), words.dictionary.cast(pa.binary()), width)
        yield rows(name, 1, np.arange(n) + (1 << 40), ids, codes, width)

    def rows(name, kind, at, ids, body, width):
        n = len(at)
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, name, np.int64)), pa.array(np.full(n, kind, np.int32)), pa.array(at.astype(np.int64)), ids, body, pa.array(np.full(n, width, np.int32))], names=["block", "kind", "at", "id", "body", "width"])

    def number(batches):
        k, table = TaskContext.get().partitionId() << 32, class_table(runs)
        for b in batches:
            sizes = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(b.column(1)), 0).to_numpy())
            i = 0
            while i < b.num_rows:
                done = sizes[i - 1] if i else 0
                j = max(i + 1, int(np.searchsorted(sizes, done + BLOCK_BYTES, "right")))
                yield from block(k, b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), table)
                i, k = j, k + 1

    return number


def load_ranks(path: str | None = None) -> bytes:
    """The rank file of the vocabulary; the installed byte_bpe_50k if no path is given."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        return f.read()


def encoding(ranks: bytes):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
    return tiktoken.Encoding("bpe", pat_str=r"[\s\S]+", mergeable_ranks=table, special_tokens={})  # words come split


def _word_ids(ranks: bytes):
    """Rows (block, at, word) sorted by word -> (block, at, ids); each distinct word is encoded once."""

    def run(batches):
        bpe, last, ids = None, None, b""
        for b in batches:
            bpe = bpe or encoding(ranks)
            d = b.column(2).dictionary_encode()
            out = []
            for w in d.dictionary.to_pylist():
                if w != last:
                    ids, last = np.array(bpe.encode_ordinary(w.decode("utf-8")), np.int32).tobytes(), w
                out.append(ids)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary()).take(d.indices)], names=["block", "at", "body"])

    return run


def _put_together(lengths_only: bool):
    """Rows sorted by block and at: first the ids of a block's words, then its texts -> (id, ids or their number)."""

    def texts(b: pa.RecordBatch, flat, start, size):
        width = b.column(4)[0].as_py()
        bodies = b.column(3)
        raw = np.frombuffer(b"".join(bodies.to_pylist()), np.uint16 if width == 2 else np.uint32)
        n = pa.compute.binary_length(bodies).to_numpy() // width
        lens = size[raw]
        total = np.concatenate([[0], np.cumsum(lens)])
        at = total[np.concatenate([[0], np.cumsum(n)])]
        if lengths_only:
            out = pa.array(np.diff(at).astype(np.int64))
        else:
            where = np.repeat(start[raw] - total[:-1], lens) + np.arange(total[-1])
            out = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(flat[where]))
        return pa.RecordBatch.from_arrays([b.column(2), out], names=["id", "n_tokens" if lengths_only else "ids"])

    def run(batches):
        block, words, tables = None, [], None
        for b in batches:
            if not b.num_rows:
                continue
            names, ats = b.column(0).to_numpy(), b.column(1).to_numpy()
            edges = np.flatnonzero((np.diff(names) != 0) | (np.diff(ats >= 1 << 40) != 0)) + 1
            for i, j in zip([0, *edges], [*edges, b.num_rows]):
                if names[i] != block:
                    block, words, tables = names[i], [], None
                part = b.slice(i, j - i)
                if ats[i] < 1 << 40:
                    words += part.column(3).to_pylist()
                    continue
                if tables is None:
                    size = np.array([len(w) // 4 for w in words], np.int64)
                    tables = np.frombuffer(b"".join(words), np.int32), np.cumsum(size) - size, size
                step = 256
                for k in range(0, part.num_rows, step):
                    yield texts(part.slice(k, step), *tables)

    return run


def encode_corpus(docs: DataFrame, keep: str | list[str] = "doc_id", text_column: str = "text", ranks_path: str | None = None, lengths_only: bool = False) -> DataFrame:
    """One row per row of ``docs``: the columns to keep and ``ids``, the token ids of the whole text without special tokens.

    With ``lengths_only``, ``n_tokens`` (bigint) stands in place of ``ids``. A null or empty text has an empty list; a
    repeated or null id gives a row each time; an empty table gives none. Strings of special tokens are ordinary text.
    Columns not named are not looked at. No document or word is cut short, however long.
    """
    keep = [keep] if isinstance(keep, str) else list(keep)
    ranks = load_ranks(ranks_path)
    d = docs.select(F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(keep)]).alias("id"), F.col(text_column).cast("string").alias("text"))
    kind = dict(d.dtypes)["id"]
    blocks = written(d.mapInArrow(_numbered(class_runs(), to_arrow_type(d.schema["id"].dataType)), f"block long, kind int, at long, id {kind}, body binary, width int"))
    words = blocks.filter("kind = 0").select("block", "at", "body").repartition("body").sortWithinPartitions("body").mapInArrow(_word_ids(ranks), "block long, at long, body binary")
    texts = blocks.filter("kind = 1").select("block", "at", "id", "body", "width")
    both = words.select("block", "at", F.lit(None).cast(kind).alias("id"), "body", F.lit(0).alias("width")).unionByName(texts)
    out = both.repartition("block").sortWithinPartitions("block", "at").mapInArrow(_put_together(lengths_only), f"id {kind}, " + ("n_tokens long" if lengths_only else "ids array<int>"))
    return out.select(*[F.col(f"id.c{i}").alias(c) for i, c in enumerate(keep)], out.columns[1])


def decode_corpus(encoded: DataFrame, id_column: str = "doc_id", ids_column: str = "ids", ranks_path: str | None = None) -> DataFrame:
    """The texts of token ids: id and ``text``. The token-byte table has as many rows as the vocabulary and goes to
    every task for that reason. Null ids give a null text, an unknown id is an error."""
    ranks = load_ranks(ranks_path)

    def run(batches):
        table = {int(b): base64.b64decode(a) for a, b in (line.split() for line in ranks.splitlines() if line)}
        for b in batches:
            out = [None if x is None else b"".join([table[i] for i in x]).decode("utf-8", "replace") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["id", "text"])

    d = encoded.select(F.col(id_column).alias("id"), F.col(ids_column).alias("ids"))
    return d.mapInArrow(run, f"id {dict(d.dtypes)['id']}, text string").withColumnRenamed("id", id_column)
