"""Helpers the operators share: tables, scratch folders, words."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from duskwatch.session import shared_folder

#: The white space that separates words: the blank and \x09 to \x0D. ``bytes.split()`` cuts at exactly these.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
#: A-Z to a-z in UTF-8 bytes; other letters stay as they are.
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


#: Text that a task works on at once.
PIECE_BYTES = 2_000_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: The folder of the innermost ``scratch`` block, if any.
_FOLDER: ContextVar[str | None] = ContextVar("scratch", default=None)


def _written(df: DataFrame, folder: str | None, name: str) -> DataFrame:
    path = f"{folder or shared_folder(df.sparkSession) + '/llm'}/{name}-{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the folder all executors share and read back.

    Lineage ends here: a lost executor costs a read, not a recomputation, and row numbers given
    before stay what they were. Inside a ``scratch`` block the table goes with the block.
    """
    return _written(df, _FOLDER.get(), name)


def delete_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder on whatever file system it is."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """A folder for what ``settled`` writes inside the block, deleted when the block ends.

    Yields a function like ``settled`` for the tables that outlive the block: it writes them where
    the block itself stands, so that an outer block still clears them.
    """
    outer = _FOLDER.get()
    folder = f"{outer or shared_folder(spark) + '/llm'}/scratch-{uuid4().hex}"
    token = _FOLDER.set(folder)
    try:
        yield lambda df, name: _written(df, outer, name)
    finally:
        _FOLDER.reset(token)
        delete_folder(spark, folder)


def mixed(values):
    """A 64-bit finaliser over a numpy uint64 array: close inputs get unrelated outputs."""
    import numpy as np

    x = values.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class WordHashes:
    """64-bit hashes of words, remembered for the words of the current batches only."""

    def __init__(self, keep: int = 150_000):
        self.known: dict[bytes, int] = {}
        self.keep = keep

    def of(self, words: list[bytes]):
        import numpy as np
        from xxhash import xxh64_intdigest

        known = self.known
        if len(known) > self.keep:
            known.clear()
        for word in set(words).difference(known):
            known[word] = xxh64_intdigest(word)
        return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))


#: Bytes hashed at once, and the odd number whose powers weigh them.
HASHED, BASE = 1 << 18, 0x9E3779B97F4A7C15


def _powers(base: int, n: int):
    import numpy as np

    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def column_words(texts):
    """(hash, row, line) of every word of an Arrow column of texts, A-Z made small, in order; lines from 0 in each text.

    The hash is a polynomial of the word's bytes: a difference of two running sums, so that no word becomes
    a Python object. Sums are carried on from one run of bytes to the next: memory is bounded by the words.
    """
    import numpy as np
    import pyarrow as pa

    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, dtype=np.int64)
    size = int(offsets[-1] - offsets[0])
    data = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if size else np.zeros(0, dtype=np.uint8)
    offsets = offsets - offsets[0]
    inside = ~((data == 32) | (data >= 9) & (data <= 13))
    cut = np.zeros(size + 1, dtype=bool)  # before which bytes a text begins
    cut[offsets] = True
    starts = np.flatnonzero(inside & (cut[:-1] | np.r_[True, ~inside[:-1]])) if size else np.zeros(0, dtype=np.int64)
    ends = np.flatnonzero(inside & (cut[1:] | np.r_[~inside[1:], True])) + 1 if size else starts
    value = mixed(np.frombuffer(bytes(range(256)).translate(LOWER), dtype=np.uint8).astype(np.uint64) + np.uint64(1))
    back = pow(BASE, -1, 1 << 64)
    up, down = _powers(BASE, HASHED), _powers(back, HASHED)
    words = np.empty(len(starts), dtype=np.uint64)
    opened = np.empty(len(starts), dtype=np.uint64)  # the sum before the word
    carried, i, j = np.uint64(0), 0, 0
    for lo in range(0, size, HASHED):
        run = data[lo : lo + HASHED]
        scale = np.uint64(pow(BASE, lo, 1 << 64))
        sums = np.cumsum(np.r_[carried, value[run] * up[: len(run)] * scale], dtype=np.uint64)
        last_start, last_end = np.searchsorted(starts, lo + len(run)), np.searchsorted(ends, lo + len(run), "right")
        opened[i:last_start] = sums[starts[i:last_start] - lo]
        words[j:last_end] = sums[ends[j:last_end] - lo] - opened[j:last_end]
        carried, i, j = sums[-1], last_start, last_end
    for lo in range(0, size, HASHED):  # shift every word to place 0
        a, b = np.searchsorted(starts, (lo, lo + HASHED))
        words[a:b] *= down[starts[a:b] - lo] * np.uint64(pow(back, lo, 1 << 64))
    words = mixed(words + (ends - starts).astype(np.uint64))
    rows = np.searchsorted(offsets, starts, "right") - 1
    breaks = np.flatnonzero(data == 10)
    lines = np.searchsorted(breaks, starts) - np.searchsorted(breaks, offsets)[rows]
    return words, rows, lines


def windows(hashes, width: int):
    """The hash of every run of ``width`` consecutive words; of the whole sequence if it is shorter."""
    import numpy as np

    width = max(1, min(width, len(hashes)))
    n = len(hashes) - width + 1
    total = np.zeros(max(n, 0), dtype=np.uint64)
    for i in range(width):
        total = total * np.uint64(0x9E3779B97F4A7C15) + mixed(hashes[i : i + n] + np.uint64(i))
    return mixed(total)


def pieces(batch, text: int):
    """An Arrow batch cut into runs of rows with about two million bytes of text; a longer text is a run of its own.

    What tasks build from a text is many times its size: they build it for a piece, not for ten thousand rows.
    """
    held, start = 0, 0
    for row, value in enumerate(batch.column(text)):
        held += len(value.as_buffer()) if value.is_valid else 0
        if held >= PIECE_BYTES:
            yield batch.slice(start, row + 1 - start)
            held, start = 0, row + 1
    if start < batch.num_rows:
        yield batch.slice(start)


def arrow_map(df: DataFrame, text: str, keep: list[str], schema: str, make) -> DataFrame:
    """Apply ``make(list of texts) -> list of arrow arrays`` to Arrow batches of ``text``.

    The columns ``keep`` pass through unchanged; ``schema`` names all columns of the result. Nulls
    in ``text`` arrive as None.
    """
    import pyarrow as pa

    names = [f.strip().split(" ", 1)[0] for f in _fields(schema)]

    def run(batches):
        for whole in batches:
            at = whole.schema.get_field_index(text)
            for batch in pieces(whole, at):
                made = make(batch.column(at).to_pylist())
                kept = [batch.column(batch.schema.get_field_index(k)) for k in keep]
                yield pa.RecordBatch.from_arrays([*kept, *made], names=names)

    return df.mapInArrow(run, schema)


def _fields(schema: str) -> list[str]:
    """The fields of a DDL string, commas inside angle brackets left alone."""
    out, depth = [""], 0
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out
