"""Words and word runs as 64-bit numbers, for whole batches of documents at a time."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext

MIX = np.uint64(0x9E3779B97F4A7C15)
SLICE_ROWS = 256  # rows of a batch that are Python objects at a time
CACHED_WORDS = 200_000  # distinct words a task remembers before it starts afresh


class WordNumbers(dict):
    """64-bit digest of a word's bytes, remembered."""

    def __init__(self, seed: int = 0):
        super().__init__()
        self.seed = seed

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word, self.seed)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > CACHED_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def blank_words(text: bytes | None) -> list[bytes]:
    """Words between ASCII white space (space, tab to carriage return) of UTF-8 text; none for null."""
    return text.split() if text else []


def lower_blank_words(text: bytes | None) -> list[bytes]:
    """The same with A-Z lower-cased and nothing else changed."""
    return text.lower().split() if text else []


def texts(batch: pa.RecordBatch) -> list[bytes | None]:
    """The texts of a batch, as a column or in the input rows it carries along as ``row``."""
    column = batch.column("text") if "text" in batch.schema.names else pc.struct_field(batch.column("row"), "text")
    return column.cast(pa.binary()).to_pylist()


class Chunk:
    """Some whole documents: their words end to end, as numbers, with the document of each."""

    def __init__(self, rows: list[dict], lists: list[list[bytes]], numbers: WordNumbers):
        self.rows, self.lists = rows, lists
        self.lengths = np.fromiter(map(len, lists), np.int64, len(lists))
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)]).astype(np.int64)
        self.owner = np.repeat(np.arange(len(lists)), self.lengths)
        self.numbers = numbers.of(list(itertools.chain.from_iterable(lists)))

    def grams(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Number of the run of ``size`` words at each position, and which of these lie in one document."""
        count = max(0, len(self.numbers) - size + 1)
        return grams(self.numbers, size), self.owner[:count] == self.owner[size - 1 :][:count]


def grams(numbers: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit number for each run of ``size`` entries, the same wherever the run stands."""
    count = max(0, len(numbers) - size + 1)
    out = np.full(count, size, np.uint64)
    for i in range(size):
        out ^= numbers[i : i + count]
        out *= MIX
        out ^= out >> np.uint64(29)
    return out


def chunks(
    batches: Iterator[pa.RecordBatch],
    split: Callable[[bytes | None], list[bytes]],
    keep: tuple[str, ...],
    most_words: int = 400_000,
    seed: int = 0,
) -> Iterator[Chunk]:
    """Whole documents in chunks of about ``most_words`` words; a longer document is a chunk of its own."""
    numbers, rows, lists, held = WordNumbers(seed), [], [], 0
    for batch in batches:
        for at in range(0, len(batch), SLICE_ROWS):
            some = batch.slice(at, SLICE_ROWS)
            columns = [some.column(name).to_pylist() for name in keep]
            for text, *values in zip(texts(some), *columns, strict=True):
                words = split(text)
                if lists and held + len(words) > most_words:
                    yield Chunk(rows, lists, numbers)
                    rows, lists, held = [], [], 0
                rows.append(dict(zip(keep, values, strict=True)))
                lists.append(words)
                held += len(words)
    if lists:
        yield Chunk(rows, lists, numbers)


def chunk_ids() -> Iterator[int]:
    """Numbers for the chunks of this task, the same when the task runs again."""
    context = TaskContext.get()
    return itertools.count((context.partitionId() if context else 0) << 32)


def pack(numbers: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of each number."""
    return np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def pack_short(numbers: np.ndarray) -> bytes:
    """Numbers in as many bytes as the largest needs; that width comes first."""
    width = max(1, -(-int(numbers.max(initial=0)).bit_length() // 8))
    return bytes([width]) + pack(numbers, width)


def unpack_short(data: bytes) -> np.ndarray:
    return unpack(data[1:], data[0])


def unpack(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return out.view("<u8").reshape(-1)
