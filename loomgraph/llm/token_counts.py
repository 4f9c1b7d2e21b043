"""Token counts: batches go through the tokenizer's own library, and only lengths come back.

Arrow batches are merged until they hold BATCH_BYTES of text, and cut there, so
what the library gets at once is of about equal size whatever the rows' lengths;
a longer text is alone. A text above SPLIT_BYTES is cut where no token can reach across: at a single space between two
characters that aren't spaces, when no piece of the vocabulary holds a space
after another character. The space itself becomes the mark that the library
puts before each text, so the parts' counts add up to the whole's. The check of
the vocabulary is made when the library is opened; where it fails, texts aren't cut.

Defined results: null counts as an empty text and has no tokens; special
strings in a text are ordinary text; nothing is truncated or padded; extra
columns pass through if kept; repeated rows count alike.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import common

BATCH_BYTES = 1 << 20
SPLIT_BYTES = 16 << 10
MODEL = "piece_bpe_32k.model"


class Counter:
    """One opened library: lengths of texts."""

    def __init__(self, name: str, path: str | None = None) -> None:
        import public_tokenizers

        path = path or public_tokenizers.path(name)
        self.cut_at = None
        if path.endswith(".model"):
            import sentencepiece

            processor = sentencepiece.SentencePieceProcessor(model_file=path)
            pieces = [processor.id_to_piece(i) for i in range(processor.get_piece_size())]
            plain = processor.encode("a  b ", out_type=str) and "".join(processor.encode("a  b ", out_type=str)) == "▁a▁▁b▁"
            if plain and not any("▁" in p.lstrip("▁") for p in pieces):
                self.cut_at = re.compile(r"(?<=[^ ]) (?=[^ ])")
            self.lengths = lambda texts: [len(x) for x in processor.encode(texts, num_threads=1)]
        else:
            import tokenizers

            tokenizer = tokenizers.Tokenizer.from_file(path)
            tokenizer.no_truncation()
            tokenizer.no_padding()
            tokenizer.encode_special_tokens = True
            self.lengths = lambda texts: [len(x) for x in tokenizer.encode_batch(texts, add_special_tokens=False)]

    def parts(self, text: str) -> list[str]:
        if self.cut_at is None or len(text) <= SPLIT_BYTES:
            return [text]
        out, low = [], 0
        while len(text) - low > SPLIT_BYTES:
            found = self.cut_at.search(text, low + SPLIT_BYTES)
            if not found:
                break
            out.append(text[low : found.start()])
            low = found.end()
        return [*out, text[low:]]

    def count(self, texts: list[str]) -> np.ndarray:
        parts, rows = [], []
        for row, text in enumerate(texts):
            own = self.parts(text) if text else []
            parts += own
            rows += [row] * len(own)
        return np.bincount(np.array(rows, np.int64), weights=self.lengths(parts), minlength=len(texts)).astype(np.int64) if parts else np.zeros(len(texts), np.int64)


@lru_cache(2)
def opened(name: str, path: str | None) -> Counter:
    return Counter(name, path)


def balanced(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The rows in batches of at least BATCH_BYTES of text, the last one excepted: short texts share a batch."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += int(common.text_buffers(batch.column(batch.schema.get_field_index(column)))[1][-1])
        if size >= BATCH_BYTES:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def count(documents: DataFrame, model: str = MODEL, path: str | None = None, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, then n_bytes and n_tokens of the text."""
    common.prepare(documents.sparkSession)
    frame = documents.select(*keep, F.col(text).alias("__text"))
    out_schema = frame.drop("__text").schema.add("n_bytes", "long", False).add("n_tokens", "long", False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = opened(model, path)
        for rows, _, offsets in common.texts(balanced(batches, "__text"), "__text", BATCH_BYTES):
            tokens = counter.count([x or "" for x in rows.column(rows.num_columns - 1).to_pylist()])
            yield pa.RecordBatch.from_arrays([*rows.columns[:-1], pa.array(np.diff(offsets)), pa.array(tokens)], names=[*rows.schema.names[:-1], "n_bytes", "n_tokens"])

    return frame.mapInArrow(common.released(run), out_schema)
