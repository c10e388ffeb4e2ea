"""Token counts of whole texts; huge texts are encoded in overlapping chunks and spliced.

A byte-pair encoder merges neighbouring symbols only into pieces of its vocabulary. So between
two characters that stand beside each other in no piece, no merge can ever cross: what lies on
either side is encoded alike with and without the rest. Such places are proven stable, and two
overlapping chunks may be spliced at one of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from dqspark.llm.common import ship

SPACE_MARK = "▁"
#: Characters of a chunk beyond the overlap, and of the first overlap tried.
CHUNK, OVERLAP = 20_000, 64


class PieceEncoder:
    """A SentencePiece byte-pair model with identity normalisation, and what can be proven of it."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        pieces = [self.model.id_to_piece(i) for i in range(n)]
        is_byte = [self.model.is_byte(i) for i in range(n)]
        #: Characters that begin in a token: continuation bytes begin none.
        self.chars = np.array([int(int(p[1:-1], 16) & 0xC0 != 0x80) if b else len(p) for p, b in zip(pieces, is_byte)])
        self.inner = np.array([b and int(p[1:-1], 16) & 0xC0 == 0x80 for p, b in zip(pieces, is_byte)])
        #: Pairs of characters side by side in some piece.
        self.pairs = {p[i : i + 2] for p, b in zip(pieces, is_byte) if not b for i in range(len(p) - 1)}

    def ids(self, text: str) -> list[int]:
        return self.model.encode(text, num_threads=1)

    def bounds(self, text: str, left: int, right: int) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of a chunk, and where in the text each begins (-1: within a character)."""
        ids = np.asarray(self.ids(text[left:right]), dtype=np.int64)
        ends = np.cumsum(self.chars[ids])
        starts = np.concatenate([[0], ends])[:-1] - 1 + left  # less the mark put before every chunk
        return ids, np.where(self.inner[ids], -1, starts)

    def stable(self, text: str, at: int) -> bool:
        """Whether no piece of the vocabulary can reach across this place."""
        return text[at - 1 : at + 1].replace(" ", SPACE_MARK) not in self.pairs

    def spliced(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> np.ndarray:
        """The tokens of a whole text, from overlapping chunks.

        ``done`` is the last splice. The next chunk starts ``overlap`` characters before the end
        of this one; the splice is the last stable place at which both begin a token. Where there
        is none the overlap is doubled, and once it spans the whole chunk, the chunk is.
        """
        out, begin, done, end = [], 0, 0, min(len(text), chunk)
        ids, starts = self.bounds(text, begin, end)
        while end < len(text):
            width, place = overlap, None
            while place is None and end - width > begin:
                left, right = end - width, min(len(text), end + chunk)
                next_ids, next_starts = self.bounds(text, left, right)
                common = np.intersect1d(starts, next_starts)
                common = common[(common > max(left, done)) & (common < end)]
                place = next((int(p) for p in common[::-1] if self.stable(text, int(p))), None)
                width *= 2
            if place is None:
                end = min(len(text), end + max(chunk, end - begin))
                ids, starts = self.bounds(text, begin, end)
                continue
            out.append(ids[self.first(starts, done) : self.first(starts, place)])
            ids, starts, begin, end, done = next_ids, next_starts, left, right, place
        out.append(ids[self.first(starts, done) :])
        return np.concatenate(out)

    @staticmethod
    def first(starts: np.ndarray, place: int) -> int:
        """The token that begins at a place; at 0, the first of all."""
        return int(np.flatnonzero(starts == place)[0]) if place else 0

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        short = [i for i, t in enumerate(texts) if len(t) <= CHUNK]
        counts = [0] * len(texts)
        for at in range(0, len(short), 256):
            part = short[at : at + 256]
            for i, ids in zip(part, self.model.encode([texts[i] for i in part], num_threads=1)):
                counts[i] = len(ids)
        for i, t in enumerate(texts):
            if len(t) > CHUNK:
                counts[i] = len(self.spliced(t))
        return counts


@lru_cache(maxsize=2)
def encoder(path: str) -> PieceEncoder:
    """One encoder per model file and worker."""
    return PieceEncoder(path)


def token_counts(docs: DataFrame, model: str, limit: int = 4096) -> DataFrame:
    """Per document: ``doc_id``, ``n_bytes``, ``n_tokens``, ``over_limit``.

    ``model`` is a SentencePiece byte-pair model that every executor can open. NULL texts count
    as empty: no bytes, no tokens. Nothing is shuffled; a worker holds one batch of rows, and the
    encoder never sees more than a chunk of a huge text. Repeated rows and ids of any kind are
    passed on; an empty table gives an empty one; other columns are not read.
    """
    ship(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n = encoder(model).count(texts)
            size = pa.array([len(t.encode()) for t in texts], pa.int64())
            over = pa.array([x > limit for x in n], pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), size, pa.array(n, pa.int64()), over], ["doc_id", "n_bytes", "n_tokens", "over_limit"]
            )

    schema = f"doc_id {id_type}, n_bytes bigint, n_tokens bigint, over_limit boolean"
    return docs.select(docs["doc_id"], docs["text"]).mapInArrow(count, schema)
