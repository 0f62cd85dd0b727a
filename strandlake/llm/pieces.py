"""Encoding with a merge-type piece model by a prefix table, and decoding.

For each prefix of a chunk the table stores its last token. It is unique: of the tokens that an automaton finds ending
there it is the one that is compatible with the last token of the prefix before it, where two tokens are compatible
if merging their joined characters gives just these two. Following last tokens backwards gives the ids. Characters
outside the vocabulary fall back to their bytes and part the text.

Defined cases: null and empty texts have no ids; blanks are kept as they are; texts of any length are processed whole;
repeated rows give repeated results, an empty table an empty one; of merges with equal scores the leftmost comes first, as
in the library; only the id and text columns are read, so further ones cannot clash. A model that the table does not
cover, one with a normaliser, without the leading space mark or without bytes, raises ValueError.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .tokens import TextEncoder, piece_cuts

MARK = "▁"
#: Pairs whose compatibility a worker remembers at most.
MAX_PAIRS = 1 << 20


class PrefixTable:
    """``scores`` maps pieces to merge scores (higher merges first), ``ids`` to their ids; ``byte_ids`` has 256 ids."""

    def __init__(self, scores: dict[str, float], ids: dict[str, int], byte_ids: list[int]):
        import ahocorasick

        self.scores, self.ids, self.byte_ids = scores, ids, byte_ids
        self.pairs: dict[tuple[str, str], bool] = {}
        self.automaton = ahocorasick.Automaton()
        for piece in scores:
            if len(piece) == 1 or self.merged(piece) == [piece]:  # others are never made by merging
                self.automaton.add_word(piece, piece)
        self.automaton.make_automaton()

    def merged(self, text: str) -> list[str]:
        """The defining procedure: join the best-scored neighbours, the leftmost of equals, while there are any."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: str, right: str) -> bool:
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= MAX_PAIRS:
                self.pairs.clear()
            known = self.pairs[left, right] = self.merged(left + right) == [left, right]
        return known

    def encode(self, text: str) -> list[int]:
        last: list[str | None] = [None] * (len(text) + 1)
        done = [False] * (len(text) + 1)  # of a prefix whose last token is found
        pairs = self.pairs
        for end, token in self.automaton.iter(text):
            end += 1
            if done[end]:
                continue
            start = end - len(token)
            before = last[start]
            if before is None:
                fits = True
            else:
                fits = pairs.get((before, token))
                if fits is None:
                    fits = self.compatible(before, token)
            if fits:
                last[end], done[end] = token, True
        out: list[int] = []
        end = len(text)
        while end:
            token = last[end]
            if token is None:
                end -= 1
                out += [self.byte_ids[b] for b in reversed(text[end].encode())]
            else:
                out.append(self.ids[token])
                end -= len(token)
        out.reverse()
        return out


@lru_cache(maxsize=2)
def load(path: str) -> tuple:
    """(library processor, encoder) of a model file, once per worker process."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    probe = "Ａ ﬁ  é e\u0301 "
    if model.decode(model.encode(probe)) != probe or model.decode(model.encode(" x")) != " x" or not all(model.is_byte(model.piece_to_id(f"<0x{b:02X}>")) for b in range(256)):
        raise ValueError("this model changes its texts or has no bytes to fall back to")
    if model.id_to_piece(model.encode("a")[0])[0] != MARK:
        raise ValueError("this model puts no space mark before a text")
    size = model.get_piece_size()
    plain = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    scores = {model.id_to_piece(i): model.get_score(i) for i in plain}
    if any(MARK in piece.lstrip(MARK) for piece in scores):
        raise ValueError("this vocabulary has pieces with a space mark behind another character")
    table = PrefixTable(scores, {model.id_to_piece(i): i for i in plain}, [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)])

    def encode(chunks: list[bytes]) -> list[np.ndarray]:
        return [np.array(table.encode(c.decode("utf-8").replace(" ", MARK)), dtype=np.uint32) for c in chunks]

    return model, TextEncoder(encode, piece_cuts, lead=b" ")


def encode_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Per row: number of ids, digest of the ids, digest of the decoded text; ids and text too where asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, encoder = load(model_path)
        for batch in batches:
            for part in slices(batch, 256):
                ids = [x.tolist() for x in encoder.encode(part.column(1))]
                texts = model.decode(ids) if ids else []
                columns = [
                    part.column(0),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in texts], pa.string()),
                ]
                if with_ids:
                    columns += [pa.array(ids, pa.list_(pa.int32())), pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(columns)])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
