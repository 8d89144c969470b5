"""Token counts under a unigram model, by dynamic programming shared over a trie of pre-tokens.

A pre-token is a word between ASCII white space with the vocabulary's word mark before it. The model scores a piece of
the given vocabulary by its rank, -ln(rank + OFFSET) (a Zipf-Mandelbrot law, nothing is trained), and a character in no piece by its UTF-8
bytes. Each worker inserts the distinct pre-tokens it meets in a trie; a node keeps the best forward score of its prefix
and the number of pieces that reach it, computed once however many pre-tokens share the prefix. The counts of terminals are
also kept by pre-token, so that one met again needs no walk, and both live as long as the worker does, not only for a task. The
trie is emptied when it reaches ``NODES`` and the counts when they reach ``WORDS``; pre-tokens over ``LONGEST`` characters are
computed without being kept, so memory is bounded. Documents are only mapped, nothing is shuffled.
"""

from __future__ import annotations

import gc
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
OFFSET = 10.0
BYTE_PENALTY = 10.0
NODES = 800_000
WORDS = 1_500_000
LONGEST = 256


@dataclass
class Unigram:
    scores: dict[str, float]
    longest: int
    byte_score: float


def load(path: str = VOCABULARY) -> Unigram:
    """The pieces of a sentencepiece file in the order of their ids, without control and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    scores = {p: -math.log(rank + OFFSET) for rank, p in enumerate(pieces)}
    return Unigram(scores, max(map(len, pieces)), -math.log(len(pieces) + OFFSET) - BYTE_PENALTY)


def tails(model: Unigram) -> dict:
    """The pieces as a trie read from their ends: letter -> [score of the piece that begins here or None, trie]."""
    root: dict = {}
    for piece, score in model.scores.items():
        at, entry = root, None
        for letter in reversed(piece):
            entry = at.setdefault(letter, [None, {}])
            at = entry[1]
        if entry:
            entry[0] = score
    return root


def extend(ends: dict, byte_score: float, token: str, end: int, best: list[float], count: list[int]) -> tuple[float, int]:
    """Best score and its number of pieces for ``token[:end]``, given those of all shorter prefixes; ties take fewer pieces.
    Pieces that end here are met by walking ``ends`` backwards, which stops where no piece goes on."""
    start = end - 1
    width = len(token[start].encode("utf-8", "surrogateescape"))
    top, pieces = best[start] + width * byte_score, count[start] + width
    while start >= 0:
        entry = ends.get(token[start])
        if entry is None:
            break
        score, ends = entry
        if score is not None:
            score += best[start]
            if score > top or (score == top and count[start] + 1 < pieces):
                top, pieces = score, count[start] + 1
        start -= 1
    return top, pieces


class Counter(dict):
    """UTF-8 word -> number of tokens; a miss walks and grows the trie."""

    def __init__(self, model: Unigram):
        super().__init__()
        self.ends, self.byte_score = tails(model), model.byte_score
        self.root, self.nodes = {}, 0

    def __missing__(self, word: bytes) -> int:
        token, best, count = MARK + word.decode("utf-8", "surrogateescape"), [0.0], [0]
        if len(token) > LONGEST:
            for end in range(1, len(token) + 1):
                top, pieces = extend(self.ends, self.byte_score, token, end, best, count)
                best.append(top)
                count.append(pieces)
            return count[-1]
        if self.nodes >= NODES:
            self.root, self.nodes = {}, 0
        if len(self) >= WORDS:
            self.clear()
        children = self.root
        for end, letter in enumerate(token, 1):
            node = children.get(letter)
            if node is None:
                node = children[letter] = (*extend(self.ends, self.byte_score, token, end, best, count), {})
                self.nodes += 1
            best.append(node[0])
            count.append(node[1])
            children = node[2]
        self[word] = count[-1]
        return count[-1]


_counters: dict[str, Counter] = {}


def _counter(name: str, model: Unigram) -> Counter:
    """The worker's counter for this model; there is one at a time."""
    if name not in _counters:
        _counters.clear()
        _counters[name] = Counter(model)
    return _counters[name]


def token_counts(docs: DataFrame, model: Unigram | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: (doc_id, n_words, n_tokens). Null and blank texts have none; a byte that is no UTF-8 is a
    character of its own, in no piece. Rows that repeat an id or a text are counted each; an empty table gives an empty one;
    other columns are not read."""
    sent, name = docs.sparkSession.sparkContext.broadcast(model or load()), uuid.uuid4().hex
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = _counter(name, sent.value).__getitem__
        collecting = gc.isenabled()
        gc.disable()  # the trie has no cycles, and looking for some takes longer than the scores
        try:
            for batch in batches:
                words, tokens = [], []
                for text in batch.column(1):
                    own = (text.as_py() or b"").split()
                    words.append(len(own))
                    tokens.append(sum(map(get, own)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], names=["doc_id", "n_words", "n_tokens"])
        finally:
            if collecting:
                gc.enable()

    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, n_words long, n_tokens long")
