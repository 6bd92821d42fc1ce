"""Token counts of a unigram tokenizer without its tokens: Aho-Corasick matches and a Viterbi pass that carries counts.

Counts are those of a sentencepiece unigram model with this vocabulary. The box has no such model file, only one of byte pair
encoding, and tokenizers aren't trained here. Its pieces are read as a unigram vocabulary: merges come in the order of frequency,
so a piece's rank gives its log-probability by the law of Zipf and Mandelbrot. A file of a unigram model keeps its own scores.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from argil.llm._text import read, slices

SPACE = "▁"
#: What an unknown character costs beyond the worst piece.
PENALTY = 10.0
#: Probability of a piece is in inverse proportion to its rank and so much more. Scores are multiples of a power of two, so that sums
#: are exact and ties don't hang on the order of additions.
OFFSET, UNIT = 100, 1024
#: Words whose counts a worker remembers, the first that it meets, and the longest that it does.
REMEMBERED, LONGEST = 1 << 19, 48
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
_CHUNK = re.compile(f"{SPACE}+[^{SPACE}]*")


@dataclass
class Vocabulary:
    """Pieces with scores, without control, unknown and byte pieces, which no text matches. With ``bytes_`` an unknown character gives a
    token for each of its UTF-8 bytes, else unknown characters in a row give one token together."""

    pieces: list[tuple[str, float]]
    bytes_: bool = True
    _machine: ahocorasick.Automaton | None = field(default=None, repr=False)
    _known: dict[str, int] = field(default_factory=dict, repr=False)

    def __post_init__(self) -> None:
        self._floor = min((s for _, s in self.pieces), default=0.0) - PENALTY
        self._ring = 1 << max((len(p) for p, _ in self.pieces), default=0).bit_length()
        # words are counted apart where no piece, and no run of unknown characters that is one token, goes over the beginning of one
        self._apart = all(SPACE not in p.lstrip(SPACE) for p, _ in self.pieces) and (self.bytes_ or any(p == SPACE for p, _ in self.pieces))

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_machine": None, "_known": {}}

    @staticmethod
    def load(path: str) -> Vocabulary:
        """Pieces of a sentencepiece model file that text can match. Scores below -100 are ranks of merges, not logarithms."""
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        chosen = [i for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
        scores = [float(m.get_score(i)) for i in chosen]
        if min(scores, default=0.0) < -100:
            scores = [-round(UNIT * math.log(OFFSET - s)) / UNIT for s in scores]
        return Vocabulary([(m.id_to_piece(i), s) for i, s in zip(chosen, scores)], any(m.is_byte(i) for i in range(m.get_piece_size())))

    def machine(self) -> ahocorasick.Automaton:
        if self._machine is None:
            self._machine = ahocorasick.Automaton()
            for piece, value in self.pieces:
                self._machine.add_word(piece, (len(piece), value))
            self._machine.make_automaton()
        return self._machine

    def count_chunk(self, chunk: str) -> int:
        """Tokens on the best path through a chunk, in which spaces are ``SPACE``.

        The path to each end is the one of highest score; of equal ones that whose last piece begins first, as pieces are tried in
        the order of where they begin and only a strictly better one replaces another. An unknown character comes last. Only as
        many states are held as the longest piece has characters, however long the chunk.
        """
        n, mask = len(chunk), self._ring - 1
        best, count, loose = [0.0] * (mask + 1), [0] * (mask + 1), [False] * (mask + 1)
        found = self.machine().iter(chunk) if self.pieces else iter(())
        end, piece = next(found, (n, None))
        for at in range(n):
            top, tokens, single, first, out = 0.0, 0, False, True, False
            while end == at:
                size, value = piece
                begin = at + 1 - size & mask
                value += best[begin]
                if first or value > top:
                    top, tokens, first = value, count[begin] + 1, False
                single |= size == 1
                end, piece = next(found, (n, None))
            if not single:
                begin = at & mask
                value = self._floor + best[begin]
                if first or value > top:
                    top = value
                    tokens = count[begin] + (len(chunk[at].encode()) if self.bytes_ else 0 if loose[begin] else 1)
                    out = True
            into = at + 1 & mask
            best[into], count[into], loose[into] = top, tokens, out
        return count[n & mask]

    def words(self, words: list[str]) -> list[int]:
        """Tokens of words, each with one ``SPACE`` before it. The first words are remembered, so that a frequent one is counted once."""
        counts = list(map(self._known.get, words))
        for i, c in enumerate(counts):
            if c is None:
                c = counts[i] = self.count_chunk(SPACE + words[i])
                if len(words[i]) <= LONGEST and len(self._known) < REMEMBERED:
                    self._known[words[i]] = c
        return counts

    def count(self, text: str | None) -> int:
        """Tokens of a text: a space is put before it, and spaces count as ``SPACE``."""
        if not text:
            return 0
        text = SPACE + text.replace(" ", SPACE)
        return sum(map(self.count_chunk, _CHUNK.findall(text) if self._apart else [text]))

    def column(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text of a column. Where one space parts any two words, a slice's distinct words are counted once."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        odd = pc.or_(pc.match_substring_regex(texts, f"(?s)^ |  | $|{SPACE}"), pc.equal(texts, "")).to_numpy(zero_copy_only=False)
        odd |= not self._apart
        out = np.zeros(len(texts), dtype=np.int64)
        for i in np.flatnonzero(odd).tolist():
            out[i] = self.count(texts[i].as_py())
        plain = np.flatnonzero(~odd)
        if len(plain):
            split = pc.split_pattern(texts.take(pa.array(plain)), " ")
            words = split.flatten().dictionary_encode()
            each = np.array(self.words(words.dictionary.to_pylist()), dtype=np.int64)[words.indices.to_numpy()]
            out[plain] = np.add.reduceat(each, split.offsets.to_numpy()[:-1] - split.offsets[0].as_py())
        return out


def count_tokens(docs: DataFrame, vocabulary: Vocabulary, text_column: str = "text", count_column: str = "n_tokens") -> DataFrame:
    """Add the number of tokens of each whole text; a null or empty text has none. A column of that name is replaced, unless it is the
    text's own, which is an error.

    No token is built, and a text of any length, with spaces or without, takes memory for its characters only. Nothing is shuffled; the
    vocabulary is broadcast, whose size the tokenizer fixes. Repeated rows and nulls in other columns pass through; no rows, no rows.
    """
    if text_column == count_column:
        raise ValueError("the count needs a column of its own")
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    rest = [c for c in docs.columns if c != count_column]
    place = rest.index(text_column)
    schema = docs.select(*rest).schema.add(count_column, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        for batch in batches:
            for part in slices(batch, text_column):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(words.column(part.column(place)))], names=schema.names)

    return docs.select(*rest).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str, model: str = MODEL) -> DataFrame:
    """op9: tokens of every document."""
    return count_tokens(read(spark, sf_dir, "documents").select("doc_id", "text"), Vocabulary.load(model)).select("doc_id", "n_tokens")
