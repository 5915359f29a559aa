"""Token counts under a unigram vocabulary, without building the tokens.

Per distinct word, an Aho-Corasick automaton enumerates every vocabulary entry that ends at each
character; dynamic programming carries the best score and the number of pieces, and nothing else.
Ties follow the tokenizer: a later candidate replaces an earlier one only with a strictly higher
score, candidates come with ascending start, and the unknown character comes last. Runs of unknown
characters fuse into one piece, or fall back to their bytes.

A text's words are ``[^\\x20\\x09-\\x0D]+``, each with the space mark in front. Defined results: a
null or empty text has 0 tokens; repeated rows are counted each; an empty table gives no rows.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from cargoscope.llm.batches import bound_batches, by_bytes, kept_in_worker, span_sums
from cargoscope.llm.shingles import split_words

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SPACE = "▁"
#: What the tokenizer puts an unknown character below its lowest score.
UNKNOWN_PENALTY = 10.0
#: Words a worker remembers before it starts over.
MAX_WORDS = 1_000_000


def read_vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece model file, in id order."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class Counter:
    """Pieces per word; ``byte_fallback`` as in the tokenizer file."""

    def __init__(self, vocabulary: list[tuple[str, float]], byte_fallback: bool = True):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in dict(vocabulary).items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in vocabulary) - UNKNOWN_PENALTY
        known = {piece for piece, _ in vocabulary}
        self.bytes_known = byte_fallback and all(f"<0x{b:02X}>" in known for b in range(256))
        self.known: dict[str, int] = {}

    def count(self, word: str) -> int:
        """Pieces of one word on the best path."""
        n = len(word)
        best = [0.0] * (n + 1)
        pieces = [0] * (n + 1)
        fused = [False] * (n + 1)  # the best path to here ends in an unknown character
        matches: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for end, (length, score) in self.automaton.iter(word):
            matches[end + 1].append((length, score))
        for end in range(1, n + 1):
            top, how, own = None, 0, False
            for length, score in matches[end]:  # longest first: starts ascend
                value = score + best[end - length]
                if top is None or value > top:
                    top, how = value, length
                own = own or length == 1
            if not own:
                value = self.unknown + best[end - 1]
                if top is None or value > top:
                    top, how = value, 0
            best[end] = top
            if how:
                pieces[end] = pieces[end - how] + 1
            elif self.bytes_known:
                pieces[end] = pieces[end - 1] + len(word[end - 1].encode())
            else:
                pieces[end] = pieces[end - 1] + (not fused[end - 1])
                fused[end] = True
        return pieces[n]

    def counts(self, words: list[str]) -> np.ndarray:
        if len(self.known) > MAX_WORDS:
            self.known = {}
        known, out = self.known, np.empty(len(words), np.int64)
        for i, word in enumerate(words):
            got = known.get(word)
            if got is None:
                got = known[word] = self.count(SPACE + word)
            out[i] = got
        return out


def _counting(path: str, byte_fallback: bool):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = kept_in_worker(f"unigram:{path}:{byte_fallback}", lambda: Counter(read_vocabulary(path), byte_fallback))
        for batch in batches:
            for part in by_bytes(batch, "text"):
                text = part.column("text")
                words, offsets = split_words(text)
                coded = words.dictionary_encode()
                each = counter.counts(coded.dictionary.to_pylist())
                tokens = span_sums(each[coded.indices.to_numpy()] if len(words) else each, offsets)
                chars = pc.fill_null(pc.utf8_length(text), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), chars, pa.array(np.diff(offsets).astype(np.int64)), pa.array(tokens)],
                    ["doc_id", "n_chars", "n_words", "n_tokens"],
                )

    return count


def token_counts(docs: DataFrame, vocabulary_path: str, *, byte_fallback: bool = True) -> DataFrame:
    """Per document: characters, words and tokens of its whole text."""
    bound_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        _counting(vocabulary_path, byte_fallback), f"doc_id {kind}, n_chars long, n_words long, n_tokens long"
    )
