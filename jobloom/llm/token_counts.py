"""Token counts by a unigram vocabulary, without building the tokens.

An Aho-Corasick automaton enumerates all pieces that end at each place; dynamic programming carries
the best score and how many pieces reach it. Ties: of equal scores the longest piece stands, as in the library,
which starts from the left and replaces only by a strictly better score. A character that is no piece scores the
least piece less ten, and neighbours of that kind count as one.

Where no piece has a word mark after another character, each distinct segment from mark to mark is
counted once. Edge cases: a null text counts as empty (0 tokens); rows and ids may repeat or be null, each row gives one row; an empty
table gives none; a very long text is one row's memory; other columns are not carried, so names cannot clash.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .piece_codec import MARK, REMEMBERED, _sliced, default_model

UNKNOWN_PENALTY = 10.0


def vocabulary(path: str) -> list[tuple[str, float]]:
    """The plain pieces of a model file with their scores."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = (i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)))
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in plain]


class Counter:
    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        self.single = {p for p, _ in pieces if len(p) == 1}
        self.apart = not any(MARK in p.lstrip(MARK) for p, _ in pieces)
        self.cut = re.compile(f"{MARK}+[^{MARK}]*")
        self.known: dict[str, int] = {}

    def best(self, text: str) -> int:
        """How many pieces the best segmentation of a normalised text has."""
        ends: list[list] = [[] for _ in text]
        for end, found in self.automaton.iter(text):
            ends[end].append(found)
        score, count, odd = [0.0], [0], [False]
        for at, matches in enumerate(ends):
            best, n, unknown = None, 0, False
            for length, value in sorted(matches, reverse=True):  # from the left: the longest first
                s = score[at + 1 - length] + value
                if best is None or s > best:
                    best, n, unknown = s, count[at + 1 - length] + 1, False
            if text[at] not in self.single:
                s = score[at] + self.unknown
                if best is None or s > best:
                    best, n, unknown = s, count[at] + (not odd[at]), True
            score.append(best)
            count.append(n)
            odd.append(unknown)
        return count[-1]

    def count(self, text: str) -> int:
        if not text:
            return 0
        normal = MARK + text.replace(" ", MARK)
        if not self.apart:
            return self.best(normal)
        segments, known = self.cut.findall(normal), self.known
        if len(known) > REMEMBERED:
            known.clear()
        for s in set(segments).difference(known):
            known[s] = self.best(s)
        return sum(map(known.__getitem__, segments))


_counters: dict[int, Counter] = {}


def counts(docs: DataFrame, pieces: list[tuple[str, float]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and n_tokens for each row. The vocabulary, of fixed size whatever the data, is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(pieces)
    kind, key = docs.schema[id_col].dataType.simpleString(), hash(tuple(pieces))

    def run(batches):
        if key not in _counters:
            _counters.clear()
            _counters[key] = Counter(shared.value)
        c = _counters[key]
        for b in _sliced(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.count(t or "") for t in b.column(1).to_pylist()], pa.int64())], ["id", "n_tokens"])

    return docs.select(docs[id_col], docs[text_col]).mapInArrow(run, f"id {kind}, n_tokens bigint").withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import read

    return counts(read(spark, sf_dir, "documents"), vocabulary(default_model()))
