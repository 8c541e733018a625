"""Token counts of a unigram vocabulary by a count-only Viterbi search.

An Aho-Corasick automaton lists the vocabulary pieces in a word, all ends in one pass. Dynamic programming carries the best
score and the number of tokens of the best segmentation up to every place; no segmentation is built. Tie rules are those
of the unigram model of the tokenizers library: at an end, pieces are tried from the longest to the shortest, and only a
strictly better score replaces the best one; a character that is no piece is an unknown piece of the least score minus 10,
and falls back to one token for each of its bytes.

Blanks become ``▁``, one is put in front, and words begin at every ``▁``. Words are scored separately, so the result of a
word is remembered.

The vocabulary is read from a SentencePiece file. Its scores are ranks of merges; ``unigram_scores`` derives log-probabilities
from ranks by Zipf's law, rounded to 1/1024, so that sums are exact in any order.

Defined cases: a null or empty text has no tokens and score 0; a very long word without blanks is searched in linear time;
control and unknown pieces of the file are no pieces here.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesync.llm.common import restored, shielded

BLANK = "▁"
WORD = re.compile(f"{BLANK}[^{BLANK}]*")
#: Scores are whole multiples of 1 / UNIT.
UNIT = 1024
UNKNOWN_PENALTY = 10
#: Words a Python worker remembers.
MEMORY = 300_000
#: A remembered word holds its tokens and its cost (negative score in units) in one number, so that sums stay in C.
SHIFT = 40


def unigram_scores(path: str) -> list[tuple[str, float]]:
    """Pieces of a SentencePiece file with scores by rank, in the order of the file; byte pieces are last in rank."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i))]
    ranked = [i for i in ids if not model.is_byte(i)] + [i for i in ids if model.is_byte(i)]
    rank = {i: r for r, i in enumerate(ranked)}
    return [(model.id_to_piece(i), -round(UNIT * math.log((rank[i] + 2) * math.log(len(ids) + 2))) / UNIT) for i in ids]


class Counter:
    """Tokens and score of texts."""

    def __init__(self, vocabulary: list[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self.automaton.add_word(piece, (len(piece), round(-score * UNIT)))
        self.automaton.make_automaton()
        self.unknown = max(round(-s * UNIT) for _, s in vocabulary) + UNKNOWN_PENALTY * UNIT
        self.single = {p for p, _ in vocabulary if len(p) == 1}
        self.known: dict[str, int] = {}

    def word(self, word: str) -> tuple[int, int]:
        """Tokens and cost of the best segmentation of a word; least cost is best score."""
        found: list[list[tuple[int, int]]] = [[] for _ in word]
        for end, piece in self.automaton.iter(word):
            found[end].append(piece)
        cost, tokens = [0], [0]
        for end, character in enumerate(word):
            best, count = None, 0
            for length, price in sorted(found[end], reverse=True):  # longest first, as the tie rule wants
                total = cost[end + 1 - length] + price
                if best is None or total < best:
                    best, count = total, tokens[end + 1 - length] + 1
            if character not in self.single:
                total = cost[end] + self.unknown
                if best is None or total < best:
                    best, count = total, tokens[end] + len(character.encode())
            cost.append(best)
            tokens.append(count)
        return tokens[-1], cost[-1]

    def text(self, text: str) -> tuple[int, int]:
        if not text:
            return 0, 0
        marked = text.replace(" ", BLANK)
        parts = WORD.findall(marked if marked[0] == BLANK else BLANK + marked)
        if len(self.known) > MEMORY:
            self.known = {}
        for part in set(parts).difference(self.known):
            tokens, cost = self.word(part)
            self.known[part] = tokens << SHIFT | cost
        # Costs add up below 2 ** SHIFT for fewer than 2 ** 24 words, so longer texts are added up in parts.
        total = [sum(map(self.known.__getitem__, parts[at : at + (1 << 20)])) for at in range(0, len(parts), 1 << 20)]
        return sum(t >> SHIFT for t in total), sum(t & (1 << SHIFT) - 1 for t in total)


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """One counter for each Python worker."""
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(unigram_scores(path))
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """Documents with ``n_tokens`` and ``token_score`` of their whole text; columns of these names are replaced."""

    @F.pandas_udf("n long, score double")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        count = counter(vocabulary)
        for batch in batches:
            found = [count.text(t) for t in batch]
            yield pd.DataFrame({"n": [n for n, _ in found], "score": [-c / UNIT for _, c in found]})

    named, (body,) = shielded(docs, text)
    rows = named.withColumn("found", counted(F.coalesce(body, F.lit(""))))
    return restored(rows, docs.columns, {"n_tokens": F.col("found.n"), "token_score": F.col("found.score")})
