"""Token counts under a unigram vocabulary, without the tokens.

An Aho-Corasick automaton lists every piece of the vocabulary that ends at each character; the Viterbi
recurrence over these ends carries the best score and the number of pieces on that best path, and
nothing to walk back along. Text is cut before each blank, as the tokenizer's pre-tokenizer does, so
that each distinct word is worked out once a worker.
"""

import functools
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What stands for a blank in the vocabulary.
BLANK = "▁"
#: An unknown character scores so much less than the lowest piece.
UNKNOWN = 10.0


def zipf_vocabulary(model: str) -> list[tuple[str, float]]:
    """The pieces of a public sentencepiece file with Zipf's law for their log-probabilities.

    Merge-based vocabularies carry ranks and no probabilities; piece number r gets -ln(r + 1). Control
    and unknown pieces are left out, byte pieces serve unknown characters only and are left out too.
    """
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=model)
    return [(m.id_to_piece(i), -math.log(i + 1)) for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]


class Viterbi:
    """Best score and number of pieces of a word. Unknown characters count as their UTF-8 bytes.

    Of paths with equal scores to the same character, the one whose last piece begins first is kept,
    as the tokenizer keeps the first that it meets from the left.
    """

    def __init__(self, vocabulary: list[tuple[str, float]]):
        import ahocorasick

        self.auto = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self.auto.add_word(piece, (len(piece), score))
        self.auto.make_automaton()
        self.single = {piece for piece, _ in vocabulary if len(piece) == 1}
        self.unknown = min(score for _, score in vocabulary) - UNKNOWN

    def __call__(self, word: str) -> tuple[float, int]:
        n = len(word)
        best, count = [0.0] + [-math.inf] * n, [0] * (n + 1)
        at = 1  # the end that comes next
        for last, (length, score) in self.auto.iter(word):  # for each end, the longest first
            while at <= last:
                self._unknown(word, at, best, count)
                at += 1
            x = best[last + 1 - length] + score
            if x > best[last + 1]:
                best[last + 1], count[last + 1] = x, count[last + 1 - length] + 1
        while at <= n:
            self._unknown(word, at, best, count)
            at += 1
        return best[n], count[n]

    def _unknown(self, word: str, at: int, best: list[float], count: list[int]) -> None:
        """The shortest of the pieces that end before ``at``: the character alone, if unknown."""
        c = word[at - 1]
        if c not in self.single and (x := best[at - 1] + self.unknown) > best[at]:
            best[at], count[at] = x, count[at - 1] + len(c.encode("utf-8", "surrogatepass"))


@functools.lru_cache(maxsize=2)
def _counter(vocabulary: tuple[tuple[str, float], ...] | str, keep: int):
    viterbi = Viterbi(zipf_vocabulary(vocabulary) if isinstance(vocabulary, str) else list(vocabulary))

    class Words(dict):
        """Counts of the words met so far; all are forgotten when there are too many."""

        def __missing__(self, word: str) -> int:
            if len(self) >= keep:
                self.clear()
            self[word] = n = viterbi(BLANK + word)[1]
            return n

    words = Words()

    def count(text: str | None) -> int:
        if not text:
            return 0
        text = text.replace(BLANK, " ")
        return sum(map(words.__getitem__, (text[1:] if text[0] == " " else text).split(" ")))

    return count


def count_tokens(docs: DataFrame, vocabulary: str | list[tuple[str, float]], text_col: str = "text", to: str = "n_tokens", word_cache: int = 1_000_000) -> DataFrame:
    """``docs`` with the column ``to``: the number of pieces of each whole text.

    ``vocabulary``: pieces and their scores, or a public sentencepiece file (see zipf_vocabulary), which
    each worker then opens itself.

    Defined results: a null or empty text has 0 pieces; a leading blank stands for the one that the
    tokenizer sets before each text; all other columns and repeated rows stay as they are, except
    that a column that is named ``to`` is replaced. Nothing is shuffled.
    """
    given = vocabulary if isinstance(vocabulary, str) else tuple(vocabulary)

    @F.pandas_udf("long")
    def pieces(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = _counter(given, word_cache)
        for texts in batches:
            yield pd.Series([count(x) for x in texts], dtype="int64")

    return docs.withColumn(to, pieces(F.col(text_col).cast("string")))
