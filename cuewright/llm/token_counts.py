"""Token counts under a unigram model, computed on a trie of the distinct pre-tokens.

The best segmentation of a pre-token into pieces of a public vocabulary maximises the sum of piece
scores. Its forward scores depend on the beginning of the pre-token only, so the distinct pre-tokens
of a chunk of texts are inserted in a trie and each node is scored once, from the nodes on its path;
terminal nodes hold the token count, and a text's count is the sum over its pre-tokens.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuewright.session import ship_package

SPACE = "▁"


@dataclass
class Vocabulary:
    """Piece scores; characters without a piece cost one token per UTF-8 byte at ``unknown`` each."""

    scores: dict[str, float]
    unknown: float
    longest: int

    @staticmethod
    def of(scores: dict[str, float]) -> Vocabulary:
        return Vocabulary(scores, min(scores.values(), default=0.0) - 10.0, max(map(len, scores), default=1))


def load(model_file: str) -> Vocabulary:
    """The pieces of a public sentencepiece model; control, unknown and byte pieces are left out.

    The models at hand rank pieces by merge order, so a piece of rank r scores -log(r + 2): frequent
    pieces are cheap, and one long piece beats the pieces it is made of.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    kept = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    return Vocabulary.of({model.id_to_piece(i): -float(np.log(rank + 2)) for rank, i in enumerate(kept)})


@dataclass
class Trie:
    """Pre-tokens sharing beginnings; ``best`` and ``count`` are the forward values of each node."""

    vocabulary: Vocabulary
    step: dict[int, int] = field(default_factory=dict)
    best: list[float] = field(default_factory=lambda: [0.0])
    count: list[int] = field(default_factory=lambda: [0])
    terminal: dict[str, int] = field(default_factory=dict)

    def insert(self, word: str) -> int:
        """Token count of ``word``; nodes it shares with earlier words are not scored again.

        Of equal scores the segmentation with fewer tokens wins.
        """
        known = self.terminal.get(word)
        if known is not None:
            return known
        step, best, count = self.step, self.best, self.count
        scores, unknown, longest = self.vocabulary.scores, self.vocabulary.unknown, self.vocabulary.longest
        node, path = 0, [0]
        for end, char in enumerate(word, 1):
            at = node << 21 | ord(char)
            node = step.get(at, -1)
            if node < 0:
                single = len(char.encode("utf-8", "surrogatepass"))
                before = path[-1]
                top, fewest = best[before] + single * unknown, count[before] + single
                for begin in range(max(0, end - longest), end):
                    score = scores.get(word[begin:end])
                    if score is not None:
                        total, tokens = best[path[begin]] + score, count[path[begin]] + 1
                        if total > top or (total == top and tokens < fewest):
                            top, fewest = total, tokens
                node = step[at] = len(best)
                best.append(top)
                count.append(fewest)
            path.append(node)
        self.terminal[word] = count[node]
        return count[node]


def pre_tokens(text: str) -> Counter:
    """Words between white space, each with the space mark in front."""
    return Counter(SPACE + w for w in text.split())


NODES = 1_000_000


def token_counts(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_pre_tokens, n_tokens`` of every row of ``docs``.

    White space separates pre-tokens and is not counted itself; null, empty and blank texts have 0
    tokens. Repeated rows each get a row, a null id stays null. A task keeps its trie from text to
    text and starts a new one beyond ``NODES`` nodes, which changes no count.
    """
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # one public vocabulary file
    rows = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(shared.value)
        for batch in batches:
            totals, sizes = [], []
            for text in batch.column(1):
                if len(trie.best) > NODES:
                    trie = Trie(shared.value)
                found = pre_tokens(text.as_py())
                sizes.append(sum(found.values()))
                totals.append(sum(n * trie.insert(w) for w, n in found.items()))
            arrays = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(totals, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_pre_tokens", "n_tokens"])

    return rows.mapInArrow(run, f"doc_id {kind}, n_pre_tokens long, n_tokens long")
