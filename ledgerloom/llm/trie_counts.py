"""Token counts under a unigram vocabulary, with dynamic programming shared through a trie.

The distinct pre-tokens that a task meets go into a trie. The best score of a prefix
depends on the prefix alone, so the forward pass computes it once per trie node,
whichever and however many pre-tokens run through it; a pre-token's token count is
stored at the node where it ends. Documents then only sum the counts of their
pre-tokens. A trie that has grown full is dropped and begun anew, and below a certain
depth, which few pre-tokens reach, no nodes are kept, so memory is bounded.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pre-tokens whose counts a task remembers, and bytes of the longest one remembered; nodes of a trie, and its depth.
REMEMBERED, LONGEST, NODES, DEPTH = 1 << 19, 64, 1 << 19, 64
#: Marks the start of a pre-token in the vocabulary.
START = "▁"


def read_scores(path: str) -> dict[str, float]:
    """piece -> score of a sentencepiece vocabulary: minus the logarithm of its place, as a word's frequency falls with its rank.

    The file ranks its pieces but holds no probabilities. Control, unknown and byte
    pieces are left out.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    normal = (i for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    return {model.id_to_piece(i): -math.log(place + 2) for place, i in enumerate(normal)}


class Unigram:
    """Piece scores, and what a character that no piece covers costs: a token for each UTF-8 byte, below any piece's score."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.longest = max(map(len, scores), default=1)
        self.byte_score = min(scores.values(), default=0.0) - 10.0

    def step(self, end: str, before: list[tuple[float, int]]) -> tuple[float, int]:
        """The best (score, minus tokens) of a prefix that ends with `end`, from those of shorter prefixes, the empty one first.

        Of equal scores the one with fewer tokens, then the longer last token. `end`
        and `before` need to reach no further back than the longest piece.
        """
        n_bytes = len(end[-1].encode("utf-8", "surrogatepass"))
        score, tokens = before[-1]
        best = (score + n_bytes * self.byte_score, tokens - n_bytes)
        scores, n = self.scores, len(before)
        for back in range(min(self.longest, len(end)), 0, -1):
            piece = scores.get(end[-back:])
            if piece is not None:
                score, tokens = before[n - back]
                if (score + piece, tokens - 1) > best:
                    best = (score + piece, tokens - 1)
        return best


class Trie:
    """Nodes by (parent, character); each holds the forward score and token count of its prefix."""

    def __init__(self, unigram: Unigram):
        self.unigram = unigram
        self.children: dict[int, int] = {}
        self.forward: list[tuple[float, int]] = [(0.0, 0)]

    def tokens(self, word: str) -> int:
        """Tokens of the best-scoring split; characters below known nodes are computed, those above are not."""
        children, forward, unigram = self.children, self.forward, self.unigram
        node, before, longest = 0, [forward[0]], unigram.longest
        for depth, c in enumerate(word):
            if depth == DEPTH:
                break
            key = node << 21 | ord(c)
            node = children.get(key, 0)
            if not node:
                node = children[key] = len(forward)
                forward.append(unigram.step(word[max(0, depth + 1 - longest) : depth + 1], before))
            before.append(forward[node])
        for depth in range(DEPTH, len(word)):  # what no node holds
            before = before[-longest:]
            before.append(unigram.step(word[max(0, depth + 1 - longest) : depth + 1], before))
        return -before[-1][1]


def count_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_pretokens, n_distinct and n_tokens, one row per input row, over whole texts.

    Pre-tokens part at 0x20 and 0x09 to 0x0D and start with the vocabulary's mark.
    Null and empty texts have none. Bytes that aren't UTF-8 are read as U+FFFD. Scores
    are those of read_scores, made of a vocabulary's order. Repeated rows give repeated
    rows; other columns don't come out. The vocabulary, a file of fixed size, is all
    that is broadcast.
    """
    known = docs.sparkSession.sparkContext.broadcast(Unigram(read_scores(vocabulary)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[bytes, int] = {}
        trie = Trie(known.value)

        def tokens(word: bytes) -> int:
            nonlocal trie
            n = counts.get(word)
            if n is None:
                if len(trie.forward) > NODES:
                    trie = Trie(known.value)
                n = trie.tokens(START + word.decode(errors="replace"))
                if len(counts) < REMEMBERED and len(word) <= LONGEST:
                    counts[word] = n
            return n

        for pdf in batches:
            rows = []
            for text in pdf["text"]:
                c = Counter(text.split() if text is not None else ())
                rows.append((sum(c.values()), len(c), sum(n * tokens(w) for w, n in c.items())))
            yield pd.DataFrame(rows, columns=["n_pretokens", "n_distinct", "n_tokens"]).assign(id=pdf["id"])[["id", "n_pretokens", "n_distinct", "n_tokens"]]

    told = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("binary").alias("text"))
    return told.mapInPandas(run, "id string, n_pretokens long, n_distinct long, n_tokens long").select(F.col("id").cast("long").alias(id_col), "n_pretokens", "n_distinct", "n_tokens")
