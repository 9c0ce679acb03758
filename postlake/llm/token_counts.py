"""Token counts by trie-shared dynamic programming over unigram scores.

A text is cut into pre-tokens at white space (each begins with the mark U+2581).  Distinct pre-tokens, of whatever
length, are inserted into a trie in sorted order, that is, depth first: each node holds the best forward score of
its prefix and the number of tokens on that path, it is computed once, and only the path to the current word is in
memory.  The count at a word's last node is stored and added up over the texts that have the word.

Words that are frequent (the ``OFTEN`` most frequent of those that some stretch of text repeats) are scored once for
all documents, and every task gets their counts.  The others, which few tasks share, are scored by the task that meets
them, those of a batch of texts in one trie.  So no text and no word but those is shuffled.

Scores are unigram log probabilities by Zipf's law over the vocabulary's order:
-log(rank + RANK_OFFSET), less the log of their sum.  A character that no piece covers costs its UTF-8
bytes as tokens, at UNKNOWN below the lowest score each.  Equal scores: fewer tokens win.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlake.llm.streams import tidy
from postlake.runtime import Scratch, ship_package

MARK = "▁"
RANK_OFFSET, UNKNOWN = 3.0, 10.0
#: Words whose counts every task gets, and their longest; words that a task counts before it hands on those that it met
#: twice; words that a task scores; bytes of other words whose counts a task remembers (it forgets all beyond, but for those of the texts at hand); depth to which nodes of a path are kept for
#: the next word (deeper ones are computed again); steps of a doubling in the histogram of frequencies.
OFTEN, OFTEN_BYTES, HELD, SCORED, KNOWN, KEEP, STEPS = 200_000, 64, 200_000, 20_000, 40 << 20, 1_024, 16


def public_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@lru_cache(maxsize=2)
def load_pieces(path: str) -> dict[str, float]:
    """Pieces and their scores, in the vocabulary's order; control and byte pieces are left out."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    mass = math.log(sum(1 / (r + RANK_OFFSET) for r in range(len(pieces))))
    return {p: -math.log(r + RANK_OFFSET) - mass for r, p in enumerate(pieces)}


class TokenTrie:
    """A trie of pre-tokens walked depth first.  A node is (best score, token count, partial pieces that end here with
    what came before them); ``path`` are the nodes of the last word's prefixes."""

    def __init__(self, pieces: dict[str, float]):
        self.vocabulary: dict = {}
        for piece, score in pieces.items():
            at = self.vocabulary
            for c in piece:
                at = at.setdefault(c, {})
            at[""] = score
        self.unknown = min(pieces.values(), default=0.0) - UNKNOWN
        self.clear()

    def clear(self) -> None:
        self.word, self.path, self.nodes = "", [(0.0, 0, ())], 0

    def _next(self, before: tuple, c: str) -> tuple:
        """The node of one more character: all pieces that end with it, or the character as bytes."""
        best, tokens = -math.inf, 0
        score0, tokens0, partial = before
        active = []
        here = self.vocabulary.get(c)
        if here is not None:
            active.append((here, score0, tokens0))
            if "" in here:
                best, tokens = score0 + here[""], tokens0 + 1
        if best == -math.inf:
            size = len(c.encode("utf-8", "surrogatepass"))
            best, tokens = score0 + size * self.unknown, tokens0 + size
        for at, score, n in partial:
            at = at.get(c)
            if at is not None:
                active.append((at, score, n))
                piece = at.get("")
                if piece is not None and (score + piece > best or (score + piece == best and n + 1 < tokens)):
                    best, tokens = score + piece, n + 1
        return best, tokens, active

    def count(self, token: str) -> int:
        """Tokens of a pre-token; what it shares with the one before is not computed again."""
        same = 0
        for a, b in zip(token, self.word, strict=False):
            if a != b:
                break
            same += 1
        path = self.path
        same = min(same, len(path) - 1)
        del path[same + 1 :]
        node = path[same]
        for depth, c in enumerate(token[same:] if same else token, same + 1):
            node = self._next(node, c)
            self.nodes += 1
            if depth <= KEEP:
                path.append(node)
        self.word = token
        return node[1]


def _weight(word: str) -> int:
    """Bytes of a word and its place in a table, at most."""
    return 150 + 4 * len(word)


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pre-tokens that a stretch of text has more than once and how often, in bounded memory."""
    found: Counter = Counter()

    def some() -> pa.RecordBatch:
        rows = [(w, n) for w, n in found.items() if n > 1 and len(w) <= OFTEN_BYTES]
        return pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], names=["word", "n"])

    for batch in batches:
        for text in batch.column("text").to_pylist():
            if text:
                words = text.split()
                # longer ones aren't handed on, and mustn't be held
                found.update(words if len(max(words, key=len, default="")) <= OFTEN_BYTES else [w for w in words if len(w) <= OFTEN_BYTES])
            if len(found) >= HELD:
                yield some()
                found.clear()
    yield some()


def frequent_counts(docs: DataFrame, scratch: Scratch, path: str) -> dict[str, int]:
    """Token counts of the most frequent pre-tokens; at most ``OFTEN`` words of ``OFTEN_BYTES`` bytes reach the driver."""
    found = docs.select("text").mapInArrow(tidy(_repeated), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    found = scratch.keep(found.where(F.octet_length("word") <= OFTEN_BYTES).withColumn("step", F.floor(STEPS * F.log2("n")).cast("int")), "words")
    least, total = 0, 0
    for r in found.groupBy("step").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("step")).collect():  # 64 * STEPS rows at most
        least, total = r["step"], total + r["n"]
        if total > OFTEN:
            least, total = least + 1, total - r["n"]
            break

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = TokenTrie(load_pieces(path))
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array([trie.count(MARK + w) for w in batch.column("word").to_pylist()], pa.int64())], names=["word", "tokens"])

    ranged = found.where(F.col("step") >= least).select("word").repartitionByRange(max(1, -(-total // SCORED)), "word").sortWithinPartitions("word")
    rows = ranged.mapInArrow(tidy(score), "word string, tokens long").collect()
    scratch.drop("words")
    return {r[0]: r[1] for r in rows}


def count_tokens(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, n_pretokens, n_tokens of every whole text.

    A null text is empty; an empty or blank one has no tokens.  Rows are independent: repeated rows, null ids and
    extra columns need no care, and an empty table gives an empty result.
    """
    spark = docs.sparkSession
    ship_package(spark)
    path = vocabulary or public_pieces()
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    shared = spark.sparkContext.broadcast(frequent_counts(source, Scratch(spark, "tokens"), path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, trie = shared.value, TokenTrie(load_pieces(path))
        rare, held = {}, 0  # and its bytes
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts = part.column("text").to_pylist()
                found = [Counter((t or "").split()) for t in texts]
                new = set().union(*found)
                new.difference_update(often, rare)
                held += sum(map(_weight, new))
                if held > KNOWN:
                    new.update(w for f in found for w in f if w in rare)
                    rare.clear()
                    held = sum(map(_weight, new))
                for w in sorted(new):
                    rare[w] = trie.count(MARK + w)
                count = lambda w: often[w] if w in often else rare[w]
                columns = [[len(t or "") for t in texts], [f.total() for f in found], [sum(n * count(w) for w, n in f.items()) for f in found]]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns)], names=["doc_id", "n_chars", "n_pretokens", "n_tokens"])

    return source.mapInArrow(tidy(run), f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_chars long, n_pretokens long, n_tokens long")
